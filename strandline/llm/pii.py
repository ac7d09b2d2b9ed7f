"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs,
digits, URL schemes and identifier cues. From each anchor a deterministic local parser
expands to the boundaries of an email address, IP address, card or phone number
(``BASE`` kinds), and of an address with credentials or an IP host or the number of a
``tel:`` link, an IBAN, or an account or passport number behind its cue (added kinds), and
validates what it found. Schemes and cues are found in any ASCII case. An IBAN without its
cue must be in upper case and have its country's length.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped, no retries:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

A social security number behind its cue is an account with an area, group and serial that
are given out; an address in brackets is an IPv6 address.

Defined results: null and empty texts have no spans; texts of any length are searched whole;
repeated rows give their spans each; an empty table gives an empty one. Overlapping spans
of different kinds stay; of one start, the kinds come in the order of ``KINDS``. Other
columns are carried along unchanged, one named ``pii_spans`` gives way to the result.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import prepare

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "iban", "account")
KINDS = BASE + ADDED

#: Identifier cues in lower case; found in any case.
CUES = ("account number", "account no", "account:", "acct", "customer number", "customer id", "passport no", "passport number")
_SSN_CUES = ("ssn", "social security number")
#: The address behind ``mailto:`` is found by its at-sign.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
_IBAN_CUE = "iban"
#: Length of an IBAN by country.
_IBAN_SIZE = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 "
    "KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}  # fmt: skip
_LOWER = {i: i + 32 for i in range(65, 91)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_URL_USER = re.compile(r"(?:https?|ftp|sftp|ssh)://([A-Za-z0-9._~%!$&'()*+,;=:-]+@)?(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::[0-9]{1,5})?(?:/[^\s\"'<>|]*)?", re.I)
_IBAN = re.compile(r"[\x20:.#=-]{0,4}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})")
_ACCOUNT = re.compile(r"[\x20:.#=-]{0,4}(?:is\x20)?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
_PASSPORT = re.compile(r"[\x20:.#=-]{1,4}(?:is\x20)?((?:[A-Z]{1,2}\x20)?(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,12})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20:.#=-]{0,4}(?:is\x20)?([0-9]{3}([\x20-]?)[0-9]{2}\2[0-9]{4})(?![0-9])")
_TEL = re.compile(r"([0-9(][0-9().-]*[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The address around the at-sign; nothing before ``low`` belongs to it."""
    s = at
    while s > low and text[s - 1] in _LOCAL:
        s -= 1
    m = _DOMAIN.match(text, at + 1) if s < at else None
    return (s, m.end()) if m else None


def _ips(chain: re.Match) -> Iterator[tuple[int, int]]:
    runs = [(m.start(), m.end()) for m in _RUN.finditer(chain.string, chain.start(), chain.end())]
    for i in range(0, len(runs) - 3, 4):
        quad = runs[i : i + 4]
        if all(e - s <= 3 or not chain.string[s : e - 3].strip("0") for s, e in quad) and all(int(chain.string[max(s, e - 3) : e]) <= 255 for s, e in quad):
            yield quad[0][0], quad[3][1]


def _iban(text: str, end_of_cue: int) -> tuple[int, int] | None:
    m = _IBAN.match(text, end_of_cue)
    if m:  # the longest prefix that validates, so that following words are left out
        for e in range(m.end(1), m.start(1) + 14, -1):
            if text[e - 1] != " " and (e == len(text) or not text[e].isalnum()) and iban_ok(text[m.start(1) : e]):
                return m.start(1), e
    return None


def _bare_iban(text: str, at: int) -> tuple[int, int] | None:
    """The IBAN whose first digit is at ``at``, without a cue."""
    s, left = at - 2, _IBAN_SIZE.get(text[at - 2 : at], 0)
    if not left or (s and text[s - 1].isalnum()):
        return None
    e = s
    while left and e < len(text):
        if "0" <= text[e] <= "9" or "A" <= text[e] <= "Z":
            left -= 1
        elif text[e] != " " or text[e - 1] == " ":
            return None
        e += 1
    body = text[s:e]
    return None if left or (e < len(text) and text[e].isalnum()) or not body.replace(" ", "")[2:4].isdigit() or not iban_ok(body) else (s, e)


def _account(text: str, end_of_cue: int, passport: bool) -> tuple[int, int] | None:
    found = [m.span(1) for p in ((_ACCOUNT, _PASSPORT) if passport else (_ACCOUNT,)) if (m := p.match(text, end_of_cue))]
    return max(found, key=lambda x: x[1], default=None)


def _ssn(text: str, end_of_cue: int) -> tuple[int, int] | None:
    """Three, two and four digits, none of them zeros only, in an area that is given out."""
    m = _SSN.match(text, end_of_cue)
    digits = "".join(c for c in m.group(1) if c.isdigit()) if m else ""
    return m.span(1) if m and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else None


def _ip_host(host: str) -> bool:
    """An IPv4 address, or an IPv6 address in brackets."""
    try:
        return ipaddress.IPv6Address(host[1:-1]) is not None if host[0] == "[" else ipaddress.IPv4Address(host) is not None
    except ValueError:
        return False


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    a.add_word("tel:", ("tel", 4))
    for c in CUES:
        a.add_word(c, ("passport" if c.startswith("passport") else "cue", len(c)))
    for c in _SSN_CUES:
        a.add_word(c, ("ssn", len(c)))
    a.add_word(_IBAN_CUE, ("iban", 4))
    a.make_automaton()
    return a


_AUTOMATON = None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in ``KINDS``."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = automaton()
    out: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    folded = text.lower() if text.isascii() else text.translate(_LOWER)
    for last, (what, size) in _AUTOMATON.iter(folded):
        at = last - size + 1
        if what == "digit":
            if at > 1 and at - 2 >= account_end and "A" <= text[at - 1] <= "Z" and (span := _bare_iban(text, at)):
                out.append(("iban", *span))
                account_end = span[1]
            if at >= ip_end:
                chain = _IP_CHAIN.match(text, at)
                ip_end = chain.end()
                if ip_end - at > 6:
                    out += (("ip", s, e) for s, e in _ips(chain))
            if at >= card_end:
                m = _CARD_CHAIN.match(text, at)
                card_end = m.end()
                if card_end - at >= 14:
                    digits = "".join(c for c in m.group() if c not in " -")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card_end))
        elif what == "at":
            if at >= email_end and (span := _email(text, at, email_end)):
                out.append(("email", *span))
                email_end = span[1]
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", at, phone_end))
        elif what == "scheme":
            if at >= url_end and (m := _URL_USER.match(text, at)):
                url_end = m.end()
                if (m.group(1) and (m.group(2)[0] != "[" or _ip_host(m.group(2)))) or _ip_host(m.group(2)):
                    out.append(("address", at, url_end))
        elif what == "iban":
            if last + 1 >= account_end and (span := _iban(text, last + 1)):
                out.append(("iban", *span))
                account_end = span[1]
        elif what == "tel":
            if not (at and text[at - 1].isalnum()) and (m := _TEL.match(text, last + 1)) and 7 <= sum(c.isdigit() for c in m.group(1)) <= 15:
                out.append(("address", *m.span(1)))
        elif what == "ssn":
            if last + 1 >= account_end and not (at and text[at - 1].isalnum()) and (span := _ssn(text, last + 1)):
                out.append(("account", *span))
                account_end = span[1]
        elif last + 1 >= account_end and not (at and text[at - 1].isalnum()) and (span := _account(text, last + 1, what == "passport")):
            out.append(("account", *span))
            account_end = span[1]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, text: str = "text", masked: str | None = None) -> DataFrame:
    """``docs`` with ``pii_spans``; with ``masked``, also that column holding the masked text.

    ``masked`` may name the text column itself, which then is replaced in place.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("pii_spans")
    if masked and masked != text:
        docs = docs.drop(masked)
    names = docs.columns
    at = names.index(text)
    schema = docs.withColumn("pii_spans", F.lit(None).cast(SPAN)).schema
    if masked and masked != text:
        schema = schema.add(masked, T.StringType())
    for f in schema.fields:
        f.nullable = True
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [find(t) if t else [] for t in texts]
            cols = [batch.column(i) for i in range(batch.num_columns)]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind)
            if masked:
                clean = pa.array([mask(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
                if masked == text:
                    cols[at] = clean
                else:
                    yield pa.RecordBatch.from_arrays([*cols, spans, clean], [*names, "pii_spans", masked])
                    continue
            yield pa.RecordBatch.from_arrays([*cols, spans], [*names, "pii_spans"])

    return docs.mapInArrow(run, schema)


def span_text(spans):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("pii_spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *(count(k) for k in BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))
