"""Periodic runs of words: stretches that repeat one block of words at least four times.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) and length at least ``max(min_length, min_exponent * q)`` that no neighbouring word
extends. So at lag q it has ``length - q`` matches in a row. For every lag the matches of
a text are counted first, by two ways that add up to the exact number:

* frequent words by autocorrelation: the power spectra of their indicator sequences are
  added and transformed back once, each count rounded to the integer it is;
* rare words by the differences of their positions, all texts of a batch at once.

Only lags with enough matches are scanned for islands of consecutive matches. Lags go up,
and a run that is found takes its matches off all multiples of its period (there it is the
same maximal stretch), so a text that repeats one block throughout is not scanned again at
each multiple. An island of m matches in a row holds m // s of any points s apart, so a
scan looks at every s-th word first and at all words only where those match: all lags
together cost about n log n words, not n * n.

Defined results: null and empty texts have no run and an empty remainder; a word is what
stands between blanks (\\x20, \\x09-\\x0D), compared by its bytes. Where stretches of
several periods overlap, each is a run of its own; the same stretch counts once, with its
smallest period. Repeated rows are judged each; texts of any length are read whole; an
empty table gives an empty one. Other columns are carried along, those named like a result
give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import prepare

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Points that a first look takes within the shortest run of a lag.
LOOKS = 8
#: Squared frequencies that are added before transforming back: the error stays far below 1/2.
EXACT = 1 << 44
#: Words of texts whose positions are compared at once.
CHUNK = 1 << 18
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def _frequent(n: np.ndarray) -> np.ndarray:
    """Occurrences from which the transform is cheaper than pairs of positions."""
    return np.maximum(16, 2 * np.sqrt(n))


def _smooth(n: int) -> int:
    """The least length of at least ``n`` with factors 2, 3 and 5 only."""
    best = 1 << (n - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            size = three << max(0, (-(-n // three) - 1).bit_length())
            best = min(best, size)
            three *= 3
        five *= 5
    return best


def _by_transform(x: np.ndarray, words: np.ndarray, often: np.ndarray, lags: int) -> tuple[np.ndarray, int]:
    """Matches at lags 1 .. ``lags`` of the given words, and by how much they may be too low."""
    size = _smooth(len(x) + lags)
    total, slack, power, held = np.zeros(lags, dtype=np.int64), 0, np.zeros(size // 2 + 1), 0

    def flush():
        nonlocal total, power, slack
        total += np.rint(np.fft.irfft(power, size)[1 : lags + 1]).astype(np.int64)
        slack += held // 10**14
        power = np.zeros(size // 2 + 1)

    for w, c in zip(words.tolist(), often.tolist(), strict=True):
        spectrum = np.fft.rfft((x == w).astype(np.float64), size)
        power += spectrum.real**2 + spectrum.imag**2
        held += c * c
        if held > EXACT:
            flush()
            held = 0
    flush()
    return total, slack


def lag_matches(texts: list[np.ndarray], lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of each text at lags 1 .. ``lags`` one after the other, where each text begins,
    and by how much its counts may be too low. Texts are arrays of word numbers from 0 on."""
    n = np.array([len(x) for x in texts], dtype=np.int64)
    at = np.cumsum(lags) - lags
    counts, slack = np.zeros(int(lags.sum()), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    kinds = np.array([int(x.max()) + 1 if len(x) else 0 for x in texts], dtype=np.int64)
    base = np.cumsum(kinds) - kinds
    word = np.concatenate(texts) + np.repeat(base, n) if len(texts) else np.zeros(0, dtype=np.int64)
    text_of = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    often = np.bincount(word, minlength=int(kinds.sum()))
    frequent = often > _frequent(np.repeat(n, kinds))
    for w in np.unique(np.repeat(np.arange(len(texts)), kinds)[frequent]).tolist():
        own = np.flatnonzero(frequent[base[w] : base[w] + kinds[w]])
        if lags[w]:
            found, slack[w] = _by_transform(texts[w], own, often[base[w] + own], int(lags[w]))
            counts[at[w] : at[w] + lags[w]] += found
    order = np.argsort(word, kind="stable")
    order = order[~frequent[word[order]]]
    word, pos, text_of = word[order], pos[order], text_of[order]
    room, place = lags[text_of], at[text_of] - 1
    alive, step = np.arange(len(word)), 0
    while len(alive):  # the next occurrence, the one after it, ... as long as it is near enough
        step += 1
        alive = alive[alive + step < len(word)]
        far = pos[alive + step] - pos[alive]
        near = (word[alive + step] == word[alive]) & (far <= room[alive])
        alive = alive[near]
        np.add(counts, np.bincount(place[alive] + far[near], minlength=len(counts)), out=counts)
    return counts, at, slack


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of at least ``least`` true values in a row."""
    edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def scan_lag(x: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches with at least ``least`` matches in a row at lag ``q``."""
    step = max(1, least // LOOKS)
    start, end = _islands(x[:-q:step] == x[q::step], least // step)
    if step == 1:
        return [(a, b - a + q) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    out = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        lo, hi = max(0, (a - 1) * step + 1), min(len(x) - q, b * step)
        for s, e in zip(*(v.tolist() for v in _islands(x[lo:hi] == x[lo + q : hi + q], least)), strict=True):
            out.append((lo + s, e - s + q))
    return out


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    lags = np.array([len(x) // min_exponent for x in texts], dtype=np.int64)
    counts, at, slack = lag_matches(texts, lags)
    period = np.arange(len(counts)) - np.repeat(at, lags) + 1
    enough = np.maximum(min_length, min_exponent * period) - period
    may = np.flatnonzero(counts + np.repeat(slack, lags) >= np.maximum(enough, 1))
    first = np.searchsorted(may, np.append(at, len(counts)))
    out = []
    for t, x in enumerate(texts):
        found: dict[tuple[int, int], int] = {}
        lo, top = int(at[t]), int(lags[t])
        for i in may[first[t] : first[t + 1]].tolist():
            q, least = i - lo + 1, max(int(enough[i]), 1)
            if counts[i] + slack[t] < least:
                continue  # all of them lie in runs that are known
            for start, length in scan_lag(x, q, least):
                if (start, length) not in found:
                    found[start, length] = q
                    more = np.arange(2 * q, min(length - 1, top) + 1, q)
                    counts[lo + more - 1] -= length - more
        out.append(sorted((s, n, q) for (s, n), q in found.items()))
        out[-1].sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that stay: of each run its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period in words) and ``collapsed``, which
    replaces the text: its words but for the repetitions, with one blank between."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    prepare(docs.sparkSession)
    names = ["n_words", "runs", "collapsed"]
    kept = [c for c in docs.columns if c != text and c.lower() not in names]
    docs = docs.select(*kept, F.col(text).cast("binary").alias("__raw"))
    schema = T.StructType([*docs.drop("__raw").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    for f in schema.fields:
        f.nullable = True
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(words: list[list[bytes]]) -> tuple[list, list]:
        texts = []
        for own in words:
            number: dict[bytes, int] = {}
            texts.append(np.array([number.setdefault(w, len(number)) for w in own], dtype=np.int64))
        runs, rest = runs_of(texts, min_length, min_exponent), []
        for own, found in zip(words, runs, strict=True):
            rest.append(b" ".join([own[i] for i in np.flatnonzero(collapse(len(own), found)).tolist()] if found else own))
        return runs, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(r or b"").split() for r in batch.column(len(kept)).to_pylist()]
            runs, rest, held, size = [], [], [], 0
            for i, own in enumerate(words):
                held.append(own)
                size += len(own)
                if size >= CHUNK or i == len(words) - 1:
                    found = work(held)
                    runs, rest, held, size = runs + found[0], rest + found[1], [], 0
            lists = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(rest, pa.binary()).cast(pa.string())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which a tenth of the texts, by the checksum of the id, repeat a block of
    their words from some word on (the query's contract)."""
    h = F.crc32(F.col(doc_id).cast("string"))
    words = docs.withColumn("__w", F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(h / 10), F.size("__w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice("__w", F.lit(1), a), tail), " ")
    return words.withColumn(text, F.when((h % 10 == 0) & (F.size("__w") > 0), made).otherwise(F.col(text))).drop("__w")


def op12_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_runs(planted(docs))
    # by start, then period: the first of the greatest stays
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    out = found.withColumns({"b": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) AS h
  FROM documents
), a AS (
  SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS made, (h // 10) % greatest(len(w), 1) AS a FROM c
), d AS (
  SELECT r, doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a
), o AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM d
), pair AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT r, start, length, min(q) AS period FROM island GROUP BY r, start, length
), best AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    max(length::DECIMAL(38, 0) * 1000000000000 // period) AS top FROM run GROUP BY r
), one AS (
  SELECT r, start, length, period FROM (SELECT run.*, row_number() OVER (PARTITION BY r ORDER BY start, period) AS k
    FROM run JOIN best USING (r) WHERE run.length::DECIMAL(38, 0) * 1000000000000 // run.period = best.top) WHERE k = 1
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), rest AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM o ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN one USING (r) LEFT JOIN rest USING (r)
"""
