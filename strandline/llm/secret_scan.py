"""Secret scans with a random forest that removes false positives.

Candidates are values assigned with ``=`` or ``:`` and long runs of key characters that
hold a digit, whole whatever their length. Each gets features of its length, character classes and transitions,
dictionary coverage, its path (the document's source) and the words before and after it.
A random forest trained on labelled findings scores them; a finding is a candidate with
at least half of the votes.

The forest is trained here, in NumPy, on at most ``MAX_TRAIN`` labelled rows (those with
the lowest hash of their content, where there are more). Without labelled findings of
one's own, ``synthetic_findings`` makes a labelled set from rules and a seed.

Defined results: null texts have no candidates, a null path is empty; repeated rows each
give their findings; offsets count code points; texts of any length are searched whole;
an empty table gives none. A score of exactly one half is a secret. Only the id, the text
and the path are read, so other columns do not matter; null ids are carried along.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import prepare

MAX_TRAIN = 20_000
CONTEXT = 40

_ASSIGNED = re.compile(r"[=:][\x20\t]*[\"'`]?([^\s\"'`,;<>(){}|]{8,})")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{20,}(?![A-Za-z0-9_+/=.-])")
_WORD = re.compile(r"[a-z]+")

CUE_WORDS = frozenset("token secret password passwd pwd key apikey auth authorization bearer credential credentials private access signing".split())
PLAIN_WORDS = frozenset("commit sha sha256 sha512 md5 checksum digest hash uuid guid id revision version integrity etag build ref url href src path file image page".split())
PATH_WORDS = frozenset("test tests testing spec fixture fixtures mock example examples sample docs doc readme demo".split())
#: Dictionary for coverage; words are matched inside the candidate's letters.
DICTIONARY = tuple(
    "access account address admin application attribute author base book build button cache change changeme class client code column comment common config content count create "
    "data date default delete demo description design detail dummy element email error event example false field file filter find first folder font form format function group "
    "header here host html http image index info input insert item json label language last library license line link list local login manager menu message method model module "
    "name network node number object option order page param parent password path placeholder plugin policy port position post price private process product profile project public "
    "query read record release remote report request resource response result root sample search secret section select server service session setting source start state status "
    "string style submit table target template test text time title token true type update upload user value version view width window word write your".split()
)
_DICT = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
FEATURES = ("length", "digit_share", "upper_share", "symbol_share", "hex", "class_changes", "vowel_share", "entropy", "distinct_share", "dictionary", "repeat", "cue_before", "plain_before", "cue_after", "plain_path", "assigned", "uuid", "known_prefix")
_PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abps]-|sk-|pk_live_|sk_live_|eyJ|AIza)")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned), by start; a run inside an assigned value is not repeated."""
    out = [(m.start(1), m.end(1), True) for m in _ASSIGNED.finditer(text)]
    taken = sorted(out)
    i = 0
    for m in _RUN.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not (i < len(taken) and taken[i][0] < e) and any(c.isdigit() for c in m.group()):
            out.append((s, e, False))
    return sorted(out)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def describe(value: str, before: str, after: str, path: str, assigned: bool) -> list[float]:
    """The features of one candidate, in the order of ``FEATURES``."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    count = Counter(value)
    letters = [c for c in value.lower() if c.isalpha()]
    near = _WORD.findall(before.lower())[-4:]
    nxt = _WORD.findall(after.lower())[:3]
    covered = sum(len(m) for m in _DICT.findall(value.lower()))
    return [
        min(n, 200),
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        -sum(v / n * math.log2(v / n) for v in count.values()),
        len(count) / n,
        covered / max(1, len(letters)),
        max(count.values()) / n,
        float(any(w in CUE_WORDS for w in near)),
        float(any(w in PLAIN_WORDS for w in near)),
        float(any(w in CUE_WORDS for w in nxt)),
        float(any(w in PATH_WORDS for w in _WORD.findall(path.lower()))),
        float(assigned),
        float(bool(_UUID.match(value))),
        float(bool(_PREFIX.match(value))),
    ]


class Forest:
    """A random forest for two classes over dense features; arrays only, so it ships easily."""

    def __init__(self, trees: int = 40, depth: int = 10, leaf: int = 2, seed: int = 7):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows].astype(float), 0, rng, nodes)
            self.nodes.append(np.array(nodes))
        return self

    def _grow(self, x, y, level, rng, nodes) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y.mean() if len(y) else 0.5])
        if level >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = (0.0, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= self.leaf) & (cut <= len(y) - self.leaf)]
            if not len(cut):
                continue
            left, right = s[cut - 1] / cut, (s[-1] - s[cut - 1]) / (len(y) - cut)
            gain = whole - (cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)) / len(y)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), int(f), float((v[cut[i] - 1] + v[cut[i]]) / 2))
        if best[1] < 0:
            return at
        low = x[:, best[1]] <= best[2]
        nodes[at][:2] = best[1], best[2]
        nodes[at][2] = self._grow(x[low], y[low], level + 1, rng, nodes)
        nodes[at][3] = self._grow(x[~low], y[~low], level + 1, rng, nodes)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean vote for the positive class."""
        total = np.zeros(len(x))
        for nodes in self.nodes:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = nodes[at, 0].astype(int)
                inner = f >= 0
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(low, nodes[at, 2], nodes[at, 3]).astype(int), at)
            total += nodes[at, 4]
        return total / len(self.nodes)


Finding = tuple[str, str, str, str, bool, int]


def synthetic_findings(n: int = 3000, seed: int = 11) -> list[Finding]:
    """(value, before, after, path, assigned, label) rows made by rules, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    text = lambda alphabet, size: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), size))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, alnum = digits + "abcdef", low + low.upper() + digits
    syllables = ["er", "in", "th", "on", "re", "st", "ti", "an", "ou", "le", "en", "ge", "ch", "os", "que", "ment", "al", "ta"]
    prose = lambda: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(4))
    cue = lambda: pick(["token", "secret", "password", "api key", "api_key", "access_key", "auth", "client secret", "private key", "TOKEN", "PASSWORD"])
    paths, plain_paths = ["src0", "src7", "src/app/config.py", ".env", "deploy/settings.yaml", "web/main.js"], ["tests/test_login.py", "docs/readme.md", "examples/demo.py", "spec/fixtures/a.json"]
    rows: list[Finding] = []
    for i in range(n):
        path = pick(paths) if rng.random() < 0.8 else pick(plain_paths)
        before, after = prose() + " ", " " + prose()
        if i % 2 == 0:
            kind = int(rng.integers(5))
            value = [text(hexa, pick([32, 40, 64])), text(alnum, int(rng.integers(20, 60))), pick(["AKIA", "ghp_", "sk_live_"]) + text(alnum, int(rng.integers(16, 36))), text(alnum + "!$%&*+-_", int(rng.integers(10, 24))), text(alnum + "+/", 43) + "="][kind]
            if rng.random() < 0.15:
                value = value.upper()
            assigned = kind != 2 or bool(rng.random() < 0.5)
            if assigned:
                before += cue() + pick([" = ", ": ", "=", ' = "', " := '"])
            rows.append((value, before, after, path, assigned, 1))
            continue
        kind = int(rng.integers(8))
        word = lambda: pick(DICTIONARY)
        if kind == 0:
            value, before, assigned = text(hexa, pick([32, 40, 64])), before + pick(["commit ", "sha256 ", "md5 checksum ", "digest ", "revision "]), False
        elif kind == 1:
            value, before, assigned = text(hexa, pick([32, 40, 64])), before + pick(["commit: ", "sha256=", "checksum: ", "etag = ", "integrity=", "build: "]), True
        elif kind == 2:
            h = text(hexa, 32)
            value, assigned = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", bool(rng.random() < 0.5)
            before += pick(["id = ", "uuid: "]) if assigned else ""
        elif kind == 3:
            value, assigned = pick(["your_", "my-", "example_", "test_", "sample-"]) + word() + pick(["_", "-"]) + word() + pick(["_here", "", "1", "123"]), True
            before += cue() + pick([" = ", ": "])
        elif kind == 4:
            value, assigned = "_".join(word() for _ in range(int(rng.integers(3, 6)))) + pick(["", "2", "_1"]), bool(rng.random() < 0.5)
        elif kind == 5:
            value, assigned = pick("xX*0a1") * int(rng.integers(8, 40)), True
            before += cue() + " = "
        elif kind == 6:
            value, assigned = "//" + "".join(pick(syllables) for _ in range(3)) + ".example.com/" + word() + "/" + text(digits, 3), True
            before += pick(["http:", "https:", "see "])
        else:
            value, assigned = "".join(pick(syllables) for _ in range(int(rng.integers(4, 12)))) + pick(["", ".", "12"]), bool(rng.random() < 0.7)
            before += pick(["note: ", "type = ", "name: ", ""])
        rows.append((value, before, after, path, assigned, 0))
    return rows


def train(findings: Iterable[Finding], seed: int = 7) -> Forest:
    rows = list(findings)
    if len(rows) > MAX_TRAIN:
        rows = sorted(rows, key=lambda r: hashlib.md5("\0".join(map(str, r)).encode()).digest())[:MAX_TRAIN]
    x = np.array([describe(v, b[-CONTEXT:], a[:CONTEXT], p, s) for v, b, a, p, s, _ in rows])
    return Forest(seed=seed).fit(x, np.array([r[5] for r in rows]))


def train_from(labelled: DataFrame, seed: int = 7) -> Forest:
    """From columns value, before, after, path, assigned, label; at most ``MAX_TRAIN`` rows are taken."""
    cols = ["value", "before", "after", "path", "assigned", "label"]
    rows = labelled.select(*cols).dropna().orderBy(F.xxhash64(*cols)).limit(MAX_TRAIN)
    return train(tuple(r) for r in rows.collect() if r[0])


def scan(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, start, end, value, assigned, score, is_secret) of every candidate."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(forest)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("assigned", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, end, value, assigned, rows = [], [], [], [], [], []
            for i, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for s, e, a in candidates(t or ""):
                    owner.append(i)
                    start.append(s)
                    end.append(e)
                    value.append(t[s:e])
                    assigned.append(a)
                    rows.append(describe(t[s:e], t[max(0, s - CONTEXT) : s], t[e : e + CONTEXT], p or "", a))
            score = shared.value.score(np.array(rows)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.string()), pa.array(assigned, pa.bool_()), pa.array(score, pa.float64())], schema.fieldNames()
            )

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path")).mapInArrow(run, schema)
    return found.withColumn("is_secret", F.col("score") >= 0.5)


def op5_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs, train(synthetic_findings()))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
