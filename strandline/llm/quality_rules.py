"""Quality rules with cross-document line frequency.

Base rules look at one document: too few words, or too many words inside repeated
8-word windows. The method then hashes normalised lines (ASCII lower case, digits as 0,
single blanks), counts in how many distinct documents of a host each occurs, removes the
lines above the limit, and rejects documents of which too little is left.

A line is above the limit when it occurs in more than ``min_docs`` distinct texts of its
host and in more than ``share`` of them. A document is depleted when removal leaves
fewer than ``min_words`` words or less than ``min_left`` of its words. Exact copies count
as one document, so a copied document does not deplete itself.

Defined results: null text counts as no words and fails; a null host is a host of its own;
a line that stands exactly at a limit stays, as does a document. Repeated rows are judged
each. Texts of any length are read whole; an empty table gives an empty one. Columns named
like a result give way to it in ``judge`` and are kept in ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .storage import Scratch
from .wordhash import _SPACE, BASE_B, U, Words, mix

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MIN_DOCS, SHARE, MIN_LEFT = 20, 0.1, 0.3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_PRIVATE = {"__host": T.StringType(), "__digest": T.BinaryType(), "__lines": T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.IntegerType())]))}


def line_key(line: bytes) -> tuple[int, int]:
    """Hash of the normalised line and its number of words."""
    words = line.translate(_FOLD).split()
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True), len(words)


def features(raw: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text."""
    lens = np.array([len(r) for r in raw], dtype=np.int64)
    start = np.cumsum(lens + 1) - lens - 1
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    w = Words(buf, start)
    sums = lambda flag: np.add.reduceat(flag, start, dtype=np.int64)
    at = np.flatnonzero(w.left() >= REPEAT_WINDOW)
    key = mix(w.windows(REPEAT_WINDOW, at) + w.text_of[at].astype(U) * BASE_B)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(w.n + 1, dtype=np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return {
        "n_words": w.n_words,
        "word_chars": sums(~_SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": sums(_SYMBOL[buf]),
        "n_repeat_words": np.bincount(w.text_of[covered], minlength=len(raw)),
    }


def measure(docs: DataFrame, text: str, host: str) -> DataFrame:
    """``docs`` without text, with the features, host, text digest and hashed lines."""
    own = [c for c in docs.columns if c != text and c not in FEATURES and c not in _PRIVATE]
    docs = docs.select(*own, F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("__host"), F.col(text).cast("binary").alias("__raw"))
    schema = docs.drop("__raw").schema
    for name in FEATURES:
        schema = schema.add(name, T.LongType())
    for name in ("__digest", "__lines"):
        schema = schema.add(name, _PRIVATE[name])
    for f in schema.fields:
        f.nullable = True
    kept = len(own) + 1
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [r or b"" for r in batch.column(kept).to_pylist()]
            f = features(raw)
            dup, lines = [], []
            for r in raw:
                n, all_lines = 0, set()
                count: dict[int, int] = {}
                for line in r.split(b"\n"):
                    if not line.split(None, 1):
                        continue
                    n += line in all_lines
                    all_lines.add(line)
                    k, size = line_key(line)
                    count[k] = count.get(k, 0) + size
                dup.append(n)
                lines.append([{"line": k, "words": v} for k, v in count.items()])
            f["n_dup_lines"] = np.array(dup)
            cols = [*(batch.column(i) for i in range(kept)), *(pa.array(f[name], pa.int64()) for name in FEATURES), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array(lines, kind)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:kept], *FEATURES, "__digest", "__lines"])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, text: str = "text", host: str = "source", scratch: Scratch | None = None, min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """``docs`` without text, with the features, base_failed, n_line_words (words in removed
    lines), ``__hot`` (hashes of the removed lines) and kept."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    table = scratch.table(measure(docs, text, host), "features")
    # copies of a text within a host are one document
    lines = table.select("__host", "__digest", F.explode("__lines").alias("l")).select("__host", "__digest", F.col("l.line").alias("line"), F.col("l.words").alias("words")).distinct()
    hosts = table.select("__host", "__digest").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("docs"))
    counts = lines.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    hot = scratch.table(counts.join(hosts, "__host").where(F.col("n") > F.col("docs") * share).select("__host", "line"), "hot")
    lost = lines.join(hot, ["__host", "line"]).groupBy("__host", "__digest").agg(F.sum("words").alias("n_line_words"), F.collect_set("line").alias("__hot"))
    out = table.drop("__lines", "n_line_words", "__hot").join(lost, ["__host", "__digest"], "left")
    left = F.col("n_words") - F.coalesce("n_line_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_line_words").isNotNull() & ((left < MIN_WORDS) | (left < F.col("n_words") * min_left))
    return out.withColumns({"n_line_words": F.coalesce("n_line_words", F.lit(0)).cast("long"), "base_failed": failed, "kept": ~failed & ~depleted})


def clean(docs: DataFrame, text: str = "text", host: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The documents that are kept, without their removed lines; columns as in ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    verdict = judge(docs.select(text, host), text, host, scratch).where("kept").select(F.col("__host").alias("__h"), F.col("__digest").alias("__d"), F.col("__hot").alias("__x")).dropDuplicates(["__h", "__d"])
    keyed = docs.withColumns({"__host": F.coalesce(F.col(host).cast("string"), F.lit("\0")), "__digest": tb.text_key(text)})
    joined = keyed.join(verdict, (F.col("__host") == F.col("__h")) & (F.col("__digest") == F.col("__d"))).drop("__host", "__digest", "__h", "__d")
    at, names = docs.columns.index(text), docs.columns
    schema = docs.schema
    for f in schema.fields:
        f.nullable = True

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column(len(names)).to_pylist()
            cols = [batch.column(i) for i in range(len(names))]
            if any(hot):
                texts = cols[at].to_pylist()
                for i, h in enumerate(hot):
                    if h:
                        h = set(h)
                        texts[i] = "\n".join(x for x in texts[i].split("\n") if line_key(x.encode())[0] not in h)
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.select(*names, "__x").mapInArrow(strip, schema)


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS seq FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, md5(seq)) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r
), line AS (
  SELECT r, host, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d)
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM line WHERE len(lw) > 0 GROUP BY r
), norm AS (
  SELECT r, host, t, array_to_string(lw, ' ') AS k, len(lw) AS n FROM line WHERE len(lw) > 0
), hosts AS (
  SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host
), hot AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT t) AS n FROM norm GROUP BY host, k) JOIN hosts USING (host) WHERE n > 20 AND n > docs * 0.1
), lost AS (
  SELECT r, sum(n) AS n FROM norm JOIN hot USING (host, k) GROUP BY r
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, lost.n AS lost
  FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT coalesce(n_words - lost < 20 OR n_words - lost < n_words * 0.3, false) AS kept
FROM f
"""
