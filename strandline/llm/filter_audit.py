"""Filter interaction audit: what each filter removes, in every order of the filters.

A document's outcome in any order depends on one thing only: the set of filters it fails,
a mask of k bits. So the corpus is counted once into 2**k masks for each part, and the
histograms (all documents, and those with a label) become the rows of one integer matrix.
Its products with four fixed matrices of 2**k rows and k! * k columns (five filters: 32 by
600) are the counts of all outcomes at each step of each order:

* kept: no filter up to this step fails; removed: this one fails, none before it does;
* redundant: this one fails, but one before it removed the document;
* unique: it is the only filter that fails.

``audit`` takes any boolean columns as filters; ``corpus_flags`` computes five of them for
texts, the last of which (a copy of a text with a smaller id) looks at the whole table.

Defined results: null text is the empty text, and empty texts are copies of each other; a
null part is the part with the empty name. A row without id is a copy of nothing, and
nothing is a copy of it; rows that repeat the smallest id of a text are not copies. Several
label rows of one id count as one that has a label if any of them has it. A null flag is not
a failure. Texts of any length are read whole; an empty table gives an empty one. Columns
other than those named are not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import spread_join
from .storage import Scratch, prepare

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
FILTERS = "ABCDE"
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Filters whose orders are still few enough to list (7! * 7 columns of 128 rows).
MAX_FILTERS = 7


def outcome_matrices(k: int) -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 2**k masks by k! * k steps, of 0 and 1; and
    ``own``, which sums columns of the same filter over all orders."""
    orders = np.array(list(permutations(range(k))))
    bit = (1 << orders).ravel()
    before = (np.cumsum(1 << orders, axis=1) - (1 << orders)).ravel()
    mask = np.arange(1 << k)[:, None]
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == bit}
    return {name: m.astype(np.int64) for name, m in found.items()} | {"own": (bit[:, None] == bit[None, :]).astype(np.int64)}


def audit(rows: DataFrame, filters: str, part: str = "part", count: str | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost ..., shapley).

    ``filters`` names boolean columns of one letter each, true where the filter fails. ``count``:
    a column with the documents that a row stands for (none: one each). ``labels`` are columns
    with how many of those have a label. One row for each part, order and step.
    """
    k = len(filters)
    if not 0 < k <= MAX_FILTERS or len(set(filters)) < k:
        raise ValueError(f"1 to {MAX_FILTERS} different filters, each a column of one letter")
    prepare(rows.sparkSession)
    mask = reduce(lambda a, b: a + b, (F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(filters)))
    measures = [F.sum(F.col(count) if count else F.lit(1)).cast("long").alias("m0"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(f"m{i + 1}") for i, c in enumerate(labels))]
    # partial sums first: a part with a third of all rows sends at most 2**k rows from each task
    hist = rows.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask")).agg(*measures)
    m = len(labels) + 1
    stacked = hist.groupBy("part").agg(F.collect_list(F.struct("mask", *(f"m{i}" for i in range(m)))).alias("rows"))  # 2**k at most
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in labels), "shapley"]
    kinds = [T.StringType(), T.StringType(), T.IntegerType(), *[T.LongType()] * (len(names) - 3)]
    orders = ["".join(o) for o in permutations(filters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = outcome_matrices(k)
        columns = by["kept"].shape[1]
        order, step = np.repeat(orders, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, held = batch.column(0)[at : at + 256], batch.column(1)[at : at + 256].to_pylist()
                h = np.zeros((m, len(held), 1 << k), dtype=np.int64)
                for p, entries in enumerate(held):
                    for e in entries:
                        h[:, p, e["mask"]] = [e[f"m{i}"] for i in range(m)]
                removed = h.reshape(-1, 1 << k) @ by["removed"]
                lost = removed.reshape(m, len(held), columns)
                out = [h[0] @ by["kept"], lost[0], h[0] @ by["redundant"], h[0] @ by["unique"], *lost[1:], lost[0] @ by["own"]]
                whose = np.repeat(np.arange(len(held)), columns)
                yield pa.RecordBatch.from_arrays([part.take(pa.array(whose)), pa.array(np.tile(order, len(held)).tolist(), pa.string()), pa.array(np.tile(step, len(held))), *(pa.array(x.ravel()) for x in out)], names)

    return stacked.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))


def measure(docs: DataFrame) -> DataFrame:
    """(id, part, text) to id, part, the digest of the text and the four filters that look at it alone."""
    schema = T.StructType([docs.schema["id"], docs.schema["part"], T.StructField("digest", T.BinaryType()), *(T.StructField(f, T.BooleanType()) for f in FILTERS[:4])])
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, flags = [], []
            for t in batch.column(2).to_pylist():
                raw = (t or "").encode()
                words = raw.split()  # at exactly \x20 and \x09-\x0D
                capitals = len(raw) - len(raw.translate(None, CAPITALS))
                digest.append(hashlib.sha256(raw).digest())
                flags.append((len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words), 100 * capitals > MAX_CAPITAL_PERCENT * len(t or ""), len(raw.translate(None, SYMBOLS)) < len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), *(pa.array([f[i] for f in flags], pa.bool_()) for i in range(4))], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def corpus_flags(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents grouped by the filters they fail.

    A: fewer than 200 words; B: under 50 % of them distinct; C: over 2 % of the code points are
    capitals A-Z; D: holds one of ``#$%&*|``; E: the text of a smaller id, anywhere in the table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "filters")
    facts = measure(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text")))
    facts = scratch.table(facts.groupBy(*facts.columns).agg(F.count(F.lit(1)).alias("n")), "facts")
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("g"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("x"))
    seen = spread_join(facts, known, "id", "digest", "left").withColumns({"g": F.coalesce("g", F.lit(False)), "x": F.coalesce("x", F.lit(False))})
    keys = ["digest", "part", "A", "B", "C", "D", "g", "x"]
    # copies of a text in one part with the same labels become one row that knows its smallest id and the rows with it
    per_text = seen.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("lo"))
    first = F.min("lo.id").over(W.partitionBy("digest"))
    stays = F.col("without") + F.when(F.col("lo.id") == F.col("first"), F.col("lo.n")).otherwise(0)
    split = per_text.withColumn("first", first).withColumn("stays", stays)
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("stays").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("stays")).alias("n")))).alias("s")
    rows = split.select("part", "A", "B", "C", "D", "g", "x", both).where("s.n > 0")
    n = F.col("s.n")
    return rows.select("part", "A", "B", "C", "D", F.col("s.E").alias("E"), n.alias("n"), F.when(F.col("g"), n).otherwise(0).alias("good"), F.when(F.col("x"), n).otherwise(0).alias("toxic"))


def op13_filter_interaction_audit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(corpus_flags(docs, labels), FILTERS, "part", "n", ("good", "toxic"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), low AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM d JOIN low USING (t) LEFT JOIN l USING (doc_id)
), h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), i AS (SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE list_unique([a.i, b.i, c.i, d.i, e.i]) = 5
), s AS (
  SELECT o, list_aggregate(list_transform(o, lambda x: 'ABCDE'[x]), 'string_agg', '') AS filter_order, i AS step, o[i] AS f FROM o, i
), r AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS bad, list_contains(list_transform(o[1:step - 1], lambda x: fails[x]), true) AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS single FROM h, s
), q AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND single), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM q
"""
