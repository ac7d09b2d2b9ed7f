"""Joins on cells of the intervals' own sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import contracts, dyadic, evidence, intervals

INF, NAN = float("inf"), float("nan")


def mixed(rng, n):
    out = []
    for _ in range(n):
        a = rng.choice([rng.uniform(-50, 50), rng.uniform(-1e6, 1e6), float(rng.randint(-8, 8)), 1e17])
        out.append((a, a + rng.choice([0.0, 0.0, 1e-9, 0.03125, rng.uniform(0, 3), float(rng.randint(0, 9)), rng.uniform(0, 1e5), 1e8])))
    return [*out, (-INF, INF), (3.0, INF), (-INF, -4.0), (5.0, 1.0), (NAN, 1.0), (0.0, NAN), (None, 1.0), (2.0, None)]


def proper(a, b):
    return a is not None and b is not None and not math.isnan(a) and not math.isnan(b) and a <= b


def keyed(rows):
    return [("k" if i % 3 else None if i % 7 == 0 else "m", i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("fine", [0, 5])
def test_pairs_equal_brute_force(spark, fine):
    rng = random.Random(fine)
    left, right = keyed(mixed(rng, 150)), keyed(mixed(rng, 150))
    points = keyed([(x,) for x in [rng.uniform(-50, 50) for _ in range(80)] + [float(x) for x in range(-9, 9)] + [INF, -INF, NAN, None, 1e17, 1e300]])
    of = lambda rows, names: spark.createDataFrame(rows, f"key string, {names}")
    a, b = of(left, "i long, lo double, hi double"), of(right, "j long, s double, e double")
    got = sorted((r.i, r.j) for r in dyadic.overlapping(a, b, ["key"], ("lo", "hi"), ("s", "e"), fine).collect())
    want = sorted((i, j) for k, i, x, y in left for m, j, s, e in right if k == m is not None and proper(x, y) and proper(s, e) and s <= y and e >= x)
    assert got == want and len(want) > 1000
    found = dyadic.containing(a, of(points, "p long, t double"), ["key"], "lo", "hi", "t", fine)
    assert found.columns == ["key", "i", "lo", "hi", "p", "t"]
    want = sorted((i, p) for k, i, x, y in left for m, p, t in points if k == m is not None and proper(x, y) and proper(t, t) and x <= t <= y)
    assert sorted((r.i, r.p) for r in found.collect()) == want


def test_integers_and_empty_tables(spark):
    rng = random.Random(9)
    spans = [(i, a := rng.randint(0, 5000), a + rng.choice([0, 1, 2, 3, 63, 64, 65, 4000])) for i in range(120)]
    a = spark.createDataFrame([("k", *s) for s in spans], "key string, i long, lo long, hi long")
    b = a.select("key", F.col("i").alias("j"), F.col("lo").alias("s"), F.col("hi").alias("e"))
    for fine in (0, 6):
        got = sorted((r.i, r.j) for r in dyadic.overlapping(a, b, ["key"], ("lo", "hi"), ("s", "e"), fine).collect())
        assert got == sorted((i, j) for i, x, y in spans for j, s, e in spans if s <= y and e >= x)
    assert dyadic.overlapping(a.limit(0), b, ["key"], ("lo", "hi"), ("s", "e")).count() == 0
    assert dyadic.containing(a, b.limit(0), ["key"], "lo", "hi", "s").count() == 0


def test_rows_that_move_are_bounded(spark):
    """Whatever the lengths: three rows for an interval, one for a start and level in use."""
    rng = random.Random(3)
    n, lengths = 2000, (0.0, 0.01, 0.03, 5.0, 700.0, 1e8, 1e12)
    spans = [(float(rng.uniform(0, 1e6)), rng.choice(lengths)) for _ in range(n)]
    rows = spark.createDataFrame([(a, a + d) for a, d in spans], "lo double, hi double")
    home = rows.select(F.size(F.expr(dyadic._home(1, "lo", "hi", 0))).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert home[0] <= 3 and home[1] <= 3 * n
    levels = rows.agg(F.expr(f"collect_set({dyadic._level('lo', 'hi', 0)})")).first()[0]
    assert len(levels) <= 2 * len(lengths)  # a length may round to two powers of two
    fine = rows.select(F.size(F.expr(dyadic._home(1, "lo", "hi", 6))).alias("n")).agg(F.max("n")).first()
    assert fine[0] <= 2**6 + 2


def test_alignment_of_a_span_over_everything(spark):
    """60,000 frames and 1,000 cues, one frame shown throughout and one for 1e8 s: as brute force says."""
    n, m = 60_000, 1_000
    frames = spark.range(n).select(F.lit("v").alias("source_id"), F.col("id").alias("frame_no"), (F.col("id") / 30).alias("time_s"), ((F.col("id") + 1) / 30).alias("end_s"))
    long = spark.createDataFrame([("v", n, 0.0, 2000.0), ("v", n + 1, 100.0, 1e8), ("w", 0, 0.0, 1e300)], frames.schema)
    cues = spark.range(m).select(F.lit("v").alias("source_id"), F.col("id").alias("cue"), (F.col("id") * 2.0).alias("a"), (F.col("id") * 2.0 + 1.5).alias("b"))
    wide = spark.createDataFrame([("v", m, -1e6, 1e6)], cues.schema)
    found = intervals.align(cues.unionByName(wide), frames.unionByName(long)).groupBy("cue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("frame_no") >= n).alias("long"), F.min("frame_no").alias("lo"), F.max(F.when(F.col("frame_no") < n, F.col("frame_no"))).alias("hi"))
    got = {r.cue: (r.n, r.long, r.lo, r.hi) for r in found.collect()}
    want = {m: (n + 2, 2, 0, n - 1)}
    for i in range(m):
        a, b = i * 2.0, i * 2.0 + 1.5
        own = [k for k in range(max(0, int(a * 30) - 3), min(n, int(b * 30) + 4)) if k / 30 < b and (k + 1) / 30 > a]
        over = 1 + (b > 100.0)
        want[i] = (len(own) + over, over, own[0], own[-1])
    assert got == want


def test_mapping_and_uncomputed_frames_of_long_intervals(spark):
    frames = spark.range(5000).select(F.lit("v").alias("source_id"), F.col("id").alias("frame_no"), (F.floor(F.col("id") / 7) * 7).alias("exact_start"), F.when(F.col("id") != 4321, F.lit("d")).alias("digest"), F.lit(0.5).alias("max_local_delta"))
    entries = spark.createDataFrame([("v", "all", 0, 4999), ("v", "one", 10, 10), ("v", "past", 4990, 10**12), ("v", "good", 0, 4320)], "source_id string, id string, start_frame long, end_frame long")
    mapped = evidence.mapping(frames, entries).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("start_frame").alias("lo"), F.max("end_frame").alias("hi"))
    assert {tuple(r) for r in mapped.collect()} == {("all", 715, 0, 4999), ("one", 1, 10, 10), ("past", 3, 4990, 4999), ("good", 618, 0, 4320)}
    assert {r.id for r in contracts.uncomputed_intervals(entries, frames).collect()} == {"all", "past"}


def test_cues_that_cannot_be_stored(spark):
    frames = spark.createDataFrame([("v", 0, 1.0)], "source_id string, frame_no long, time_s double")
    schema = "source_id string, key string, pos long, begin double, end double, offset double, text string, translation string"
    for begin, end, offset, text in ((INF, INF, 0.0, "x"), (1.0, INF, 0.0, "x"), (NAN, 1.0, 0.0, "x"), (0.0, 1.0, INF, "x"), (2.0, 2.0, 0.0, "x"), (0.0, 1.0, 0.0, " "), (0.0, 1.0, 0.0, None), (None, 1.0, 0.0, "x")):
        with pytest.raises(Exception, match="source v: cue 0"):
            intervals.align_store(spark.createDataFrame([("v", "lang-1", 0, begin, end, offset, text, None)], schema), frames).collect()
    (row,) = intervals.align_store(spark.createDataFrame([("v", "lang-1", 4, 0.5, 1.5, 0.25, "x", "y")], schema), frames).collect()
    assert (row.id, row.original_start, row.original_end, row.start_time, row.end_time, row.text_original, row.translation, [tuple(r) for r in row.frame_ranges], row.warnings) == ("lang-1:c5", 0.5, 1.5, 0.75, 1.75, "x", "y", [(0, 0)], ["unknown_display_duration"])


def test_cells_are_never_broadcast(spark):
    """Spark's guess of a size knows nothing of the rows that cells make, so a small guess must not decide."""
    a = spark.range(50).select(F.lit("v").alias("key"), F.col("id").alias("lo"), (F.col("id") + 3).alias("hi"))
    p = spark.range(50).select(F.lit("v").alias("key"), F.col("id").alias("at"))
    b = a.select("key", F.col("lo").alias("s"), F.col("hi").alias("e"))
    for df in (dyadic.containing(a, p, ["key"], "lo", "hi", "at", 6), dyadic.overlapping(a, b, ["key"], ("lo", "hi"), ("s", "e"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_uncomputed_intervals_merge_their_cells(spark):
    frames = spark.range(50).select(F.lit("v").alias("source_id"), F.col("id").alias("frame_no"), F.lit("d").alias("digest"))
    entries = spark.range(1).select(F.lit("v").alias("source_id"), F.lit("a").alias("id"), (F.col("id") + 3).alias("start_frame"), (F.col("id") + 9).alias("end_frame"))
    assert "SortMergeJoin" in contracts.uncomputed_intervals(entries, frames)._jdf.queryExecution().executedPlan().toString()


def test_whole_numbers_have_no_cells_below_one(spark):
    rows = spark.createDataFrame([(7, 7), (7, 9), (0, 64), (5, 4999), (0, 10**12)], "lo long, hi long")
    home = dyadic._home(0, *dyadic._finite(rows, "lo", "hi"), 6, dyadic._whole(rows, "lo", "hi"))
    cells = {(r.lo, r.hi): r.n for r in rows.select("lo", "hi", F.size(F.expr(home)).alias("n")).collect()}
    assert cells[(7, 7)] == 1 and cells[(7, 9)] == 3 and max(cells.values()) <= 2**6 + 2
