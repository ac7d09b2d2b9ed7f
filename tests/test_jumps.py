"""Folds over long sources in blocks, against the rules one row after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import jumps, selection


def slow(rows, span, ordinals, kind):
    """(ordinal, start, why) of one source's rows (ordinal, time, marked) in order."""
    out, first = [], None
    for frame, time, marked in rows:
        time = None if time is None or math.isnan(time) else time
        why = jumps.NONE
        if first is None or marked:
            why = jumps.MARKED
        elif time is None:
            why = jumps.ORDINALS if ordinals is not None and frame - first[0] >= ordinals else jumps.NONE
        elif first[1] is not None and (time - first[1] >= span if kind == "difference" else time >= first[1] + span):
            why = jumps.SPAN
        if why:
            first = (frame, time)
        out.append((frame, first[0], why))
    return out


def timeline(rng, n):
    rows, frame, time = [], rng.randint(0, 5), rng.uniform(-3, 3)
    unknown, back, marks = rng.choice([0, 0.1, 0.9]), rng.choice([0, 0.2]), rng.choice([0, 0.05])
    for _ in range(n):
        frame += rng.choice([1, 1, 1, rng.randint(1, 9)])
        time += rng.choice([1 / 30, 0.1, 0.5]) * (-3 if rng.random() < back else 1)
        rows.append((frame, rng.choice([None, float("nan")]) if rng.random() < unknown else time, rng.random() < marks))
    return rows


@pytest.mark.parametrize("block", [4, 32, 1 << 16])
def test_starts_equal_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(jumps, "BLOCK", block)
    rng = random.Random(block)
    for span, ordinals, kind in ((0.3, 7, "difference"), (1.5, None, "sum"), (40.0, 60, "difference"), (0.1, 1, "difference")):
        sources = {s: timeline(rng, rng.choice([1, 3, 40, 150])) for s in ("a", "b", "c", "d", None)}
        table = spark.createDataFrame([(s, *r, "own") for s, rows in sources.items() for r in rows], "source_id string, n long, t double, m boolean, start string")
        got = {(r.source_id, r.n): (r.start, r.why) for r in jumps.starts(table, "source_id", "n", "t", span, "m", ordinals, kind).collect()}
        assert got == {(s, n): (a, w) for s, rows in sources.items() for n, a, w in slow(rows, span, ordinals, kind)}


def test_next_starts_and_thresholds_without_spark():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 300).astype(np.float64)
    least, start = rng.integers(0, 60, 300).astype(np.float64), np.arange(1, 301)
    got = jumps.first_above(values, start, least, 300)
    for i in range(300):
        hits = [j for j in range(start[i], 300) if values[j] >= least[i]]
        assert got[i] == (hits[0] if hits else 300)
    for span in (0.1, 5.0, 1e6):
        t = np.concatenate([rng.uniform(-100, 100, 200), [0.0, -0.1, 1e9, 0.1, 0.3]])
        at = jumps.thresholds(t, span, "difference")
        assert (at - t >= span).all() and (np.nextafter(at, -np.inf)[np.abs(at) > 1e-3] - t[np.abs(at) > 1e-3] < span).all()
        assert (jumps.thresholds(t, span, "sum") == t + span).all()


def test_a_long_source_without_a_gap_is_many_tasks(spark, monkeypatch):
    """30 frames a second, no gap of five seconds: many groups, small tables, the fold's result."""
    monkeypatch.setattr(jumps, "BLOCK", 1 << 14)
    n = 400_000
    frames = spark.range(n).select(F.lit("v").alias("source_id"), F.col("id").alias("frame_no"), (F.col("id") / 30).alias("time_s"))
    taken = sorted(r.frame_no for r in selection.anchors(frames, 5.0).collect())
    want, anchor = [], -math.inf
    for i in range(n):
        if i / 30 >= anchor:
            want.append(i)
            anchor = i / 30 + 5.0
    assert taken == want
    private = frames.select(F.col("source_id").alias("__source"), F.floor(F.col("frame_no") / jumps.BLOCK).alias("__block"), F.col("frame_no").alias("__frame"), F.col("time_s").alias("__time"), F.lit(False).alias("__marked"))
    blocks = private.groupBy(F.col("__source").alias("__s"), F.col("__block").alias("__b")).agg(F.max("__time").alias("__top")).select("__s", "__b", (F.col("__top") - jumps.BLOCK / 30).alias("__above"), (F.col("__b") > 0).alias("__later"))
    entries = jumps._entries(private, blocks, jumps.Rule(5.0, None, "sum"))
    sizes = [r["count"] for r in entries.groupBy("__at_block").count().collect()]
    assert len(sizes) == -(-n // jumps.BLOCK) and max(sizes) <= 5 * 30 + 2
