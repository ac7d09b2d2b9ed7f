"""Ordered frame operators, ordered by ordinal, never by time."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import ordered
from .ordered import running

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have the package


def runs(frames: DataFrame) -> DataFrame:
    """``exact_start``: first ordinal of the run of equal consecutive digests.

    Changes are found inside blocks of ordinals; a block's first row is judged by the digest
    that the block before ends with, and a run that goes on begins where an earlier block says.
    """
    n, one = F.col("frame_no"), F.struct("digest")
    differs = lambda before, now: before["digest"].isNull() | F.coalesce(before["digest"] != now["digest"], F.lit(False))
    inside = W.partitionBy("source_id", "__block").orderBy("frame_no")
    rows = frames.withColumn("__block", F.floor(n / ordered.BLOCK))
    rows = rows.withColumn("__before", F.lag(one).over(inside)).withColumn("__change", F.when(F.col("__before").isNotNull() & differs(F.col("__before"), one), n))
    rows = rows.withColumn("__start", F.last("__change", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    blocks = rows.groupBy("source_id", "__block").agg(F.min_by(one, n).alias("head"), F.max_by(one, n).alias("tail"), F.min(n).alias("lo"), F.max("__change").alias("last"))
    along = W.partitionBy("source_id").orderBy("__block")
    blocks = blocks.withColumn("before", F.lag("tail").over(along))
    begins = F.when(F.col("before").isNull() | differs(F.col("before"), F.col("head")), F.col("lo"))
    carried = F.last(F.coalesce("last", begins), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(F.col("source_id").alias("__of"), F.col("__block").alias("__at"), F.coalesce(begins, carried).alias("__head"))
    told = rows.join(blocks, [F.col("source_id").eqNullSafe(F.col("__of")), F.col("__block") == F.col("__at")])
    return told.select(*(c for c in frames.columns if c != "exact_start"), F.coalesce("__start", "__head").alias("exact_start"))


def anomalies(frames: DataFrame) -> DataFrame:
    """Per source: frames without a presentation time, frames without any, and times not above
    the last known one. ``time_source`` tells the first; without it every known time counts as one."""
    flagged = running(frames, ["source_id"], "frame_no", ["frame_no"], __known=("last", F.col("time_s"), False)).withColumn("__bad", F.col("time_s") <= F.col("__known"))
    no_pts = F.col("time_source") != "pts" if "time_source" in frames.columns else F.col("time_s").isNull()
    return flagged.groupBy("source_id").agg(F.count_if(no_pts).alias("missing_pts"), F.count_if(F.col("time_s").isNull()).alias("missing_all_time"), F.count_if("__bad").alias("non_increasing_time"))


def states(run_frames: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row per run of computed frames (with a digest); clipped runs keep their original start."""
    run_frames = run_frames.where(F.col("digest").isNotNull())
    if start is not None:
        run_frames = run_frames.where(F.col("frame_no").between(start, end))
    return run_frames.groupBy("source_id", "exact_start").agg(
        F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time"),
        F.min("digest").alias("digest"), F.max("global_delta").alias("global_delta"), F.max("max_local_delta").alias("local_delta"), F.max("changed_fraction").alias("changed_fraction"),
    )


def ranges(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Distinct integers as closed ranges of consecutive values."""
    rows = running(values.select(*keys, value).distinct(), keys, value, [value], __n=("sum", F.lit(1), True))
    return rows.groupBy(*keys, (F.col(value) - F.col("__n")).alias("__island")).agg(F.min(value).alias("start"), F.max(value).alias("end")).drop("__island")


def select_expression(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges as one filter expression in frame order: terms with escaped commas, added up in
    pairs level by level, so that the expression is a balanced tree. All levels are columns
    of one row per key; 40 of them hold more terms than any array.
    """
    term = F.when(F.col("start") == F.col("end"), F.format_string("eq(n\\,%d)", "start")).otherwise(F.format_string("between(n\\,%d\\,%d)", "start", "end"))
    rows = ranged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", term.alias("t")))).alias("t"))
    pair = lambda a, i: F.when(i * 2 + 1 < F.size(a), F.concat(F.lit("("), F.get(a, i * 2), F.lit("+"), F.get(a, i * 2 + 1), F.lit(")"))).otherwise(F.get(a, i * 2))
    halve = lambda a: F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 2).cast("int") - 1), lambda i: pair(a, i))).otherwise(a)
    level = F.reduce(F.sequence(F.lit(1), F.lit(40)), F.transform("t", lambda x: x["t"]), lambda a, _: halve(a))
    return rows.select(*keys, F.concat(F.lit("select="), F.get(level, F.lit(0))).alias("expression"))


def _neighbours(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``rows`` with ``__before``, the vector of the row before; per source, or over the whole table.

    Over a whole table (numeric) keys are dealt by ranges between their quantiles, so that no
    task gets all rows, and only the last row of each range moves, to the range that follows.
    """
    if "source_id" in rows.columns:
        return rows.withColumn("__before", F.lag(vector).over(W.partitionBy("source_id").orderBy(key)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5])).first()[0] or []
    literal = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    dealt = rows.withColumn("__part", F.size(F.filter(literal, lambda c: c < F.col(key))))
    w = W.partitionBy("__part").orderBy(key)
    inside = dealt.withColumns({"__before": F.lag(vector).over(w), "__first": F.row_number().over(w) == 1})
    last = dealt.groupBy("__part").agg(F.max_by(F.struct(F.col(vector).alias("v")), key).alias("l"))
    # at most ``n`` rows: the last vector of each range, for the next range that has rows
    edges = last.select(F.lead("__part").over(W.orderBy("__part")).alias("__part"), F.col("l.v").alias("__edge")).where("__part is not null")
    joined = inside.join(F.broadcast(edges), "__part", "left")
    return joined.withColumn("__before", F.when(F.col("__first"), F.col("__edge")).otherwise(F.col("__before"))).drop("__part", "__first", "__edge")


def vector_metrics(rows: DataFrame, key: str, vector: str, tile: int, threshold: float) -> DataFrame:
    """Change of each vector against the one before: mean, largest tile mean, count and share
    of elements at or above the threshold, and the first strongest tile. A first vector or a
    change of size gives nulls."""
    out = _neighbours(rows, key, vector)
    prev = F.col("__before")
    delta = F.when(F.size(prev) == F.size(vector), F.zip_with(vector, prev, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    out = out.select(*(c for c in rows.columns if c != vector), delta.alias("d"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.size("d") - 1) / tile)), lambda i: F.struct(mean(F.slice("d", i * tile + 1, F.lit(tile))).alias("m"), (-i).alias("minus")))
    count = F.size(F.filter("d", lambda x: x >= threshold))
    out = out.withColumn("t", F.when(F.col("d").isNotNull(), F.array_max(tiles)))
    return out.select(
        *(c for c in out.columns if c not in ("d", "t")), F.when(F.col("d").isNotNull(), mean(F.col("d"))).alias("global_delta"), F.col("t.m").alias("max_local_delta"),
        F.when(F.col("d").isNotNull(), count).cast("long").alias("changed_elements"), F.when(F.col("d").isNotNull(), count / F.size("d")).alias("changed_fraction"), (-F.col("t.minus")).cast("long").alias("strongest_tile"),
    )


_METRICS = "global_delta double, max_local_delta double, changed_pixels long, changed_fraction double, tiles array<struct<box:array<int>,mean_delta:double>>"


_NO_CHANGE = {"global_delta": None, "max_local_delta": None, "changed_pixels": None, "changed_fraction": None, "tiles": []}
#: Ordinals of a block of images.
IMAGES = 256


def image_change(before: np.ndarray, now: np.ndarray, tile: int, threshold: int) -> dict | None:
    """Change between two images (height, width, 3): per pixel the largest of its channels.

    Tiles start at multiples of ``tile``; those at the edge have their true area. Of equal
    tiles the first in rows wins. ``None`` if the sizes differ.
    """
    if before.shape != now.shape:
        return None
    delta = np.maximum(now, before) - np.minimum(now, before)  # no sign, so no wider type
    delta = np.maximum(np.maximum(delta[..., 0], delta[..., 1]), delta[..., 2])
    height, width = delta.shape
    tops, lefts = range(0, height, tile), range(0, width, tile)
    columns = np.add.reduceat(delta, list(lefts), axis=1, dtype=np.int64)
    sums = np.add.reduceat(columns, list(tops), axis=0)
    tall = np.array([min(tile, height - y) for y in tops])
    wide = np.array([min(tile, width - x) for x in lefts])
    means = sums / np.outer(tall, wide)
    best = int(means.argmax())
    y, x = tops[best // len(wide)], lefts[best % len(wide)]
    changed = int((delta >= threshold).sum())
    box = [x, y, min(width, x + tile), min(height, y + tile)]
    return {"global_delta": float(sums.sum() / delta.size), "max_local_delta": float(means.max()), "changed_pixels": changed, "changed_fraction": changed / delta.size, "tiles": [{"box": box, "mean_delta": float(means.max())}]}


def image_metrics(frames: DataFrame, tile: int = 32, threshold: int = 8) -> DataFrame:
    """``frames`` (source_id, frame_no, width, height, pixels: RGB bytes in rows) with digest,
    run start and change metrics in place of the pixels.

    A source is dealt in blocks of ordinals, each with the last image of the block before as a
    halo, so one long source is many tasks and each holds one previous image. Runs are stitched
    over the digests afterwards. A first frame, or one of another size, has null metrics and
    no tiles.
    """
    if tile < 1 or not 1 <= threshold <= 255:
        raise ValueError("tile must be positive and threshold within 1..255")
    frames = frames.select("source_id", "frame_no", "width", "height", "pixels").withColumn("__block", F.floor(F.col("frame_no") / IMAGES))
    # the ordinals alone tell which image each block hands on, and to which block
    ends = frames.groupBy(F.col("source_id").alias("__of"), "__block").agg(F.max("frame_no").alias("__last"))
    ends = ends.select("__of", "__last", F.lead("__block").over(W.partitionBy("__of").orderBy("__block")).alias("__next")).where("__next is not null")
    halo = frames.join(ends, [F.col("source_id").eqNullSafe(F.col("__of")), F.col("frame_no") == F.col("__last")]).select("source_id", "frame_no", "width", "height", "pixels", F.col("__next").alias("__block"), F.lit(True).alias("__halo"))
    schema = f"source_id {frames.schema['source_id'].dataType.simpleString()}, frame_no long, width int, height int, digest string, {_METRICS}"

    def run(batches):
        group = before = None
        for batch in batches:
            out = []
            small = batch.select(["source_id", "frame_no", "width", "height", "__block", "__halo"]).to_pylist()
            pixels = batch.column("pixels")
            for i, row in enumerate(small):
                size, raw = (row["height"], row["width"], 3), memoryview(pixels[i].as_buffer())  # not copied
                if len(raw) != size[0] * size[1] * 3:
                    raise ValueError(f"frame {row['frame_no']} does not have the indexed size")
                own, is_halo = (row["source_id"], row.pop("__block")), row.pop("__halo")
                if own != group:
                    group, before = own, None
                now = np.frombuffer(raw, np.uint8).reshape(size)
                if not is_halo:
                    digest = hashlib.sha256(f"{row['width']}x{row['height']}:rgb24:".encode())
                    digest.update(raw)
                    change = None if before is None else image_change(before, now, tile, threshold)
                    out.append({**row, "digest": digest.hexdigest(), **(change or _NO_CHANGE)})
                before = now
            before = None if before is None else before.copy()  # outlives the batch
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    dealt = frames.withColumn("__halo", F.lit(False)).unionByName(halo).repartition("source_id", "__block")
    scanned = staged(dealt.sortWithinPartitions("source_id", "__block", "frame_no").mapInArrow(run, schema), "metrics")
    return runs(scanned).select("source_id", "frame_no", "width", "height", "digest", "exact_start", *(c for c in scanned.columns if c in _NO_CHANGE))
