"""Requests, candidates and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import jumps, segments
from .frames import states
from .ordered import running


def anchors(frames: DataFrame, seconds: float) -> DataFrame:
    """Greedy sampler: a frame at or after the next anchor is taken, and the anchor moves to its time + seconds.

    Frames without time are skipped; 0 seconds take none. A source is worked on in blocks,
    however long it is (``jumps``).
    """
    timed = frames.where(F.col("time_s").isNotNull() & ~F.isnan("time_s")).select("source_id", "frame_no", "time_s")
    if seconds <= 0:
        return timed.select("source_id", "frame_no").limit(0)
    return jumps.starts(timed, "source_id", "frame_no", "time_s", seconds, kind="sum").where(F.col("why") > 0).select("source_id", "frame_no")


def first_last(frames: DataFrame) -> DataFrame:
    ends = frames.groupBy("source_id").agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"))
    return ends.select("source_id", F.col("lo").alias("frame_no"), F.lit("first").alias("reason")).unionByName(ends.select("source_id", F.col("hi").alias("frame_no"), F.lit("last_computed").alias("reason")))


def change_reasons(run_frames: DataFrame, global_at: float = 2.0, local_at: float = 0.8, pixels_at: int = 8, distinct_states: bool = True) -> DataFrame:
    """(source_id, frame_no, reason): new states, size changes, and changes at or above thresholds."""
    g = F.col("global_delta")
    reasons = F.array_compact(F.array(
        F.when((F.col("exact_start") == F.col("frame_no")) & F.lit(distinct_states), "distinct_state"),
        F.when(g.isNull() & (F.col("frame_no") > 0), "dimension_change"),
        F.when((g > 0) & (g >= global_at), "global_change"),
        F.when((g > 0) & (F.col("max_local_delta") >= local_at), "local_change"),
        F.when((g > 0) & (F.col("changed_pixels") >= pixels_at), "pixel_change"),
    ))
    return run_frames.select("source_id", "frame_no", F.explode(reasons).alias("reason"))


def context(flagged: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """Neighbours up to ``k`` ordinals away, where such frames exist."""
    near = flagged.select("source_id", "frame_no").distinct().select("source_id", F.col("frame_no").alias("of"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame_no") - k), F.col("frame_no") + k)).alias("frame_no"))
    near = near.where("frame_no <> of").select("source_id", "frame_no", F.concat(F.lit("context_of_"), F.col("of").cast("string")).alias("reason"))
    return near.join(frames.select("source_id", "frame_no"), ["source_id", "frame_no"], "left_semi")


def focus(frames: DataFrame, start: float, end: float, stride: int) -> DataFrame:
    """Every ``stride``-th frame with start <= time <= end."""
    inside = running(frames.where(F.col("time_s").between(start, end)), ["source_id"], "frame_no", ["frame_no"], __n=("sum", F.lit(1), True))
    return inside.where((F.col("__n") - 1) % stride == 0).select("source_id", "frame_no")


def candidates(requests: DataFrame, run_frames: DataFrame) -> DataFrame:
    """Requests by run: sorted ``reason@frame`` texts and requested frames."""
    joined = requests.join(run_frames.select("source_id", "frame_no", "exact_start"), ["source_id", "frame_no"])
    label = F.concat("reason", F.lit("@"), F.col("frame_no").cast("string"))
    return joined.groupBy("source_id", F.col("exact_start").alias("frame_no")).agg(F.array_sort(F.collect_set(label)).alias("reasons"), F.array_sort(F.collect_set("frame_no")).alias("represented_requests"))


def pending(found: DataFrame, views: DataFrame) -> DataFrame:
    """Candidates without a full native view."""
    return found.join(views.where("kind = 'full' and presentation = 'native'").select("source_id", "frame_no"), ["source_id", "frame_no"], "left_anti")


def queue(found: DataFrame, frames: DataFrame, start: float | None, end: float | None, batch: int) -> DataFrame:
    """First ``batch`` candidates of each source: those with a request inside the closed time range first, then by ordinal.

    ``matched``: the requests inside the range; ``matched_ranges``: them as ranges of
    consecutive ordinals with the times of both ends. Without a range none is inside.
    """
    if batch < 1:
        raise ValueError("batch must be positive")
    if (start is None) != (end is None) or (start is not None and not float("-inf") < start <= end < float("inf")):
        raise ValueError("give both ends of a range in order, or neither")
    times = frames.select("source_id", F.col("frame_no").alias("request"), "time_s")
    near = F.col("time_s").between(start, end) if start is not None else F.lit(False)
    hits = found.select("source_id", "frame_no", F.explode("represented_requests").alias("request")).join(times, ["source_id", "request"]).where(near)
    hits = hits.withColumn("island", F.col("request") - F.row_number().over(W.partitionBy("source_id", "frame_no").orderBy("request")))
    one = hits.groupBy("source_id", "frame_no", "island").agg(
        F.min("request").alias("start_frame"), F.max("request").alias("end_frame"), F.min_by("time_s", "request").alias("start_time_s"), F.max_by("time_s", "request").alias("end_time_s"), F.collect_list("request").alias("m"),
    )
    inside = one.groupBy("source_id", "frame_no").agg(
        F.array_sort(F.flatten(F.collect_list("m"))).alias("matched"), F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "start_time_s", "end_time_s"))).alias("matched_ranges")
    )
    rows = found.join(inside, ["source_id", "frame_no"], "left").withColumn("in_range", F.col("matched").isNotNull())
    w = W.partitionBy("source_id").orderBy(F.col("in_range").desc(), "frame_no")
    return rows.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= batch)


def manifest(found: DataFrame, frames: DataFrame, assets: DataFrame, views: DataFrame, pending_only: bool = False, start: float | None = None, end: float | None = None) -> DataFrame:
    """Candidates with time, size, full image and whether that was seen natively, by ordinal.

    A time filter leaves out frames without a time. ``views``: asset_id, frame_no, presentation.
    """
    full = assets.where("kind = 'full'").select("source_id", "frame_no", F.col("id").alias("asset_id"), "path")
    seen = views.where("presentation = 'native'").join(full.select("source_id", "asset_id"), ["source_id", "asset_id"], "left_semi")
    seen = seen.select("source_id", "frame_no", F.lit(True).alias("viewed")).distinct()
    rows = found.join(frames.select("source_id", "frame_no", "time_s", "width", "height"), ["source_id", "frame_no"])
    rows = rows.join(full, ["source_id", "frame_no"], "left").join(seen, ["source_id", "frame_no"], "left").withColumn("viewed", F.coalesce("viewed", F.lit(False)))
    if pending_only:
        rows = rows.where("not viewed")
    if start is not None:
        rows = rows.where(F.col("time_s") >= start)
    return rows.where(F.col("time_s") <= end) if end is not None else rows


#: The thresholds that a layered selection must leave as they are.
DEFAULTS = {"anchor_seconds": 5.0, "global_at": 2.0, "local_at": 0.8, "pixels_at": 8, "context_frames": 1}


def select(run_frames: DataFrame, mode: str = "layered", **given) -> DataFrame:
    """Automatic requests (source_id, frame_no, reason) of the computed frames.

    ``coverage`` asks for every state, ``changes`` for changes only; both add the first and
    last frame, anchors and the neighbours of every flagged frame. ``layered`` asks for the
    representatives of the plan and takes no thresholds.
    """
    p = DEFAULTS | given
    if unknown := given.keys() - DEFAULTS.keys():
        raise ValueError(f"unknown thresholds {sorted(unknown)}")
    if mode == "layered":
        if p != DEFAULTS:
            raise ValueError("the layered mode takes no thresholds")
        return segments.prepare(states(run_frames))[1].select("source_id", "frame_no", "reason")
    if mode not in ("coverage", "changes"):
        raise ValueError("mode must be layered, coverage or changes")
    if min(p["anchor_seconds"], p["global_at"], p["local_at"], p["context_frames"]) < 0 or p["pixels_at"] < 1:
        raise ValueError("thresholds must not be negative, pixels_at positive")
    computed = run_frames.where(F.col("digest").isNotNull())
    flagged = change_reasons(computed, p["global_at"], p["local_at"], p["pixels_at"], mode == "coverage")
    timed = anchors(computed, p["anchor_seconds"]).withColumn("reason", F.lit("time_anchor"))
    return first_last(computed).unionByName(timed).unionByName(flagged).unionByName(context(flagged, computed, p["context_frames"])).distinct()
