"""Interval operators. Three comparison rules coexist: closed integers, strict previous-only, half-open with points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import dyadic
from .ordered import following, running


def union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Closed integer spans merged; adjacent spans merge too."""
    # distinct spans have one order, so both passes see the same
    reach = running(spans.select(*keys, "start", "end").distinct(), keys, "start", ["start", "end"], __reach=("max", F.col("end"), False))
    new = (F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + 1)).cast("long")
    rows = running(reach, keys, "start", ["start", "end"], __island=("sum", new, True))
    return rows.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def complement(merged: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Closed gaps of merged spans inside [lo, hi] of ``bounds``, clipped, empty ones dropped."""
    w = W.partitionBy(*keys).orderBy("start")
    inside = bounds.join(merged, keys, "left").where(F.col("start").isNull() | ((F.col("end") >= F.col("lo")) & (F.col("start") <= F.col("hi"))))
    rows = inside.withColumns({"__prev": F.lag("end").over(w), "__last": F.lead("start").over(w).isNull()})
    before = F.struct(F.coalesce(F.col("__prev") + 1, F.col("lo")).alias("start"), F.coalesce(F.col("start") - 1, F.col("hi")).alias("end"))
    after = F.struct((F.col("end") + 1).alias("start"), F.col("hi").alias("end"))
    gaps = rows.select(*keys, F.explode(F.array_compact(F.array(before, F.when(F.col("__last") & F.col("end").isNotNull(), after)))).alias("g"))
    uncovered = bounds.join(inside.select(*keys).distinct(), keys, "left_anti").select(*keys, F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")).alias("g"))
    return gaps.unionByName(uncovered).select(*keys, "g.start", "g.end").where("start <= end")


def overlaps_running(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Spans that start at or before the largest end of all earlier ones; ``order`` begins with ``start``."""
    told = running(spans, keys, order[0], order, __reach=("max", F.col("end"), False))
    return told.where(F.col("start") <= F.col("__reach")).drop("__reach")


def overlaps_previous(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Spans that start before the end of the span just before them."""
    w = W.partitionBy(*keys).orderBy(*order)
    return spans.withColumn("__end", F.lag("end").over(w)).where(F.col("start") < F.col("__end")).drop("__end")


def display_spans(frames: DataFrame) -> DataFrame:
    """Display interval of each timed frame: to the next frame's time if later, else its duration, else a point."""
    told = following(frames, ["source_id"], "frame_no", __after=F.col("time_s"))
    after = F.col("__after")
    dur = F.coalesce("duration", F.lit(0.0)) if "duration" in frames.columns else F.lit(0.0)
    end = F.when(after > F.col("time_s"), after).when(dur > 0, F.col("time_s") + dur).otherwise(F.col("time_s"))
    return told.withColumn("end_s", end).where(F.col("time_s").isNotNull()).drop("__after")


def align(cues: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of cue [a, b) and display span [t, e): t < b and (e > a or (e = a and e = t)).

    Cues and spans meet in cells of their own sizes (``dyadic``), so neither one span over a
    whole recording nor a wrong time makes more rows than any other.
    """
    cues, spans = cues.where("a <= b"), spans.where("time_s <= end_s")
    hit = (F.col("time_s") < F.col("b")) & ((F.col("end_s") > F.col("a")) | ((F.col("end_s") == F.col("a")) & (F.col("end_s") == F.col("time_s"))))
    return dyadic.overlapping(cues, spans, ["source_id"], ("a", "b"), ("time_s", "end_s")).where(hit)


def cue_overlaps(cues: DataFrame) -> DataFrame:
    """Cues that begin before the largest end of all earlier cues in input order."""
    told = running(cues, ["source_id"], "pos", ["pos"], __reach=("max", F.col("b"), False))
    return told.where(F.col("a") < F.col("__reach")).drop("__reach")


def align_store(cues: DataFrame, frames: DataFrame) -> DataFrame:
    """Imported cues with shifted times, the ranges of frames they overlap, and warnings per source.

    ``cues``: source_id, pos (from 0), begin, end, offset, text, and optionally key (of the import),
    translation, language, speaker and confidence. Cues whose times are not finite, without a
    later end or without text are refused with an error when read. Out: cue columns, id
    (key:c1, key:c2, ...), original_start, original_end, start_time, end_time, text_original,
    frame_ranges array of (start, end), alignment, warnings (sorted, distinct, of the whole import).
    """
    by = ["source_id", *(["key"] if "key" in cues.columns else [])]
    wrong = F.raise_error(F.format_string("source %s: cue %d", F.col("source_id").cast("string"), F.col("pos"))).cast("double")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    sound = finite("begin") & finite("end") & finite("offset") & (F.col("end") > F.col("begin")) & F.coalesce(F.trim("text") != "", F.lit(False))
    timed = cues.withColumns({"a": F.when(sound, F.col("begin") + F.col("offset")).otherwise(wrong), "b": F.col("end") + F.col("offset")})
    spans = staged(display_spans(frames).select("source_id", "frame_no", "time_s", "end_s"), "spans")
    pairs = align(timed.select(*by, "pos", "a", "b"), spans).select(*by, "pos", "frame_no").distinct()
    w = W.partitionBy(*by, "pos").orderBy("frame_no")
    runs = pairs.withColumn("g", F.col("frame_no") - F.row_number().over(w)).groupBy(*by, "pos", "g").agg(F.min("frame_no").alias("start"), F.max("frame_no").alias("end"))
    ranged = runs.groupBy(*by, "pos").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("frame_ranges"))
    out = timed.join(ranged, [*by, "pos"], "left")
    told = running(out, by, "pos", ["pos"], __reach=("max", F.col("b"), False))
    own = told.select(*by, F.array_compact(F.array(F.when(F.col("a") < F.col("__reach"), "overlap"), F.when(F.col("frame_ranges").isNull(), "outside_index"))).alias("w"))
    of_frames = frame_warnings(frames).join(cues.select(*by).distinct(), "source_id").select(*by, F.array("w").alias("w")) if len(by) > 1 else frame_warnings(frames).select(*by, F.array("w").alias("w"))
    told = own.withColumn("w", F.explode("w")).unionByName(of_frames.withColumn("w", F.explode("w"))).groupBy(*by).agg(F.array_sort(F.collect_set("w")).alias("warnings"))
    label = F.when(F.col("frame_ranges").isNull(), "unaligned").otherwise("display_interval_overlap")
    empty, none = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    made = {
        "id": F.concat(F.col("key") if len(by) > 1 else F.col("source_id").cast("string"), F.lit(":c"), (F.col("pos") + 1).cast("string")), "original_start": F.col("begin"), "original_end": F.col("end"), "start_time": F.col("a"), "end_time": F.col("b"),
        "text_original": F.col("text"), "frame_ranges": F.coalesce("frame_ranges", empty), "alignment": label, "warnings": F.coalesce("warnings", none),
    }
    return out.join(told, by, "left").select(*(c for c in cues.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def frame_warnings(frames: DataFrame) -> DataFrame:
    """(source_id, w), each once: frames whose time is unknown, not above the last known one, or whose display is a point."""
    frames = running(frames, ["source_id"], "frame_no", ["frame_no"], __before=("last", F.col("time_s"), False))
    frames = following(frames, ["source_id"], "frame_no", __after=F.col("time_s"))
    before, after = F.col("__before"), F.col("__after")
    dur = F.coalesce("duration", F.lit(0.0)) if "duration" in frames.columns else F.lit(0.0)
    t = F.col("time_s")
    point = t.isNotNull() & ~F.coalesce(after > t, F.lit(False)) & ~F.coalesce(dur > 0, F.lit(False))
    said = F.array_compact(F.array(F.when(t.isNull(), "unknown_frame_time"), F.when(t <= before, "non_increasing_frame_time"), F.when(point, "unknown_display_duration")))
    return frames.select("source_id", F.explode(said).alias("w")).distinct()


def linked_steps(issues: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, issue_id, step_id): explicit step ids if there are any, else steps that intersect the issue's closed range.

    Explicit ids are given even if there is no such step. Ranges meet in cells of their own
    sizes (``dyadic``), so work follows the steps near an issue and no pair comes twice.
    """
    explicit = issues.where(F.size("step_ids") > 0).select(*keys, "issue_id", F.explode("step_ids").alias("step_id"))
    rest = issues.where(F.coalesce(F.size("step_ids"), F.lit(0)) <= 0).select(*keys, "issue_id", F.col("start").alias("__s"), F.col("end").alias("__e"))
    ranged = dyadic.overlapping(rest, steps.select(*keys, "step_id", "start", "end"), keys, ("__s", "__e"), ("start", "end"))
    return explicit.unionByName(ranged.select(*keys, "issue_id", "step_id"))


def contains(outer: list[str], inner: list[str]):
    """Box (x0, y0, x1, y1) of ``inner`` columns inside that of ``outer``."""
    (a, b, c, d), (e, f, g, h) = outer, inner
    return (F.col(e) >= F.col(a)) & (F.col(f) >= F.col(b)) & (F.col(g) <= F.col(c)) & (F.col(h) <= F.col(d))
