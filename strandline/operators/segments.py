"""Segmentation of states into buckets, representatives and risk clues.

States come from ``frames.states``: one row per run, in ordinal order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import jumps
from .ordered import running

#: Why a state begins a bucket, in the order in which reasons are tried; fixed values.
GAP, LAYOUT, DWELL, SPAN, ORDINALS, START = "uncomputed gap", "layout/control surface change", "stable dwell exit", "context duration bound", "unknown-time ordinal context bound", "start/continuation"


def hard_breaks(states: DataFrame, layout_delta: float = 5.0, stable_seconds: float = 0.75, layout_fraction: float = 0.12) -> DataFrame:
    """``hard`` (reason or null): breaks that depend on the state before only.

    A gap of ordinals; a change of layout (share or mean of changes, unknown as none); the end
    of a state that stayed for ``stable_seconds``, where its start time is known.
    """
    told = running(states, ["source_id"], "start_frame", ["start_frame"], __before=("last", F.struct("start_frame", "end_frame", "start_time", "end_time"), False))
    before = lambda c: F.col(f"__before.{c}")
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    reason = (
        F.when(F.col("start_frame") != before("end_frame") + 1, GAP)
        .when((known("changed_fraction") >= layout_fraction) | (known("global_delta") >= layout_delta), LAYOUT)
        .when(before("end_time") - before("start_time") >= stable_seconds, DWELL)
    )
    return told.withColumn("hard", F.when(F.col("__before").isNotNull(), reason)).drop("__before")


def islands(broken: DataFrame) -> DataFrame:
    """``island``: how many hard breaks there are up to a state, the source's begin counted as one."""
    cuts = running(broken, ["source_id"], "start_frame", ["start_frame"], island=("sum", F.col("hard").isNotNull().cast("long"), True))
    return cuts.withColumn("island", F.col("island") + 1)


def buckets(broken: DataFrame, max_span: float = 15.0, max_ordinals: int = 1200) -> DataFrame:
    """``bucket`` (first ordinal of the state's bucket) and ``boundary_clue`` of the state.

    A state begins a new bucket after a hard break, when it starts ``max_span`` seconds after
    the bucket, both times known, or, its own time unknown, ``max_ordinals`` ordinals after
    it. A source is worked on in blocks, however long it is (``jumps``).
    """
    told = jumps.starts(broken.withColumn("__hard", F.col("hard").isNotNull()), "source_id", "start_frame", "start_time", max_span, "__hard", max_ordinals)
    clue = F.when(F.col("why") == jumps.SPAN, SPAN).when(F.col("why") == jumps.ORDINALS, ORDINALS).otherwise(F.coalesce("hard", F.lit(START)))
    return told.select(*(c for c in told.columns if c not in ("start", "why", "__hard", "bucket", "boundary_clue")), F.col("start").alias("bucket"), clue.alias("boundary_clue"))


def retraces(bucketed: DataFrame) -> DataFrame:
    """States whose digest already occurred earlier in their bucket."""
    w = W.partitionBy("source_id", "bucket", "digest").orderBy("start_frame")
    return bucketed.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def _listed(flag: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(flag, F.col("start_frame"))))


def proposals(bucketed: DataFrame) -> DataFrame:
    """One proposal per bucket: id, bounds, clue, representatives, risk clues and merge kind.

    Representatives are the first and last ordinal, the first strongest and the first
    weakest state with a local change, and the first retrace. Changed states are those with
    a local change above 0; a small change is one of these whose share is below 0.01 (unknown
    as 0).
    """
    again = F.row_number().over(W.partitionBy("source_id", "bucket", "digest").orderBy("start_frame")) > 1
    d, at = F.col("local_delta"), F.col("start_frame")
    changed = F.coalesce(d > 0, F.lit(False))
    rows = bucketed.withColumn("__again", again).groupBy("source_id", "bucket").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.min_by("start_time", "start_frame").alias("start_time"), F.max_by("end_time", "start_frame").alias("end_time"),
        F.min_by("boundary_clue", "start_frame").alias("boundary_clue"), (-F.max(F.when(changed, F.struct(d, (-at).alias("m"))))["m"]).alias("strongest"),
        F.min(F.when(changed, F.struct(d, at.alias("m"))))["m"].alias("weakest"), F.count(F.lit(1)).alias("distinct_states"),
        _listed(changed & (F.coalesce("changed_fraction", F.lit(0.0)) < 0.01)).alias("small_change_frames"), _listed(F.col("__again")).alias("retrace_frames"),
        _listed(at == F.col("end_frame")).alias("one_frame_states"),
    )
    reps = F.array_sort(F.array_distinct(F.array_compact(F.array("start_frame", "end_frame", "strongest", "weakest", F.get("retrace_frames", F.lit(0))))))
    return rows.select(
        "source_id", F.format_string("P%09d", "start_frame").alias("id"), "start_frame", "end_frame", "start_time", "end_time", "boundary_clue", reps.alias("representative_frames"),
        "distinct_states", "small_change_frames", "retrace_frames", "one_frame_states", F.when(F.col("distinct_states") == 1, "exact").otherwise("approximate_proposal").alias("merge"),
    )


def prepare(states: DataFrame, max_span: float = 15.0, layout_fraction: float = 0.12, stable_seconds: float = 0.75, layout_delta: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(proposals, requests) of the whole plan: each representative is an automatic request."""
    if not all(0 < x < float("inf") for x in (max_span, layout_fraction, stable_seconds)):
        raise ValueError("segmentation controls must be finite and positive")
    plan = proposals(buckets(hard_breaks(states, layout_delta, stable_seconds, layout_fraction), max_span))
    wanted = plan.select("source_id", F.explode("representative_frames").alias("frame_no"), F.concat(F.lit("layer_overview:"), "id").alias("reason"), F.lit("automatic").alias("origin"))
    return plan, wanted


def plan_key(fingerprints: DataFrame, config: dict) -> DataFrame:
    """(source_id, key): hash of configuration and index; sources whose stored key is equal need no new plan."""
    text = ",".join(f"{k}={config[k]!r}" for k in sorted(config))
    return fingerprints.select("source_id", F.sha2(F.concat_ws("\n", F.lit(text), "fingerprint"), 256).alias("key"))
