"""Progress of each source in one row: counters, ranges and completion flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..sources.ledger import Ledger
from ..sources.tables import staged
from . import layers
from .audit import unresolved_issues

NOT_COUNTED = ("coarse_frames", "fine_frames", "examined_frames", "coarse_ranges", "fine_ranges", "examined_ranges", "not_coarse_ranges", "not_fine_ranges", "not_examined_ranges", "candidate_operation_units", "approximate_merge_intervals")


def listed(rows: DataFrame, name: str) -> DataFrame:
    """(source_id, name): the ordinals of ``rows`` as sorted closed ranges."""
    spans = fr.ranges(rows, "frame_no", ["source_id"])
    return spans.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))


def full_native(led: Ledger) -> DataFrame:
    """(source_id, frame_no) that were seen natively in a full image."""
    full = led.assets.where("kind = 'full'").select("source_id", F.col("id").alias("asset_id"))
    return led.views.where("presentation = 'native'").join(full, ["source_id", "asset_id"], "left_semi").select("source_id", "frame_no").distinct()


def mismatch(declared, total, clean):
    """Whether a container declares another number of frames than the whole index has; null while either is unknown."""
    return F.when(clean & declared.isNotNull() & total.isNotNull(), declared != total)


def status(led: Ledger, requests: DataFrame, candidates: DataFrame, sources: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """One row per source.

    ``sources``: source_id, declared_frames, total_frames, index_clean, scan_clean. ``broken``:
    (source_id) with records that break their contract; their counters of reviewed intervals are
    null, not zero.
    """
    frames = led.frames
    computed = frames.where(F.col("digest").isNotNull())
    seen = full_native(led)
    out = sources.withColumn("frame_count_mismatch", mismatch(F.col("declared_frames"), F.col("total_frames"), F.col("index_clean")))
    count = lambda rows, name: rows.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    unseen = candidates.join(seen, ["source_id", "frame_no"], "left_anti")
    one = [
        count(frames, "indexed_frames"), count(computed, "computed_frames"), listed(computed, "computed_ranges"), listed(frames.where(F.col("digest").isNull()), "unprocessed_ranges"),
        listed(frames.select("source_id", "frame_no").join(seen, ["source_id", "frame_no"], "left_anti"), "unviewed_ranges"),
        requests.groupBy("source_id").agg(F.count_distinct("frame_no").alias("candidate_requests")), count(candidates, "candidate_frames"), count(unseen, "candidates_pending"), listed(unseen, "pending_ranges"),
        led.views.groupBy("source_id").agg(
            F.count_distinct("frame_no").alias("visual_frames"), F.count_distinct(F.when(F.col("presentation") == "overview", F.col("frame_no"))).alias("overview_frames"), F.count(F.lit(1)).alias("view_events")
        ),
        count(seen, "full_image_frames"), count(led.coverage, "state_accounting_records"), count(unresolved_issues(led.issues), "unresolved_issues"),
        layers.coverage(led),
    ]
    for i, rows in enumerate(one, 1):  # all in one plan would run dozens of stages at once, each held by the driver
        out = out.join(rows, "source_id", "left")
        out = staged(out, "progress") if i % 4 == 0 else out
    zeros = ["indexed_frames", "computed_frames", "candidate_requests", "candidate_frames", "candidates_pending", "visual_frames", "overview_frames", "view_events", "full_image_frames", "state_accounting_records", "unresolved_issues"]
    out = out.fillna(0, zeros)
    known = F.col("total_frames").isNotNull() & (F.col("total_frames") > 0)
    out = out.withColumns({
        "candidates_reviewed": F.col("candidate_frames") - F.col("candidates_pending"),
        "full_compute_complete": F.coalesce(F.col("index_clean") & F.col("scan_clean") & known & (F.col("computed_frames") == F.col("total_frames")), F.lit(False)),
        "selected_review_complete": (F.col("candidate_frames") > 0) & (F.col("candidates_pending") == 0),
        "all_frames_review_complete": F.coalesce(known & (F.col("full_image_frames") == F.col("total_frames")), F.lit(False)),
        "unindexed_from": F.when(~F.col("index_clean"), F.col("indexed_frames")),
        "near_duplicate_merging": F.col("approximate_merge_intervals") > 0,
    })
    if broken is not None:
        out = out.join(broken.select("source_id", F.lit(True).alias("__broken")).distinct(), "source_id", "left")
        out = out.withColumns({c: F.when(F.col("__broken").isNull(), F.col(c)) for c in (*NOT_COUNTED, "near_duplicate_merging")}).drop("__broken")
    return out


def complete(status_rows: DataFrame, invalid: DataFrame, review_findings: DataFrame) -> DataFrame:
    """(source_id, valid, review_complete): no invalid record; and all computed, all candidates seen, no finding left."""
    bad = invalid.select("source_id").distinct().withColumn("__bad", F.lit(True))
    left = review_findings.select("source_id").distinct().withColumn("__left", F.lit(True))
    rows = status_rows.join(bad, "source_id", "left").join(left, "source_id", "left")
    valid = F.col("__bad").isNull()
    return rows.select("source_id", valid.alias("valid"), (valid & F.col("full_compute_complete") & F.col("selected_review_complete") & F.col("__left").isNull()).alias("review_complete"))
