"""Content identity: fingerprints of indexes, snapshots of ledgers, scope and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordinals (or keys of one hash range) that are hashed as one line of the level above.
BLOCK = 10_000


def line(*parts: str | Column) -> Column:
    """Parts as one text; nulls and lists have spellings of their own."""
    return F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\\N")) for p in parts))


def section(rows: DataFrame, name: str, key: str | Column, *parts: str | Column, block: Column | None = None) -> DataFrame:
    """(source_id, section, block, key, line) of one table of a ledger."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.select("source_id", F.lit(name).alias("section"), (F.lit(0) if block is None else block).cast("long").alias("block"), key.cast("string").alias("key"), line(*parts).alias("line"))


def snapshot(*sections: DataFrame) -> DataFrame:
    """(source_id, snapshot): SHA-256 over the hashes of all blocks of all sections, in order.

    Lines are sorted by key within a block, and blocks by section and number, so the hash
    depends on content only; a block, not a source, is what one row must hold.
    """
    rows = reduce(DataFrame.unionByName, sections)
    sorted_lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    blocks = rows.groupBy("source_id", "section", "block").agg(F.sha2(sorted_lines(F.struct("key", "line")), 256).alias("h"))
    top = blocks.withColumn("line", F.concat_ws(":", "section", F.col("block").cast("string"), "h"))
    return top.groupBy("source_id").agg(F.sha2(sorted_lines(F.struct("section", "block", "line")), 256).alias("snapshot"))


def combined(*snapshots: DataFrame) -> DataFrame:
    """The hash of several snapshots of each source."""
    out = None
    for i, s in enumerate(snapshots):
        s = s.select("source_id", F.col("snapshot").alias(f"__{i}"))
        out = s if out is None else out.join(s, "source_id", "full_outer")
    return out.select("source_id", F.sha2(F.concat_ws("\n", *(F.coalesce(f"__{i}", F.lit("")) for i in range(len(snapshots)))), 256).alias("snapshot"))


def frames_section(frames: DataFrame) -> DataFrame:
    return section(frames, "frames", F.lpad(F.col("frame_no").cast("string"), 19, "0"), "frame_no", "digest", "exact_start", block=F.floor(F.col("frame_no") / BLOCK))


def steps_section(steps: DataFrame) -> DataFrame:
    return section(steps, "steps", "id", "id", "start_frame", "end_frame", "status", "author", F.array_join("evidence", ","), F.array_join("uncertainties", ","))


def issues_section(issues: DataFrame) -> DataFrame:
    return section(issues, "issues", "id", "id", "start_frame", "end_frame", "status", "question", F.array_join("step_ids", ","), F.col("resolution.mode"))


def coverage_section(coverage: DataFrame) -> DataFrame:
    key = F.lpad(F.col("frame_no").cast("string"), 19, "0")
    return section(coverage, "coverage", key, "frame_no", "classification", "reviewer", F.array_join("step_ids", ","), F.array_join("issue_ids", ","), F.array_join("evidence", ","), block=F.floor(F.col("frame_no") / BLOCK))


def intervals_section(intervals: DataFrame) -> DataFrame:
    return section(intervals, "intervals", "id", "id", "start_frame", "end_frame", "disposition", "merge", "fine_status", "reviewer", F.array_join("step_ids", ","), F.array_join("issue_ids", ","), F.array_join("evidence", ","))


def checks_section(checks: DataFrame) -> DataFrame:
    return section(checks, "checks", "id", "id", "interval_id", "scope_hash", "method", "conclusion", "reviewer", F.array_join("evidence", ","), F.array_join("resolves", ","))


def cited_assets_section(assets: DataFrame, refs: DataFrame) -> DataFrame:
    """Only assets that records cite are pinned; a cited asset that is missing has a line too. ``refs``: source_id, id."""
    joined = refs.select("source_id", "id").distinct().join(assets, ["source_id", "id"], "left")
    return section(joined, "assets", "id", "id", "frame_no", "kind", "sha256", "parent_id")


def strict_snapshot(led, retirements: DataFrame | None = None, supplements: DataFrame | None = None) -> DataFrame:
    """Frames, steps, issues, coverage and the assets they cite; retirements and supplements only where there are any."""
    cites = lambda rows, e: rows.select("source_id", F.explode(e).alias("id"))
    proof = F.coalesce("resolution.evidence", F.array().cast("array<string>"))
    refs = cites(led.steps, "evidence").unionByName(cites(led.coverage, "evidence")).unionByName(cites(led.issues, proof))
    more = [section(rows, name, "id", *rows.columns) for name, rows in (("retirements", retirements), ("supplements", supplements)) if rows is not None]
    return snapshot(frames_section(led.frames), steps_section(led.steps), issues_section(led.issues), coverage_section(led.coverage), cited_assets_section(led.assets, refs), *more)


def layered_snapshot(led, checks: DataFrame, language: DataFrame | None = None, retirements: DataFrame | None = None) -> DataFrame:
    """The strict snapshot with intervals, checks and language sources (source_id, id, sha256)."""
    more = [] if language is None else [section(language, "language", "id", "id", "sha256")]
    return combined(strict_snapshot(led, retirements), snapshot(intervals_section(led.intervals), checks_section(checks), *more))


def delivery_snapshot(led, context: DataFrame) -> DataFrame:
    """Context (question, scope, used_language_source_ids), steps, issues and intervals; the next action is left out on purpose."""
    told = section(context, "context", F.lit("context"), "question", "scope", F.array_join("used_language_source_ids", ","))
    return snapshot(told, steps_section(led.steps), issues_section(led.issues), intervals_section(led.intervals))


def stale(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``rows`` with ``stale``: their snapshot is not the source's current one."""
    now = snapshots.select("source_id", F.col("snapshot").alias("__now"))
    return rows.join(now, "source_id", "left").withColumn("stale", ~F.col("snapshot").eqNullSafe(F.col("__now"))).drop("__now")


def freshness(evidence_changed: Column, snapshot_: Column, now: Column, valid: Column) -> Column:
    """The first that applies: evidence_changed, stale, record_invalid, current."""
    return F.when(evidence_changed, "evidence_changed").when(~snapshot_.eqNullSafe(now), "stale").when(~valid, "record_invalid").otherwise("current")


def index_fingerprint(frames: DataFrame) -> DataFrame:
    """(source_id, fingerprint) of what cues are aligned with: ordinals, times and durations."""
    duration = "duration" if "duration" in frames.columns else F.lit(None)
    rows = section(frames, "index", F.lpad(F.col("frame_no").cast("string"), 19, "0"), "frame_no", "time_s", duration, block=F.floor(F.col("frame_no") / BLOCK))
    return snapshot(rows).withColumnRenamed("snapshot", "fingerprint")


def plan_fingerprint(frames: DataFrame) -> DataFrame:
    """(source_id, fingerprint) of all of a frame that a plan depends on."""
    parts = ("frame_no", "time_s", "digest", "exact_start", "global_delta", "max_local_delta", "changed_fraction")
    rows = section(frames, "plan", F.lpad(F.col("frame_no").cast("string"), 19, "0"), *parts, block=F.floor(F.col("frame_no") / BLOCK))
    return snapshot(rows).withColumnRenamed("snapshot", "fingerprint")


def cache_key(sources: DataFrame, fingerprints: DataFrame, version: int = 2) -> DataFrame:
    """(source_id, id, key) of language imports: the file, its offset and language, and the index it was aligned with."""
    joined = sources.join(fingerprints, "source_id")
    text = F.concat_ws("\n", F.lit(str(version)), "sha256", F.col("offset").cast("string"), "language", "fingerprint")
    return joined.select("source_id", "id", F.concat(F.lit("lang-"), F.substring(F.sha2(text, 256), 1, 24)).alias("key"))
