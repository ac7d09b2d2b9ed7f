"""Who saw what: views, state-equivalent coverage, samples, crops, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import dyadic, intervals


def viewed_frames(refs: DataFrame, assets: DataFrame, views: DataFrame, native: bool = False, full: bool = False) -> DataFrame:
    """Frames that an actor saw through listed assets; hash and frame of view and asset must agree.

    ``refs``: source_id, actor, asset_id.
    """
    a = assets.select("source_id", F.col("id").alias("asset_id"), "frame_no", "kind", F.col("sha256").alias("asset_sha256"))
    seen = refs.join(a, ["source_id", "asset_id"]).join(views, ["source_id", "asset_id", "frame_no", "actor", "asset_sha256"])
    if native:
        seen = seen.where("presentation = 'native'")
    if full:
        seen = seen.where("kind = 'full'")
    return seen.select("source_id", "actor", "frame_no").distinct()


def covered(targets: DataFrame, viewed: DataFrame, run_frames: DataFrame) -> DataFrame:
    """Targets in whose run some viewed frame lies."""
    run = run_frames.select("source_id", "frame_no", "exact_start")
    seen = viewed.join(run, ["source_id", "frame_no"]).select("source_id", "exact_start").distinct()
    return targets.join(run, ["source_id", "frame_no"]).join(seen, ["source_id", "exact_start"], "left_semi")


def crop_regions(assets: DataFrame) -> DataFrame:
    """(source_id, id, x0, y0, x1, y1) of crops in source coordinates; cycles and bad boxes fail closed.

    A crop fits or does not fit its parent, whatever that lies in, and its place in the source
    is the sum of the offsets up its chain. So chains are followed by doubling: each round
    joins every open crop with the one it points at, which is 1, 2, 4, ... parents up. A chain
    of a thousand crops takes ten rounds; one that is still open when its rounds exceed the
    number of crops is a cycle.
    """
    box = lambda i: F.col("crop")[i]
    sound = (F.size("crop") == 4) & (box(0) >= 0) & (box(1) >= 0) & (box(0) < box(2)) & (box(1) < box(3))
    crops = staged(assets.where("kind = 'crop'").where(sound).select("source_id", "id", "parent_id", *(box(i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))), "crops")
    full = assets.where("kind = 'full'").select("source_id", F.col("id").alias("parent_id"))
    parents = crops.select("source_id", F.col("id").alias("parent_id"), F.col("x0").alias("dx"), F.col("y0").alias("dy"), F.col("x1").alias("qx"), F.col("y1").alias("qy"))
    ends = crops.join(full, ["source_id", "parent_id"], "left_semi").select("source_id", "id", F.lit(None).cast("string").alias("up"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    inner = crops.join(parents, ["source_id", "parent_id"]).where("dx + x1 <= qx and dy + y1 <= qy").select("source_id", "id", F.col("parent_id").alias("up"), "dx", "dy")
    links, reach, n = staged(ends.unionByName(inner), "links"), 1, crops.count()
    while reach < 2 * n and not links.where("up is not null").isEmpty():
        above = links.select("source_id", F.col("id").alias("up"), F.col("up").alias("far"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
        further = links.where("up is not null").join(above, ["source_id", "up"])  # none above: the chain breaks there
        further = further.select("source_id", "id", F.col("far").alias("up"), (F.col("dx") + F.col("ex")).alias("dx"), (F.col("dy") + F.col("ey")).alias("dy"))
        links, reach = staged(links.where("up is null").unionByName(further), "links"), 2 * reach
    done = links.where("up is null").select("source_id", "id", "dx", "dy")
    moved = lambda a, b: (F.col(a) + F.col(b)).alias(a)
    return crops.join(done, ["source_id", "id"]).select("source_id", "id", moved("x0", "dx"), moved("y0", "dy"), moved("x1", "dx"), moved("y1", "dy"))


def covered_length(spans: DataFrame, run_frames: DataFrame) -> DataFrame:
    """Covered and uncovered ordinals of each source between its first and last frame."""
    bounds = run_frames.groupBy("source_id").agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"))
    merged = intervals.union(spans, ["source_id"])
    gaps = intervals.complement(merged, bounds, ["source_id"])
    length = lambda df, name: df.groupBy("source_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias(name))
    return bounds.join(length(merged, "covered"), "source_id", "left").join(length(gaps, "uncovered"), "source_id", "left").fillna(0, ["covered", "uncovered"])


def mapping(run_frames: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, id, exact_start, start_frame, end_frame, local_delta, digest): the states of each
    interval, clipped to it.

    Intervals meet only the frames inside them, in cells of a sixty-fourth of their size
    (``dyadic``), so one interval over a long source is many tasks.
    """
    asked = entries.select("source_id", "id", F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"))
    dealt = run_frames.where(F.col("digest").isNotNull()).select("source_id", "frame_no", "exact_start", "digest", "max_local_delta")
    inside = dyadic.containing(asked, dealt, ["source_id"], "lo", "hi", "frame_no", fine=6)
    return inside.groupBy("source_id", "id", "exact_start").agg(
        F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.max("max_local_delta").alias("local_delta"), F.min("digest").alias("digest")
    )


def scopes(mapped: DataFrame, entries: DataFrame, steps: DataFrame) -> DataFrame:
    """(source_id, id, scope_hash): SHA-256 of an interval, its states and its steps as they are now.

    Views and retries are not part of it, so they do not make a check stale.
    """
    row = lambda *cols: F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols))
    lines = lambda df, key, *cols: df.groupBy("source_id", "id").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row(*cols).alias("v")))).alias(f"__{key}"))
    states = lines(mapped, "start_frame", "exact_start", "start_frame", "end_frame", "digest")
    named = entries.select("source_id", "id", F.explode("step_ids").alias("step_id")).join(steps.withColumnRenamed("id", "step_id").select("source_id", "step_id", "status", "start_frame", "end_frame"), ["source_id", "step_id"])
    linked = lines(named, "step_id", "step_id", "status", "start_frame", "end_frame")
    joined = entries.join(states, ["source_id", "id"], "left").join(linked, ["source_id", "id"], "left")
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["v"]), ","), F.lit(""))
    own = F.concat_ws("|", "id", F.col("start_frame").cast("string"), F.col("end_frame").cast("string"), "merge", "disposition", "fine_status", F.array_join("evidence", ","), F.array_join("step_ids", ","), F.array_join("issue_ids", ","))
    return joined.select("source_id", "id", F.sha2(F.concat_ws("\n", F.col("source_id").cast("string"), own, text("__start_frame"), text("__step_id")), 256).alias("scope_hash"))


def required_sample(mapped: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, id, required, frames, all_state_frames) of each interval.

    Sampled are, among the states strictly inside, the first with the strongest local change
    (unknown as 0), the first with the weakest above 0, and one at a position seeded by the
    column ``scope_hash`` (64 hex digits). Approximate merges and context intervals require a
    sample; where they have no state inside, it is their first frame.
    """
    bounds = entries.select("source_id", "id", F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"))
    w = W.partitionBy("source_id", "id").orderBy("start_frame")
    inside = mapped.join(bounds, ["source_id", "id"]).where("start_frame > lo and start_frame < hi")
    inside = inside.select("source_id", "id", (F.row_number().over(w) - 1).alias("position"), "start_frame", F.coalesce("local_delta", F.lit(0.0)).alias("d"))
    d, at = F.col("d"), F.col("start_frame")
    picks = inside.groupBy("source_id", "id").agg(
        F.count(F.lit(1)).alias("n"), (-F.max(F.struct(d, (-at).alias("m")))["m"]).alias("strongest"), F.min(F.when(d > 0, F.struct(d, at.alias("m"))))["m"].alias("weakest")
    )
    every = mapped.groupBy("source_id", "id").agg(F.array_sort(F.collect_list("start_frame")).alias("all_state_frames"))
    seed = F.conv(F.substring("scope_hash", 1, 16), 16, 10).cast("decimal(20,0)")
    asked = entries.join(picks, ["source_id", "id"], "left").join(every, ["source_id", "id"], "left").withColumn("position", F.when(F.col("n") > 0, (seed % F.col("n")).cast("int")))
    rows = asked.join(inside.select("source_id", "id", "position", F.col("start_frame").alias("seeded")), ["source_id", "id", "position"], "left")
    required = (F.col("merge") == "approximate") | (F.col("disposition") == "context")
    fallback = F.when(required & F.col("n").isNull(), F.col("start_frame"))
    frames = F.array_sort(F.array_distinct(F.array_compact(F.array("strongest", "weakest", "seeded", fallback))))
    return rows.select("source_id", "id", required.alias("required"), frames.alias("frames"), F.coalesce("all_state_frames", F.array().cast("array<bigint>")).alias("all_state_frames"))


def uncovered(targets: DataFrame, seen: DataFrame, run_frames: DataFrame, by: list[str]) -> DataFrame:
    """The ``targets`` (by, frame_no) in whose run lies no frame of ``seen`` (by, frame_no), computed or not."""
    run = run_frames.where(F.col("digest").isNotNull()).select("source_id", "frame_no", "exact_start")
    states = seen.join(run, ["source_id", "frame_no"]).select(*by, "exact_start").distinct()
    placed = targets.join(run, ["source_id", "frame_no"], "left")
    return placed.join(states, [*by, "exact_start"], "left_anti").select(*by, "frame_no")


def coarse_reviewed(entries: DataFrame, assets: DataFrame, views: DataFrame, run_frames: DataFrame) -> DataFrame:
    """(source_id, id) of the intervals both of whose boundary frames their own reviewer saw, natively
    or in an overview, in full images that the interval cites; a frame of the same run will do."""
    by = ["source_id", "id"]
    bounds = entries.select(*by, F.explode(F.array_distinct(F.array("start_frame", "end_frame"))).alias("frame_no"))
    refs = entries.select(*by, F.col("reviewer").alias("actor"), F.explode("evidence").alias("asset_id"))
    missing = uncovered(bounds, seen_through(refs, assets, views, by, full=True), run_frames, by)
    return entries.select(*by).join(missing.select(*by).distinct(), by, "left_anti")


def seen_through(refs: DataFrame, assets: DataFrame, views: DataFrame, by: list[str], native: bool = False, full: bool = False) -> DataFrame:
    """(by, frame_no) that the ``actor`` of each row of ``refs`` (by, actor, asset_id) saw through its asset."""
    a = assets.where("kind = 'full'") if full else assets
    v = views.where("presentation = 'native'") if native else views
    a = a.select("source_id", F.col("id").alias("asset_id"), "frame_no", F.col("sha256").alias("asset_sha256"))
    seen = v.select("source_id", "asset_id", "frame_no", "actor", "asset_sha256").distinct()
    return refs.join(a, ["source_id", "asset_id"]).join(seen, ["source_id", "asset_id", "frame_no", "actor", "asset_sha256"], "left_semi").select(*by, "frame_no").distinct()
