"""The layered audit: intervals, their fine review, samples, and the review of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import nonblank_list
from ..operators import evidence as ev
from ..operators import intervals as iv
from ..sources.ledger import Ledger
from ..sources.tables import staged
from .audit import NONE, _refs, cited, current_review, finding, operation_steps, review_common, transitions, union, unresolved_issues

ROLES = ("before", "during", "after")
BY = ["source_id", "id"]


def _bounds(*extra: str):
    return F.array("start_frame", "end_frame", *extra)


def step_problems(led: Ledger) -> DataFrame:
    """(source_id, step_id, code, complete) of what a step's roles lack, whatever interval names it.

    ``complete`` marks codes that only count where a finished review is required.
    """
    steps = led.steps.withColumnRenamed("id", "step_id")
    held = F.lit(True)
    for role in ROLES:
        held = held & nonblank_list(F.try_element_at("role_evidence", F.lit(role)))
    with_roles = steps.where(F.coalesce(held, F.lit(False)))
    no_roles = steps.join(with_roles.select("source_id", "step_id"), ["source_id", "step_id"], "left_anti")
    refs = with_roles.select("source_id", "step_id", "author", "start_frame", "end_frame", "evidence", F.explode(F.map_filter("role_evidence", lambda k, _: k.isin(*ROLES))).alias("role", "refs"))
    undeclared = refs.where(F.size(F.array_except("refs", "evidence")) > 0)
    each = refs.select("source_id", "step_id", "role", F.col("author").alias("actor"), "start_frame", "end_frame", F.explode("refs").alias("asset_id"))
    at = led.assets.select("source_id", F.col("id").alias("asset_id"), "frame_no")
    by = ["source_id", "step_id", "role"]
    # written in steps: the driver holds all stages of a plan, and plans it anew after each
    placed = staged(each.join(at, ["source_id", "asset_id"]).select(*by, "frame_no", "start_frame", "end_frame").distinct(), "placed")
    seen = ev.seen_through(each.select(*by, "actor", "asset_id"), led.assets, led.views, by, native=True)
    code = lambda rows, name, complete=False: rows.select("source_id", "step_id", F.lit(name).alias("code"), F.lit(complete).alias("complete"))
    unseen = staged(code(placed.join(seen, [*by, "frame_no"], "left_anti"), "operation_native_view_missing"), "unseen")
    empty = refs.select(*by).join(placed.select(*by).distinct(), by, "left_anti")
    order = placed.groupBy("source_id", "step_id").agg(*(f(F.when(F.col("role") == r, F.col("frame_no"))).alias(f"{n}_{r}") for r in ROLES for f, n in ((F.min, "min"), (F.max, "max"))))
    wrong = order.where("min_before is not null and min_during is not null and min_after is not null").where("not (max_before <= min_during and max_during <= min_after)")
    unsettled = with_roles.where(~F.col("status").eqNullSafe("confirmed") | (F.size("uncertainties") > 0))
    return staged(union(
        code(no_roles, "operation_roles_missing"), code(undeclared, "role_evidence_not_declared"), code(empty, "operation_native_view_missing"), unseen,
        code(placed.where("frame_no < start_frame or frame_no > end_frame"), "role_evidence_outside_step"), code(wrong, "operation_role_order"), code(unsettled, "operation_unresolved", True),
    ).distinct(), "step-problems")


def fine_problems(led: Ledger) -> DataFrame:
    """(source_id, id, code, complete) of each interval's fine review.

    An interval that is no operation or was never finely reviewed has that problem only.
    """
    entries = led.intervals
    begun = (F.col("disposition") == "operation") & (F.col("fine_status") != "not_reviewed")
    open_ = entries.where(begun)
    named = open_.select("source_id", "id", "start_frame", "end_frame", F.explode("step_ids").alias("step_id"))
    steps = led.steps.select("source_id", F.col("id").alias("step_id"), F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"), F.lit(True).alias("there"))
    issues = unresolved_issues(led.issues)
    links = iv.linked_steps(issues.select("source_id", F.col("id").alias("issue_id"), "step_ids", F.col("start_frame").alias("start"), F.col("end_frame").alias("end")), led.steps.select("source_id", F.col("id").alias("step_id"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end")), ["source_id"])
    linked = staged(links.select("source_id", "step_id").distinct(), "linked")
    doubtful = named.join(linked, ["source_id", "step_id"], "left_semi").select(*BY)
    direct = open_.select(*BY, F.explode("issue_ids").alias("issue_id")).join(issues.select("source_id", F.col("id").alias("issue_id")), ["source_id", "issue_id"], "left_semi").select(*BY)
    code = lambda rows, name, complete=False: rows.select(*BY, F.lit(name).alias("code"), F.lit(complete).alias("complete"))
    doubts = staged(code(doubtful.unionByName(direct).distinct(), "operation_issue_unresolved", True), "doubts")
    held = staged(named.join(steps, ["source_id", "step_id"], "left"), "held")
    return staged(union(
        code(entries.where(~begun), "operation_not_fine_reviewed"), code(open_.where("fine_status <> 'reviewed'"), "operation_not_fine_reviewed", True),
        doubts, code(held.where("there is null"), "interval_step_missing"),
        code(held.where("lo < start_frame or hi > end_frame or lo > hi"), "step_outside_interval"), held.join(step_problems(led), ["source_id", "step_id"]).select(*BY, "code", "complete"),
    ).distinct(), "fine-problems")


def coverage(led: Ledger) -> DataFrame:
    """Per source: lengths and ranges of coarsely reviewed, finely examined and finely reviewed
    intervals between first and last frame, distinct operation steps, approximate merges."""
    entries = led.intervals
    coarse = staged(ev.coarse_reviewed(entries, led.assets, led.views, led.frames), "coarse")
    problems = fine_problems(led)
    spans = entries.select("source_id", "id", F.col("start_frame").alias("start"), F.col("end_frame").alias("end")).join(coarse, BY, "left_semi")
    kinds = {"coarse": spans, "fine": spans.join(problems, BY, "left_anti"), "examined": spans.join(problems.where("not complete"), BY, "left_anti")}
    bounds = led.frames.groupBy("source_id").agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"))
    out = bounds.select("source_id")
    listed = lambda df, name: df.groupBy("source_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias(f"{name}_frames"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias(f"{name}_ranges"))
    for name, some in kinds.items():
        merged = staged(iv.union(some, ["source_id"]), f"{name}-spans")
        gaps = iv.complement(merged, bounds, ["source_id"])
        out = out.join(listed(merged, name), "source_id", "left").join(listed(gaps, f"not_{name}"), "source_id", "left").drop(f"not_{name}_frames")
    units = entries.select("source_id", F.explode("step_ids").alias("s")).groupBy("source_id").agg(F.count_distinct("s").alias("candidate_operation_units"))
    merges = entries.groupBy("source_id").agg(F.count_if(F.col("merge") == "approximate").alias("approximate_merge_intervals"))
    out = out.join(units, "source_id", "left").join(merges, "source_id", "left")
    return out.fillna(0, [f"{n}_frames" for n in kinds] + ["candidate_operation_units", "approximate_merge_intervals"])


def intervals(led: Ledger) -> DataFrame:
    """Findings of the intervals themselves and of their fine review."""
    entries, frames = led.intervals, _bounds()
    ends = led.frames.groupBy("source_id").agg(F.lit(0).cast("long").alias("lo"), F.max("frame_no").alias("hi"))
    spans = entries.select("source_id", "id", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    gaps = iv.complement(iv.union(spans, ["source_id"]), ends, ["source_id"])
    mapped = ev.mapping(led.frames, entries).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    several = entries.join(mapped.where("n > 1"), BY)
    known = led.issues.select("source_id", F.col("id").alias("issue"))
    doubts = entries.select(*BY, "start_frame", "end_frame", F.explode("issue_ids").alias("issue"))
    operations = entries.where("disposition = 'operation'")
    problems = operations.join(fine_problems(led), BY)
    steps = led.steps.select("source_id", F.col("id").alias("step_id"), "author", "evidence")
    named = operations.select(*BY, "start_frame", "end_frame", F.explode("step_ids").alias("step_id")).join(steps, ["source_id", "step_id"])
    refs = named.select(*BY, "step_id", "start_frame", "end_frame", F.col("author").alias("actor"), F.explode("evidence").alias("asset_id"))
    by = [*BY, "step_id", "asset_id"]
    seen = ev.seen_through(refs.select(*by, "actor"), led.assets, led.views, by, native=True)
    return union(
        finding(gaps, "interval_gap", "start", F.array("start", "end"), "coverage"),
        finding(iv.overlaps_running(spans, ["source_id"], ["start", "end", "id"]), "interval_overlap", "id", F.array("start"), "coverage"),
        cited(_refs(entries, F.col("id"), "evidence", frames), led, "coverage"),
        finding(entries.join(ev.coarse_reviewed(entries, led.assets, led.views, led.frames), BY, "left_anti"), "interval_overview_missing", "id", frames, "coverage", interval_id="id"),
        finding(several.where("merge = 'exact'"), "false_exact_merge", "id", frames, "coverage", interval_id="id"),
        finding(several.where("merge = 'none' and disposition <> 'operation'"), "merge_reason_missing", "id", frames, "coverage", interval_id="id"),
        finding(doubts.join(known, ["source_id", "issue"], "left_anti"), "interval_issue_missing", "id", frames, "coverage"),
        finding(entries.where("disposition = 'uncertain'"), "interval_uncertain", "id", frames, "coverage"),
        finding(problems.select(*BY, "code", "start_frame", "end_frame").distinct(), F.col("code"), "id", frames, "fine", interval_id="id"),
        finding(refs.join(seen, by, "left_anti"), "operation_native_view_missing", "step_id", frames, "fine"),
        handoffs(led),
    )


def handoffs(led: Ledger) -> DataFrame:
    """Findings of steps of operations that take or leave files and have no state of one."""
    keys = F.array_union(F.coalesce(F.map_keys("transition.before"), F.array()), F.coalesce(F.map_keys("transition.after"), F.array()))
    steps = led.steps.where((F.size("input_files") > 0) | (F.size("output_files") > 0)).where(~F.exists(keys, lambda k: F.startswith(k, F.lit("file:"))))
    named = led.intervals.where("disposition = 'operation'").select("source_id", "start_frame", "end_frame", F.explode("step_ids").alias("step_id"))
    handed = named.join(steps.select("source_id", F.col("id").alias("step_id")), ["source_id", "step_id"])
    return finding(handed, "file_handoff_state_missing", "step_id", _bounds(), "continuity")


def samples(led: Ledger, checks: DataFrame) -> DataFrame:
    """Findings of interval checks.

    ``checks``: source_id, id, interval_id, reviewer, scope_hash, method, conclusion, evidence,
    resolves, source_scope_frames. A check is current while its scope hash is the interval's.
    A clear, exhaustive check closes an earlier anomaly if its reviewer saw that anomaly's
    original states; of another interval only if that interval comes first.
    """
    need = led.sampled.select(*BY, "start_frame", "end_frame", F.col("scope_hash").alias("now"), "required", "frames", "all_state_frames")
    need = need.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy("start_frame", "end_frame", "id"))).withColumnRenamed("id", "interval_id")
    need = staged(need, "need")
    own = checks.join(need, ["source_id", "interval_id"])
    current = own.where("scope_hash = now").withColumn("targets", F.when(F.col("method") == "exhaustive", F.col("all_state_frames")).otherwise(F.col("frames")))
    current = staged(current, "current-checks")
    seen = ev.seen_through(current.select(*BY, F.col("reviewer").alias("actor"), F.explode("evidence").alias("asset_id")), led.assets, led.views, BY, native=True, full=True)
    seen = staged(seen, "check-views")
    lacking = ev.uncovered(current.select(*BY, F.explode("targets").alias("frame_no")), seen, led.frames, BY).select(*BY).distinct()
    lacking = staged(lacking, "lacking")
    valid = current.where("conclusion = 'clear'").join(lacking, BY, "left_anti")
    old = checks.select("source_id", F.col("id").alias("ref"), F.col("conclusion").alias("was"), F.col("source_scope_frames").alias("prior"))
    answers = valid.select(*BY, "method", "rank", F.explode("resolves").alias("ref")).join(old, ["source_id", "ref"], "left")
    by = [*BY, "ref"]
    left = ev.uncovered(answers.select(*by, F.explode("prior").alias("frame_no")), answers.select(*by).join(seen, BY), led.frames, by).select(*by).distinct().withColumn("left", F.lit(True))
    judged = staged(answers.join(left, by, "left"), "answers")
    good = F.coalesce((F.col("method") == "exhaustive") & (F.col("was") == "expand") & (F.size("prior") > 0) & F.col("left").isNull(), F.lit(False))
    closed = judged.where(good).groupBy("source_id", F.col("ref").alias("id")).agg(F.min("rank").alias("closed_at"))
    flags = own.groupBy("source_id", "interval_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("scope_hash = now")).alias("n_current"), F.count_if(F.expr("scope_hash = now and conclusion = 'expand'")).alias("n_expand"))
    n_valid = valid.groupBy("source_id", "interval_id").agg(F.count(F.lit(1)).alias("n_valid"))
    state = need.join(flags, ["source_id", "interval_id"], "left").join(n_valid, ["source_id", "interval_id"], "left").fillna(0, ["n", "n_current", "n_expand", "n_valid"])
    wide = F.concat(F.array(F.col("start_frame") - 1), "all_state_frames", F.array(F.col("end_frame") + 1))
    anomalies = own.where("conclusion = 'expand'").join(closed, BY, "left").where("closed_at is null or closed_at > rank")
    retired = checks.where("conclusion = 'expand'").join(need.select("source_id", "interval_id"), ["source_id", "interval_id"], "left_anti").join(closed, BY, "left_anti")
    return union(
        cited(_refs(current, F.col("id"), "evidence", F.col("frames")), led, "sampling"),
        finding(current.join(lacking, BY, "left_semi"), "sample_evidence_incomplete", "id", F.col("targets"), "sampling"),
        finding(judged.where(~good), "expansion_scope_incomplete", "id", F.coalesce("prior", F.expr(NONE)), "sampling"),
        finding(state.where("n > 0 and n_current = 0"), "interval_sample_stale", "interval_id", F.col("frames"), "sampling"),
        finding(state.where("required and n_current = 0"), "interval_sample_missing", "interval_id", F.col("frames"), "sampling"),
        finding(state.where("required and n_current > 0 and n_valid = 0 and n_expand = 0"), "interval_sample_incomplete", "interval_id", F.col("frames"), "sampling"),
        finding(anomalies, "sample_requires_expansion", "id", wide, "sampling"), finding(retired, "retired_interval_anomaly", "id", stage="sampling"),
    )


def layered(led: Ledger, checks: DataFrame) -> DataFrame:
    """All findings before the review of the layered records."""
    operations = led.intervals.where("disposition = 'operation'")
    return union(
        intervals(led), samples(led, checks), transitions(led, operation_steps(operations)), finding(unresolved_issues(led.issues), "unresolved_issue", "id", F.array("start_frame", "end_frame"))
    )


def covered_assets(targets: DataFrame, refs: DataFrame, led: Ledger, by: list[str]) -> DataFrame:
    """The ``targets`` (by, asset_id) that the actor's ``refs`` (by, actor, ref) cover natively.

    An asset is covered by itself, or by one of the same run whose region in the source image
    holds its own. Regions of crops follow their chain of parents; broken chains have none.
    """
    a = led.assets.select("source_id", "id", "frame_no", "kind", "parent_id")
    size = led.frames.where(F.col("digest").isNotNull()).select("source_id", "frame_no", "exact_start", "width", "height")
    whole = a.where("kind = 'full' and parent_id is null").join(size, ["source_id", "frame_no"]).where("width > 0 and height > 0")
    zero = F.lit(0).cast("int")
    full = whole.select("source_id", "id", zero.alias("x0"), zero.alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    regions = full.unionByName(ev.crop_regions(led.assets)).join(a.select("source_id", "id", "frame_no"), BY).join(size.select("source_id", "frame_no", "exact_start"), ["source_id", "frame_no"]).drop("frame_no")
    seen = led.views.where("presentation = 'native'").join(a.select("source_id", F.col("id").alias("asset_id"), "frame_no"), ["source_id", "asset_id", "frame_no"])
    seen = seen.join(led.assets.select("source_id", F.col("id").alias("asset_id"), F.col("sha256").alias("asset_sha256")), ["source_id", "asset_id", "asset_sha256"], "left_semi")
    shown = refs.join(seen.select("source_id", F.col("asset_id").alias("ref"), "actor").distinct(), ["source_id", "ref", "actor"]).select(*by, "ref").distinct()
    same = targets.join(shown.withColumnRenamed("ref", "asset_id"), [*by, "asset_id"], "left_semi")
    inner = targets.join(regions.withColumnRenamed("id", "asset_id"), ["source_id", "asset_id"])
    outer = shown.join(regions.select("source_id", F.col("id").alias("ref"), "exact_start", *(F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1"))), ["source_id", "ref"])
    held = inner.join(outer, [*by, "exact_start"]).where("ox0 <= x0 and oy0 <= y0 and ox1 >= x1 and oy1 >= y1")
    return same.unionByName(held.select(*same.columns)).distinct()


def layered_review(led: Ledger, reviews: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Findings of the reviews of the layered records.

    ``reviews``: checked_interval_ids in place of states. The reviewer must have seen both
    bounds of every interval in full, its required sample natively, and the regions of
    every role's evidence.
    """
    review, out = current_review(led.frames.select("source_id").distinct(), reviews, snapshots)
    entries = led.intervals
    ids = entries.groupBy("source_id").agg(F.array_sort(F.collect_set("id")).alias("all_ids"))
    scope = review.join(ids, "source_id", "left").where(F.array_sort(F.array_distinct("checked_interval_ids")) != F.coalesce("all_ids", F.array().cast("array<string>")))
    who = review.select("source_id", F.col("reviewer").alias("actor"), F.explode("evidence").alias("asset_id"))
    due = staged(led.sampled.join(review.select("source_id"), "source_id", "left_semi"), "due")
    targets = F.when(F.col("required"), F.col("frames")).otherwise(F.expr(NONE))

    def lacking(frames, native):
        seen = ev.seen_through(who, led.assets, led.views, ["source_id"], native=native, full=True)
        return ev.uncovered(due.select("source_id", F.explode(frames).alias("frame_no")).distinct(), seen, led.frames, ["source_id"])

    asked = lambda frames: due.select(*BY, F.explode(frames).alias("frame_no"))
    bad = asked(_bounds()).join(lacking(_bounds(), False), ["source_id", "frame_no"], "left_semi").select(*BY).unionByName(asked(targets).join(lacking(targets, True), ["source_id", "frame_no"], "left_semi").select(*BY)).distinct()
    roles = led.steps.select("source_id", F.col("id").alias("step_id"), F.explode(F.flatten(F.map_values("role_evidence"))).alias("asset_id")).distinct()
    roles = staged(roles, "roles")
    wanted = due.select(*BY, F.explode("step_ids").alias("step_id")).join(roles, ["source_id", "step_id"]).join(led.assets.select("source_id", F.col("id").alias("asset_id"), "frame_no"), ["source_id", "asset_id"])
    refs = who.select("source_id", "actor", F.col("asset_id").alias("ref"))
    covered = covered_assets(wanted.select("source_id", "asset_id").distinct(), refs, led, ["source_id"])
    blind = wanted.join(covered, ["source_id", "asset_id"], "left_anti").select(*BY).distinct()
    views = wanted.groupBy(*BY).agg(F.array_sort(F.collect_set("frame_no")).alias("f")).join(blind, BY, "left_semi")
    authors = led.steps.select("source_id", "author").unionByName(entries.select("source_id", F.col("reviewer").alias("author")))
    missing = due.select(*BY, F.array_union(_bounds(), targets).alias("f")).join(bad, BY, "left_semi")
    return union(
        out, review_common(review, led, authors), finding(scope, "review_scope_incomplete", "id", stage="review"),
        finding(missing, "reviewer_view_missing", "id", F.col("f"), "review"), finding(views, "reviewer_fine_view_missing", "id", F.col("f"), "review"),
    )

