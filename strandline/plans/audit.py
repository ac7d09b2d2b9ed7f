"""Integrity checks and the strict audit: each rule turns DataFrames into findings.

Findings: source_id, code, stage, reference, frames, attrs (map of texts). ``located`` adds which of the frames
are computed and their time range. A source without findings passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, nonblank, nonblank_list
from ..operators import records
from ..sources.ledger import Ledger
from ..sources.tables import staged

NONE = "cast(array() as array<bigint>)"
FACTS = {"confirmation": "confirmation_gap", "result": "result_gap"}


def finding(rows: DataFrame, code: str | Column, reference: str, frames: Column | None = None, stage: str = "records", **attrs: str | Column) -> DataFrame:
    """``attrs`` says more, by name: above all whose finding it is (``step_id``, ``previous_step``, ``next_step``)."""
    code = F.lit(code) if isinstance(code, str) else code
    pairs = [x for n, v in attrs.items() for x in (F.lit(n), (F.col(v) if isinstance(v, str) else v).cast("string"))]
    told = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    return rows.select("source_id", code.alias("code"), F.lit(stage).alias("stage"), F.col(reference).cast("string").alias("reference"), (F.expr(NONE) if frames is None else frames.cast("array<bigint>")).alias("frames"), told.alias("attrs"))


def union(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def located(findings: DataFrame, frames: DataFrame) -> DataFrame:
    """``findings`` with suggested_frames (those of ``frames`` that are computed) and their first and last time."""
    known = frames.where(F.col("digest").isNotNull()).select("source_id", F.col("frame_no").alias("n"), "time_s")
    attrs = F.col("attrs") if "attrs" in findings.columns else F.expr("cast(map() as map<string,string>)")
    each = findings.select("source_id", "code", "stage", "reference", "frames", attrs.alias("attrs"), F.explode_outer(F.array_distinct("frames")).alias("n")).join(known.withColumn("__known", F.lit(True)), ["source_id", "n"], "left")
    hit = F.when(F.col("__known"), F.col("n"))
    return each.groupBy("source_id", "code", "stage", "reference", "frames", F.to_json("attrs").alias("__attrs")).agg(F.any_value("attrs").alias("attrs"), F.array_sort(F.collect_set(hit)).alias("suggested_frames"), F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time")).drop("__attrs")


def summary(findings: DataFrame) -> DataFrame:
    """Per source: number of findings, sorted distinct suggested frames, first and last time."""
    return findings.groupBy("source_id").agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("suggested_frames")))).alias("suggested_frames"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def requests(findings: DataFrame, prefix: str = "audit:") -> DataFrame:
    """The suggested frames as requests of origin ``audit``."""
    return findings.select("source_id", F.explode("suggested_frames").alias("frame_no"), F.concat(F.lit(prefix), "code").alias("reason"), F.lit("audit").alias("origin")).distinct()


# --- what was seen ---------------------------------------------------------------------


def cited(refs: DataFrame, led: Ledger, stage: str) -> DataFrame:
    """Findings of cited evidence that is unknown or was never validly seen. ``refs``: source_id, reference, id, frames
    and, where the reference belongs to a step, step_id."""
    known, seen = (t.withColumn(n, F.lit(True)) for t, n in ((led.known, "__known"), (led.seen, "__seen")))
    told = refs.join(known, ["source_id", "id"], "left").join(seen, ["source_id", "id"], "left").where("__known is null or __seen is null")
    return finding(told, F.when(F.col("__known").isNull(), "audit_evidence_missing").otherwise("audit_evidence_unreviewed"), "reference", F.col("frames"), stage, **({"step_id": "step_id"} if "step_id" in refs.columns else {}))


def _refs(rows: DataFrame, reference: Column, evidence: str | Column, frames: Column, step: str | None = None) -> DataFrame:
    owner = [F.col(step).alias("step_id")] if step else []
    return rows.select("source_id", reference.alias("reference"), F.explode(evidence).alias("id"), frames.cast("array<bigint>").alias("frames"), *owner)


# --- record integrity ------------------------------------------------------------------


def validate(led: Ledger, sheets: DataFrame | None = None) -> DataFrame:
    """Reference integrity of assets, views, steps and issues.

    ``sheets``: source_id, id, intact (the file has its recorded hash), members array of
    (asset_id, source_sha256); views of presentation ``overview`` need a member of an intact one.
    """
    steps, assets, views = led.steps, led.assets, led.views
    bounds = steps.select("source_id", "id", F.explode(F.array("start_frame", "end_frame")).alias("frame_no"))
    proof = F.when(F.col("resolution").isNotNull(), F.coalesce("resolution.evidence", F.array().cast("array<string>")))
    refs = steps.select("source_id", F.col("id").alias("owner"), F.explode("evidence").alias("id")).unionByName(led.issues.select("source_id", F.col("id").alias("owner"), F.explode(F.array_distinct(proof)).alias("id")))
    known = led.known
    told = nonblank(F.col("trace_ref")) & nonblank(F.col("observation"))
    right = led.valid_views
    seen = right.where(told).select("source_id", F.col("asset_id").alias("id")).distinct()
    parents = assets.select("source_id", F.col("id").alias("parent_id"), "frame_no")
    wrong = views.join(right.select("source_id", "id").distinct(), ["source_id", "id"], "left_anti")
    out = [
        finding(bounds.join(led.frames.select("source_id", "frame_no"), ["source_id", "frame_no"], "left_anti"), "unknown_frame", "id"),
        finding(steps.where(F.size("evidence") <= 0), "missing_evidence", "id"),
        finding(refs.join(known, ["source_id", "id"], "left_anti"), "unknown_evidence", "owner"),
        finding(refs.join(known, ["source_id", "id"], "left_semi").join(seen, ["source_id", "id"], "left_anti"), "unreviewed_evidence", "owner"),
        finding(wrong, "bad_view_reference", "id"),
        finding(right.where(~told), "missing_view_trace", "id"),
        finding(assets.where(F.col("parent_id").isNotNull()).join(parents, ["source_id", "parent_id", "frame_no"], "left_anti"), "bad_crop_parent", "id"),
    ]
    if sheets is not None:
        panels = sheets.where("intact").select("source_id", F.col("id").alias("sheet_id"), F.explode("members").alias("m")).select("source_id", "sheet_id", F.col("m.asset_id").alias("asset_id"), F.col("m.source_sha256").alias("asset_sha256"))
        out.append(finding(views.where("presentation = 'overview'").join(panels, ["source_id", "sheet_id", "asset_id", "asset_sha256"], "left_anti"), "bad_sheet_view", "id"))
    return union(*out)


def asset_files(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of asset files. ``assets``: path (relative); ``files``: source_id, path, sha256 of what lies in the folder."""
    from ..functions.scalars import safe_path

    inside = safe_path(F.col("path"))
    joined = assets.where(inside).join(files.select("source_id", "path", F.col("sha256").alias("__now")), ["source_id", "path"], "left")
    return union(
        finding(assets.where(~inside), "unsafe_asset_path", "id"), finding(joined.where(F.col("__now").isNull()), "missing_asset", "id"),
        finding(joined.where(F.col("__now") != F.col("sha256")), "asset_hash_mismatch", "id"),
    )


def source_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of source media. ``sources``: path, sha256; ``files``: path, sha256, kind (null: container not accepted)."""
    now = files.select("path", F.col("sha256").alias("__now"), "kind", F.lit(True).alias("__there"))
    j = sources.join(now, "path", "left")
    code = (
        F.when(F.col("path").isNull() | F.col("__there").isNull(), "source_missing").when(F.col("__now").isNull(), "source_unreadable")
        .when(~F.col("__now").eqNullSafe(F.col("sha256")), "source_hash_mismatch").when(F.col("kind").isNull(), "source_unsupported_media_input")
    )
    return finding(j.withColumn("__code", code).where(F.col("__code").isNotNull()), F.col("__code"), "path")


# --- strict audit ----------------------------------------------------------------------


def account_states(led: Ledger) -> DataFrame:
    """States without coverage, and coverage without evidence, views, steps or issues that fit."""
    n, end = F.col("exact_start"), F.col("end_frame")
    near = F.array(n - 1, n, F.least(n + 1, end), end, end + 1)
    joined = led.states.select("source_id", "exact_start", "end_frame").join(led.coverage.withColumnRenamed("frame_no", "exact_start"), ["source_id", "exact_start"], "left").withColumn("near", near)
    joined = staged(joined, "accounted")
    held = joined.where("classification is not null")
    steps = led.steps.select("source_id", F.col("id").alias("step_id"), F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"))
    named = held.select("source_id", "exact_start", "end_frame", "near", F.explode("step_ids").alias("step_id"))
    doubts = held.select("source_id", "exact_start", "near", F.explode("issue_ids").alias("id"))
    run = led.frames.select("source_id", "frame_no", "exact_start")
    own = led.valid_views.where("kind = 'full' and presentation = 'native'").join(run, ["source_id", "frame_no"]).select("source_id", F.col("asset_id").alias("id"), "exact_start", F.col("actor").alias("reviewer")).distinct()
    shown = held.select("source_id", "exact_start", "reviewer", F.explode("evidence").alias("id")).join(own, ["source_id", "id", "exact_start", "reviewer"], "left_semi").select("source_id", "exact_start")
    frames = F.col("near")
    return union(
        finding(joined.where("classification is null"), "unaccounted_state", "exact_start", frames, "coverage"),
        cited(_refs(held, F.concat(F.lit("coverage:"), n.cast("string")), "evidence", frames), led, "coverage"),
        finding(held.join(shown, ["source_id", "exact_start"], "left_anti"), "state_full_view_missing", "exact_start", frames, "coverage"),
        finding(named.join(steps, ["source_id", "step_id"], "left_anti"), "coverage_step_missing", "exact_start", frames, "coverage"),
        finding(named.join(steps, ["source_id", "step_id"]).where("lo > end_frame or hi < exact_start"), "coverage_step_outside_state", "exact_start", frames, "coverage"),
        finding(doubts.join(led.issues.select("source_id", "id"), ["source_id", "id"], "left_anti"), "coverage_issue_missing", "exact_start", frames, "coverage"),
        finding(held.where("classification = 'uncertain'"), "state_unresolved", "exact_start", frames, "coverage"),
    )


def operation_steps(coverage: DataFrame) -> DataFrame:
    """(source_id, id) of steps that some operation state or interval names."""
    return coverage.select("source_id", F.explode("step_ids").alias("id")).distinct()


def facts(steps: DataFrame) -> DataFrame:
    """Facts of the before (phase 0) and after (phase 1) maps of steps with a whole transition.

    ``value`` is JSON text in canonical form; ``null`` is a recorded null. A fact without key,
    value or evidence is not ``usable``.
    """
    one = lambda name, n: steps.select("source_id", "id", "start_frame", "end_frame", "step_order", "near", F.lit(n).alias("phase"), F.lit(name).alias("phase_name"), F.explode(f"transition.{name}").alias("key", "f"))
    rows = one("before", 0).unionByName(one("after", 1))
    usable = nonblank(F.col("key")) & F.col("f.value").isNotNull() & nonblank_list(F.col("f.evidence"))
    return rows.select(*(c for c in rows.columns if c != "f"), canonical_json(F.col("f.value")).alias("value"), F.col("f.evidence").alias("evidence"), F.coalesce(usable, F.lit(False)).alias("usable"))


def transitions(led: Ledger, linked: DataFrame) -> DataFrame:
    """Continuity of the steps of each source in the order (start, end, id).

    A known value of a key holds until the next known one; nulls and unusable facts reset nothing.
    """
    order = W.partitionBy("source_id").orderBy("start_frame", "end_frame", "id")
    a, b = F.col("start_frame"), F.col("end_frame")
    steps = led.steps.withColumns({"step_order": F.row_number().over(order), "before_end": F.lag("end_frame").over(order), "near": F.array(a - 1, a, b, b + 1)})
    steps = staged(steps, "ordered-steps")
    frames, stage = F.col("near"), "continuity"
    t = F.col("transition")
    whole = t.isNotNull() & t["before"].isNotNull() & t["after"].isNotNull() & t["confirmation"].isNotNull() & t["result"].isNotNull()
    told = steps.where(whole)
    every = staged(facts(told), "facts")
    usable = every.where("usable")
    known = usable.where("value <> 'null'")
    w = W.partitionBy("source_id", "key").orderBy("step_order", "phase")
    jumps = known.withColumns({"last_value": F.lag("value").over(w), "last_end": F.lag("end_frame").over(w), "last_id": F.lag("id").over(w)}).where("phase = 0 and last_value <> value")
    final = F.try_element_at("final_parameters", F.col("key"))
    last = known.where("phase = 1").join(steps.select("source_id", "id", "final_parameters"), ["source_id", "id"]).withColumn("final", unwrapped(final))
    owner = F.concat_ws(".", "id", "phase_name", "key")
    out = [
        finding(steps.join(linked, ["source_id", "id"], "left_anti"), "step_without_state", "id", frames, stage, step_id="id"),
        finding(steps.where(~nonblank(F.col("author"))), "step_author_missing", "id", frames, stage, step_id="id"),
        finding(steps.where(~F.col("status").eqNullSafe("confirmed") | (F.size("uncertainties") > 0)), "step_unresolved", "id", frames, stage, step_id="id"),
        finding(steps.where("start_frame < before_end"), "step_ranges_overlap", "id", frames, stage, step_id="id"),
        finding(steps.where(~whole), "step_transition_missing", "id", frames, stage, step_id="id"),
        *(finding(told.where(F.size(f"transition.{p}") == 0), "step_state_missing", "id", frames, stage, step_id="id") for p in ("before", "after")),
        finding(every.where("not usable"), "state_fact_invalid", "id", frames, stage, step_id="id"),
        cited(_refs(usable, owner, "evidence", frames, "id"), led, stage),
        finding(usable.where("value = 'null'"), "state_value_unknown", "id", frames, stage, step_id="id"),
        finding(jumps, "state_discontinuity", "id", F.array("last_end", "start_frame"), stage, state_key="key", previous_step="last_id", next_step="id", previous_value="last_value", next_value="value"),
        finding(last.where("final <> 'null' and final <> value"), "final_parameter_mismatch", "id", frames, stage, step_id="id", parameter_key="key"),
    ]
    for role, code in FACTS.items():
        item = t[role]
        fit = item["status"].isin("observed", "not_applicable") & nonblank(item["note"]) & item["evidence"].isNotNull() & F.forall(item["evidence"], nonblank) & ((item["status"] != "observed") | (F.size(item["evidence"]) > 0))
        fit = F.coalesce(fit, F.lit(False))
        out += [finding(told.where(~fit), code, "id", frames, stage, step_id="id"), cited(_refs(told.where(fit), F.concat_ws(".", "id", F.lit(role)), item["evidence"], frames, "id"), led, stage)]
    return union(*out)


def unwrapped(value: Column) -> Column:
    """Canonical JSON of a parameter: of its ``value`` where it is an object."""
    v = F.try_parse_json(value)
    inner = F.coalesce(F.to_json(F.try_variant_get(v, "$.value", "variant")), F.lit("null"))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), inner).otherwise(F.to_json(v))


def unresolved_issues(issues: DataFrame) -> DataFrame:
    """Issues that are not resolved with proof."""
    return issues.where(~records.issue_is_resolved())


def strict(led: Ledger, invalid: DataFrame | None = None, unfinished: DataFrame | None = None) -> DataFrame:
    """All findings before the omission review. ``invalid``: findings of ``validate``;
    ``unfinished``: (source_id) whose scan is not complete."""
    open_ = unresolved_issues(led.issues)
    out = [account_states(led), transitions(led, operation_steps(led.coverage.where("classification = 'operation'"))), finding(open_, "unresolved_issue", "id", F.array("start_frame", "end_frame"))]
    if invalid is not None:
        out.append(finding(invalid.select("source_id", F.lit("records").alias("id")).distinct(), "record_consistency_failed", "id"))
    if unfinished is not None:
        out.append(finding(unfinished.select("source_id", F.lit("scan").alias("id")).distinct(), "full_scan_incomplete", "id"))
    return union(*out)


# --- omission reviews ------------------------------------------------------------------


def review_common(review: DataFrame, led: Ledger, authors: DataFrame) -> DataFrame:
    """Findings that reviews of both modes share. ``review``: the latest, current one of each source."""
    named = authors.select("source_id", F.col("author").alias("reviewer")).where("reviewer is not null").distinct()
    dependent = review.where("independence <> 'independent'").select("source_id", "id").unionByName(review.join(named, ["source_id", "reviewer"], "left_semi").select("source_id", "id")).distinct()
    traced = led.valid_views.where(nonblank(F.col("trace_ref")) & nonblank(F.col("observation"))).select("source_id", F.col("asset_id").alias("ref"), F.col("actor").alias("reviewer"), F.col("trace_ref").alias("trace"))
    real = review.select("source_id", "id", "reviewer", F.explode("evidence").alias("ref")).join(traced, ["source_id", "ref", "reviewer"]).select("source_id", "id", "trace").distinct()
    loose = review.select("source_id", "id", F.explode("tool_trace_refs").alias("trace")).join(real, ["source_id", "id", "trace"], "left_anti").select("source_id", "id").distinct()
    solved = led.issues.where(records.issue_is_resolved()).select("source_id", F.col("id").alias("issue"))
    doubts = review.select("source_id", "id", F.explode("issue_ids").alias("issue")).join(solved, ["source_id", "issue"], "left_anti")
    return union(
        finding(dependent, "reviewer_not_independent", "id", stage="review"), cited(_refs(review, F.col("id"), "evidence", F.expr(NONE)), led, "review"), finding(loose, "review_trace_unlinked", "id", stage="review"),
        finding(doubts, "review_issue_unresolved", "issue", stage="review"), finding(review.where("conclusion <> 'no_additional_omissions_found'"), "review_not_complete", "id", stage="review"),
    )


def current_review(sources: DataFrame, reviews: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the latest review of each source if it is of the current snapshot, findings of the others)."""
    last = records.latest(reviews, ["source_id"], [F.col("recorded_at").desc(), F.col("id").desc()])
    held = staged(last.join(snapshots.select("source_id", F.col("snapshot").alias("now")), "source_id", "left"), "reviews")
    fresh = F.col("snapshot").eqNullSafe(F.col("now"))
    missing = sources.join(held.select("source_id"), "source_id", "left_anti").withColumn("id", F.lit(None).cast("string"))
    return held.where(fresh).drop("now"), union(finding(missing, "omission_review_missing", "id", stage="review"), finding(held.where(~fresh), "omission_review_stale", "id", stage="review"))


def strict_review(led: Ledger, reviews: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Findings of the omission reviews: every state checked, and seen natively in full by the reviewer."""
    review, out = current_review(led.frames.select("source_id").distinct(), reviews, snapshots)
    states = led.states.select("source_id", "exact_start", "end_frame")
    checked = review.select("source_id", "id", F.explode("checked_state_frames").alias("exact_start")).distinct()
    due = review.select("source_id", "id", "reviewer").join(states, "source_id")
    unchecked = due.join(checked, ["source_id", "id", "exact_start"], "left_anti").groupBy("source_id", "id").agg(F.array_sort(F.collect_set("exact_start")).alias("f"))
    extra = checked.join(states, ["source_id", "exact_start"], "left_anti").select("source_id", "id").distinct()
    scope = extra.join(unchecked, ["source_id", "id"], "full_outer").withColumn("f", F.coalesce("f", F.expr(NONE)))
    run = led.frames.select("source_id", "frame_no", "exact_start")
    full = led.valid_views.where("kind = 'full' and presentation = 'native'").select("source_id", F.col("asset_id").alias("ref"), F.col("actor").alias("reviewer"), "frame_no")
    seen = review.select("source_id", "id", "reviewer", F.explode("evidence").alias("ref")).join(full, ["source_id", "ref", "reviewer"]).join(run, ["source_id", "frame_no"]).select("source_id", "id", "exact_start").distinct()
    n, end = F.col("exact_start"), F.col("end_frame")
    unseen = due.join(seen, ["source_id", "id", "exact_start"], "left_anti")
    authors = led.steps.select("source_id", "author").unionByName(led.coverage.select("source_id", F.col("reviewer").alias("author")))
    return union(
        out, review_common(review, led, authors), finding(scope, "review_scope_incomplete", "id", F.col("f"), "review"),
        finding(unseen, "reviewer_view_missing", "exact_start", F.array(n - 1, n, F.least(n + 1, end), end, end + 1), "review"),
    )


def gate(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """(source_id, findings, passed)."""
    n = findings.groupBy("source_id").agg(F.count(F.lit(1)).alias("findings"))
    return sources.select("source_id").distinct().join(n, "source_id", "left").fillna(0, ["findings"]).withColumn("passed", F.col("findings") == 0)
