"""Queries of sources, contracts, corrections, identity and presentation, each with its SQL.

Records are made from the driver's tables by plain rules on the events' payload number ``k``; the
SQL states what each rule must lead to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import presentation as pr
from ..functions import scalars as sc
from ..operators import contracts as ct
from ..operators import evidence as ev
from ..operators import frames as fr
from ..operators import identity as idn
from ..operators import intervals as iv
from ..operators import records as rc
from ..sources import adapters as ad
from ..sources import sinks, store
from ..sources.tables import staged
from ..streaming import budget
from . import audit, report, supplements
from . import status as st
from .catalog import _FRAMES, _RUNS, _frames, _runs, _text, query
from .ledger_queries import _SHOW, INTERVALS, LEDGER, STRICT, _ledger

_K = "(props->>'k')::BIGINT"


def _events(spark, d, wrap: int | None = None):
    """All events with their payload number ``k``; with ``wrap`` its remainder, which picks one of so many cases."""
    k = F.get_json_object("props", "$.k").cast("long")
    return ad.table(spark, d, "events").withColumn("k", k % wrap if wrap else k)


def _pick(values: list[str], base: str):
    """Text ``values[k]`` of an event, ``base`` beyond the list."""
    return F.coalesce(F.get(F.array(*(F.lit(v) for v in values)), F.col("k").cast("int")), F.lit(base))


def _case(values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE k {whens} END"


# --- contracts -------------------------------------------------------------------------


def _faulty(base: dict, changes: list[tuple[str, str] | str]):
    """JSON texts with one fault each: (old, new) replaced in the sound text, or a whole text."""
    import json

    sound = json.dumps(base)
    out = []
    for c in changes:
        if isinstance(c, str):
            out.append(c)
            continue
        if c[0] not in sound:
            raise ValueError(c)
        out.append(sound.replace(c[0], c[1], 1))
    return out, sound


_STEP = {
    "id": "S1", "phase": "p", "start_frame": 3, "end_frame": 9, "software": "s", "module": "m", "menu_path": ["a"], "selected_objects": [], "final_parameters": {"A": 1}, "confirmation_action": "c", "visible_result": "v",
    "input_files": [], "output_files": [], "evidence": ["f1", "f2"], "uncertainties": [], "status": "confirmed", "author": "ann", "role_evidence": {"before": ["f1"]},
    "transition": {"before": {"A": {"value": 1, "evidence": ["f1"]}}, "after": {}, "confirmation": {"status": "observed", "note": "n"}, "result": {"status": "x"}},
}
_STEP_FAULTS = [
    (('"phase": "p"', '"phase": 1'), "phase"), (('"start_frame": 3', '"start_frame": "3"'), "start_frame"), (('"start_frame": 3', '"start_frame": 10'), "start_frame/end_frame"), (('"status": "confirmed"', '"status": "done"'), "status"),
    (('"uncertainties": []', '"uncertainties": ["u"]'), "status/uncertainties"), (('"before": ["f1"]', '"before": ["f1", " "]'), "role_evidence"), (('"evidence": ["f1", "f2"]', '"evidence": ["f2"]'), "evidence"), (('"evidence": ["f1"]', '"evidence": "f1"'), "evidence"),
    (('"author": "ann"', '"author": 7'), "author"), (('"id": "S1"', '"id": "  "'), "id"), (('"after": {}', '"after": []'), "transition.after"), (('"A": {"value"', '" ": {"value"'), "transition.before"), (('"note": "n"', '"note": null'), "transition.confirmation"),
    (('"result": {"status": "x"}', '"result": 1'), "transition.result"), ("[]", "object"), ("{broken", "object"), (('"final_parameters": {"A": 1}', '"final_parameters": null'), "final_parameters"), (('"end_frame": 9', '"end_frame": 9.5'), "end_frame"),
    (('"phase": "p", ', ''), "phase"), (('"role_evidence": {"before": ["f1"]}', '"role_evidence": []'), "role_evidence"),
]


def _contract(spark, d, base, faults, rules):
    texts, sound = _faulty(base, [f for f, _ in faults])
    rows = _events(spark, d).select("event_id", _pick(texts, sound).alias("payload"))
    return ct.violations(rows, *rules()).select("event_id", "code")


def _expected(faults) -> str:
    return f"SELECT event_id, code FROM (SELECT event_id, {_case([repr(c) for _, c in faults])} AS code FROM (SELECT *, {_K} AS k FROM events)) WHERE code IS NOT NULL"


@query(_expected(_STEP_FAULTS))
def rc_step(spark, d):
    return _contract(spark, d, _STEP, _STEP_FAULTS, ct.step_rules)


_ISSUE = {"id": "I1", "question": "q", "status": "resolved", "attempts": [], "start_frame": 1, "end_frame": None, "step_ids": ["S1"], "resolution": {"mode": "evidence", "reviewer": "b", "reason": "r", "evidence": ["f1"]}, "followup": {"claim": "c", "original_record_limit": "l", "reviewer": "b", "supplement_refs": [{"supplement_id": "s", "asset_id": "f1"}]}}
_ISSUE_FAULTS = [
    (('"question": "q"', '"question": ""'), "question"), (('"status": "resolved"', '"status": "closed"'), "status"), (('"attempts": []', '"attempts": {}'), "attempts"), (('"start_frame": 1', '"start_frame": -1'), "start_frame"), (('"end_frame": null', '"end_frame": 0'), "start_frame/end_frame"),
    (('"step_ids": ["S1"]', '"step_ids": [""]'), "step_ids"), (('"step_ids": ["S1"]', '"step_id": 5'), "step_id"), (('"mode": "evidence"', '"mode": "guess"'), "resolution"), (('"evidence": ["f1"]', '"evidence": []'), "resolution"), (('"mode": "evidence"', '"mode": "withdrawn"'), "resolution"),
    (('"claim": "c", ', ''), "followup"), (('[{"supplement_id": "s", "asset_id": "f1"}]', '[]'), "followup"), (('"evidence": ["f1"]', '"evidence": [1]'), "evidence"),
]


def _issue_sql() -> str:
    return _expected(_ISSUE_FAULTS) + f" UNION ALL SELECT event_id, 'resolution' FROM events WHERE {_K} = {len(_ISSUE_FAULTS) - 1}"


@query(_issue_sql())
def rc_issue(spark, d):
    return _contract(spark, d, _ISSUE, _ISSUE_FAULTS, ct.issue_rules)


@query(f"SELECT event_id, CASE WHEN {_K} IN (0, 2) THEN false ELSE {_K} <> 1 END AS resolved FROM events")
def rc_resolution(spark, d):
    texts, sound = _faulty(_ISSUE, [('"mode": "evidence"', '"mode": "withdrawn"'), ('"status": "resolved"', '"status": "open"'), ('"resolution": {"mode"', '"was": {"mode"')])
    rows = ct.parsed(_events(spark, d).select("event_id", _pick(texts, sound).alias("payload")))
    return rows.select("event_id", (F.try_variant_get("__v", "$.status", "string").eqNullSafe("resolved") & ct.resolved_with_proof()).alias("resolved"))


_AUX = {"frame_no": 4, "classification": "operation", "reason": "r", "reviewer": "b", "step_ids": ["S1"], "issue_ids": [], "evidence": ["f4"]}
_AUX_FAULTS = [(('"frame_no": 4', '"frame_no": 4.5'), "frame_no"), (('"operation"', '"other"'), "classification"), (('"reason": "r"', '"reason": " "'), "reason"), (('"step_ids": ["S1"]', '"step_ids": []'), "step_ids"), (('"operation"', '"uncertain"'), "issue_ids"), (('"evidence": ["f4"]', '"evidence": []'), "evidence")]


@query(_expected(_AUX_FAULTS))
def rc_aux(spark, d):
    return _contract(spark, d, _AUX, _AUX_FAULTS, ct.coverage_rules)


_LAYER = {"id": "P1", "start_frame": 0, "end_frame": 5, "phase": "p", "reason": "r", "reviewer": "b", "disposition": "operation", "merge": "exact", "fine_status": "reviewed", "evidence": ["f0"], "step_ids": ["S1"], "issue_ids": []}
_LAYER_FAULTS = [(('"end_frame": 5', '"end_frame": -5'), "start_frame/end_frame"), (('"merge": "exact"', '"merge": "all"'), "merge"), (('"fine_status": "reviewed"', '"fine_status": null'), "fine_status"), (('"step_ids": ["S1"]', '"step_ids": []'), "step_ids"), (('"operation"', '"uncertain"'), "issue_ids"), (('"phase": "p"', '"phase": "\\n"'), "phase")]


@query(_expected(_LAYER_FAULTS))
def rc_layer(spark, d):
    return _contract(spark, d, _LAYER, _LAYER_FAULTS, ct.interval_rules)


_REPRO = {"id": "R1", "reviewer": "b", "scope": "s", "environment": "e", "result": "r", "content_snapshot": "h", "outcome": "passed", "step_ids": ["S1"], "artifacts": [{"path": "a.png", "sha256": "0" * 64}]}
_REPRO_FAULTS = [(('"outcome": "passed"', '"outcome": "good"'), "outcome"), (('"step_ids": ["S1"]', '"step_ids": ["S1", "S1"]'), "step_ids"), (('"path": "a.png"', '"path": ""'), "artifacts"), (('"sha256": "0', '"sha256": "Z'), "artifacts"), (('"environment": "e", ', ''), "environment")]


@query(_expected(_REPRO_FAULTS))
def rc_repro(spark, d):
    return _contract(spark, d, _REPRO, _REPRO_FAULTS, ct.reproduction_rules)


_CONTEXT_FAULTS = [(('"question": "q"', '"question": 1'), "question"), (('["lang-1"]', '["lang-1", "lang-1"]'), "used_language_source_ids"), (('["lang-1"]', '"lang-1"'), "used_language_source_ids"), (('"next_action": "n"', '"next_action": ""'), "next_action")]


@query(_expected(_CONTEXT_FAULTS))
def rc_context(spark, d):
    return _contract(spark, d, {"question": "q", "scope": "s", "next_action": "n", "used_language_source_ids": ["lang-1"]}, _CONTEXT_FAULTS, ct.context_rules)


_REVIEW = {"id": "V1", "reviewer": "b", "note": "n", "independence": "independent", "snapshot": "a" * 64, "checked_state_frames": [0, 3], "evidence": ["f0"], "issue_ids": [], "tool_trace_refs": ["t"], "conclusion": "incomplete"}
_REVIEW_FAULTS = [(('"snapshot": "a', '"snapshot": "A'), "snapshot"), (("[0, 3]", "[0, 0]"), "checked_state_frames"), (("[0, 3]", "[0, -3]"), "checked_state_frames"), (('"tool_trace_refs": ["t"]', '"tool_trace_refs": []'), "tool_trace_refs"), (('"independent"', '"alone"'), "independence"), (('"incomplete"', '"done"'), "conclusion")]


@query(_expected(_REVIEW_FAULTS))
def rc_legacy(spark, d):
    """Stored rows are judged by the same rules, and by whether their id is their payload's."""
    texts, sound = _faulty(_REVIEW, [f for f, _ in _REVIEW_FAULTS])
    rows = _events(spark, d).select(F.col("user_id").alias("source_id"), F.lit("V1").alias("id"), "event_id", _pick(texts, sound).alias("payload"))
    return ct.violations(rows, *ct.review_rules()).select("event_id", "code")


@query(f"SELECT event_id, unnest(refs) AS ref FROM (SELECT event_id, CASE WHEN {_K} < 50 THEN ['a', 'b', 'c' || {_K}] ELSE ['b'] END AS refs FROM events)")
def rc_evidence(spark, d):
    deep = F.concat(F.lit('{"evidence": ["a"], "x": [{"y": {"evidence": ["b", "a"]}}, [[{"evidence": ["c'), F.col("k").cast("string"), F.lit('"]}]]]}'))
    rows = _events(spark, d).select("event_id", F.when(F.col("k") < 50, deep).otherwise('{"z": {"evidence": ["b"]}, "evidences": ["no"]}').alias("payload"))
    return rows.select("event_id", F.explode(ct.evidence_in("payload")["refs"]).alias("ref"))


_TRACES = ["shot.PNG", "abc", "f000000001", "session://x/y.jpg", " ", "read_image#1"]


@query(f"SELECT event_id, CASE WHEN k = 4 THEN 'blank' WHEN k <= 3 THEN 'trace' WHEN k = 6 THEN 'tool' END AS problem FROM (SELECT event_id, {_K} % 7 AS k FROM events)")
def rc_view(spark, d):
    rows = _events(spark, d, 7).withColumn("trace", _pick(_TRACES, "read_image#2"))
    tool = F.when(F.col("k") == 6, "eyes").otherwise("read_image")
    return rows.select("event_id", ct.view_problem(tool, F.lit("ann"), F.col("trace"), F.lit("seen"), F.lit("f000000001"), F.lit("evidence/f1.png")).alias("problem"))


@query(f"SELECT event_id, CASE WHEN {_K} < 10 THEN 'unknown_sheet' WHEN {_K} < 20 THEN 'blank' WHEN {_K} < 30 THEN 'not_in_sheet' ELSE 'source_changed' END AS code FROM events WHERE {_K} < 40")
def rc_sheet_view(spark, d):
    k = F.col("k")
    rows = _events(spark, d).withColumn("source_id", F.col("user_id"))
    views = rows.select("source_id", "event_id", F.when(k < 10, "gone").otherwise("sheet").alias("sheet_id"), F.when(k.between(20, 29), "f9").otherwise("f1").alias("asset_id"), F.when(k.between(30, 39), "new").otherwise("old").alias("sha256"), F.lit("ann").alias("actor"), F.lit("t").alias("trace_ref"), F.when(k.between(10, 19), "").otherwise("seen").alias("observation"))
    sheets = rows.select("source_id").distinct().select("source_id", F.lit("sheet").alias("id"), F.array(F.struct(F.lit("f1").alias("asset_id"), F.lit("old").alias("source_sha256"))).alias("members"))
    return ct.sheet_view_problems(views, sheets).select("event_id", "code")


_NAMES = ["ok-1", "CON", "lpt9", "a b", "", "-x", "x" * 65, "OK-1", "../a", "x" * 64]


@query("SELECT id, code FROM (VALUES ('CON', 'unsafe'), ('lpt9', 'unsafe'), ('a b', 'unsafe'), ('', 'unsafe'), ('-x', 'unsafe'), (repeat('x', 65), 'unsafe'), ('../a', 'unsafe'), ('ok-1', 'duplicate'), ('OK-1', 'duplicate')) v(id, code)")
def rc_supp_id(spark, d):
    rows = _events(spark, d, len(_NAMES)).select(F.lit(1).alias("source_id"), _pick(_NAMES, "").alias("id")).distinct()
    return ct.identifier_problems(rows).select("id", "code")


_PATHS = ["a/b.png", "../a", "/etc/x", "a//b", "a/./b", "c:\\x", "a\\b", "a/..", ""]


@query(f"SELECT event_id, {_K} % {len(_PATHS)} IN (0, 6) AS safe FROM events")
def rc_path(spark, d):
    return _events(spark, d, len(_PATHS)).select("event_id", sc.safe_path(_pick(_PATHS, "")).alias("safe"))


@query(f"WITH {_RUNS} SELECT source_id, frame_no FROM runs WHERE exact_start <> frame_no")
def rc_representative(spark, d):
    runs = _runs(spark, d)
    return ct.representative_problems(runs, runs)


@query(f"WITH RECURSIVE {LEDGER} SELECT i.source_id, i.id FROM intervals i JOIN runs r ON r.source_id = i.source_id AND r.frame_no BETWEEN i.start_frame AND i.end_frame GROUP BY i.source_id, i.id, i.start_frame, i.end_frame HAVING count(*) < i.end_frame - i.start_frame + 1")
def rc_computed(spark, d):
    led = _ledger(spark, d)
    return ct.uncomputed_intervals(led.intervals, led.frames)


@query(f"SELECT user_id AS source_id, event_id::VARCHAR AS id FROM events WHERE {_K} < 10")
def rc_immutable(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("source_id"), F.col("event_id").cast("string").alias("id"), "k", F.lit('{"a": 1, "b": [2]}').alias("payload"))
    return ct.changed_checks(rows, rows.withColumn("payload", F.when(F.col("k") < 10, '{"a": 1, "b": [3]}').otherwise('{"b":[2],"a":1}')))


@query(f"SELECT user_id AS source_id, tbl, id, code FROM (SELECT user_id, 'steps' AS tbl, 'S' || {_K} AS id, CASE WHEN count(*) > 1 THEN 'duplicate' END AS code FROM events GROUP BY user_id, {_K} UNION ALL SELECT user_id, 'ghosts', event_id::VARCHAR, 'unknown_table' FROM events WHERE {_K} = 50) WHERE code IS NOT NULL")
def src_records(spark, d):
    """A batch of records: what it breaks, ids that it repeats, and tables that there are not."""
    import json

    e = _events(spark, d)
    steps = e.select(F.col("user_id").alias("source_id"), F.lit("steps").alias("tbl"), F.concat(F.lit("S"), F.col("k").cast("string")).alias("id"), F.lit(json.dumps(_STEP)).alias("payload"))
    ghosts = e.where("k = 50").select(F.col("user_id").alias("source_id"), F.lit("ghosts").alias("tbl"), F.col("event_id").cast("string").alias("id"), F.lit("{}").alias("payload"))
    return ct.batch_problems(steps.unionByName(ghosts)).select("source_id", "tbl", "id", "code")


# --- corrections and lineage -----------------------------------------------------------


@query(f"""WITH RECURSIVE {LEDGER}, req AS (SELECT * FROM steps WHERE k0 >= 65 AND k0 < 95),
named AS (SELECT DISTINCT source_id, unnest(step_ids) AS id FROM coverage UNION SELECT source_id, unnest(step_ids) FROM intervals)
SELECT DISTINCT r.source_id, r.id, 'coverage_still_name_the_step' AS code FROM req r JOIN (SELECT source_id, unnest(step_ids) AS id FROM coverage) c USING (source_id, id)
UNION SELECT r.source_id, r.id, 'intervals_still_name_the_step' FROM req r JOIN (SELECT source_id, unnest(step_ids) AS id FROM intervals) c USING (source_id, id)
UNION SELECT source_id, id, 'uncertainty_lost' FROM req WHERE len(uncertainties) > 0
UNION SELECT source_id, id, 'unresolved_status_lost' FROM req WHERE status <> 'confirmed'
UNION SELECT source_id, id, 'replacement_not_active' FROM req WHERE k0 >= 80
UNION SELECT source_id, id, 'retired_id_used_again' FROM req WHERE k0 >= 90""")
def lin_retire(spark, d):
    """Retirement of doubtful steps by one sound step each, or by one that is not there."""
    led = _ledger(spark, d)
    k0 = led.states.select("source_id", F.format_string("S%09d", "start_frame").alias("id"), "k0")
    steps = led.steps.join(k0, ["source_id", "id"])
    due = staged(steps.where("k0 >= 65 and k0 < 95"), "due")
    heir = F.concat(F.lit("N"), F.col("id"))
    requests = due.select("source_id", "id", F.when(F.col("k0") >= 80, F.array(F.lit("gone"))).otherwise(F.array(heir)).alias("replacement_step_ids"))
    new = due.withColumns({"id": heir, "status": F.lit("confirmed"), "uncertainties": F.array().cast("array<string>")}).drop("k0")
    none = led.issues.limit(0), led.intervals.limit(0), led.coverage.limit(0)
    quiet = led.issues.where("resolution is not null and status = 'resolved'")  # open issues have their own query
    before = {"steps": led.steps, "issues": quiet, "intervals": led.intervals, "coverage": led.coverage}
    archive = due.where("k0 >= 90").select("source_id", "id")
    return rc.retirement_violations(requests, archive, before, {"steps": new, "issues": none[0], "intervals": none[1], "coverage": none[2]})


@query(f"SELECT user_id AS source_id, event_type AS id, event_id AS seq, next AS replaced_by, {_K} >= 90 AS deleted FROM (SELECT *, lead(event_id) OVER w AS next, lead(props) OVER w AS np FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) WHERE next IS NOT NULL AND {_K} < 0".replace(f"{_K} >= 90 AS deleted", "(np->>'k')::BIGINT >= 90 AS deleted").replace(f"AND {_K} < 0", f"AND {_K} < 90"))
def lin_history(spark, d):
    log = _events(spark, d).select(F.col("user_id").alias("source_id"), F.lit("steps").alias("tbl"), F.col("event_type").alias("id"), F.lit("").alias("payload"), F.col("event_id").alias("seq"), F.col("event_id").alias("batch_id"), (F.col("k") >= 90).alias("tombstone"))
    return rc.history(log).select("source_id", "id", "seq", "replaced_by", "deleted")


@query(f"WITH RECURSIVE {LEDGER}, {STRICT} {_SHOW} trans WHERE code IN ('final_parameter_mismatch', 'state_fact_invalid', 'state_value_unknown')")
def cont_final(spark, d):
    return _by_code(spark, d, "final_parameter_mismatch", "state_fact_invalid", "state_value_unknown")


@query(f"WITH RECURSIVE {LEDGER}, {STRICT} {_SHOW} trans WHERE code IN ('confirmation_gap', 'result_gap')")
def cont_conf(spark, d):
    return _by_code(spark, d, "confirmation_gap", "result_gap")


def _by_code(spark, d, *codes):
    led = _ledger(spark, d)
    rows = audit.transitions(led, audit.operation_steps(led.coverage.where("classification = 'operation'"))).where(F.col("code").isin(*codes))
    return rows.select("source_id", "code", "reference", _text("frames").alias("frames"))


@query(f"WITH RECURSIVE {LEDGER}, {INTERVALS} {_SHOW} iv WHERE code = 'file_handoff_state_missing'")
def cont_file(spark, d):
    from . import layers

    return layers.handoffs(_ledger(spark, d)).select("source_id", "code", "reference", _text("frames").alias("frames"))


@query(f"""WITH RECURSIVE {LEDGER}, {STRICT} SELECT source_id, id, phase, key, value, usable FROM rawfacts""")
def cont_facts(spark, d):
    steps = _ledger(spark, d).steps.withColumns({"step_order": F.lit(0), "near": F.array().cast("array<bigint>")})
    return audit.facts(steps.where("transition is not null")).select("source_id", "id", "phase", "key", "value", "usable")


# --- status, sets, relations -----------------------------------------------------------

_STATUS = (
    """done AS (SELECT DISTINCT v.source_id, v.frame_no FROM views v JOIN assets a ON a.source_id = v.source_id AND a.id = v.asset_id AND a.kind = 'full' WHERE v.presentation = 'native'),
src AS (SELECT source_id, count(*) AS indexed, (count(*) + CASE WHEN max(k) FILTER (WHERE frame_no = 0) < 50 THEN 1 ELSE 0 END) AS declared, max(k) FILTER (WHERE frame_no = 0) < 80 AS clean FROM runs GROUP BY source_id),
cand AS (SELECT DISTINCT source_id, exact_start AS frame_no FROM runs WHERE k < 30), open_ AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = c.source_id AND d.frame_no = c.frame_no))"""
)
_SPANS_OF = "(SELECT source_id, string_agg(a || '-' || b, ',' ORDER BY a) AS t FROM (SELECT source_id, min(frame_no) AS a, max(frame_no) AS b FROM (SELECT *, frame_no - row_number() OVER (PARTITION BY source_id ORDER BY frame_no) AS g FROM {x}) GROUP BY source_id, g) GROUP BY source_id)"


@query(f"""WITH RECURSIVE {LEDGER}, {_STATUS}, unseen AS (SELECT source_id, frame_no FROM runs r WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = r.source_id AND d.frame_no = r.frame_no)),
v AS (SELECT source_id, count(DISTINCT frame_no) AS visual, count(DISTINCT frame_no) FILTER (WHERE presentation = 'overview') AS over, count(*) AS n FROM views GROUP BY source_id)
SELECT s.source_id, indexed AS indexed_frames, CASE WHEN clean THEN declared <> indexed END AS frame_count_mismatch, clean AS full_compute_complete, CASE WHEN NOT clean THEN indexed END AS unindexed_from,
  (SELECT count(DISTINCT frame_no) FROM runs r WHERE r.source_id = s.source_id AND k < 30) AS candidate_requests, (SELECT count(*) FROM cand c WHERE c.source_id = s.source_id) AS candidate_frames,
  (SELECT count(*) FROM open_ o WHERE o.source_id = s.source_id) AS candidates_pending, coalesce(v.visual, 0) AS visual_frames, coalesce(v.over, 0) AS overview_frames, coalesce(v.n, 0) AS view_events,
  (SELECT count(*) FROM done d WHERE d.source_id = s.source_id) AS full_image_frames, (SELECT count(*) FROM coverage c WHERE c.source_id = s.source_id) AS state_accounting_records,
  (SELECT count(*) FROM issues i WHERE i.source_id = s.source_id AND NOT solved) AS unresolved_issues, u.t AS unviewed_ranges, p.t AS pending_ranges
FROM src s LEFT JOIN v USING (source_id) LEFT JOIN {_SPANS_OF.format(x="unseen")} u USING (source_id) LEFT JOIN {_SPANS_OF.format(x="open_")} p USING (source_id)""")
def agg_progress(spark, d):
    led = _ledger(spark, d)
    first = F.max(F.when(F.col("frame_no") == 0, F.col("k")))
    sources = led.frames.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_frames"), first.alias("kf"))
    clean = F.col("kf") < 80
    sources = sources.select("source_id", "total_frames", (F.col("total_frames") + F.when(F.col("kf") < 50, 1).otherwise(0)).alias("declared_frames"), clean.alias("index_clean"), clean.alias("scan_clean"))
    asked = led.frames.where("k < 30").select("source_id", "frame_no", F.lit("r").alias("reason"), "exact_start")
    out = st.status(led, asked, asked.select("source_id", F.col("exact_start").alias("frame_no")).distinct(), sources)
    spans = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",").alias(c)
    return out.select(
        "source_id", "indexed_frames", "frame_count_mismatch", "full_compute_complete", "unindexed_from", "candidate_requests", "candidate_frames", "candidates_pending", "visual_frames", "overview_frames", "view_events", "full_image_frames",
        "state_accounting_records", "unresolved_issues", spans("unviewed_ranges"), spans("pending_ranges"),
    )


@query(f"WITH RECURSIVE {LEDGER}, {_STATUS}, unseen AS (SELECT source_id, frame_no FROM runs r WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = r.source_id AND d.frame_no = r.frame_no)) SELECT source_id, t AS ranges FROM {_SPANS_OF.format(x='unseen')}")
def agg_unviewed(spark, d):
    led = _ledger(spark, d)
    rows = led.frames.select("source_id", "frame_no").join(st.full_native(led), ["source_id", "frame_no"], "left_anti")
    listed = st.listed(rows, "r")
    return listed.select("source_id", F.array_join(F.transform("r", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",").alias("ranges"))


@query(f"WITH RECURSIVE {LEDGER} SELECT source_id, list_contains(list(author), 'bob') AS bob_wrote, count(DISTINCT author) AS authors FROM (SELECT source_id, author FROM steps UNION SELECT source_id, reviewer FROM coverage) WHERE author IS NOT NULL GROUP BY source_id")
def agg_authors(spark, d):
    led = _ledger(spark, d)
    who = led.steps.select("source_id", "author").unionByName(led.coverage.select("source_id", F.col("reviewer").alias("author"))).where("author is not null").distinct()
    return who.groupBy("source_id").agg(F.collect_set("author").alias("a")).select("source_id", F.array_contains("a", "bob").alias("bob_wrote"), F.size("a").cast("long").alias("authors"))


@query(f"SELECT event_id, CASE WHEN k < 10 OR k BETWEEN 20 AND 29 THEN NULL ELSE k >= 30 END AS mismatch FROM (SELECT event_id, {_K} % 40 AS k FROM events)")
def agg_mismatch(spark, d):
    k = F.col("k")
    rows = _events(spark, d, 40)
    return rows.select("event_id", st.mismatch(F.when(k >= 30, F.lit(2)).otherwise(1), F.when(k < 10, F.lit(None)).otherwise(1), ~k.between(20, 29)).alias("mismatch"))


@query(f"WITH RECURSIVE {LEDGER} SELECT source_id, count(DISTINCT frame_no) AS any_frames, count(DISTINCT frame_no) FILTER (WHERE presentation = 'overview') AS overview_frames, count(DISTINCT frame_no) FILTER (WHERE presentation = 'native') AS native_frames FROM views GROUP BY source_id")
def agg_dedupe_views(spark, d):
    kind = lambda k: F.count_distinct(F.when(F.col("presentation") == k, F.col("frame_no"))).alias(f"{k}_frames")
    return _ledger(spark, d).views.groupBy("source_id").agg(F.count_distinct("frame_no").alias("any_frames"), kind("overview"), kind("native"))


@query(f"WITH RECURSIVE {LEDGER}, {_STATUS} SELECT source_id, count(*) FILTER (WHERE hit) AS reviewed, count(*) FILTER (WHERE NOT hit) AS pending FROM (SELECT source_id, EXISTS (SELECT 1 FROM done d WHERE d.source_id = c.source_id AND d.frame_no = c.frame_no) AS hit FROM cand c) GROUP BY source_id")
def agg_pending(spark, d):
    led = _ledger(spark, d)
    found = led.frames.where("k < 30").select("source_id", F.col("exact_start").alias("frame_no")).distinct()
    seen = st.full_native(led).withColumn("hit", F.lit(True))
    return found.join(seen, ["source_id", "frame_no"], "left").groupBy("source_id").agg(F.count("hit").alias("reviewed"), F.count_if(F.col("hit").isNull()).alias("pending"))


@query("SELECT source_id, all(n > 1) AS subset, bool_and(n > 1) AND count(*) = 5 AS equal FROM (SELECT user_id AS source_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY source_id".replace("all(n > 1)", "bool_and(n > 1)"))
def set_subset(spark, d):
    """Whether the kinds a user has once are among those had several times (then there are none), and whether all five are."""
    n = _events(spark, d).groupBy(F.col("user_id").alias("source_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    sets = n.groupBy("source_id").agg(F.collect_set("event_type").alias("all"), F.collect_set(F.when(F.col("n") > 1, F.col("event_type"))).alias("many"))
    five = F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))
    return sets.select("source_id", (F.size(F.array_except("all", "many")) == 0).alias("subset"), (F.array_sort("many") == five).alias("equal"))


@query(f"WITH {_RUNS} SELECT source_id, frame_no, time_s, digest, exact_start FROM runs")
def rel_scan_order(spark, d):
    return _runs(spark, d).select("source_id", "frame_no", "time_s", "digest", "exact_start").orderBy("source_id", "frame_no")


@query("SELECT p.p_partkey, (SELECT min(l_suppkey) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS first_supplier FROM part p")
def rel_scalar_sub(spark, d):
    first = ad.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("first_supplier"))
    return ad.table(spark, d, "part").select("p_partkey").join(first, "p_partkey", "left")


@query("SELECT k AS id, min(v) AS v FROM (SELECT c_custkey AS k, 'customer' AS v FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) GROUP BY k")
def rel_insert_ignore(spark, d):
    row = lambda t, k, v: ad.table(spark, d, t).select(F.col(k).alias("id"), F.lit(v).alias("v"))
    return rc.insert_ignore(row("customer", "c_custkey", "customer"), row("supplier", "s_suppkey", "supplier"), ["id"])


@query("SELECT c_custkey, coalesce(n, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def rel_update(spark, d):
    n = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("c_acctbal"))
    return store.updated(ad.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), n, ["c_custkey"], ["c_acctbal"])


@query("""SELECT event_type, min(event_id) AS event_id, 'payload' AS missing FROM events GROUP BY event_type UNION ALL SELECT event_type, min(event_id), 'actor' FROM events GROUP BY event_type""")
def rel_schema_probe(spark, d):
    """The columns that a table lacks, for the first event of each type, before and after one of them is added."""
    rows = ad.table(spark, d, "events")
    lacking = store.has_columns(rows, "event_id", "payload", "user_id", "actor")
    first = rows.groupBy("event_type").agg(F.min("event_id").alias("event_id"), *(F.lit(c).alias(c) for c in lacking))
    return first.select("event_type", "event_id", F.explode(F.array(*lacking)).alias("missing"))


# --- sources and sinks -----------------------------------------------------------------

_HEADS = ["1A45DFA3FF", "524946460000000041564920", "000000186674797069736F6D", "0000000877696465", "4F67675300", "574542565454200A", "310A303A30303A30312C303030202D2D3E20303A30303A30322C303030", "EFBBBF0A574542565454", "5245444d45"]
_KINDS = ["matroska", "avi", "mov", "mov", None, "webvtt", "srt", "webvtt", None]


@query(f"SELECT event_id, {_case([repr(x) if x else None for x in _KINDS])} AS subtitles, {_case([repr(x) if x and i < 4 else None for i, x in enumerate(_KINDS)])} AS media FROM (SELECT event_id, {_K} % {len(_KINDS)} AS k FROM events)")
def src_sniff(spark, d):
    rows = _events(spark, d, len(_HEADS)).withColumn("content", F.unhex(_pick(_HEADS, "")))
    return rows.select("event_id", ad.container_kind("content", True).alias("subtitles"), ad.container_kind("content").alias("media"))


def _mov_files() -> list[bytes]:
    box = lambda kind, body, size=None: ((len(body) + 8) if size is None else size).to_bytes(4, "big") + kind + body
    dref = lambda n, *urls: box(b"dref", bytes(4) + n.to_bytes(4, "big") + b"".join(urls))
    own, far = box(b"url ", b"\0\0\0\1"), box(b"url ", b"\0\0\0\0http://x\0")
    movie = lambda *inner: box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"dinf", b"".join(inner))))))
    deep = b""
    for _ in range(20):
        deep = box(b"udta", deep)
    return [movie(dref(1, own)), movie(dref(1, far)), movie(dref(2, own)), box(b"ftyp", b"isom") + box(b"mdat", b"x"), movie(dref(1, own)) + box(b"cmov", b""), box(b"moov", deep), movie(dref(1, own))[:-4], box(b"moov", box(b"meta", b"\0\0\0\1")), box(b"moov", b"", 0)]


@query(f"SELECT event_id, {_case([None, *(repr(x) for x in ('external reference', 'reference count', 'no movie metadata', 'reference or compressed movie', 'nested too deep', 'box outside its parent', 'metadata layout'))])} AS problem FROM (SELECT event_id, {_K} % 9 AS k FROM events)")
def src_mov(spark, d):
    rows = _events(spark, d, 9).withColumn("content", F.unhex(_pick([f.hex() for f in _mov_files()], "")))
    return rows.select("event_id", ad.mov_problems("content").alias("problem"))


@query(f"SELECT event_id, 0 AS pos, k::DOUBLE AS start_time, k + 1.5::DOUBLE AS end_time, event_type || chr(10) || 'x' AS text_original, true AS sound FROM (SELECT *, {_K} AS k FROM events) UNION ALL SELECT event_id, 1, NULL, NULL, NULL, false FROM events")
def src_srt(spark, d):
    k = F.col("k")
    clock = lambda x, ms: F.format_string(f"0:%02d:%02d,{ms}", F.floor(x / 60).cast("int"), (x % 60).cast("int"))
    end = F.when(k % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    rows = _events(spark, d).withColumn("text", F.concat(F.lit("1"), end, clock(k, "000"), F.lit(" --> "), clock(k + 1, "500"), end, F.col("event_type"), F.lit("\nx\n\n2\nno time\nno text\n")))
    return ad.srt_blocks(rows.withColumn("source_id", F.col("event_id"))).select(F.col("source_id").alias("event_id"), "pos", "start_time", "end_time", "text_original", "sound")


@query(f"""WITH {_FRAMES}, first AS (SELECT source_id, floor(time_s)::DOUBLE AS t FROM frames WHERE frame_no = 0), seg AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_no) - 1 AS pos, k, digest FROM frames)
SELECT source_id, pos, CASE WHEN source_id % 2 = 0 THEN t ELSE 0 END + 2.5 AS offset_s, k::DOUBLE AS begin_s, k + 1::DOUBLE AS end_s, digest AS text FROM seg JOIN first USING (source_id)""")
def src_transcript(spark, d):
    frames = _frames(spark, d).withColumn("time_s", F.floor("time_s").cast("double"))
    k = F.get_json_object("props", "$.k").cast("double")
    told = frames.withColumn("k", k).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "k", "digest"))), lambda x: F.struct(x["k"].alias("start"), (x["k"] + 1).alias("end"), x["digest"].alias("text"))).alias("segments"))
    docs = told.select("source_id", F.when(F.col("source_id") % 2 == 0, "video_relative").otherwise("original").alias("time_base"), F.lit(2.5).alias("offset_seconds"), "segments")
    return ad.transcript_cues(docs, frames).select("source_id", "pos", F.col("offset").alias("offset_s"), F.col("begin").alias("begin_s"), F.col("end").alias("end_s"), "text")


_CUE = f"""{_FRAMES}, first AS (SELECT source_id, time_s AS t FROM frames WHERE frame_no = 0),
cues AS (SELECT f.source_id, row_number() OVER (PARTITION BY f.source_id ORDER BY frame_no) - 1 AS pos, time_s + 100 AS a, time_s + 100 + 20000 * (k + 1)::DOUBLE AS b FROM frames f WHERE digest = 'error'),
spans AS (SELECT source_id, frame_no, time_s, coalesce(lead(time_s) OVER (PARTITION BY source_id ORDER BY frame_no), time_s) AS e FROM frames),
hit AS (SELECT c.source_id, pos, frame_no, frame_no - row_number() OVER (PARTITION BY c.source_id, pos ORDER BY frame_no) AS g FROM cues c JOIN spans s ON s.source_id = c.source_id AND time_s < b AND (e > a OR (e = a AND e = time_s))),
r AS (SELECT source_id, pos, string_agg(x || '-' || y, ',' ORDER BY x) AS ranges FROM (SELECT source_id, pos, min(frame_no) AS x, max(frame_no) AS y FROM hit GROUP BY source_id, pos, g) GROUP BY source_id, pos),
own AS (SELECT c.source_id, c.pos, r.ranges, a < max(b) OVER (PARTITION BY c.source_id ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM cues c LEFT JOIN r USING (source_id, pos)),
w AS (SELECT source_id, concat_ws(',', CASE WHEN bool_or(ranges IS NULL) THEN NULL END, CASE WHEN bool_or(ranges IS NULL) THEN 'outside_index' END, CASE WHEN bool_or(over) THEN 'overlap' END, 'unknown_display_duration') AS warnings FROM own GROUP BY source_id)"""


@query(f"WITH {_CUE} SELECT source_id, pos, coalesce(ranges, '') AS frame_ranges, CASE WHEN ranges IS NULL THEN 'unaligned' ELSE 'display_interval_overlap' END AS alignment, warnings FROM own JOIN w USING (source_id)")
def ivl_align_store(spark, d):
    from pyspark.sql import Window as W

    frames = _frames(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    n = (F.row_number().over(W.partitionBy("source_id").orderBy("frame_no")) - 1).cast("long")
    cues = frames.where("digest = 'error'").select("source_id", n.alias("pos"), F.col("time_s").alias("begin"), (F.col("time_s") + 20000 * (k + 1).cast("double")).alias("end"), F.lit(100.0).alias("offset"), F.lit("x").alias("text"))
    out = iv.align_store(cues, frames)
    return out.select("source_id", "pos", F.array_join(F.transform("frame_ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",").alias("frame_ranges"), "alignment", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {_CUE}, known AS (SELECT source_id, digest IN ('error', 'view') AS reused FROM frames WHERE frame_no = 0)
SELECT source_id, pos, coalesce(ranges, '') AS frame_ranges, CASE WHEN ranges IS NULL THEN 'unaligned' ELSE 'display_interval_overlap' END AS alignment, warnings, reused AS cache_reused, pos + 1 AS number, 'en' AS language FROM own JOIN w USING (source_id) JOIN known USING (source_id)""")
def src_subtitles(spark, d):
    """Imports of all sources, of which those whose first event is an error or a view were stored before."""
    from pyspark.sql import Window as W

    from ..operators import language

    frames = staged(_frames(spark, d), "frames")
    k = F.get_json_object("props", "$.k").cast("long")
    n = (F.row_number().over(W.partitionBy("source_id").orderBy("frame_no")) - 1).cast("long")
    cues = frames.where("digest = 'error'").select("source_id", F.lit("srt").alias("id"), n.alias("pos"), F.col("time_s").alias("begin"), (F.col("time_s") + 20000 * (k + 1).cast("double")).alias("end"), F.lit("x").alias("text"))
    ask = cues.select("source_id", "id").distinct().select("source_id", "id", F.sha2(F.col("source_id").cast("string"), 256).alias("sha256"), F.lit(100.0).alias("offset"), F.lit("en").alias("language"))
    early = frames.where("frame_no = 0 and digest in ('error', 'view')").select("source_id")
    nothing = spark.createDataFrame([], store.TABLES["cues"]).withColumn("source_id", F.col("source_id").cast(frames.schema["source_id"].dataType))
    stored = language.remember(ask.join(early, "source_id", "left_semi"), cues, frames, nothing)[1]
    told, _ = language.remember(ask, cues, frames, stored)
    ranges = F.array_join(F.transform("frame_ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    number = F.regexp_extract("id", ":c([0-9]+)$", 1).cast("long")
    return told.select("source_id", "pos", ranges.alias("frame_ranges"), "alignment", F.array_join("warnings", ",").alias("warnings"), "cache_reused", number.alias("number"), "language")


@query(f"WITH {_FRAMES} SELECT source_id, time_s AS first_time FROM frames WHERE frame_no = 0")
def ivl_relative_base(spark, d):
    return ad.first_times(_frames(spark, d))


@query(f"WITH RECURSIVE {LEDGER} SELECT s.source_id, s.id AS step_id, i.id AS interval_id, s.start_frame >= i.start_frame AND s.end_frame <= i.end_frame AS inside FROM (SELECT source_id, id, start_frame, end_frame, unnest(step_ids) AS step_id FROM intervals) i JOIN steps s ON s.source_id = i.source_id AND s.id = i.step_id")
def ivl_contains(spark, d):
    led = _ledger(spark, d)
    named = led.intervals.select("source_id", F.col("id").alias("interval_id"), F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"), F.explode("step_ids").alias("step_id"))
    steps = led.steps.select("source_id", F.col("id").alias("step_id"), "start_frame", "end_frame")
    return named.join(steps, ["source_id", "step_id"]).select("source_id", "step_id", "interval_id", F.expr("start_frame >= lo and end_frame <= hi").alias("inside"))


@query(f"""SELECT event_id, depth, 10 * depth AS x0, 5 * depth AS y0 FROM (SELECT event_id, unnest(range(1, 2 + {_K} % 4)) AS depth FROM events)""")
def box_contains(spark, d):
    """Chains of crops of 1 to 4 levels in source coordinates."""
    e = _events(spark, d)
    levels = e.select("event_id", F.explode(F.sequence(F.lit(1), (1 + F.col("k") % 4).cast("int"))).alias("depth"))
    name = lambda n: F.concat_ws("-", F.col("event_id").cast("string"), n.cast("string"))
    crop = F.array(F.lit(10), F.lit(5), F.lit(600) - 20 * F.col("depth"), F.lit(300) - 10 * F.col("depth"))
    crops = levels.select(F.lit(1).alias("source_id"), name(F.col("depth")).alias("id"), F.lit("crop").alias("kind"), name(F.col("depth") - 1).alias("parent_id"), crop.alias("crop"), "event_id", "depth")
    full = e.select(F.lit(1).alias("source_id"), name(F.lit(0)).alias("id"), F.lit("full").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("array<int>").alias("crop"))
    regions = ev.crop_regions(staged(full.unionByName(crops.select(*full.columns)), "boxes"))
    return regions.join(crops.select("id", "event_id", "depth"), "id").select("event_id", F.col("depth").cast("long").alias("depth"), F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"))


@query("SELECT page_id AS id, sha256(html) AS sha256, CASE WHEN page_id % 3 = 0 THEN 'changed' WHEN page_id % 5 = 0 THEN 'missing' ELSE 'same' END AS state FROM pages".replace("page_id % 3 = 0", "contains(url, 'https')").replace("page_id % 5 = 0", "contains(url, '#')"))
def src_tree(spark, d):
    pages = ad.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("name"), "url", F.sha2("html", 256).alias("sha256"))
    other = pages.where(F.contains("url", F.lit("https")) | ~F.contains("url", F.lit("#"))).withColumn("sha256", F.when(F.contains("url", F.lit("https")), "x").otherwise(F.col("sha256")))
    return ad.compare_inventories(pages, other).join(pages, "name").select(F.col("name").cast("long").alias("id"), "sha256", "state")


@query(f"WITH {_FRAMES} SELECT source_id, frame_no, 'f' || lpad(frame_no::VARCHAR, 9, '0') AS asset_id, k < 50 AS verified FROM frames")
def snk_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    frames = _frames(spark, d)
    decoded = frames.withColumn("digest", F.when(k < 50, F.col("digest")).otherwise("other"))
    return sinks.extracted(frames, frames, decoded)


@query(f"WITH RECURSIVE {LEDGER} SELECT source_id, id || '-crop-' || array_to_string(box, '-') AS id, frame_no, CASE WHEN kind <> 'full' THEN 'not_a_full_image' WHEN box[3] > 640 THEN 'outside' END AS problem FROM (SELECT a.source_id, a.id, a.frame_no, a.kind, [0, 0, 10 * (r.k + 1), 90] AS box FROM assets a JOIN runs r USING (source_id, frame_no))")
def snk_crop(spark, d):
    led = _ledger(spark, d)
    size = led.frames.select("source_id", "frame_no", "k")
    wanted = led.assets.join(size, ["source_id", "frame_no"]).select("source_id", F.col("id").alias("asset_id"), F.array(F.lit(0), F.lit(0), (10 * (F.col("k") + 1)).cast("int"), F.lit(90)).alias("box"))
    return sinks.crop_assets(wanted, led.assets, led.frames).select("source_id", "id", "frame_no", "problem")


@query(f"""WITH {_FRAMES}, p AS (SELECT source_id, frame_no, least(480, 300 + 10 * k) AS w, 360.0 * least(480, 300 + 10 * k) / (300 + 10 * k) AS hh, row_number() OVER (PARTITION BY source_id ORDER BY frame_no) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM frames),
q AS (SELECT *, round_even(hh, 0)::BIGINT AS h, least(4, n) AS cols FROM p), c AS (SELECT *, max(h) OVER (PARTITION BY source_id) + 28 AS cell FROM q)
SELECT source_id, frame_no, (i % cols) * 480 AS x, (i // cols) * cell + 28 AS y, w, h FROM c""")
def snk_sheet(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    panels = _frames(spark, d).select("source_id", F.lit("all").alias("sheet"), "frame_no", (300 + 10 * k).alias("width"), F.lit(360).alias("height"))
    out = sinks.sheet_layout(panels)
    at = lambda c, i: F.col(c)[i].cast("long")
    return out.select("source_id", "frame_no", at("box", 0).alias("x"), at("box", 1).alias("y"), at("display_size", 0).alias("w"), at("display_size", 1).alias("h"))


@query(f"WITH {_FRAMES} SELECT source_id, frame_no, CASE WHEN n <= 5 THEN 'complete' ELSE 'paused_budget' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_no) AS i, count(*) OVER (PARTITION BY source_id) AS n FROM frames WHERE k >= 10) WHERE i <= 5")
def st_budget(spark, d):
    frames = _frames(spark, d)
    return budget(frames, frames.where(F.get_json_object("props", "$.k").cast("long") < 10), 5)


@query(f"WITH {_FRAMES} SELECT source_id, frame_no FROM frames WHERE k < 5 OR k >= 95")
def st_resume(spark, d):
    frames = _frames(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    again = frames.where(k < 95).withColumn("digest", F.when(k < 5, "other").otherwise(F.col("digest")))
    return ad.replay_mismatches(frames, again, ["time_s", "digest"])


@query(f"SELECT event_id, n AS frame_no, 2 AS width, 1 AS height, sha256(from_hex(lpad(to_hex({_K} + n), 12, '0'))) AS digest FROM (SELECT *, unnest(range(0, 1 + {_K} // 40)) AS n FROM events)")
def src_decode(spark, d):
    """Streams of one to three images of two pixels."""
    image = lambda n: F.concat(F.encode(F.lit("P6\n# c\n2 1\n255\n"), "UTF-8"), F.unhex(F.lpad(F.hex(F.col("k") + n), 12, "0")))
    k = F.col("k")
    stream = F.concat(image(0), F.when(k >= 40, image(1)).otherwise(F.unhex(F.lit(""))), F.when(k >= 80, image(2)).otherwise(F.unhex(F.lit(""))))
    out = ad.ppm_frames(_events(spark, d).select(F.col("event_id").alias("source_id"), stream.alias("content")))
    return out.select(F.col("source_id").alias("event_id"), "frame_no", "width", "height", F.sha2("pixels", 256).alias("digest"))


@query(f"SELECT event_id, CASE WHEN {_K} < 50 THEN 1 ELSE 0 END AS audio, CASE WHEN {_K} >= 25 THEN 1 ELSE 0 END AS subtitles FROM events")
def src_tracks(spark, d):
    stream = lambda i, kind: F.struct(F.lit(i).alias("index"), F.lit("c").alias("codec_name"), F.lit(kind).alias("codec_type"))
    k = F.col("k")
    every = F.array_compact(F.array(stream(0, "video"), F.when(k < 50, stream(1, "audio")), F.when(k >= 25, stream(2, "subtitle"))))
    out = ad.tracks(_events(spark, d).select(F.col("event_id").alias("source_id"), every.alias("streams")))
    return out.select(F.col("source_id").alias("event_id"), F.size("audio").alias("audio"), F.size("subtitles").alias("subtitles"))


@query(f"""WITH {_FRAMES}, t AS (SELECT source_id, frame_no, CASE WHEN k >= 10 THEN time_s END AS t, CASE WHEN k < 50 THEN k::DOUBLE ELSE 0 END AS dur FROM frames), n AS (SELECT *, lead(t) OVER (PARTITION BY source_id ORDER BY frame_no) AS nxt FROM t)
SELECT source_id, frame_no, t AS time_s, CASE WHEN nxt > t THEN nxt WHEN dur > 0 THEN t + dur ELSE t END AS end_s FROM n WHERE t IS NOT NULL""")
def ivl_display(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _frames(spark, d).select("source_id", "frame_no", F.when(k >= 10, F.col("time_s")).alias("time_s"), F.when(k < 50, k.cast("double")).otherwise(0.0).alias("duration"))
    return iv.display_spans(rows).select("source_id", "frame_no", "time_s", "end_s")


# --- identity of files and imports -----------------------------------------------------


@query("SELECT page_id, CASE WHEN contains(url, '#') THEN 'source_missing' WHEN contains(url, 'https') THEN 'source_hash_mismatch' ELSE 'source_unsupported_media_input' END AS code FROM pages WHERE contains(url, '#') OR contains(url, 'https') OR contains(url, '?')")
def id_file(spark, d):
    has = lambda s: F.contains("url", F.lit(s))
    pages = ad.table(spark, d, "pages").select(F.col("page_id").alias("source_id"), "url", F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("sha256"))
    files = pages.where(~has("#")).select("path", F.when(has("https"), "x").otherwise(F.col("sha256")).alias("sha256"), F.when(has("?"), F.lit(None)).otherwise("matroska").alias("kind"))
    return audit.source_files(pages, files).select(F.col("source_id").alias("page_id"), "code")


@query(f"WITH RECURSIVE {LEDGER}, files AS (SELECT source_id, id, kind, frame_no, k FROM assets JOIN runs USING (source_id, frame_no)) SELECT source_id, id, CASE WHEN k < 10 THEN 'unsafe_asset_path' WHEN k < 20 THEN 'missing_asset' ELSE 'asset_hash_mismatch' END AS code FROM files WHERE k < 30")
def asset_hash_mismatch(spark, d):
    led = _ledger(spark, d)
    k = F.col("k")
    assets = led.assets.join(led.frames.select("source_id", "frame_no", "k"), ["source_id", "frame_no"]).withColumn("path", F.when(k < 10, F.concat(F.lit("../"), F.col("id"))).otherwise(F.concat(F.lit("evidence/"), F.col("id"))))
    files = assets.where("k >= 20").select("source_id", "path", F.when(k < 30, "x").otherwise(F.col("sha256")).alias("sha256"))
    return audit.asset_files(assets, files).select("source_id", F.col("reference").alias("id"), "code")


@query(f"""WITH {_FRAMES}, b AS (SELECT source_id, frame_no // 16 AS b, sha256(string_agg(frame_no || '|' || digest, chr(10) ORDER BY frame_no)) AS h FROM frames GROUP BY source_id, frame_no // 16), p AS (SELECT source_id, sha256(string_agg(h, chr(10) ORDER BY b)) AS f FROM b GROUP BY source_id)
SELECT source_id, 'lang-' || substr(sha256('2' || chr(10) || 'file' || chr(10) || '2.5' || chr(10) || 'und' || chr(10) || f), 1, 24) AS key FROM p""")
def id_lang_cache(spark, d):
    frames = _frames(spark, d)
    prints = rc.table_fingerprint(frames, ["source_id"], "frame_no", [F.col("frame_no"), F.col("digest")], 16)
    sources = frames.select("source_id").distinct().select("source_id", F.lit("l").alias("id"), F.lit("file").alias("sha256"), F.lit(2.5).alias("offset"), F.lit("und").alias("language"))
    return idn.cache_key(sources, prints).select("source_id", "key")


@query(f"WITH RECURSIVE {LEDGER} SELECT v.source_id, v.id FROM views v JOIN runs r USING (source_id, frame_no) WHERE v.presentation = 'overview' AND NOT (r.k < 76 AND v.source_id % 2 = 0)".replace("v.source_id % 2 = 0", "r.digest <> 'error'"))
def bad_sheet_view(spark, d):
    """Overview views need a member of an intact sheet: here one sheet a source, without its errors' frames."""
    led = _ledger(spark, d)
    shown = led.frames.where("k between 70 and 75 and digest <> 'error'").join(led.assets.where("kind = 'full'").select("source_id", "frame_no", "id", "sha256"), ["source_id", "frame_no"])
    sheets = shown.groupBy("source_id").agg(F.collect_list(F.struct(F.col("id").alias("asset_id"), F.col("sha256").alias("source_sha256"))).alias("members")).select("source_id", F.lit("s").alias("id"), F.lit(True).alias("intact"), "members")
    from dataclasses import replace

    with_sheet = replace(led, views=led.views.withColumn("sheet_id", F.lit("s")))
    return audit.validate(with_sheet, sheets).where("code = 'bad_sheet_view'").select("source_id", F.col("reference").alias("id"))


@query(f"""WITH RECURSIVE {LEDGER}, first AS (SELECT source_id, k AS kf FROM runs WHERE frame_no = 0) SELECT source_id, unnest(CASE WHEN kf < 30 THEN ['record_consistency_failed'] WHEN kf < 60 THEN ['full_scan_incomplete'] WHEN kf < 70 THEN ['full_scan_incomplete', 'record_consistency_failed'] ELSE [] END) AS code FROM first""")
def audit_gate(spark, d):
    """The two findings that come from outside the records: they are invalid, or the scan is not complete."""
    led = _ledger(spark, d)
    first = led.frames.where("frame_no = 0").select("source_id", "k")
    found = audit.strict(led, first.where("k < 30 or k between 60 and 69"), first.where("k between 30 and 69"))
    return found.where("code in ('record_consistency_failed', 'full_scan_incomplete')").select("source_id", "code")


# --- supplements and deliveries --------------------------------------------------------

_SUPPLEMENT = ["unknown_export", "export_pending", "export_incomplete", "export_invalid", "not_independent", "unknown_or_duplicate_asset", "not_a_full_image", "unsafe_path", "not_an_image", "file_changed", "no_native_view", "unknown_frame"]


@query(f"SELECT event_id, {_case([repr(c) for c in _SUPPLEMENT])} AS code FROM (SELECT event_id, {_K} % {len(_SUPPLEMENT)} AS k FROM events)")
def src_supplement(spark, d):
    """One export and one asset per event, each with the fault that its ``k`` names."""
    e = _events(spark, d, len(_SUPPLEMENT)).withColumns({"source_id": F.col("user_id"), "export_id": F.col("event_id"), "h": F.sha2(F.col("event_id").cast("string"), 256)})
    fault = lambda name: F.col("k") == _SUPPLEMENT.index(name)
    unless = lambda name, bad, good: F.when(fault(name), bad).otherwise(good)
    wanted = e.select("source_id", F.lit("s").alias("id"), "export_id", F.lit("f1").alias("asset_id"))
    exports = e.where(~fault("unknown_export")).select("export_id", unless("export_incomplete", F.lit("open"), F.lit("complete")).alias("state"), (~fault("export_invalid")).alias("valid"), unless("not_independent", F.sha2(F.lit("own"), 256), F.col("h")).alias("source_sha256"), unless("not_independent", F.sha2(F.lit("own"), 256), F.col("h")).alias("verified_sha256"), fault("export_pending").alias("pending"))
    path = unless("unsafe_path", F.lit("../f1.png"), unless("not_an_image", F.lit("f1.txt"), F.lit("f1.png")))
    assets = e.select("export_id", unless("unknown_or_duplicate_asset", F.lit("f2"), F.lit("f1")).alias("id"), F.lit(7).cast("long").alias("frame_no"), unless("not_a_full_image", F.lit("crop"), F.lit("full")).alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("parent_id"), F.col("h").alias("sha256"))
    views = e.select("export_id", F.lit("f1").alias("asset_id"), F.lit(7).cast("long").alias("frame_no"), F.col("h").alias("asset_sha256"), unless("no_native_view", F.lit("overview"), F.lit("native")).alias("presentation"), F.lit("view_image").alias("tool"), *(F.lit("x").alias(c) for c in ("actor", "trace_ref", "observation")))
    frames = e.select("export_id", unless("unknown_frame", F.lit(8), F.lit(7)).cast("long").alias("frame_no"))
    files = e.select("export_id", path.alias("path"), unless("file_changed", F.lit("x"), F.col("h")).alias("sha256"))
    primary = e.select("source_id").distinct().withColumn("sha256", F.sha2(F.lit("own"), 256))
    out = supplements.import_problems(wanted.withColumn("source_id", F.col("export_id")), exports, assets, views, frames, files, primary.limit(0).unionByName(e.select(F.col("export_id").alias("source_id"), F.sha2(F.lit("own"), 256).alias("sha256"))))
    return out.select(F.col("source_id").alias("event_id"), "code")


@query(f"SELECT event_id, CASE k WHEN 0 THEN 'invalid_supplement_reference' WHEN 1 THEN 'unknown_supplement' WHEN 2 THEN 'invalid_supplement' WHEN 3 THEN 'unknown_supplement_evidence' ELSE 'unreviewed_supplement_evidence' END AS code FROM (SELECT event_id, {_K} % 6 AS k FROM events) WHERE k <> 5")
def supplement_codes(spark, d):
    k = F.col("k")  # 5: a sound reference
    e = _events(spark, d, 6)
    refs = e.select(F.lit(1).alias("source_id"), F.col("event_id").alias("issue_id"), F.when(k == 4, "cat").otherwise("bob").alias("reviewer"), F.when(k == 0, " ").when(k == 1, "gone").when(k == 2, "bad").otherwise("good").alias("supplement_id"), F.when(k == 3, "f9").otherwise("f1").alias("asset_id"))
    state = spark.createDataFrame([(1, "good", True), (1, "bad", False)], "source_id int, id string, valid boolean")
    assets = spark.createDataFrame([(1, i, "f1", 7, "h") for i in ("good", "bad")], "source_id int, id string, asset_id string, frame_no long, sha256 string")
    views = spark.createDataFrame([(1, "good", "f1", 7, "h", "native", "view_image", "bob", "t#1", "seen")], "source_id int, id string, asset_id string, frame_no long, asset_sha256 string, presentation string, tool string, actor string, trace_ref string, observation string")
    return supplements.reference_problems(refs, state, assets, views).select(F.col("issue_id").alias("event_id"), "code")


@query(f"SELECT event_id, CASE WHEN k < 10 THEN 'already_recorded' WHEN k < 20 THEN 'unknown_step' WHEN k < 30 THEN 'stale_snapshot' ELSE 'artifact_changed' END AS code FROM (SELECT event_id, {_K} AS k FROM events) WHERE k < 40")
def delivery_checks(spark, d):
    k = F.col("k")
    e = _events(spark, d)
    id_ = F.col("event_id").cast("string")
    new = e.select(F.lit(1).alias("source_id"), id_.alias("id"), F.array(F.when(k.between(10, 19), "S9").otherwise("S1")).alias("step_ids"), F.when(k.between(20, 29), "old").otherwise("now").alias("content_snapshot"), F.array(F.struct(F.lit("a.png").alias("path"), F.when(k.between(30, 39), "x").otherwise("h").alias("sha256"))).alias("artifacts"))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = supplements.reproduction_problems(new, e.where("k < 10").select(F.lit(1).alias("source_id"), id_.alias("id")), one([(1, "S1")], "source_id int, id string"), one([(1, "now")], "source_id int, snapshot string"), one([(1, "a.png", "h")], "source_id int, path string, sha256 string"))
    return out.select(F.col("id").cast("long").alias("event_id"), "code")


# --- presentation ----------------------------------------------------------------------

_WORDS = ["", "unknown", " N/A ", "NULL", "none", "未知", "不明", "未展示", "待核实", "待辨认", "未记录", "0", "  "]


@query(f"SELECT event_id, {_K} % {len(_WORDS)} IN (0, 1, 2, 3, 5, 7, 8, 9, 10) AS is_unknown FROM events")
def sc_unknown(spark, d):
    return _events(spark, d, len(_WORDS)).select("event_id", sc.unknown(_pick(_WORDS, "")).alias("is_unknown"))


_NESTED = ['{"value": 1, "evidence": []}', '{"value": null}', "[]", '["a", ["未知"]]', "0", '{"a": {"b": "ok"}}', "{broken", "{}", '"n/a"', "false"]


@query(f"SELECT event_id, {_K} % {len(_NESTED)} IN (1, 2, 3, 6, 7, 8) AS is_unknown FROM events")
def sc_unknown_value(spark, d):
    return _events(spark, d, len(_NESTED)).select("event_id", pr.unknown_value(_pick(_NESTED, "0")).alias("is_unknown"))


@query(f"SELECT event_id, 'k：' || {_K} || '；type：' || event_type || '；list：' || '未记录' || '、' || '是' || '；none：' || '无记录' AS words FROM events")
def sc_readable(spark, d):
    text = F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "list": ["", true], "none": []}'))
    return _events(spark, d).select("event_id", pr.readable(text).alias("words"))


@query("SELECT page_id, '[' || page_id || '](<' || replace(replace(url_encode(url), '%2F', '/'), '%3A', ':') || '>)' AS link FROM pages")
def sc_link(spark, d):
    return ad.table(spark, d, "pages").select("page_id", pr.link(F.col("page_id").cast("string"), F.col("url")).alias("link"))


@query(f"""SELECT event_id, '源帧 ' || event_id || '；' || CASE WHEN k < 10 THEN '原始 PTS：未知' || CASE WHEN k < 5 THEN '；best-effort：未知' ELSE '；best-effort：' || k || '.500 s' END ELSE '原始 PTS：' || k || '.250 s' END
  || '；相对视频首帧：' || CASE WHEN k < 5 THEN '未知' ELSE lpad(((k * 60) // 60)::VARCHAR, 2, '0') || ':00.000' END AS told FROM (SELECT event_id, {_K} % 60 AS k FROM events)""")
def sc_timestamp(spark, d):
    k = F.col("k")
    rows = _events(spark, d, 60)
    pts, best = F.when(k < 10, "N/A").otherwise(F.concat(k.cast("string"), F.lit(".25"))), F.when(k < 5, "nan").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return rows.select("event_id", pr.timestamp(F.col("event_id"), pts, best, F.lit("best_effort"), F.when(k >= 5, k * 60.0 + 7.5), F.lit(7.5)).alias("told"))


@query(f"""SELECT event_id, CASE WHEN k < 10 THEN '控件不可见' WHEN k < 20 THEN k || ' mm' WHEN k < 30 THEN '未知' ELSE k::VARCHAR END AS value,
CASE WHEN k < 5 THEN '生效未核实（记录完整性待修复）' WHEN k < 10 THEN '生效未核实（审计发现冲突或证据缺口）' WHEN k < 30 THEN '生效未核实' WHEN k < 40 THEN '生效未核实（确认或结果依据未记录）' ELSE 'S' || k || ' 完成后（按该步骤记录）' END AS scope FROM (SELECT event_id, {_K} AS k FROM events)""")
def sc_param(spark, d):
    k = F.col("k")
    n = k.cast("string")
    value = F.when(k < 10, '{"visible": false}').when(k < 20, F.concat(F.lit('{"unit": "mm", "value": '), n, F.lit("}"))).when(k < 30, '{"value": null}').otherwise(n)
    scope = pr.parameter_scope(F.concat(F.lit("S"), n), k >= 5, k < 10, k >= 30, k >= 40)
    return _events(spark, d).select("event_id", pr.parameter_value(value).alias("value"), scope.alias("scope"))


_AFFECTED = ", ".join(repr(c) for c in pr.STEP_CODES)
# a finding is its step's; a jump of a value is that of both steps it lies between
_HITS = f"""hits AS (
  SELECT DISTINCT f.source_id, s.id, code, reference FROM strict f JOIN steps s ON s.source_id = f.source_id AND (f.reference = s.id OR starts_with(f.reference, s.id || '.')) WHERE code IN ({_AFFECTED})
  UNION SELECT source_id, last_id, 'state_discontinuity', id FROM known WHERE phase = 0 AND last_value <> value)"""


@query(f"WITH RECURSIVE {LEDGER}, {STRICT}, {_HITS} SELECT source_id, id, code, reference, false AS ambiguous FROM hits")
def sc_affected(spark, d):
    led = _ledger(spark, d)
    return pr.affected_steps(led.steps, staged(audit.strict(led), "findings")).select("source_id", "id", "code", "reference", "ambiguous")


@query(f"""WITH RECURSIVE {LEDGER}, {STRICT}, {_HITS},
doubt AS (SELECT DISTINCT source_id, unnest(step_ids) AS id FROM issues WHERE NOT solved UNION SELECT i.source_id, s.id FROM issues i JOIN steps s ON s.source_id = i.source_id AND i.frame_no BETWEEN s.start_frame AND s.end_frame WHERE NOT solved AND len(i.step_ids) = 0)
SELECT source_id, id, CASE WHEN status = 'confirmed' AND (EXISTS (SELECT 1 FROM hits h WHERE h.source_id = s.source_id AND h.id = s.id) OR EXISTS (SELECT 1 FROM doubt h WHERE h.source_id = s.source_id AND h.id = s.id)) THEN '部分确认，待核实（步骤登记为已确认）'
  WHEN status = 'confirmed' THEN '已确认（步骤登记）' WHEN status = 'partial' THEN '部分确认，待核实' ELSE '待核实' END AS label FROM steps s""")
def sc_label(spark, d):
    led = _ledger(spark, d)
    return pr.labels(led.steps, led.issues, staged(audit.strict(led).select("source_id", "code", "reference", "attrs"), "findings"))


@query(f"""WITH RECURSIVE {LEDGER}, r AS (
  SELECT source_id, id, unnest([fa, fa, fz]) AS ref, unnest(['操作前', '操作中', '操作后']) AS role, unnest([0, 1, 2]) AS o FROM steps WHERE roles
  UNION SELECT source_id, id, fz, '确认动作', 3 FROM steps WHERE whole AND k0 < 70 UNION SELECT source_id, id, fz, '结果', 4 FROM steps WHERE whole AND k1 < 70)
SELECT e.source_id, e.id, e.ref AS asset_id, coalesce((SELECT string_agg(role, '、' ORDER BY o) FROM r WHERE r.source_id = e.source_id AND r.id = e.id AND r.ref = e.ref), '角色未记录') AS roles FROM (SELECT source_id, id, unnest(evidence) AS ref FROM steps) e""")
def sc_roles(spark, d):
    return pr.evidence_roles(_ledger(spark, d).steps)


@query(f"WITH {_RUNS}, p AS (SELECT source_id, frame_no - row_number() OVER (PARTITION BY source_id ORDER BY frame_no) AS g, frame_no FROM frames WHERE digest = 'error'), r AS (SELECT source_id, min(frame_no) AS a, max(frame_no) AS b FROM p GROUP BY source_id, g) SELECT source_id, string_agg(a || '–' || b, '；' ORDER BY a) AS told FROM r GROUP BY source_id")
def sc_range_text(spark, d):
    spans = fr.ranges(_frames(spark, d).where("digest = 'error'"), "frame_no", ["source_id"])
    return spans.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r")).select("source_id", pr.range_text(F.col("r")).alias("told"))


@query(f"""SELECT event_id, '旁白与语言：' || CASE WHEN k < 10 THEN '音轨未检查' WHEN k < 50 THEN '有音轨' ELSE '无音轨' END || '；' || CASE WHEN k < 20 THEN '按审阅者记录已使用外部转写 l' || k || '（来源待核对）；导入文本不表示实际听取音频。' WHEN k < 30 THEN '已导入 2 份文本，未声明使用；本报告不声称已利用旁白。' WHEN k < 50 THEN '旁白未转写，本次无已使用的语言来源。' ELSE '无已使用的字幕或转写记录。' END AS told,
'复现验收 R' || k || '：' || CASE WHEN k < 50 THEN '当前内容' ELSE '已过期，需按当前内容重验' END || '；记录结果：部分完成；范围：s；环境：e；记录者：未知；r。' AS repro FROM (SELECT event_id, {_K} AS k FROM events)""")
def sc_summary(spark, d):
    k = F.col("k")
    n = k.cast("string")
    used = F.struct(F.concat(F.lit("l"), n).alias("id"), F.lit("asr_interchange").alias("kind"), F.lit(None).cast("string").alias("path"))
    listed = F.when(k < 20, F.array(used)).otherwise(F.filter(F.array(used), lambda x: F.lit(False)))
    told = pr.narration(F.when(k < 50, 1).otherwise(0), k >= 10, F.when(k < 30, 2).otherwise(0), listed)
    check = F.struct(F.concat(F.lit("R"), n).alias("id"), F.when(k < 50, "current").otherwise("stale").alias("freshness"), F.lit("partial").alias("outcome"), F.lit("s").alias("scope"), F.lit("e").alias("environment"), F.lit(None).cast("string").alias("reviewer"), F.lit("r").alias("result"))
    return _events(spark, d).withColumn("c", check).select("event_id", told.alias("told"), pr.reproduction_line(F.col("c")).alias("repro"))


@query(f"SELECT event_id, k * 60 + 7.5::DOUBLE AS seconds FROM (SELECT event_id, {_K} % 60 AS k FROM events)")
def sc_clock_parse(spark, d):
    return _events(spark, d, 60).select("event_id", sc.clock_parse(F.format_string("0:%02d:07,500", F.col("k"))).alias("seconds"))


@query(f"WITH RECURSIVE {LEDGER}, {STRICT}, open_ AS (SELECT source_id, 'x' AS x FROM issues WHERE NOT solved) SELECT s.source_id, count(*) AS lines FROM (SELECT source_id FROM steps UNION ALL SELECT source_id FROM steps UNION ALL SELECT source_id FROM (SELECT source_id, unnest(evidence) FROM steps) UNION ALL SELECT source_id FROM (SELECT source_id, unnest(uncertainties) FROM steps) UNION ALL SELECT source_id FROM open_ UNION ALL SELECT source_id FROM strict) s GROUP BY s.source_id")
def snk_report(spark, d):
    """Lines of the report of each source."""
    led = _ledger(spark, d)
    lines = report.report_lines(led, staged(audit.strict(led), "findings"))
    return lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT event_id, '可见名称：f' || k || '；用途：' || event_type || '；x：是' AS file, '`result_gap`：' || CASE WHEN k < 10 THEN '需核实记录和证据' ELSE event_type END || CASE WHEN k >= 90 THEN '（旧发现的步骤引用存在歧义，候选：a、a.b；归属待核实）' ELSE '' END AS reason,
CASE WHEN k < 50 THEN '解决依据：/- 结案方式：证据确认。/- 记录者：b。/- 理由：r。/- 结案证据：[f1](<evidence/f1.png>)、f2（证据缺失）。' WHEN k < 90 THEN '解决依据：/- 结案方式：撤回误设问题。/- 记录者：b。/- 理由：r。/- 核对依据：\\#' || k || '。' ELSE '' END AS closed FROM (SELECT *, {_K} AS k FROM events)""")
def report_fragments(spark, d):
    """Files, reasons and resolutions in words."""
    k, n = F.col("k"), F.col("k").cast("string")
    file = F.concat(F.lit('{"visible_name": "f'), n, F.lit('", "role": "'), F.col("event_type"), F.lit('", "x": true}'))
    many = F.when(k >= 90, F.array(F.lit("a.b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    proof = F.struct(F.when(k < 50, "evidence").otherwise("withdrawn").alias("mode"), F.lit("b").alias("reviewer"), F.lit("r").alias("reason"), F.when(k >= 50, F.concat(F.lit("#"), n)).alias("basis"), F.when(k < 50, F.array(F.lit("f1"), F.lit("f2"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    rows = _events(spark, d).withColumn("resolution", F.when(k < 90, proof))
    paths = F.create_map(F.lit("f1"), F.lit("evidence/f1.png"))
    return rows.select("event_id", pr.file_text(file).alias("file"), pr.finding_reason(F.lit("result_gap"), F.when(k >= 10, F.col("event_type")), many).alias("reason"), F.array_join(pr.resolution_lines(F.col("resolution"), paths), "/").alias("closed"))


@query(f"""SELECT event_id AS id, n, line FROM (SELECT event_id, unnest([0, 1, 2, 3, 4]) AS n, unnest(['后续主张（按审阅者记录）：c' || k || '。', '原片限制：l。', '补证不补写原片过程，不计入原片的候选查看、确认动作或审阅完成度。', '记录者：bob。',
CASE WHEN k < 20 THEN '- bad：补证不存在或完整性待修复，本条主张待核对。' WHEN k < 40 THEN '- good / f9：记录者查看依据待补。' ELSE '- good · [f1](<supplements/f1.png>)' END]) AS line FROM (SELECT event_id, {_K} AS k FROM events) WHERE k < 60)""")
def report_followups(spark, d):
    k = F.col("k")
    ref = F.struct(F.when(k < 20, "bad").otherwise("good").alias("supplement_id"), F.when(k.between(20, 39), "f9").otherwise("f1").alias("asset_id"))
    follow = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("claim"), F.lit("l").alias("original_record_limit"), F.lit("bob").alias("reviewer"), F.array(ref).alias("supplement_refs"))
    issues = _events(spark, d).select(F.lit(1).alias("source_id"), F.col("event_id").alias("id"), F.when(k < 60, follow).alias("followup"))
    snapshots = spark.createDataFrame([(1, "good", True), (1, "bad", False)], "source_id int, id string, valid boolean")
    assets = spark.createDataFrame([(1, "good", "f1", "supplements/f1.png")], "source_id int, id string, asset_id string, path string")
    views = spark.createDataFrame([(1, "good", "f1", "bob")], "source_id int, id string, asset_id string, actor string")
    return pr.followup_lines(issues, snapshots, assets, views).select("id", "n", "line")


@query(f"SELECT event_id, 'a → b' || {_K} AS place, '无记录' AS what, CASE WHEN {_K} < 50 THEN '输入过程未单独记录；请结合确认动作与前后画面核对，阶段参数不代表输入动作。' ELSE 't' END AS typed, event_type AS confirmed, '未知' AS expected FROM events")
def report_actions(spark, d):
    k = F.col("k")
    steps = _events(spark, d).select(F.lit(1).alias("source_id"), F.col("event_id").alias("id"), F.concat(F.lit('["a", "b'), k.cast("string"), F.lit('"]')).alias("menu_path"), F.lit("[]").alias("selected_objects"), F.when(k < 50, " ").otherwise("t").alias("input_action"), F.col("event_type").alias("confirmation_action"), F.lit(None).cast("string").alias("visible_result"))
    out = report.action_fields(steps)
    return out.select(F.col("id").alias("event_id"), F.col("where").alias("place"), "what", "typed", "confirmed", "expected")


@query(f"""WITH RECURSIVE {LEDGER}, {STRICT}, {_HITS}, names AS (SELECT source_id, id, 'A.rate' AS name FROM steps WHERE whole UNION ALL SELECT source_id, id, 'file:out' FROM steps WHERE whole AND k0 < 20)
SELECT DISTINCT source_id, id, name, code FROM hits JOIN names USING (source_id, id) WHERE code <> 'final_parameter_mismatch' OR name = 'A.rate'""")
def report_parameters(spark, d):
    led = _ledger(spark, d)
    found = pr.affected_steps(led.steps, staged(audit.strict(led), "findings")).select("source_id", "id", "code", "parameter_key")
    names = led.steps.select("source_id", "id", F.explode(F.map_keys("transition.after")).alias("name"))
    return pr.parameter_findings(found, names).select("source_id", "id", "name", "code").distinct()
