"""Audits, reports and plans on small ledgers."""

import pytest

from strandline.plans import audit, catalog, layers, ledger_queries, record_queries, report, status
from strandline.sources.ledger import Ledger

DATA = "/root/testdata/sf0.001"
SCHEMAS = {
    "frames": "source_id string, frame_no long, exact_start long, digest string, time_s double, max_local_delta double, width int, height int",
    "states": "source_id string, exact_start long, start_frame long, end_frame long",
    "assets": "source_id string, id string, frame_no long, kind string, parent_id string, sha256 string, crop array<int>",
    "views": "source_id string, id string, asset_id string, frame_no long, actor string, asset_sha256 string, presentation string, trace_ref string, observation string, tool string",
    "steps": "source_id string, id string, start_frame long, end_frame long, status string, uncertainties array<string>, author string, evidence array<string>, final_parameters map<string,string>, transition struct<before:map<string,struct<value:string,evidence:array<string>>>,after:map<string,struct<value:string,evidence:array<string>>>,confirmation:struct<status:string,note:string,evidence:array<string>>,result:struct<status:string,note:string,evidence:array<string>>>, role_evidence map<string,array<string>>, input_files array<string>, output_files array<string>",
    "issues": "source_id string, id string, question string, start_frame long, end_frame long, status string, resolution struct<mode:string,reviewer:string,reason:string,basis:string,evidence:array<string>>, step_ids array<string>",
    "coverage": "source_id string, frame_no long, classification string, step_ids array<string>, issue_ids array<string>, evidence array<string>, reviewer string",
    "intervals": "source_id string, id string, start_frame long, end_frame long, reviewer string, reason string, disposition string, merge string, fine_status string, evidence array<string>, step_ids array<string>, issue_ids array<string>",
}


pytestmark = pytest.mark.usefixtures("small_tables")


def f(n):
    return f"f{n:09d}"


def sound(after="2", n=8):
    """Two steps over eight frames, every state seen and told; ``after`` is what the first one leaves."""
    frames = [("v", k, k, f"d{k}", k / 4, 0.1 * k, 640, 360) for k in range(n)]
    assets = [("v", f(k), k, "full", None, f"h{k}", None) for k in range(n)]
    views = [("v", f"{f(k)}:{a}", f(k), k, a, f"h{k}", "native", f"call#{a}{k}", "seen", "read_image") for k in range(n) for a in ("ann", "bob")]
    fact = lambda v, k: {"A.rate": (v, [f(k)])}
    proof = lambda k: ("observed", "n", [f(k)])

    def step(name, a, b, was, now):
        return ("v", name, a, b, "confirmed", [], "ann", [f(a), f(b)], {"A.rate": f'{{"value": {now}}}'}, (fact(was, a), fact(now, b), proof(b), proof(b)), {"before": [f(a)], "during": [f(a)], "after": [f(b)]}, [], [])

    data = {
        "frames": frames, "states": [("v", k, k, k) for k in range(n)], "assets": assets, "views": views, "steps": [step("S1", 0, 3, "1", after), step("S2", 4, 7, "2", "3")], "issues": [],
        "coverage": [("v", k, "operation", ["S1" if k < 4 else "S2"], [], [f(k)], "ann") for k in range(n)],
        "intervals": [("v", "P1", 0, 3, "ann", "r", "operation", "approximate", "reviewed", [f(0), f(3)], ["S1"], []), ("v", "P2", 4, 7, "ann", "r", "operation", "approximate", "reviewed", [f(4), f(7)], ["S2"], [])],
    }
    return data


def ledger(spark, data):
    return Ledger(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()})


def codes(findings):
    return sorted((r.code, r.reference) for r in findings.collect())


def test_a_sound_ledger_has_no_findings(spark):
    led = ledger(spark, sound())
    assert codes(audit.strict(led)) == [] and codes(audit.validate(led)) == [] and codes(layers.intervals(led)) == []


def test_file_handoffs_ask_for_no_fine_review(spark, monkeypatch):
    """They are found from steps and intervals alone, whatever the rest of the layered audit takes."""
    data = sound()
    data["steps"] = [(*s[:-2], ["in"], []) for s in data["steps"]]
    led = ledger(spark, data)
    assert codes(layers.intervals(led)) == [("file_handoff_state_missing", "S1"), ("file_handoff_state_missing", "S2")]
    monkeypatch.setattr(layers, "fine_problems", None)
    monkeypatch.setattr(record_queries, "_ledger", lambda *_: led)
    assert codes(record_queries.cont_file(spark, DATA)) == [("file_handoff_state_missing", "S1"), ("file_handoff_state_missing", "S2")]


def test_checks_and_their_audit_find_the_samples_once(spark, monkeypatch):
    """Scopes and samples of the intervals are written once for a ledger, not by each that asks."""
    made, mapping = [], layers.ev.mapping
    monkeypatch.setattr(layers.ev, "mapping", lambda *a: made.append(a) or mapping(*a))
    led = ledger(spark, sound())
    layers.samples(led, ledger_queries._checks(led))
    assert len(made) == 1


def test_progress_is_not_one_plan_of_all_counters(spark, monkeypatch):
    """The driver holds a plan's stages at once, so the counters are joined in groups that are written."""
    led = ledger(spark, sound())
    found = led.frames.select("source_id", "frame_no")
    sources = spark.createDataFrame([("v", 8, 8, True, True)], "source_id string, declared_frames long, total_frames long, index_clean boolean, scan_clean boolean")
    monkeypatch.setattr(status.layers, "coverage", lambda led: led.intervals.groupBy("source_id").agg(status.F.count("id").alias("approximate_merge_intervals")))
    plan = status.status(led, found, found, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6, plan.count("Join ")


def test_the_fine_review_is_no_plan_of_many_joins(spark, monkeypatch):
    """Roles, links and steps are joined in plans of their own; the driver holds a plan's stages at once."""
    data = sound()
    led, plans, write = ledger(spark, data), {}, layers.staged
    monkeypatch.setattr(layers, "staged", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")}) or write(df, name))
    assert layers.fine_problems(led).columns == ["source_id", "id", "code", "complete"]
    assert max(plans.values()) <= 4, plans


def test_one_altered_value_breaks_continuity(spark):
    found = audit.strict(ledger(spark, sound(after="9")))
    assert codes(found) == [("state_discontinuity", "S2")]
    where = audit.located(found, ledger(spark, sound()).frames).first()
    assert (where.suggested_frames, where.start_time, where.end_time) == ([3, 4], 0.75, 1.0)
    # 2 and 2.0 are one number
    assert codes(audit.strict(ledger(spark, sound(after="2.0")))) == []


def test_null_facts_reset_nothing(spark):
    data = sound()
    data["steps"][1] = (*data["steps"][1][:9], ({"A.rate": ("null", [f(4)])}, *data["steps"][1][9][1:]), *data["steps"][1][10:])
    assert codes(audit.strict(ledger(spark, data))) == [("state_value_unknown", "S2")]


def test_gaps_and_overlaps_of_intervals(spark):
    data = sound()
    one = data["intervals"][0]
    data["intervals"] = [one, (*one[:1], "P2", 3, 5, *one[4:])]
    assert {c for c, _ in codes(layers.intervals(ledger(spark, data)))} >= {"interval_gap", "interval_overlap", "interval_overview_missing", "step_outside_interval"} - {"interval_overview_missing"}
    data["intervals"] = []
    assert codes(layers.intervals(ledger(spark, data))) == [("interval_gap", "0")]


def test_roles_must_be_seen_in_order(spark):
    data = sound()
    s = data["steps"][0]
    data["steps"][0] = (*s[:10], {"before": [f(3)], "during": [f(0)], "after": [f(5)]}, *s[11:])
    found = {c for c, _ in codes(layers.intervals(ledger(spark, data)))}
    assert found == {"operation_role_order", "role_evidence_not_declared", "role_evidence_outside_step"}


CHECK = "source_id string, id string, interval_id string, reviewer string, scope_hash string, method string, conclusion string, evidence array<string>, resolves array<string>, source_scope_frames array<long>"


def test_samples_and_expansions(spark):
    from strandline.operators import evidence as ev

    led = ledger(spark, sound())
    hashes = {r.id: r.scope_hash for r in ev.scopes(ev.mapping(led.frames, led.intervals), led.intervals, led.steps).collect()}
    every = lambda a, b: [f(k) for k in range(a, b + 1)]
    check = lambda *c: spark.createDataFrame(list(c), CHECK)
    clear = lambda i, p, a, b, resolves=(): ("v", i, p, "bob", hashes[p], "exhaustive", "clear", every(a, b), list(resolves), list(range(a, b + 1)))
    assert codes(layers.samples(led, check(clear("C1", "P1", 0, 3), clear("C2", "P2", 4, 7)))) == []
    assert codes(layers.samples(led, check(clear("C1", "P1", 0, 3)))) == [("interval_sample_missing", "P2")]
    stale = (*clear("C2", "P2", 4, 7)[:4], "old", *clear("C2", "P2", 4, 7)[5:])
    assert codes(layers.samples(led, check(clear("C1", "P1", 0, 3), stale))) == [("interval_sample_missing", "P2"), ("interval_sample_stale", "P2")]
    odd = ("v", "E", "P1", "bob", hashes["P1"], "exhaustive", "expand", every(0, 3), [], [0, 1, 2, 3])
    assert codes(layers.samples(led, check(odd, clear("C2", "P2", 4, 7)))) == [("sample_requires_expansion", "E")]
    assert codes(layers.samples(led, check(odd, clear("C1", "P1", 0, 3, ["E"]), clear("C2", "P2", 4, 7)))) == []
    narrow = (*clear("C1", "P1", 0, 3, ["E"])[:5], "risk_and_random", *clear("C1", "P1", 0, 3, ["E"])[6:])
    assert codes(layers.samples(led, check(odd, narrow, clear("C2", "P2", 4, 7)))) == [("expansion_scope_incomplete", "C1"), ("sample_requires_expansion", "E")]
    gone = ("v", "E", "P0", "bob", "old", "exhaustive", "expand", [], [], [1])
    assert codes(layers.samples(led, check(gone, clear("C1", "P1", 0, 3), clear("C2", "P2", 4, 7)))) == [("retired_interval_anomaly", "E")]


def test_independent_reviews_pass_the_gate(spark):
    led = ledger(spark, sound())
    snap = spark.createDataFrame([("v", "now")], "source_id string, snapshot string")
    base = "source_id string, id string, reviewer string, independence string, snapshot string, evidence array<string>, issue_ids array<string>, tool_trace_refs array<string>, conclusion string, recorded_at int, "
    all_ = [f(k) for k in range(8)]
    strict = lambda who, seen=all_, states=range(8), snapshot="now": spark.createDataFrame([("v", "V", who, "independent", snapshot, list(seen), [], ["call#bob0"], "no_additional_omissions_found", 1, list(states))], base + "checked_state_frames array<long>")
    assert codes(audit.strict_review(led, strict("bob"), snap)) == []
    assert {c for c, _ in codes(audit.strict_review(led, strict("ann"), snap))} == {"reviewer_not_independent", "review_trace_unlinked"}
    assert codes(audit.strict_review(led, strict("bob", snapshot="old"), snap)) == [("omission_review_stale", "V")]
    assert codes(audit.strict_review(led, strict("bob", all_[:7], range(7)), snap)) == [("review_scope_incomplete", "V"), ("reviewer_view_missing", "7")]
    layered = lambda seen, ids: spark.createDataFrame([("v", "V", "bob", "independent", "now", list(seen), [], ["call#bob0"], "no_additional_omissions_found", 1, list(ids))], base + "checked_interval_ids array<string>")
    assert codes(layers.layered_review(led, layered(all_, ["P2", "P1"]), snap)) == []
    # of the second interval its last frame, which is a role's image too, was not seen
    found = codes(layers.layered_review(led, layered(all_[:7], ["P1"]), snap))
    assert found == [("review_scope_incomplete", "V"), ("reviewer_fine_view_missing", "P2"), ("reviewer_view_missing", "P2")]
    none = strict("bob").limit(0)
    assert codes(audit.strict_review(led, none, snap)) == [("omission_review_missing", None)]


def test_a_larger_region_of_the_same_run_covers_a_crop(spark):
    data = sound()
    data["frames"][1] = ("v", 1, 0, "d0", 0.25, 0.0, 640, 360)
    data["assets"] += [("v", "c", 0, "crop", f(0), "hc", [10, 10, 50, 50]), ("v", "big", 1, "crop", f(1), "hb", [0, 0, 60, 60]), ("v", "small", 1, "crop", f(1), "hs", [20, 20, 60, 60])]
    data["views"] += [("v", f"{a}:bob", a, n, "bob", h, "native", "call#x", "seen", "read_image") for a, n, h in (("big", 1, "hb"), ("small", 1, "hs"))]
    led = ledger(spark, data)
    targets = spark.createDataFrame([("v", "c")], "source_id string, asset_id string")
    refs = lambda *r: spark.createDataFrame([("v", "bob", x) for x in r], "source_id string, actor string, ref string")
    covered = lambda *r: layers.covered_assets(targets, refs(*r), led, ["source_id"]).count()
    assert (covered("big"), covered("small"), covered(f(1)), covered(f(2))) == (1, 0, 1, 0)


def test_status_hides_counters_of_broken_records(spark):
    led = ledger(spark, sound())
    one = spark.createDataFrame([("v", 9, 8, True, True)], "source_id string, declared_frames long, total_frames long, index_clean boolean, scan_clean boolean")
    found = led.frames.select("source_id", "frame_no")
    row = status.status(led, found, found, one).first()
    assert (row.frame_count_mismatch, row.full_compute_complete, row.selected_review_complete, row.all_frames_review_complete, row.coarse_frames) == (True, True, True, True, 8)
    hidden = status.status(led, found, found, one, found).first()
    assert hidden.coarse_frames is None and hidden.indexed_frames == 8
    empty = spark.createDataFrame([], "source_id string")
    assert status.complete(status.status(led, found, found, one), empty, empty).first().review_complete


def test_report(spark):
    led = ledger(spark, sound(after="9"))
    text = report.render(report.report_lines(led, audit.strict(led)), "v", "g1")
    # a value that jumps between two steps leaves neither of them certain
    assert text.index("S1：部分确认，待核实（步骤登记为已确认）") < text.index("S2：部分确认，待核实（步骤登记为已确认）") < text.index("`state_discontinuity`：S2")
    assert "step-5331" in text and "g1" in text
    assert "## 下一步\n\ngo on" in report.handoff({"path": "p"}, {"full_compute_complete": False}, {"next_action": "go on"}, ["x"], "g1")


@pytest.mark.parametrize("name", ["frm_metrics", "plan_break", "sel_anchor", "agg_sample", "audit_layers", "audit_samples", "audit_strict", "ivl_intersect_closed", "ivl_align", "queue", "cand_manifest", "join_coarse_ok"])
def test_plans_have_no_products_and_no_single_task(spark, name):
    """No nested loops or products, and no exchange of many rows to one partition."""
    assert ledger_queries and record_queries
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = catalog.QUERIES[name](spark, DATA)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # what goes to one task is one partial result of each: edges between ranges of vectors, levels of intervals
    single = plan.count("Exchange SinglePartition")
    assert single <= plan.count("subquery#") + (name == "frm_metrics")
