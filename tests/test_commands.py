"""Commands on a stored ledger, from decoded frames to a passed gate."""

import hashlib
import json
import random

import pytest

from strandline.__main__ import run


pytestmark = pytest.mark.usefixtures("small_tables")


@pytest.fixture(scope="module")
def work(spark, small_tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    rng = random.Random(8)
    images, last = [], None
    for n in range(12):
        if last is None or n not in (2, 3, 7):  # 2 and 3 repeat 1, 7 repeats 6
            last = bytes(rng.randrange(256) for _ in range(8 * 6 * 3))
        images.append(("v", n, 8, 6, bytearray(last), n / 4))
    spark.createDataFrame(images, "source_id string, frame_no long, width int, height int, pixels binary, time_s double").write.parquet(f"file://{root}/decoded")
    path = f"file://{root}/ledger"

    def call(*argv):
        return run(spark, [argv[0], "--work", path, *map(str, argv[1:])])

    call("create")
    call("scan", "--frames", f"file://{root}/decoded")
    return root, call


def f(n):
    return f"f{n:09d}"


def test_doctor(spark):
    assert run(spark, ["doctor"])["ok"]


def test_scan_is_indexed_once_and_replayed(work):
    root, call = work
    assert call("scan", "--frames", f"file://{root}/decoded") == {"frames": 12, "new": 0, "status": "complete"}
    row = call("status")["status"][0]
    assert (row["indexed_frames"], row["computed_frames"], row["full_compute_complete"], row["candidate_frames"]) == (12, 12, True, 0)


def test_plan_queue_views_and_gate(spark, work):
    from strandline.sources import store

    root, call = work
    planned = call("plan")["segments"]
    again = call("plan")
    assert again["planned"] == 0 and again["segments"] == planned
    assert planned[0]["start_frame"] == 0 and sum(s["distinct_states"] for s in planned) == 9
    assert call("select", "--mode", "coverage")["requests"] > 9
    before = call("queue", "--batch-size", 3, "--start", 1.0, "--end", 2.0)
    assert before["total_pending"] == 9 and before["batch"][0]["in_range"] and len(before["batch"]) == 3
    assert call("focus", "--start", 0, "--end", 9, "--reason", "why", "--stride", 5)["requests"] == 3
    (root / "ledger" / "evidence").mkdir()
    for n in range(12):
        (root / "ledger" / "evidence" / f"{f(n)}.png").write_bytes(b"image %d" % n)
    hashed = lambda n: hashlib.sha256(b"image %d" % n).hexdigest()
    assets = [("v", f(n), n, "full", f"evidence/{f(n)}.png", hashed(n)) for n in range(12)]
    store.append(spark.createDataFrame(assets, store.TABLES["assets"].split(", parent_id")[0]), f"file://{root}/ledger", "assets")
    with pytest.raises(ValueError, match="trace"):
        call("record-view", f(0), "--source", "v", "--actor", "ann", "--tool", "view_image", "--trace", "a.png", "--observation", "x")
    states = [0, 1, 4, 5, 6, 8, 9, 10, 11]
    views = [("v", f"{f(n)}:{a}", f(n), n, a, "read_image", f"call#{a}", "seen", hashed(n), "native") for n in states for a in ("ann", "bob")]
    told = spark.createDataFrame(views, "source_id string, id string, asset_id string, frame_no long, actor string, tool string, trace_ref string, observation string, asset_sha256 string, presentation string")
    store.append(told, f"file://{root}/ledger", "views")
    assert call("queue")["total_pending"] == 0 and call("candidates", "--pending")["candidates"] == []

    proof = {"status": "observed", "note": "n", "evidence": [f(11)]}
    step = {
        "id": "S1", "phase": "p", "start_frame": 0, "end_frame": 11, "software": "s", "module": "m", "menu_path": [], "selected_objects": [], "final_parameters": {"A": {"value": 2}}, "confirmation_action": "c", "visible_result": "v", "input_files": [], "output_files": [],
        "evidence": [f(0), f(11)], "uncertainties": [], "status": "confirmed", "author": "ann", "transition": {"before": {"A": {"value": 1, "evidence": [f(0)]}}, "after": {"A": {"value": 2, "evidence": [f(11)]}}, "confirmation": proof, "result": proof},
    }
    cover = [{"frame_no": n, "classification": "operation", "reason": "r", "reviewer": "ann", "step_ids": ["S1"], "issue_ids": [], "evidence": [f(n)]} for n in states]
    put = lambda name, data: (root / name).write_text(json.dumps(data)) and call("import-records", root / name, "--source", "v")
    with pytest.raises(ValueError, match="not_a_representative"):
        put("bad.json", {"steps": [step], "coverage": [*cover, {**cover[0], "frame_no": 2}]})
    assert call("status")["status"][0]["state_accounting_records"] == 0
    assert put("good.json", {"steps": [step], "coverage": cover}) == {"imported": 10}
    assert call("validate")["valid"]
    left = call("audit", "--mode", "strict")
    assert [x["code"] for x in left["findings"]] == ["omission_review_missing"] and not left["gate"][0]["passed"]
    from strandline.operators import identity
    from strandline.sources import typed

    shot = identity.strict_snapshot(typed.ledger(store.open_ledger(spark, f"file://{root}/ledger"))).first().snapshot
    review = {"id": "V1", "reviewer": "bob", "note": "n", "independence": "independent", "snapshot": shot, "checked_state_frames": states, "evidence": [f(n) for n in states], "issue_ids": [], "tool_trace_refs": ["call#bob"], "conclusion": "no_additional_omissions_found"}
    put("review.json", {"omission_reviews": [review]})
    assert call("audit", "--mode", "strict")["gate"][0]["passed"]


def test_layers_language_and_export(work):
    root, call = work
    put = lambda name, data: (root / name).write_text(json.dumps(data)) and call("import-records", root / name, "--source", "v")
    entry = {"id": "P1", "start_frame": 0, "end_frame": 11, "phase": "p", "reason": "r", "reviewer": "ann", "disposition": "context", "merge": "approximate", "fine_status": "not_reviewed", "evidence": [f(0), f(11)], "step_ids": [], "issue_ids": []}
    with pytest.raises(ValueError, match="uncomputed_frames"):
        put("wide.json", {"intervals": [{**entry, "end_frame": 40}]})
    put("interval.json", {"intervals": [entry]})
    told = call("intervals")["intervals"][0]
    assert told["required"] and set(told["frames"]) <= set(told["all_state_frames"])
    check = {"id": "C1", "interval_id": "P1", "reviewer": "bob", "scope_hash": told["scope_hash"], "reason": "r", "method": "exhaustive", "conclusion": "clear", "evidence": [f(n) for n in told["all_state_frames"]]}
    with pytest.raises(ValueError, match="scope_not_current"):
        put("old.json", {"interval_checks": [{**check, "scope_hash": "0" * 64}]})
    put("check.json", {"interval_checks": [check]})
    with pytest.raises(ValueError, match="changed_check"):
        put("again.json", {"interval_checks": [{**check, "reason": "other"}]})
    codes = {x["code"] for x in call("audit", "--mode", "layered")["findings"]}
    assert codes == {"omission_review_missing", "step_without_state"}
    (root / "a.srt").write_text("1\n00:00:00,300 --> 00:00:01,000\nhello\n")
    cue = call("subtitles", root / "a.srt", "--source", "v", "--offset", 0.5)["cues"][0]
    assert (cue["start_time"], cue["frame_ranges"]) == (0.8, [{"start": 3, "end": 5}])
    (root / "t.json").write_text(json.dumps({"time_base": "video_relative", "segments": [{"start": 0.0, "end": 0.2, "text": "x"}]}))
    assert call("transcript", f"file://{root}/t.json", "--source", "v")["cues"][0]["frame_ranges"] == [{"start": 0, "end": 0}]
    where = call("export", "--to", f"file://{root}/out")["export"].removeprefix("file://")
    assert (root / "out").exists() and where


def test_budget_files_retirement_and_imports(spark, tmp_path):
    """One ledger through what a ledger must refuse, remember and pin."""
    from strandline.sources import store

    rng = random.Random(1)
    images = [("v", n, 4, 4, bytearray(rng.randrange(256) for _ in range(48)), n / 2) for n in range(6)]
    spark.createDataFrame(images, "source_id string, frame_no long, width int, height int, pixels binary, time_s double").write.parquet(f"file://{tmp_path}/decoded")
    path = f"file://{tmp_path}/ledger"
    call = lambda *argv: run(spark, [argv[0], "--work", path, *map(str, argv[1:])])
    call("create")
    movie = tmp_path / "m.mp4"
    movie.write_bytes(bytes.fromhex("0000000c66747970") + b"isom" + bytes.fromhex("000000086d6f6f76"))
    with pytest.raises(ValueError, match="unsupported_media_input"):
        call("scan", "--frames", f"file://{tmp_path}/decoded", "--media", str(tmp_path / "none.mp4"))
    first = call("scan", "--frames", f"file://{tmp_path}/decoded", "--max-new", 4, "--media", str(movie))
    assert (first["new"], first["status"]) == (4, "paused_budget")
    rest = call("scan", "--frames", f"file://{tmp_path}/decoded", "--max-new", 4)
    assert (rest["frames"], rest["new"], rest["status"]) == (3, 2, "complete")  # the last stored frame is looked at again
    held = store.open_ledger(spark, path)
    assert sorted(r.frame_no for r in held["frames"].collect()) == list(range(6)) and store.open_attempts(held["attempts"]).count() == 0
    with pytest.raises(ValueError, match="replay differs"):
        other = [(*i[:4], bytearray(48), i[5]) for i in images]
        spark.createDataFrame(other, "source_id string, frame_no long, width int, height int, pixels binary, time_s double").write.parquet(f"file://{tmp_path}/other")
        call("scan", "--frames", f"file://{tmp_path}/other")
    failed = store.open_ledger(spark, path)["attempts"].where("status = 'failed'").collect()
    assert len(failed) == 1 and "replay differs" in failed[0].error

    (tmp_path / "ledger" / "evidence").mkdir()
    image = tmp_path / "ledger" / "evidence" / "a.png"
    image.write_bytes(b"image")
    store.append(spark.createDataFrame([("v", f(0), 0, "full", "evidence/a.png", hashlib.sha256(b"image").hexdigest())], "source_id string, id string, frame_no long, kind string, path string, sha256 string"), path, "assets")
    view = ("record-view", f(0), "--source", "v", "--actor", "ann", "--tool", "read_image", "--trace", "read_image#1", "--observation", "x")
    assert call(*view)["frame_no"] == 0
    assert call("validate")["valid"]
    image.write_bytes(b"changed")
    with pytest.raises(ValueError, match="missing or changed"):
        call(*view)
    movie.unlink()
    assert {e["code"] for e in call("validate")["errors"]} == {"asset_hash_mismatch", "source_missing"}

    call("select", "--mode", "changes")
    assert store.review_mode(store.open_ledger(spark, path)["meta"]) == "strict"
    call("select")
    told = call("status")
    assert told["review_mode"] == "layered"
    (tmp_path / "a.srt").write_text("1\n00:00:00,300 --> 00:00:01,000\nhello\n")
    new, again = (call("subtitles", str(tmp_path / "a.srt"), "--source", "v") for _ in range(2))
    assert (new["cache_reused"], again["cache_reused"]) == (False, True) and new["cues"][0]["id"] == again["cues"][0]["id"] and len(again["cues"]) == 1
    assert call("status")["snapshots"] != told["snapshots"]  # a review of before is stale

    step = {
        "id": "S1", "phase": "p", "start_frame": 0, "end_frame": 5, "software": "s", "module": "m", "menu_path": [], "selected_objects": [], "final_parameters": {}, "confirmation_action": "c", "visible_result": "v", "input_files": [], "output_files": [], "evidence": [f(0)], "uncertainties": [], "status": "confirmed", "author": "ann",
    }
    put = lambda name, data: (tmp_path / name).write_text(json.dumps(data)) and call("import-records", tmp_path / name, "--source", "v")
    put("s.json", {"steps": [step]})
    gone = {"id": "S1", "reason": "r", "reviewer": "bob", "replacement_step_ids": ["S2"]}
    with pytest.raises(ValueError, match="replacement_not_active"):
        put("r.json", {"retire_steps": [gone]})
    put("r.json", {"retire_steps": [gone], "steps": [{**step, "id": "S2"}]})
    log = store.open_ledger(spark, path)["records"]
    from strandline.operators import contracts

    assert [r.id for r in contracts.current_table(log, "steps").collect()] == ["S2"]
    with pytest.raises(ValueError, match="retired_id_used_again"):
        put("s.json", {"steps": [step]})
