"""Commands over a stored ledger: ``python -m strandline COMMAND --work FOLDER``.

Every command prints one JSON object. Exit codes: 0 done; 1 an error, or ``validate --require-coverage``
on a ledger that is invalid or not fully reviewed; 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import contracts, evidence, identity, language, records, segments, selection
from .operators import frames as fr
from .plans import audit, layers
from .plans import status as progress
from .sources import adapters, environment, files, sinks, store, typed
from .sources.tables import staged
from .streaming import budget


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().toLocalIterator()]


class Work:
    """An open ledger: its newest version, and changes as whole new versions on top of it."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False):
        self.spark, self.path = spark, path
        self.store = store.versions(spark, path)
        self.tables = store.open_ledger(spark, path, create)
        self.base = self.store.latest()
        self.led = typed.ledger(self.tables)

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """All of these changes, or none; another writer's version in between refuses replacements."""
        append, replace = append or {}, replace or {}
        self.base = self.store.commit(self.base, {t: store.typed_as(r, t) for t, r in append.items()}, {t: store.typed_as(r, t) for t, r in replace.items()})

    def noted(self, **values: str) -> DataFrame:
        """Settings of the whole ledger as rows of ``meta``."""
        return self.spark.createDataFrame([("", k, json.dumps(v), time.time_ns()) for k, v in values.items()], store.TABLES["meta"])

    def replan(self, asked: DataFrame, mode: str) -> None:
        """Automatic requests anew, with the mode of review they are for."""
        asked = asked.select("source_id", "frame_no", "reason", "origin")
        self.commit({"meta": self.noted(review_mode=mode)}, {"requests": self.tables["requests"].where("origin <> 'automatic'").unionByName(asked)})

    @contextmanager
    def attempt(self, source: str, kind: str):
        """A run on record: opened before it begins, closed with how it ended; a crash leaves it open."""
        run = f"{kind}-{time.time_ns()}"

        def log(event, status, error=None):
            row = self.spark.createDataFrame([(source, run, kind, event, status, error)], "source_id string, id string, kind string, event string, status string, error string")
            self.commit({"attempts": row.withColumn("at", F.current_timestamp())})

        log("opened", "running")
        try:
            yield
        except BaseException as e:
            log("closed", "failed", str(e)[:2000])
            raise
        log("closed", "complete")

    def file(self, path: str | None) -> str:
        """A path inside the ledger's folder."""
        return f"{self.path.rstrip('/')}/{path}"

    def retired(self) -> DataFrame:
        return contracts.current_table(self.tables["records"], "retire_steps")

    def snapshot(self, mode: str) -> DataFrame:
        """What a review of this mode pins, retirements and, with layers, language sources included."""
        if mode == "strict":
            return identity.strict_snapshot(self.led, self.retired())
        if mode == "layered":
            return identity.layered_snapshot(self.led, typed.checks(self.tables["records"]), self.tables["languages"].select("source_id", "id", "sha256"), self.retired())
        raise ValueError("mode must be layered or strict")

    def file_findings(self) -> DataFrame:
        """Assets and source files that are gone, changed or, for sources, not a container to read."""
        root = F.lit(self.file(""))
        inside = self.led.assets.where(scalars.safe_path(F.col("path"))).select("source_id", "path", F.concat(root, "path").alias("at"))
        have = files.examined(inside.distinct(), "at").where("n_bytes is not null")
        held = store.meta(self.tables["meta"]).groupBy("source_id").pivot("key", ["source_path", "source_sha256"]).agg(F.first("value"))
        told = held.where("source_path is not null").select("source_id", F.col("source_path").alias("path"), F.col("source_sha256").alias("sha256"))
        there = files.with_kind(files.examined(told.select("path").distinct()).where("n_bytes is not null"))
        return audit.asset_files(self.led.assets, have.select("source_id", "path", "sha256")).unionByName(audit.source_files(told, there))

    @property
    def runs(self) -> DataFrame:
        return self.led.frames

    def candidates(self) -> DataFrame:
        return selection.candidates(self.tables["requests"].select("source_id", "frame_no", "reason"), self.runs)

    def sources(self) -> DataFrame:
        """Per source: declared and indexed frames, and whether index and scan ended cleanly."""
        held = store.meta(self.tables["meta"]).where("source_id <> ''").groupBy("source_id").pivot("key", ["declared_frames", "video_total_frames", "index_complete_clean", "scan_complete_clean"]).agg(F.first("value"))
        flag = lambda c: F.coalesce(F.col(c) == "true", F.lit(False))
        known = self.led.frames.select("source_id").distinct().join(held, "source_id", "left")
        return known.select("source_id", F.expr("try_cast(declared_frames as bigint)").alias("declared_frames"), F.expr("try_cast(video_total_frames as bigint)").alias("total_frames"), flag("index_complete_clean").alias("index_clean"), flag("scan_complete_clean").alias("scan_clean"))

    def broken(self) -> DataFrame:
        """Stored records that break their contract."""
        out = None
        for tbl, rules in (("steps", contracts.step_rules()), ("issues", contracts.issue_rules(False))):
            found = contracts.stored_problems(contracts.current_table(self.tables["records"], tbl), rules)
            out = found if out is None else out.unionByName(found)
        return out

    def mode(self) -> str:
        return store.review_mode(self.tables["meta"])

    def findings(self, mode: str) -> DataFrame:
        """Audit findings of a mode, reviews included."""
        led, log = self.led, self.tables["records"]
        if mode == "strict":
            found = audit.union(audit.strict(led), audit.strict_review(led, typed.reviews(log, False), self.snapshot(mode)))
        elif mode == "layered":
            checks = typed.checks(log)
            found = audit.union(layers.layered(led, checks), layers.layered_review(led, typed.reviews(log, True), self.snapshot(mode)))
        else:
            raise ValueError("mode must be layered or strict")
        return audit.located(found, led.frames)


def create(w: Work, a) -> dict:
    return {"work": w.path, "tables": sorted(w.tables)}


def _registered(w: Work, media: str) -> tuple[str, str]:
    """Path and hash of a source file; one that is not a self-contained container is refused."""
    row = files.with_kind(files.examined(w.spark.createDataFrame([(media,)], "path string"))).first()
    if row.sha256 is None or row.kind is None:
        raise ValueError(f"unsupported_media_input: {media}")
    return media, row.sha256


def scan(w: Work, a) -> dict:
    """Index and metrics of frames that a decoder wrote as Parquet (source_id, frame_no, width, height, pixels[, time_s]).

    Without a budget all frames are computed and stored ones must come out the same. With one
    the next ``--max-new`` of each source are, and the last stored one again as a check.
    """
    images = w.spark.read.parquet(a.frames)
    old = w.tables["frames"].where("digest is not null")
    key, todo, paused = ["source_id", "frame_no"], images, None
    media = _registered(w, a.media) if a.media else None
    if a.max_new is not None:
        asked = staged(budget(images, old, a.max_new), "budget")
        paused = asked.where("status = 'paused_budget'").select("source_id").distinct()
        last = old.groupBy("source_id").agg(F.max("frame_no").alias("frame_no"))
        todo = images.join(asked.select(*key).unionByName(last.select(*key)).distinct(), key, "left_semi")
    with w.attempt("", "scan"):
        done = fr.image_metrics(todo, a.tile_size, a.pixel_threshold).drop("exact_start")
        timed = images.select(*key, "time_s") if "time_s" in images.columns else images.select(*key, F.lit(None).cast("double").alias("time_s"))
        rows = staged(done.join(timed, key).withColumn("time_source", F.when(F.col("time_s").isNull(), "missing").otherwise("pts")), "scan")
        again = old if a.max_new is None else old.join(rows.select(*key), key, "left_semi")
        if bad := adapters.replay_mismatches(again, rows, ["digest"]).join(rows.select("source_id").distinct(), "source_id", "left_semi").limit(5).collect():
            raise ValueError(f"replay differs from the stored frames: {[(r.source_id, r.frame_no) for r in bad]}")
        new = rows.join(old.select(*key), key, "left_anti")
        whole = fr.runs(staged(old.select(*key, "digest").unionByName(new.select(*key, "digest")), "digests")).select(*key, "exact_start")
        new = staged(new.join(whole, key), "new")
        counts = images.groupBy("source_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
        counts = counts.withColumn("clean", F.lit("true")) if paused is None else counts.join(paused.withColumn("p", F.lit(True)), "source_id", "left").withColumn("clean", F.when(F.col("p"), "false").otherwise("true")).drop("p")
        value = lambda name, v: counts.select("source_id", F.lit(name).alias("key"), v.alias("value"), F.lit(time.time_ns()).alias("seq"))
        told = value("video_total_frames", F.col("n")).unionByName(value("index_complete_clean", F.col("clean"))).unionByName(value("scan_complete_clean", F.col("clean")))
        if media:
            told = told.unionByName(value("source_path", F.lit(media[0]))).unionByName(value("source_sha256", F.lit(media[1])))
        w.commit({"frames": new, "meta": told})
    return {"frames": rows.count(), "new": new.count(), "status": "paused_budget" if paused is not None and not paused.isEmpty() else "complete"}


def select(w: Work, a) -> dict:
    given = {k: v for k, v in (("anchor_seconds", a.anchor_seconds), ("global_at", a.global_threshold), ("local_at", a.local_threshold), ("pixels_at", a.min_changed_pixels), ("context_frames", a.context_frames)) if v is not None}
    asked = selection.select(w.runs, a.mode, **given).withColumn("origin", F.lit("automatic"))
    w.replan(staged(asked, "asked"), "layered" if a.mode == "layered" else "strict")
    return {"requests": asked.count()}


def plan(w: Work, a) -> dict:
    """Segments and their requests; only of sources whose frames or settings changed since their last plan."""
    config = {"max_span": a.max_span, "layout_fraction": a.layout_fraction, "stable_seconds": a.stable_seconds}
    keys = staged(segments.plan_key(identity.plan_fingerprint(w.runs), config), "keys")
    held = store.meta(w.tables["meta"]).where("key = 'plan_key'").select("source_id", F.col("value").alias("key"))
    due = staged(keys.join(held, ["source_id", "key"], "left_anti"), "due")
    proposals, asked = segments.prepare(w.led.states.join(due.select("source_id"), "source_id", "left_semi"), a.max_span, a.layout_fraction, a.stable_seconds)
    proposals = staged(proposals, "proposals")
    stays = lambda rows: rows.join(due.select("source_id"), "source_id", "left_anti")
    plans = staged(stays(store.typed_as(w.tables["plans"], "plans")).unionByName(store.typed_as(proposals, "plans")), "plans")
    told = w.noted(review_mode="layered").unionByName(due.select("source_id", F.lit("plan_key").alias("key"), F.col("key").alias("value"), F.lit(time.time_ns()).alias("seq")))
    # selections of other modes go, and with them the requests of plans that stay are written again
    wanted = plans.select("source_id", F.explode("representative_frames").alias("frame_no"), F.concat(F.lit("layer_overview:"), "id").alias("reason"), F.lit("automatic").alias("origin"))
    other = w.tables["requests"].where("origin <> 'automatic'")
    w.commit({"meta": told}, {"requests": other.unionByName(wanted), "plans": plans})
    return {"segments": _rows(plans.orderBy("source_id", "start_frame")), "planned": due.count()}


def focus(w: Work, a) -> dict:
    if a.start > a.end or a.stride < 1 or not a.reason.strip():
        raise ValueError("give an ordered interval, a positive stride and a reason")
    asked = selection.focus(w.runs.where("digest is not null"), a.start, a.end, a.stride).withColumns({"reason": F.lit(a.reason), "origin": F.lit("focus")})
    w.commit({"requests": asked.join(w.tables["requests"].select("source_id", "frame_no", "reason", "origin"), ["source_id", "frame_no", "reason", "origin"], "left_anti")})
    return {"requests": asked.count()}


def candidates(w: Work, a) -> dict:
    found = selection.manifest(w.candidates(), w.runs, w.led.assets, w.led.views, a.pending, a.start, a.end)
    return {"candidates": _rows(found.orderBy("source_id", "frame_no"))}


def queue(w: Work, a) -> dict:
    left = w.candidates().join(progress.full_native(w.led), ["source_id", "frame_no"], "left_anti")
    return {"total_pending": left.count(), "batch": _rows(selection.queue(left, w.runs, a.start, a.end, a.batch_size).orderBy("source_id", "position"))}


def status(w: Work, a) -> dict:
    rows = progress.status(w.led, w.tables["requests"], w.candidates().select("source_id", "frame_no"), w.sources(), w.broken())
    return {"status": _rows(rows.orderBy("source_id")), "snapshots": _rows(w.snapshot(w.mode())), "review_mode": w.mode()}


def import_records(w: Work, a) -> dict:
    """A file with one object of arrays per table; all of it is taken over, or nothing."""
    with open(a.file, encoding="utf-8-sig") as f:
        data = json.load(f)
    if not isinstance(data, dict) or any(not isinstance(v, list) for v in data.values()):
        raise ValueError("records must be an object of arrays")
    key = lambda tbl, r: str(r.get("frame_no") if tbl == "coverage" else r.get("id")) if isinstance(r, dict) else ""
    rows = [(a.source, tbl, key(tbl, r), json.dumps(r, ensure_ascii=False)) for tbl, rows in data.items() for r in rows]
    batch = w.spark.createDataFrame(rows, "source_id string, tbl string, id string, payload string")
    log, led = w.tables["records"], w.led
    more = []
    own = typed.coverage(contracts.import_batch(log.limit(0), batch, "probe")) if "coverage" in data else None
    if own is not None:
        more.append(contracts.representative_problems(own, w.runs).select("source_id", F.col("frame_no").cast("string").alias("id"), F.lit("not_a_representative").alias("code")))
    if "intervals" in data:
        spans = typed.intervals(contracts.import_batch(log.limit(0), batch, "probe"))
        more.append(contracts.uncomputed_intervals(spans, w.runs).withColumn("code", F.lit("uncomputed_frames")))
    if "interval_checks" in data:
        mapped = evidence.mapping(w.runs, led.intervals)
        now = staged(evidence.scopes(mapped, led.intervals, led.steps), "scopes")
        need = evidence.required_sample(mapped, led.intervals.join(now, ["source_id", "id"])).select("source_id", F.col("id").alias("interval_id"), "all_state_frames")
        part = batch.where("tbl = 'interval_checks'").withColumn("__v", F.try_parse_json("payload"))
        field = lambda n: F.try_variant_get("__v", f"$.{n}", "string").alias(n)
        told = part.select("source_id", "id", field("interval_id"), field("scope_hash"))
        more.append(contracts.scope_problems(told, now))
        stamped = part.withColumn("interval_id", field("interval_id")).join(need, ["source_id", "interval_id"], "left")
        # the states at import stay on the check, so later shrinkage cannot hide an anomaly
        whole = F.concat(F.rtrim(F.regexp_replace("payload", r"\}\s*$", "")), F.lit(', "source_scope_frames": '), F.to_json(F.coalesce("all_state_frames", F.expr("cast(array() as array<bigint>)"))), F.lit("}"))
        stamped = stamped.select("source_id", "tbl", "id", whole.alias("payload"))
        more.append(contracts.changed_checks(contracts.current_table(log, "interval_checks"), stamped).withColumn("code", F.lit("changed_check")))
        batch = staged(batch.where("tbl <> 'interval_checks'").unionByName(stamped), "batch")
    gone = w.retired()
    if "retire_steps" in data or not gone.isEmpty():
        asked, violated = _retirement(w, batch, gone)
        more.append(violated)
    merged = contracts.import_batch(log, batch, a.batch or f"import-{int(time.time())}", *more)
    if "retire_steps" in data:
        merged = records.retire(merged, asked, violated)
    w.commit({"records": merged.join(log.select("source_id", "tbl", "id", "seq"), ["source_id", "tbl", "id", "seq"], "left_anti")})
    return {"imported": len(rows)}


def _retirement(w: Work, batch: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, what forbids them) of a batch's corrections, judged on all tables before and after it."""
    log = w.tables["records"]
    probe = staged(contracts.import_batch(log.limit(0), batch, "probe"), "probe")
    kinds = {"steps": typed.steps, "issues": typed.issues, "intervals": typed.intervals, "coverage": typed.coverage}
    before, new = ({n: staged(f(rows), n) for n, f in kinds.items()} for rows in (log, probe))
    asked = staged(typed.retirements(probe), "retirements")
    unsound = contracts.stored_problems(contracts.current_table(log, "steps"), contracts.step_rules())
    found = records.retirement_violations(asked, gone, before, new, checks=typed.checks(log).select("source_id", "interval_id", "conclusion"), unsound=unsound.select("source_id", "id"))
    return asked, staged(found, "violations")


def record_view(w: Work, a) -> dict:
    asset = w.led.assets.where((F.col("id") == a.asset) & (F.col("source_id") == a.source)).first()
    if asset is None:
        raise ValueError(f"unknown asset {a.asset}")
    now = files.examined(w.spark.createDataFrame([(w.file(asset.path),)], "path string")).first() if w.spark.range(1).select(scalars.safe_path(F.lit(asset.path))).first()[0] else None
    if now is None or now.sha256 != asset.sha256:
        raise ValueError(f"missing or changed asset {a.asset}")
    row = [(a.source, f"{a.asset}:{a.actor}:{time.time_ns()}", a.asset, asset.frame_no, a.actor, a.tool, a.trace, a.observation, asset.sha256, "native")]
    view = w.spark.createDataFrame(row, "source_id string, id string, asset_id string, frame_no long, actor string, tool string, trace_ref string, observation string, asset_sha256 string, presentation string")
    why = view.select(contracts.view_problem(F.col("tool"), F.col("actor"), F.col("trace_ref"), F.col("observation"), F.col("asset_id"), F.lit(asset.path)).alias("p")).first().p
    if why:
        raise ValueError(f"view refused: {why}")
    w.commit({"views": view.withColumn("created", F.current_timestamp())})
    return {"asset": a.asset, "frame_no": asset.frame_no}


def validate(w: Work, a) -> dict:
    bad = audit.validate(w.led).select("source_id", "code", "reference").unionByName(w.broken().select("source_id", F.concat(F.lit("contract:"), "code").alias("code"), F.col("id").alias("reference")))
    bad = staged(bad.unionByName(w.file_findings().select("source_id", "code", "reference")), "invalid")
    out = {"valid": bad.isEmpty(), "errors": _rows(bad)}
    if a.require_coverage:
        rows = progress.status(w.led, w.tables["requests"], w.candidates().select("source_id", "frame_no"), w.sources())
        done = progress.complete(rows, bad, w.findings(w.mode()))
        out["review"] = _rows(done)
        out["failed"] = not all(r["review_complete"] for r in out["review"])
    return out


def audit_(w: Work, a) -> dict:
    found = staged(w.findings(a.mode or w.mode()), "findings")
    if a.queue:
        asked = audit.requests(found)
        w.commit({"requests": asked.join(w.tables["requests"].select(*asked.columns), asked.columns, "left_anti")})
    return {"mode": a.mode or w.mode(), "findings": _rows(found.drop("frames")), "summary": _rows(audit.summary(found)), "gate": _rows(audit.gate(w.led.frames, found))}


def intervals_(w: Work, a) -> dict:
    led = w.led
    mapped = staged(evidence.mapping(w.runs, led.intervals), "mapped")
    scoped = led.intervals.join(evidence.scopes(mapped, led.intervals, led.steps), ["source_id", "id"])
    need = evidence.required_sample(mapped, scoped)
    return {"intervals": _rows(scoped.select("source_id", "id", "start_frame", "end_frame", "scope_hash").join(need, ["source_id", "id"]).orderBy("source_id", "start_frame")), "coverage": _rows(layers.coverage(led))}


def _imported(w: Work, a, kind: str, cues: DataFrame, time_base: str, said: str) -> dict:
    """Cues of one file, aligned with the index unless the same import is stored already."""
    times = w.led.frames.where(F.col("source_id") == a.source).select("source_id", "frame_no", "time_s", F.expr("try_cast(duration_time as double)").alias("duration"))
    sha = files.examined(w.spark.createDataFrame([(a.file,)], "path string")).first().sha256
    with w.attempt(a.source, kind):
        cues = staged(cues.withColumns({"id": F.lit("one"), "pos": F.col("pos").cast("long")}), "cues")
        first = cues.select("offset").first()
        if first is None:
            raise ValueError("no cues to import")
        request = w.spark.createDataFrame([(a.source, "one", sha, first.offset, said)], "source_id string, id string, sha256 string, offset double, language string")
        told, made = language.remember(request, cues, times, w.tables["cues"])
        told = staged(told, "told")
        if not made.isEmpty():
            key = made.select("key").first().key
            row = w.spark.createDataFrame([(a.source, key, kind, a.file, sha, first.offset, said, time_base)], "source_id string, id string, kind string, path string, sha256 string, offset double, language string, time_base string")
            w.commit({"cues": made, "languages": row.withColumn("created", F.current_timestamp())})
    return {"cache_reused": made.isEmpty(), "cues": _rows(told.orderBy("source_id", "pos"))}


def subtitles(w: Work, a) -> dict:
    with open(a.file, encoding="utf-8-sig") as f:
        text = w.spark.createDataFrame([(a.source, f.read())], "source_id string, text string")
    told = adapters.srt_cues(text).select("source_id", "pos", F.col("start_time").alias("begin"), F.col("end_time").alias("end"), F.lit(a.offset).alias("offset"), F.col("text_original").alias("text"))
    return _imported(w, a, "subtitles", told, "source_pts_plus_offset", a.language)


_SEGMENT = "struct<start:double,end:double,text:string,translation:variant,language:string,speaker:string,confidence:double>"


def transcript(w: Work, a) -> dict:
    doc = w.spark.read.schema(f"time_base string, offset_seconds double, language string, segments array<{_SEGMENT}>").option("multiLine", True).json(a.file)
    head = doc.select("time_base", "language").first()
    told = adapters.transcript_cues(doc.withColumn("source_id", F.lit(a.source)), w.led.frames)
    return _imported(w, a, "transcript", told, head.time_base, head.language or "und")


def export(w: Work, a) -> dict:
    stamp = f"{a.to}/gen={int(time.time())}"
    sinks.export_tables({n: t for n, t in w.tables.items() if n != "meta"}, stamp)
    sinks.frames_jsonl(w.tables["frames"], f"{stamp}/frames.jsonl")
    return {"export": stamp}


_TIMES = [("--start", {"type": float}), ("--end", {"type": float})]
_SOURCE = [("--source", {"required": True})]
COMMANDS = {
    "create": (create, []), "scan": (scan, [("--frames", {"required": True}), ("--tile-size", {"type": int, "default": 32}), ("--pixel-threshold", {"type": int, "default": 8}), ("--max-new", {"type": int}), ("--media", {})]),
    "select": (select, [("--mode", {"default": "layered"}), ("--anchor-seconds", {"type": float}), ("--global-threshold", {"type": float}), ("--local-threshold", {"type": float}), ("--min-changed-pixels", {"type": int}), ("--context-frames", {"type": int})]),
    "plan": (plan, [("--max-span", {"type": float, "default": 15.0}), ("--layout-fraction", {"type": float, "default": 0.12}), ("--stable-seconds", {"type": float, "default": 0.75})]),
    "focus": (focus, [("--start", {"type": float, "required": True}), ("--end", {"type": float, "required": True}), ("--reason", {"required": True}), ("--stride", {"type": int, "default": 1})]),
    "candidates": (candidates, [("--pending", {"action": "store_true"}), *_TIMES]), "queue": (queue, [*_TIMES, ("--batch-size", {"type": int, "default": 8})]), "status": (status, []),
    "import-records": (import_records, [("file", {}), *_SOURCE, ("--batch", {})]), "record-view": (record_view, [("asset", {}), *_SOURCE, ("--actor", {"required": True}), ("--tool", {"required": True}), ("--trace", {"required": True}), ("--observation", {"required": True})]),
    "validate": (validate, [("--require-coverage", {"action": "store_true"})]), "audit": (audit_, [("--mode", {}), ("--queue", {"action": "store_true"})]), "intervals": (intervals_, []),
    "subtitles": (subtitles, [("file", {}), *_SOURCE, ("--offset", {"type": float, "default": 0.0}), ("--language", {"default": "und"})]), "transcript": (transcript, [("file", {}), *_SOURCE]), "export": (export, [("--to", {"required": True})]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    for name, (_, options) in COMMANDS.items():
        one = sub.add_parser(name)
        one.add_argument("--work", required=True)
        for flag, how in options:
            one.add_argument(flag, **how)
    return top


def run(spark: SparkSession, argv: list[str]) -> dict:
    a = parser().parse_args(argv)
    if a.command == "doctor":
        return environment.diagnose()
    return COMMANDS[a.command][0](Work(spark, a.work, a.command == "create"), a)


def main() -> int:
    try:
        spark = SparkSession.builder.appName("strandline").getOrCreate()
        out = run(spark, sys.argv[1:])
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"error": str(e)}, ensure_ascii=False))
        return 1
    print(json.dumps(out, ensure_ascii=False))
    return int(bool(out.get("failed")))


if __name__ == "__main__":
    sys.exit(main())
