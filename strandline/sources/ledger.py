"""A ledger as typed tables, and a stand-in ledger built from an event stream.

All tables carry ``source_id``. Facts and final parameters are JSON texts: the text ``null``
is a recorded null, SQL null a missing value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import frames as fr
from ..operators import segments as sg
from .adapters import frames as frames_of
from .tables import staged

STEP_BREAKS = {"layout_delta": 100.0, "stable_seconds": 43_200.0, "layout_fraction": 0.25}
MAX_SPAN = 3 * 86_400.0


@dataclass
class Ledger:
    """frames (with exact_start), states, and the authored records.

    What all audits ask again and again is written once: which assets there are, which views are
    valid, which assets were seen, and which sample each interval asks for.
    """

    frames: DataFrame
    states: DataFrame
    assets: DataFrame
    views: DataFrame
    steps: DataFrame
    issues: DataFrame
    coverage: DataFrame
    intervals: DataFrame

    @cached_property
    def known(self) -> DataFrame:
        """(source_id, id) of all assets."""
        return staged(self.assets.select("source_id", "id").distinct(), "known")

    @cached_property
    def valid_views(self) -> DataFrame:
        """Views whose asset exists with the same frame and hash, with the asset's kind."""
        a = self.assets.select("source_id", F.col("id").alias("asset_id"), "frame_no", F.col("sha256").alias("asset_sha256"), "kind")
        return staged(self.views.join(a, ["source_id", "asset_id", "frame_no", "asset_sha256"]), "valid-views")

    @cached_property
    def seen(self) -> DataFrame:
        """(source_id, id) of assets with a valid view."""
        return staged(self.valid_views.select("source_id", F.col("asset_id").alias("id")).distinct(), "seen")

    @cached_property
    def sampled(self) -> DataFrame:
        """The intervals with scope_hash, required, frames and all_state_frames: their scope and sample as they are now."""
        mapped = staged(ev.mapping(self.frames, self.intervals), "mapped")
        scoped = staged(self.intervals.join(ev.scopes(mapped, self.intervals, self.steps), ["source_id", "id"]), "scoped")
        return staged(scoped.join(ev.required_sample(mapped, scoped), ["source_id", "id"]), "sampled")


def _text(template: str, n: str | Column) -> Column:
    return F.format_string(template, F.col(n) if isinstance(n, str) else n)


def _when(condition: str, value, other=None) -> Column:
    return F.when(F.expr(condition), value).otherwise(F.lit(None) if other is None else other)


def _strings(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast("array<string>")


def from_events(events: DataFrame) -> Ledger:
    """Frames are a user's events; who saw, wrote and checked what follows from each event's payload number ``k``.

    The rules are arbitrary but plain; they give every kind of record, sound and faulty ones.
    """
    frames = frames_of(events).withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "width": F.lit(640), "height": F.lit(360)})
    frames = staged(fr.runs(frames), "frames")
    ends = {f"k{i}": by("k", "frame_no") for i, by in ((0, F.min_by), (1, F.max_by))}
    extra = frames.groupBy("source_id", "exact_start").agg(*(c.alias(n) for n, c in ends.items()))
    states = staged(fr.states(frames).join(extra, ["source_id", "exact_start"]), "states")
    full, none = _text("f%09d", "frame_no"), _strings()
    sha = lambda tail="": F.sha2(F.concat(F.col("source_id").cast("string"), F.lit(":"), F.col("frame_no").cast("string"), F.lit(tail)), 256)
    crop = F.concat(full, F.lit("-crop-0-0-320-180"))
    box = F.array(*(F.lit(x) for x in (0, 0, 320, 180)))
    asset = lambda rows, id_, kind, parent, hashed, crop_: rows.select("source_id", id_.alias("id"), "frame_no", F.lit(kind).alias("kind"), parent.alias("parent_id"), hashed.alias("sha256"), crop_.alias("crop"))
    assets = asset(frames.where("k < 90"), full, "full", F.lit(None).cast("string"), sha(), F.lit(None).cast("array<int>")).unionByName(
        asset(frames.where("k < 15"), crop, "crop", _when("k >= 10", _text("f%09d", F.col("frame_no") + 1), full), sha(":crop"), box)
    )
    trace = F.concat(F.lit("read_image#"), F.col("frame_no").cast("string"))

    def view(rows, id_, actor, hashed, presentation, ref):
        return rows.select("source_id", F.concat(id_, F.lit(f":{actor}")).alias("id"), id_.alias("asset_id"), "frame_no", F.lit(actor).alias("actor"), hashed.alias("asset_sha256"), presentation.alias("presentation"), ref.alias("trace_ref"), F.lit("seen").alias("observation"), F.lit("read_image").alias("tool"))

    native = F.lit("native")
    views = view(frames.where("k < 60"), full, "ann", _when("k in (5, 6)", F.lit("changed"), sha()), native, _when("k = 7", F.lit(" "), trace))
    views = views.unionByName(view(frames.where("k between 30 and 79"), full, "bob", sha(), _when("k < 70", native, F.lit("overview")), trace))
    views = views.unionByName(view(frames.where("k < 10"), crop, "ann", sha(":crop"), native, trace))

    first, last = _text("f%09d", "start_frame"), _text("f%09d", "end_frame")
    fact = lambda value, evidence: F.struct(value.alias("value"), evidence.alias("evidence"))
    check = lambda k: F.struct(_when(f"{k} < 75", F.lit("observed"), _when(f"{k} < 85", F.lit("not_applicable"), F.lit("pending"))).alias("status"), _when(f"{k} between 45 and 47", F.lit(" "), F.lit("n")).alias("note"), _when(f"{k} < 70", F.array(last), none).alias("evidence"))
    before = F.create_map(F.lit("A.rate"), fact(_when("k0 < 80", F.floor(F.col("k0") / 25).cast("string"), F.lit("null")), _when("k0 between 55 and 57", none, F.array(first))))
    after = F.create_map(F.lit("A.rate"), fact(F.floor(F.col("k1") / 25).cast("string"), F.array(last)))
    after = F.when(F.expr("k0 < 20"), F.map_concat(after, F.create_map(F.lit("file:out"), fact(F.lit("1"), F.array(last))))).otherwise(after)
    transition = F.struct(_when("k0 between 93 and 94", F.map_filter(before, lambda k, v: F.lit(False)), before).alias("before"), after.alias("after"), check("k0").alias("confirmation"), check("k1").alias("result"))
    roles = F.create_map(F.lit("before"), F.array(first), F.lit("during"), F.array(first), F.lit("after"), F.array(last))
    steps = states.where("digest = 'purchase'").select(
        "source_id", _text("S%09d", "start_frame").alias("id"), "start_frame", (F.col("end_frame") + _when("k0 < 20", F.lit(2), F.lit(0))).alias("end_frame"),
        _when("k0 < 70", F.lit("confirmed"), _when("k0 < 85", F.lit("partial"), F.lit("unresolved"))).alias("status"), _when("k0 >= 65", F.array(F.concat(F.lit("u"), F.col("k0").cast("string"))), none).alias("uncertainties"),
        _when("k0 between 40 and 44", F.lit(None).cast("string"), F.lit("ann")).alias("author"), _when("k0 between 50 and 52", none, F.array_distinct(F.array(first, last))).alias("evidence"),
        F.create_map(F.lit("A.rate"), F.floor(F.col("k0") / 20).cast("string")).alias("final_parameters"), _when("k0 between 90 and 92", F.lit(None).cast(_type(states, transition)), transition).alias("transition"),
        _when("k0 between 30 and 33", F.lit(None).cast("map<string,array<string>>"), roles).alias("role_evidence"), _when("k0 < 30", F.array(F.lit("in")), none).alias("input_files"), none.alias("output_files"),
    )
    resolution = lambda mode, basis, evidence: F.struct(F.lit(mode).alias("mode"), F.lit("bob").alias("reviewer"), F.lit("r").alias("reason"), F.lit(basis).cast("string").alias("basis"), evidence.alias("evidence"))
    proof = resolution("evidence", None, F.array(full))
    issues = frames.where("digest = 'error'").select(
        "source_id", _text("I%09d", "frame_no").alias("id"), F.lit("q").alias("question"), F.col("frame_no").alias("start_frame"), F.col("frame_no").alias("end_frame"),
        _when("k < 40", F.lit("resolved"), _when("k < 70", F.lit("open"), F.lit("blocked"))).alias("status"),
        _when("k < 20", proof, F.when(F.expr("k < 30"), resolution("withdrawn", "b", none))).alias("resolution"), _when("k >= 95", F.array(F.lit("S999999999")), none).alias("step_ids"),
    )
    operation, uncertain = F.col("digest") == "purchase", F.col("digest") == "error"
    own_step, own_issue = F.when(operation, F.array(_text("S%09d", "start_frame"))).otherwise(none), F.when(uncertain, F.array(_text("I%09d", "start_frame"))).otherwise(none)
    kind = F.when(operation, "operation").when(uncertain, "uncertain").otherwise("context")
    coverage = states.where("k0 < 85").select(
        "source_id", F.col("exact_start").alias("frame_no"), kind.alias("classification"), F.concat(own_step, _when("k0 < 5", F.array(F.lit("S000000000")), none)).alias("step_ids"),
        F.concat(own_issue, _when("k0 between 10 and 12", F.array(F.lit("I999999999")), none)).alias("issue_ids"), F.array(first).alias("evidence"), _when("k0 < 50", F.lit("ann"), F.lit("bob")).alias("reviewer"),
    )
    bucketed = sg.buckets(sg.hard_breaks(states, **STEP_BREAKS), MAX_SPAN)
    groups = bucketed.groupBy("source_id", "bucket").agg(
        F.max("end_frame").alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("k0", "start_frame").alias("k0"), F.min_by("digest", "start_frame").alias("digest"), F.array_sort(F.collect_list(F.when(operation, _text("S%09d", "start_frame")))).alias("within")
    )
    first, end = _text("f%09d", "bucket"), F.col("last") + _when("k0 < 10", F.lit(1), F.lit(0))
    intervals = groups.where("k0 < 90").select(
        "source_id", _text("P%09d", "bucket").alias("id"), F.col("bucket").alias("start_frame"), end.alias("end_frame"), F.lit("ann").alias("reviewer"), F.lit("r").alias("reason"), kind.alias("disposition"),
        F.expr("case when n = 1 then 'exact' when k0 < 50 then 'approximate' when k0 < 70 then 'none' else 'exact' end").alias("merge"), _when("k0 < 30", F.lit("reviewed"), _when("k0 < 60", F.lit("partial"), F.lit("not_reviewed"))).alias("fine_status"),
        F.array_distinct(F.array(first, _text("f%09d", end))).alias("evidence"), F.when(operation, F.col("within")).otherwise(none).alias("step_ids"), F.when(uncertain, F.array(_text("I%09d", "bucket"))).otherwise(none).alias("issue_ids"),
    )
    return Ledger(frames, states, assets, views, staged(steps, "steps"), issues, coverage, staged(intervals, "intervals"))


def _type(rows: DataFrame, column: Column) -> str:
    return rows.select(column.alias("x")).schema["x"].dataType.simpleString()
