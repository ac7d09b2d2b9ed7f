"""Structural rules of authored records, kept as JSON text and probed as VARIANT.

A contract is two lists of (code, condition that must hold): the second is only asked where
the first holds. Codes are field paths. ``violations`` gives one row per broken rule; a batch
with any is refused as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nonblank
from . import dyadic
from .records import duplicate_ids, latest

Rules = list[tuple[str, Column]]
#: Bound of ordinals; fixed value.
MAX_ORDINAL = 2**63 - 1
_TYPES = {"text": "STRING", "int": "BIGINT", "list": "ARRAY", "object": "OBJECT"}

#: Fields of a step and their types; fixed values.
STEP = {
    "id": "text", "phase": "text", "start_frame": "int", "end_frame": "int", "software": "text", "module": "text", "menu_path": "list", "selected_objects": "list", "final_parameters": "object",
    "confirmation_action": "text", "visible_result": "text", "input_files": "list", "output_files": "list", "evidence": "list", "uncertainties": "list", "status": "text",
}
STEP_STATUS, ISSUE_STATUS = ("confirmed", "partial", "unresolved"), ("open", "blocked", "resolved")
CLASSES, MERGES, FINE = ("operation", "context", "uncertain"), ("none", "exact", "approximate"), ("not_reviewed", "partial", "reviewed")
METHODS, CHECKED = ("risk_and_random", "exhaustive"), ("clear", "expand", "incomplete")
INDEPENDENCE, REVIEWED = ("independent", "self_review"), ("no_additional_omissions_found", "gaps_found", "incomplete")
VIEW_TOOLS = ("view_image", "read_image", "image_tool", "visible_attachment")
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")
OUTCOMES = ("passed", "failed", "partial")


class Json:
    """Probes of one VARIANT column."""

    def __init__(self, v: Column):
        self.v = v

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "variant")

    def kind(self, path: str = "") -> Column:
        return F.schema_of_variant(self.at(path) if path else self.v)

    def _true(self, condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def has(self, path: str) -> Column:
        return self.at(path).isNotNull()

    def is_(self, path: str, kind: str) -> Column:
        return self._true(F.startswith(self.kind(path), F.lit(_TYPES[kind])))

    def null(self, path: str) -> Column:
        return self._true(F.is_variant_null(self.at(path)))

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "string")

    def int(self, path: str) -> Column:
        return F.when(self.is_(path, "int"), F.try_variant_get(self.v, f"$.{path}", "bigint"))

    def filled(self, path: str) -> Column:
        """A text that is not blank."""
        return self.is_(path, "text") & nonblank(self.text(path))

    def members(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "array<variant>")

    def fields(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "map<string,variant>")

    def strings(self, path: str) -> Column:
        return F.when(self.is_(path, "list"), F.transform(self.members(path), lambda x: F.try_variant_get(x, "$", "string")))

    def names(self, path: str, some: bool = False, distinct: bool = False) -> Column:
        """A list of texts that are not blank; with ``some`` at least one, with ``distinct`` none twice."""
        return names_in(self.at(path), some, distinct)

    def among(self, path: str, allowed: tuple[str, ...]) -> Column:
        return self.is_(path, "text") & self.text(path).isin(*allowed)

    def ordered(self, first: str, last: str) -> Column:
        a, b = self.int(first), self.int(last)
        return self._true((a >= 0) & (a <= b))


def names_in(v: Column, some: bool = False, distinct: bool = False) -> Column:
    items = F.try_variant_get(v, "$", "array<variant>")
    good = F.startswith(F.schema_of_variant(v), F.lit("ARRAY")) & F.forall(items, lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") & nonblank(F.try_variant_get(x, "$", "string")), F.lit(False)))
    if some:
        good = good & (F.size(items) > 0)
    if distinct:
        good = good & (F.size(items) == F.size(F.array_distinct(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))))
    return F.coalesce(good, F.lit(False))


def object_in(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


_EVIDENCE = T.StructType([T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("bad", T.ArrayType(T.StringType()))])


@F.pandas_udf(_EVIDENCE)
def evidence_in(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Distinct members of every ``evidence`` list at any depth, and the paths of those that are no lists of names.

    JSON nests without bound, which VARIANT paths cannot follow; hence Python.
    """

    def collect(payload):
        refs, bad = set(), []
        try:
            todo = [("", json.loads(payload))] if payload is not None else []
        except ValueError:
            todo = []
        while todo:
            path, value = todo.pop()
            if isinstance(value, list):
                todo += ((f"{path}[{i}]", x) for i, x in enumerate(value))
            elif isinstance(value, dict):
                for name, x in value.items():
                    inner = f"{path}.{name}" if path else name
                    if name != "evidence":
                        todo.append((inner, x))
                    elif isinstance(x, list) and all(isinstance(r, str) and r.strip() for r in x):
                        refs.update(x)
                    else:
                        bad.append(inner)
        return sorted(refs), sorted(bad)

    for series in payloads:
        yield pd.DataFrame([collect(p) for p in series], columns=["refs", "bad"])


def violations(rows: DataFrame, shape: Rules, values: Rules, payload: str = "payload") -> DataFrame:
    """``rows`` times the codes they break. Text that does not parse, or is no object, breaks ``object`` only;
    misplaced evidence breaks ``evidence`` and, as a broken shape, leaves the values unasked."""
    broken = lambda rules: F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules))) if rules else F.array().cast("array<string>")
    probed = parsed(rows, payload)
    first = F.array_union(F.when(F.size("__e.bad") > 0, F.array(F.lit("evidence"))).otherwise(F.array().cast("array<string>")), broken(shape))
    staged = probed.withColumn("__first", first)
    codes = F.when(~object_in(F.col("__v")), F.array(F.lit("object"))).when(F.size("__first") > 0, F.col("__first")).otherwise(broken(values))
    return staged.withColumn("code", F.explode(codes)).drop("__v", "__e", "__first")


def parsed(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with the probed columns ``__v`` (VARIANT) and ``__e`` (evidence)."""
    return rows.withColumns({"__v": F.try_parse_json(payload), "__e": evidence_in(payload)})


def _j() -> Json:
    return Json(F.col("__v"))


def step_rules() -> tuple[Rules, Rules]:
    j = _j()
    shape = [(name, j.is_(name, kind)) for name, kind in STEP.items()]
    nested = F.size(F.array_except("__e.refs", F.coalesce(j.strings("evidence"), F.array().cast("array<string>")))) == 0
    absent = lambda path: ~j.has(path)
    items = j.members("uncertainties")
    values = [
        ("id", j.filled("id")), ("start_frame/end_frame", j.ordered("start_frame", "end_frame")), ("status", j.among("status", STEP_STATUS)),
        ("status/uncertainties", (j.text("status") != "confirmed") | (F.size(items) == 0)), ("evidence", nested),
        *((name, absent(name) | j.is_(name, "text")) for name in ("author", "input_action")),
        ("role_evidence", absent("role_evidence") | (j.is_("role_evidence", "object") & F.forall(F.map_values(j.fields("role_evidence")), lambda refs: names_in(refs)))),
        ("transition", absent("transition") | j.is_("transition", "object")),
    ]
    for phase in ("before", "after"):
        path = f"transition.{phase}"
        facts = j.is_(path, "object") & F.forall(F.map_entries(j.fields(path)), lambda e: nonblank(e["key"]) & object_in(e["value"]))
        values.append((path, absent(path) | facts))
    for role in ("confirmation", "result"):
        path = f"transition.{role}"
        texts = (absent(f"{path}.status") | j.is_(f"{path}.status", "text")) & (absent(f"{path}.note") | j.is_(f"{path}.note", "text"))
        values.append((path, absent(path) | (j.is_(path, "object") & texts)))
    return shape, values


def _all(*rules: Column) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def issue_rules(resolution: bool = True) -> tuple[Rules, Rules]:
    """Rules of an issue; with ``resolution`` also that a resolved one has its proof, as new records must."""
    j = _j()
    absent = lambda path: ~j.has(path)
    bound = lambda p: absent(p) | j.null(p) | F.coalesce(j.int(p) >= 0, F.lit(False))
    both = j.is_("start_frame", "int") & j.is_("end_frame", "int")
    refs = j.members("followup.supplement_refs")
    pair = lambda r: object_in(r) & _all(*(Json(r).filled(k) for k in ("supplement_id", "asset_id")))
    follow = j.is_("followup", "object") & _all(*(j.filled(f"followup.{k}") for k in ("claim", "original_record_limit", "reviewer"))) & j.is_("followup.supplement_refs", "list") & (F.size(refs) > 0) & F.forall(refs, pair)
    shape = [
        ("id", j.filled("id")), ("question", j.filled("question")), ("status", j.among("status", ISSUE_STATUS)), ("attempts", j.is_("attempts", "list")), ("start_frame", bound("start_frame")), ("end_frame", bound("end_frame")),
        ("start_frame/end_frame", ~both | (j.int("start_frame") <= j.int("end_frame"))), ("step_ids", absent("step_ids") | j.names("step_ids")), ("step_id", absent("step_id") | j.null("step_id") | j.filled("step_id")),
        ("followup", absent("followup") | F.coalesce(follow, F.lit(False))),
    ]
    if resolution:
        shape.append(("resolution", (j.text("status") != "resolved") | resolved_with_proof()))
    return shape, []


def resolved_with_proof() -> Column:
    """A mode with its own proof (evidence, or the basis of a withdrawal), a reviewer and a reason."""
    j = _j()
    proof = F.when(j.text("resolution.mode") == "evidence", j.names("resolution.evidence", some=True)).when(j.text("resolution.mode") == "withdrawn", j.filled("resolution.basis"))
    return F.coalesce(j.is_("resolution", "object") & proof & j.filled("resolution.reviewer") & j.filled("resolution.reason"), F.lit(False))


def _lists(j: Json, *names: str) -> Rules:
    return [(n, j.names(n)) for n in names]


def coverage_rules() -> tuple[Rules, Rules]:
    j = _j()
    shape = [("frame_no", j.is_("frame_no", "int")), ("classification", j.among("classification", CLASSES)), ("reason", j.filled("reason")), ("reviewer", j.filled("reviewer")), *_lists(j, "step_ids", "issue_ids", "evidence")]
    needs = lambda kind, name: (j.text("classification") != kind) | j.names(name, some=True)
    return shape, [("evidence", j.names("evidence", some=True)), ("step_ids", needs("operation", "step_ids")), ("issue_ids", needs("uncertain", "issue_ids"))]


def review_rules(layered: bool = False) -> tuple[Rules, Rules]:
    """Rules of an omission review, or of a review of layered records."""
    j = _j()
    shape = [(n, j.filled(n)) for n in ("id", "reviewer", "note")] + [("independence", j.among("independence", INDEPENDENCE)), *_lists(j, "evidence", "issue_ids", "tool_trace_refs"), ("conclusion", j.among("conclusion", REVIEWED))]
    if layered:
        shape += [("snapshot", j.filled("snapshot")), ("checked_interval_ids", j.names("checked_interval_ids"))]
    else:
        checked = j.members("checked_state_frames")
        numbers = F.transform(checked, lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")))
        distinct = j.is_("checked_state_frames", "list") & F.forall(numbers, lambda n: F.coalesce(n >= 0, F.lit(False))) & (F.size(F.array_distinct(numbers)) == F.size(checked))
        shape += [("snapshot", j.is_("snapshot", "text") & F.rlike(j.text("snapshot"), F.lit("^[0-9a-f]{64}$"))), ("checked_state_frames", distinct)]
    return shape, [(n, j.names(n, some=True)) for n in ("tool_trace_refs", "evidence")]


def interval_rules() -> tuple[Rules, Rules]:
    j = _j()
    shape = [("id", j.filled("id")), ("start_frame/end_frame", j.ordered("start_frame", "end_frame")), *((n, j.filled(n)) for n in ("phase", "reason", "reviewer")), ("disposition", j.among("disposition", CLASSES)), ("merge", j.among("merge", MERGES)), ("fine_status", j.among("fine_status", FINE)), *_lists(j, "evidence", "step_ids", "issue_ids")]
    needs = lambda kind, name: (j.text("disposition") != kind) | j.names(name, some=True)
    return shape, [("step_ids", needs("operation", "step_ids")), ("issue_ids", needs("uncertain", "issue_ids"))]


def check_rules() -> tuple[Rules, Rules]:
    j = _j()
    return [(n, j.filled(n)) for n in ("id", "interval_id", "reviewer", "scope_hash", "reason")] + [("method", j.among("method", METHODS)), ("conclusion", j.among("conclusion", CHECKED)), ("evidence", j.names("evidence")), ("resolves", ~j.has("resolves") | j.names("resolves"))], []


def retirement_rules() -> tuple[Rules, Rules]:
    """Rules of a request to retire a step."""
    j = _j()
    return [(n, j.filled(n)) for n in ("id", "reason", "reviewer")] + [("replacement_step_ids", j.names("replacement_step_ids", distinct=True))], [("replacement_step_ids", ~F.array_contains(j.strings("replacement_step_ids"), j.text("id")))]


def context_rules() -> tuple[Rules, Rules]:
    """Rules of a delivery context; whether its language sources exist is a join."""
    j = _j()
    return [(n, j.filled(n)) for n in ("question", "scope", "next_action")] + [("used_language_source_ids", j.names("used_language_source_ids", distinct=True))], []


def reproduction_rules() -> tuple[Rules, Rules]:
    j = _j()
    artifacts = j.members("artifacts")
    one = lambda a: object_in(a) & Json(a).filled("path") & F.rlike(Json(a).text("sha256"), F.lit("^[0-9a-f]{64}$"))
    return [(n, j.filled(n)) for n in ("id", "reviewer", "scope", "environment", "result", "content_snapshot")] + [
        ("outcome", j.among("outcome", OUTCOMES)), ("step_ids", j.names("step_ids", some=True, distinct=True)), ("artifacts", F.coalesce(j.is_("artifacts", "list") & (F.size(artifacts) > 0) & F.forall(artifacts, one), F.lit(False))),
    ], []


def view_problem(tool: Column, actor: Column, trace: Column, observation: Column, asset: Column, path: Column) -> Column:
    """Why a view must be refused: its tool, a blank field, or a trace that names an image, not a call; else null."""
    t = F.trim(trace)
    image = F.lit(False)
    for e in IMAGE_ENDINGS:
        image = image | F.endswith(F.lower(t), F.lit(e))
    bare = (F.length(t) < 40) & ~F.rlike(t, F.lit(r"://|[#:/\\ ]"))
    blank = ~nonblank(actor) | ~nonblank(trace) | ~nonblank(observation)
    return F.when(~F.coalesce(tool.isin(*VIEW_TOOLS), F.lit(False)), "tool").when(blank, "blank").when(image | bare | (t == asset) | (t == path), "trace")


def sheet_view_problems(views: DataFrame, sheets: DataFrame) -> DataFrame:
    """(…, code) of panel observations that are refused.

    ``views``: source_id, sheet_id, asset_id, sha256 (the asset's now), actor, trace_ref, observation;
    ``sheets``: source_id, id, members array of (asset_id, source_sha256).
    """
    known = sheets.select("source_id", F.col("id").alias("sheet_id"), F.lit(True).alias("__sheet"))
    members = sheets.select("source_id", F.col("id").alias("sheet_id"), F.explode("members").alias("m")).select("source_id", "sheet_id", F.col("m.asset_id").alias("asset_id"), F.col("m.source_sha256").alias("__was"))
    j = views.join(known, ["source_id", "sheet_id"], "left").join(members, ["source_id", "sheet_id", "asset_id"], "left")
    blank = ~nonblank(F.col("actor")) | ~nonblank(F.col("trace_ref")) | ~nonblank(F.col("observation"))
    code = F.when(F.col("__sheet").isNull(), "unknown_sheet").when(blank, "blank").when(F.col("__was").isNull(), "not_in_sheet").when(F.col("__was") != F.col("sha256"), "source_changed")
    return j.withColumn("code", code).where(F.col("code").isNotNull()).drop("__sheet", "__was")


#: Names of devices that no folder may have; fixed values.
DEVICES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def safe_identifier(id_: Column) -> Column:
    """1 to 64 ASCII letters, digits, ``_`` and ``-``, the first a letter or digit, and no device name."""
    return F.coalesce(F.rlike(id_, F.lit("^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")) & ~F.rlike(id_, F.lit(DEVICES)), F.lit(False))


def identifier_problems(rows: DataFrame) -> DataFrame:
    """(source_id, id, code) of supplement ids that are unsafe, or taken in another case."""
    bad = rows.where(~safe_identifier(F.col("id"))).select("source_id", "id", F.lit("unsafe").alias("code"))
    twice = duplicate_ids(rows.withColumn("folded", F.lower("id")), ["source_id", "folded"]).select("source_id", "folded")
    return bad.unionByName(rows.withColumn("folded", F.lower("id")).join(twice, ["source_id", "folded"], "left_semi").select("source_id", "id", F.lit("duplicate").alias("code")))


# --- rules that need other tables ------------------------------------------------------


def representative_problems(rows: DataFrame, run_frames: DataFrame) -> DataFrame:
    """(source_id, frame_no) of coverage frames that do not begin a run of computed frames."""
    good = run_frames.where(F.col("digest").isNotNull() & (F.col("exact_start") == F.col("frame_no"))).select("source_id", "frame_no")
    return rows.select("source_id", "frame_no").join(good, ["source_id", "frame_no"], "left_anti")


def uncomputed_intervals(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """(source_id, id) of intervals that include a frame that is not computed or not there."""
    have = frames.where(F.col("digest").isNotNull()).select("source_id", "frame_no").distinct()
    asked = entries.select("source_id", "id", "start_frame", "end_frame")
    n = dyadic.containing(asked, have, ["source_id"], "start_frame", "end_frame", "frame_no", fine=6).groupBy("source_id", "id").agg(F.count(F.lit(1)).alias("n"))
    told = asked.join(n, ["source_id", "id"], "left")
    return told.where(F.coalesce("n", F.lit(0)) < F.col("end_frame") - F.col("start_frame") + 1).select("source_id", "id")


def changed_checks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, id) of new checks whose id is stored with another payload; checks are immutable."""
    old = stored.select("source_id", "id", F.to_json(F.try_parse_json("payload")).alias("was"))
    return new.join(old, ["source_id", "id"]).where(~F.to_json(F.try_parse_json("payload")).eqNullSafe(F.col("was"))).select("source_id", "id")


def scope_problems(new: DataFrame, scopes: DataFrame) -> DataFrame:
    """(source_id, id, code) of new checks of unknown intervals, or whose scope hash is not the current one."""
    now = scopes.select("source_id", F.col("id").alias("interval_id"), F.col("scope_hash").alias("now"))
    j = new.join(now, ["source_id", "interval_id"], "left")
    return j.withColumn("code", F.when(F.col("now").isNull(), "unknown_interval").when(F.col("now") != F.col("scope_hash"), "scope_not_current")).where(F.col("code").isNotNull()).select("source_id", "id", "code")


TABLE_RULES = {"steps": step_rules, "issues": issue_rules, "coverage": coverage_rules, "omission_reviews": review_rules, "layer_reviews": lambda: review_rules(True), "intervals": interval_rules, "interval_checks": check_rules, "retire_steps": retirement_rules}


def batch_problems(batch: DataFrame) -> DataFrame:
    """(source_id, tbl, id, code) of everything a batch (source_id, tbl, id, payload) breaks, repeated ids included."""
    out = batch.where(~F.col("tbl").isin(*TABLE_RULES)).select("source_id", "tbl", "id", F.lit("unknown_table").alias("code"))
    for name, rules in TABLE_RULES.items():
        out = out.unionByName(violations(batch.where(F.col("tbl") == name), *rules()).select("source_id", "tbl", "id", "code"))
    twice = duplicate_ids(batch, ["source_id", "tbl", "id"]).select("source_id", "tbl", "id", F.lit("duplicate").alias("code"))
    return out.unionByName(twice)


def stored_problems(table: DataFrame, rules: tuple[Rules, Rules]) -> DataFrame:
    """Like ``violations`` for stored rows (source_id, id, payload), which stay as they are; also ids that differ from their payload's."""
    other = parsed(table).where(~F.coalesce(_j().text("id") == F.col("id"), F.lit(False)) & object_in(F.col("__v")))
    return violations(table, *rules).select("source_id", "id", "code").unionByName(other.select("source_id", "id", F.lit("id_differs").alias("code")))


def import_batch(log: DataFrame, batch: DataFrame, batch_id: str, *more: DataFrame) -> DataFrame:
    """The change log with the whole batch, or an error that names what it breaks: nothing is written in part.

    ``log``: source_id, tbl, id, payload, seq, batch_id, tombstone. ``more``: further problems
    (source_id, id, code). Each batch writes with one ``seq`` above all others.
    """
    problems = batch_problems(batch)
    for p in more:
        problems = problems.unionByName(p.select("source_id", F.lit("").alias("tbl"), "id", "code"))
    if found := problems.limit(20).collect():
        raise ValueError("batch refused: " + "; ".join(f"{r.source_id}/{r.tbl}/{r.id}: {r.code}" for r in found))
    seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
    return log.unionByName(batch.select("source_id", "tbl", "id", "payload", F.lit(seq).cast("long").alias("seq"), F.lit(batch_id).alias("batch_id"), F.lit(False).alias("tombstone")))


def current_table(log: DataFrame, tbl: str) -> DataFrame:
    """Current rows of one table of the change log."""
    return latest(log.where(F.col("tbl") == tbl), ["source_id", "id"], [F.col("seq").desc()]).where(~F.col("tombstone")).select("source_id", "id", "payload")
