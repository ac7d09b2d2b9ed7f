"""Typed tables of a stored ledger: JSON records by path, no sampling of schemas, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators.contracts import Json, current_table
from .ledger import Ledger

_EMPTY = "cast(array() as array<string>)"


def _parsed(log: DataFrame, tbl: str) -> DataFrame:
    return current_table(log, tbl).withColumn("__v", F.try_parse_json("payload"))


def _json() -> Json:
    return Json(F.col("__v"))


def _names(path: str) -> Column:
    return F.coalesce(_json().strings(path), F.expr(_EMPTY))


def _texts(path: str) -> Column:
    """Members of a list: texts as they are, everything else as JSON."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
    return F.coalesce(F.transform(_json().members(path), text), F.expr(_EMPTY))


def _facts(path: str) -> Column:
    one = lambda _, v: F.struct(F.to_json(F.try_variant_get(v, "$.value", "variant")).alias("value"), F.try_variant_get(v, "$.evidence", "array<string>").alias("evidence"))
    return F.transform_values(_json().fields(path), one)


def _proof(path: str) -> Column:
    j = _json()
    item = F.struct(j.text(f"{path}.status").alias("status"), j.text(f"{path}.note").alias("note"), F.try_variant_get("__v", f"$.{path}.evidence", "array<string>").alias("evidence"))
    return F.when(j.is_(path, "object"), item)


def steps(log: DataFrame) -> DataFrame:
    j = _json()
    transition = F.struct(_facts("transition.before").alias("before"), _facts("transition.after").alias("after"), _proof("transition.confirmation").alias("confirmation"), _proof("transition.result").alias("result"))
    roles = F.transform_values(j.fields("role_evidence"), lambda _, v: F.try_variant_get(v, "$", "array<string>"))
    return _parsed(log, "steps").select(
        "source_id", "id", j.int("start_frame").alias("start_frame"), j.int("end_frame").alias("end_frame"), j.text("status").alias("status"), _texts("uncertainties").alias("uncertainties"), j.text("author").alias("author"),
        _names("evidence").alias("evidence"), F.transform_values(j.fields("final_parameters"), lambda _, v: F.to_json(v)).alias("final_parameters"), F.when(j.is_("transition", "object"), transition).alias("transition"),
        roles.alias("role_evidence"), _texts("input_files").alias("input_files"), _texts("output_files").alias("output_files"),
    )


def issues(log: DataFrame) -> DataFrame:
    """``step_ids`` holds the explicit links: the list if it has members, else the single id."""
    j = _json()
    one = F.when(j.filled("step_id"), F.array(j.text("step_id"))).otherwise(F.expr(_EMPTY))
    text = lambda n: j.text(f"resolution.{n}").alias(n)
    resolution = F.struct(text("mode"), text("reviewer"), text("reason"), text("basis"), F.try_variant_get("__v", "$.resolution.evidence", "array<string>").alias("evidence"))
    return _parsed(log, "issues").select(
        "source_id", "id", j.text("question").alias("question"), j.int("start_frame").alias("start_frame"), j.int("end_frame").alias("end_frame"), j.text("status").alias("status"),
        F.when(j.is_("resolution", "object"), resolution).alias("resolution"), F.when(F.size(_names("step_ids")) > 0, _names("step_ids")).otherwise(one).alias("step_ids"),
    )


def _plain(log: DataFrame, tbl: str, ints: tuple[str, ...], texts: tuple[str, ...], lists: tuple[str, ...], id_: bool = True) -> DataFrame:
    j = _json()
    cols = [*(j.int(n).alias(n) for n in ints), *(j.text(n).alias(n) for n in texts), *(_names(n).alias(n) for n in lists)]
    return _parsed(log, tbl).select("source_id", *(["id"] if id_ else []), *cols)


def coverage(log: DataFrame) -> DataFrame:
    return _plain(log, "coverage", ("frame_no",), ("classification", "reviewer"), ("step_ids", "issue_ids", "evidence"), id_=False)


def intervals(log: DataFrame) -> DataFrame:
    return _plain(log, "intervals", ("start_frame", "end_frame"), ("reviewer", "reason", "disposition", "merge", "fine_status"), ("evidence", "step_ids", "issue_ids"))


def checks(log: DataFrame) -> DataFrame:
    """``source_scope_frames`` is what the import stamped onto the payload."""
    frames = F.coalesce(F.try_variant_get("__v", "$.source_scope_frames", "array<bigint>"), F.expr("cast(array() as array<bigint>)"))
    rows = _parsed(log, "interval_checks")
    j = _json()
    return rows.select("source_id", "id", *(j.text(n).alias(n) for n in ("interval_id", "reviewer", "scope_hash", "method", "conclusion")), _names("evidence").alias("evidence"), _names("resolves").alias("resolves"), frames.alias("source_scope_frames"))


def retirements(log: DataFrame) -> DataFrame:
    return _parsed(log, "retire_steps").select("source_id", "id", _names("replacement_step_ids").alias("replacement_step_ids"))


def reviews(log: DataFrame, layered: bool) -> DataFrame:
    """Reviews with the batch number as the time of their recording."""
    j = _json()
    scope = _names("checked_interval_ids").alias("checked_interval_ids") if layered else F.coalesce(F.try_variant_get("__v", "$.checked_state_frames", "array<bigint>"), F.expr("cast(array() as array<bigint>)")).alias("checked_state_frames")
    tbl = "layer_reviews" if layered else "omission_reviews"
    seq = log.where(F.col("tbl") == tbl).groupBy("source_id", "id").agg(F.max("seq").alias("recorded_at"))
    return _parsed(log, tbl).join(seq, ["source_id", "id"]).select("source_id", "id", "recorded_at", *(j.text(n).alias(n) for n in ("reviewer", "independence", "snapshot", "conclusion")), *(_names(n).alias(n) for n in ("evidence", "issue_ids", "tool_trace_refs")), scope)


def ledger(tables: dict[str, DataFrame]) -> Ledger:
    """The typed ledger of stored tables."""
    log = tables["records"]
    return Ledger(tables["frames"], fr.states(tables["frames"]), tables["assets"], tables["views"], steps(log), issues(log), coverage(log), intervals(log))
