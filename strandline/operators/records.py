"""Authored records: change log, contracts, continuity, lineage and identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import nonblank
from ..sources.tables import staged


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given (total) order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def current(log: DataFrame, keys: list[str], seq: str = "seq", tombstone: str = "tombstone") -> DataFrame:
    """Current state of an append-only log: last write wins, deleted keys are gone."""
    return latest(log, keys, [F.col(seq).desc()]).where(~F.col(tombstone))


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows whose key is not there yet, once each, after ``table``."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def facts(steps: DataFrame) -> DataFrame:
    """(keys, step_order, phase, key, value, usable) of the before and after maps (values: struct of value, evidence)."""
    one = lambda name, n: steps.select("source_id", "step_order", F.lit(n).alias("phase"), F.explode(name).alias("key", "f"))
    rows = one("before", 0).unionByName(one("after", 1))
    usable = nonblank(F.col("key")) & F.coalesce(F.size("f.evidence") > 0, F.lit(False)) & F.coalesce(F.forall("f.evidence", nonblank), F.lit(False))
    return rows.select("source_id", "step_order", "phase", "key", F.col("f.value").alias("value"), usable.alias("usable"))


def discontinuities(rows: DataFrame) -> DataFrame:
    """``before`` facts that differ from the last known value of their key; nulls are skipped and reset nothing."""
    w = W.partitionBy("source_id", "key").orderBy("step_order", "phase")
    known = rows.where(F.col("value").isNotNull())
    told = known.withColumns({"last_value": F.lag("value").over(w), "last_step": F.lag("step_order").over(w)})
    return told.where((F.col("phase") == 0) & (F.col("last_value") != F.col("value"))).drop("phase")


def final_mismatches(steps: DataFrame) -> DataFrame:
    """Keys whose ``after`` value differs from the step's final parameter."""
    rows = steps.select("source_id", "step_order", "final_parameters", F.explode("after").alias("key", "f"))
    final = F.try_element_at("final_parameters", F.col("key"))
    return rows.where(final.isNotNull() & F.col("f.value").isNotNull() & (final != F.col("f.value"))).select("source_id", "step_order", "key")


def contract(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: ``code``. Rules are the conditions that must hold; null counts as broken."""
    codes = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items())))
    return rows.withColumn("code", F.explode(codes))


def issue_is_resolved() -> Column:
    """Resolved needs a mode with its own proof, a reviewer and a reason; anything else is open."""
    r = F.col("resolution")
    proof = F.when(r["mode"] == "evidence", F.size(r["evidence"]) > 0).when(r["mode"] == "withdrawn", nonblank(r["basis"]))
    return F.coalesce((F.col("status") == "resolved") & proof & nonblank(r["reviewer"]) & nonblank(r["reason"]), F.lit(False))


def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(rows: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose reference does not exist."""
    return rows.join(reference.select(*on), on, "left_anti")


def explicit_links(rows: DataFrame, key: str) -> DataFrame:
    """(source_id, key, step_id) by both spellings, ``step_ids`` and ``step_id``."""
    ids = F.col("step_ids") if "step_id" not in rows.columns else F.array_union(F.coalesce("step_ids", F.array().cast("array<string>")), F.array_compact(F.array(F.when(nonblank(F.col("step_id")), F.col("step_id")))))
    return rows.select("source_id", key, F.explode(ids).alias("step_id")).distinct()


def _after(before: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return before.join(new.select("source_id", key), ["source_id", key], "left_anti").unionByName(new, allowMissingColumns=True)


def _links(issues: DataFrame, steps: DataFrame) -> DataFrame:
    """(source_id, id, step_id): explicit links of issues if there are any, else steps their range meets."""
    from .intervals import linked_steps

    named = issues.select("source_id", F.col("id").alias("issue_id"), "step_ids", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    spans = steps.select("source_id", F.col("id").alias("step_id"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    return linked_steps(named, spans, ["source_id"]).withColumnRenamed("issue_id", "id")


def retirement_violations(requests: DataFrame, archive: DataFrame, before: dict[str, DataFrame], new: dict[str, DataFrame], retired_intervals: DataFrame | None = None, checks: DataFrame | None = None, old_intervals: DataFrame | None = None, unsound: DataFrame | None = None) -> DataFrame:
    """(source_id, id, code) of everything for which a correction must be refused as a whole.

    ``requests``: source_id, id, replacement_step_ids. ``archive``: (source_id, id) retired
    before. ``before`` and ``new``: the tables steps, issues, intervals and coverage as they
    are, and the batch's rows for them. ``retired_intervals``: (source_id, id) that the batch
    retires; ``checks``: source_id, interval_id, conclusion; ``old_intervals``: intervals
    retired earlier; ``unsound``: (source_id, id) of stored steps that break the contract.
    """
    code = lambda rows, name, id_="id": rows.select("source_id", F.col(id_).alias("id"), F.lit(name).alias("code"))
    found = []

    def write(*rows: DataFrame) -> None:
        """What rules share and what they find is written in steps: the driver holds all stages of a plan. A code is found in one step."""
        found.append(staged(reduce(DataFrame.unionByName, rows).distinct(), "violations"))

    requests = staged(requests.select("source_id", "id", "replacement_step_ids"), "requests")
    ids = requests.select("source_id", "id")
    archive = archive.select("source_id", "id")
    lean = ["source_id", "id", "start_frame", "end_frame", "status", "uncertainties"]
    steps_before, steps_new = before["steps"].select(*lean), new["steps"].select(*lean)
    steps_after = staged(_after(steps_before, steps_new, "id").join(ids, ["source_id", "id"], "left_anti"), "steps")
    active = steps_after.select("source_id", F.col("id").alias("step_id"))
    gone, asked = archive.withColumnRenamed("id", "step_id"), ids.withColumnRenamed("id", "step_id")
    keys = {"issues": "id", "intervals": "id", "coverage": "frame_no"}
    after = {t: _after(before[t], new[t], k) for t, k in keys.items()}
    if retired_intervals is not None:
        after["intervals"] = after["intervals"].join(retired_intervals.select("source_id", "id"), ["source_id", "id"], "left_anti")
    some = ids.select("source_id").distinct()
    for table, key in keys.items():
        linked, fresh = explicit_links(after[table], key), explicit_links(new[table], key)
        write(
            code(fresh.join(gone, ["source_id", "step_id"], "left_semi"), f"{table}_name_a_retired_step", "step_id"),
            code(linked.join(asked, ["source_id", "step_id"], "left_semi"), f"{table}_still_name_the_step", "step_id"),
            code(fresh.join(some, "source_id", "left_semi").join(active, ["source_id", "step_id"], "left_anti"), f"{table}_name_no_active_step", "step_id"),
        )
    wanted = requests.select("source_id", "id", F.explode("replacement_step_ids").alias("step_id"))
    # what was doubtful stays doubtful
    state = lambda rows, p: rows.select("source_id", F.col("id").alias("step_id"), F.col("status").alias(f"{p}_status"), F.col("uncertainties").alias(f"{p}_doubts"))
    renewed = wanted.join(state(steps_before, "was"), ["source_id", "step_id"]).join(state(steps_after, "now"), ["source_id", "step_id"])
    weaker = (F.size(F.array_except("was_doubts", "now_doubts")) > 0) | ((F.col("was_status") != "confirmed") & (F.col("now_status") == "confirmed"))
    write(
        code(steps_new.select("source_id", "id").unionByName(ids).join(archive, ["source_id", "id"], "left_semi"), "retired_id_used_again"),
        code(ids.join(steps_before.select("source_id", "id"), ["source_id", "id"], "left_anti"), "unknown_active_step"),
        code(wanted.join(active, ["source_id", "step_id"], "left_anti"), "replacement_not_active"), code(renewed.where(weaker), "replacement_loses_doubts"),
    )
    heirs = wanted.join(state(steps_after, "now"), ["source_id", "step_id"]).groupBy("source_id", "id").agg(F.array_distinct(F.flatten(F.collect_list("now_doubts"))).alias("heir_doubts"), F.max((F.col("now_status") != "confirmed").cast("int")).alias("heir_open"))
    own = ids.join(steps_before.select("source_id", "id", "status", "uncertainties"), ["source_id", "id"]).join(heirs, ["source_id", "id"], "left")
    gone_doubts = F.size(F.array_except("uncertainties", F.coalesce("heir_doubts", F.array().cast("array<string>")))) > 0
    gone_status = (F.col("status") != "confirmed") & (F.coalesce("heir_open", F.lit(0)) == 0)
    both = F.array_compact(F.array(F.when(gone_doubts, "uncertainty_lost"), F.when(gone_status, "unresolved_status_lost")))
    breaks = [code(ids.join(unsound.select("source_id", "id"), ["source_id", "id"], "left_semi"), "original_breaks_the_contract")] if unsound is not None else []
    write(own.select("source_id", "id", F.explode(both).alias("code")), *breaks)
    # open issues of the step, its replacements, or intervals and states that name these, keep content and get a replacement
    protected = staged(ids.select("source_id", "id", F.col("id").alias("step_id")).unionByName(wanted.join(steps_before.select("source_id", F.col("id").alias("step_id")), ["source_id", "step_id"], "left_semi").select("source_id", "id", "step_id")).distinct(), "protected")
    open_ = staged(before["issues"].join(before["issues"].where(~issue_is_resolved()).select("source_id", "id"), ["source_id", "id"], "left_semi"), "open-issues")
    open_ids = open_.select("source_id", F.col("id").alias("issue"))
    explicit_was = explicit_links(open_, "id").withColumnRenamed("id", "issue")
    near = staged(_links(open_, steps_before).unionByName(explicit_links(open_, "id")).distinct().withColumnRenamed("id", "issue"), "near")
    named = protected.join(near, ["source_id", "step_id"]).select("source_id", "id", "issue")
    past = [before["intervals"]] + ([old_intervals] if old_intervals is not None else [])
    for t, key in [*((t, "id") for t in past), (before["coverage"], "frame_no")]:
        doubts = t.select("source_id", F.col(key).alias("holder"), F.explode("issue_ids").alias("issue")).join(open_ids, ["source_id", "issue"], "left_semi")
        links = explicit_links(t, key).withColumnRenamed(key, "holder")
        named = staged(named.unionByName(protected.join(links, ["source_id", "step_id"]).join(doubts, ["source_id", "holder"]).select("source_id", "id", "issue")).distinct(), "named")
    content = lambda rows, n: rows.select("source_id", F.col("id").alias("issue"), F.sha2(F.to_json(F.struct(*(c for c in sorted(rows.columns) if c not in ("step_ids", "step_id")))), 256).alias(n))
    of_due = lambda rows, issue="issue": rows.join(named.select("source_id", F.col("issue").alias(issue)).distinct(), ["source_id", issue], "left_semi")
    issues_now = staged(of_due(after["issues"], "id"), "issues-now")
    due = staged(named.join(content(open_, "was"), ["source_id", "issue"]).join(content(issues_now, "now"), ["source_id", "issue"], "left"), "due")
    links_now = staged(_links(issues_now, steps_after).withColumnRenamed("id", "issue"), "links-now")
    explicit_now = explicit_links(issues_now, "id").withColumnRenamed("id", "issue")
    passed_on = due.join(wanted, ["source_id", "id"]).join(explicit_now, ["source_id", "issue", "step_id"], "left_semi").join(links_now, ["source_id", "issue", "step_id"], "left_semi").select("source_id", "id", "issue").distinct()
    lost = lambda was, now: of_due(was).join(asked, ["source_id", "step_id"], "left_anti").join(now, ["source_id", "issue", "step_id"], "left_anti").select("source_id", "issue")
    lost_links = staged(lost(explicit_was, explicit_now).unionByName(lost(near, links_now)).distinct(), "lost-links")
    write(
        code(due.where(~F.col("was").eqNullSafe(F.col("now"))), "open_issue_changed"), code(due.join(passed_on, ["source_id", "id", "issue"], "left_anti"), "open_issue_without_replacement"),
        code(due.join(lost_links, ["source_id", "issue"], "left_semi"), "open_issue_loses_links"),
    )
    if checks is not None:
        anomalies = checks.where("conclusion = 'expand'").select("source_id", F.col("interval_id").alias("holder")).distinct()
        bare = requests.where(F.size("replacement_step_ids") == 0).select("source_id", "id")
        expanded = [explicit_links(t, "id").withColumnRenamed("id", "holder") for t in past]
        write(*(code(bare.join(protected, ["source_id", "id"]).join(links, ["source_id", "step_id"]).join(anomalies, ["source_id", "holder"], "left_semi"), "expansion_needs_a_replacement") for links in expanded))
    return reduce(DataFrame.unionByName, found)


def retire(log: DataFrame, requests: DataFrame, violations: DataFrame) -> DataFrame:
    """The change log with tombstones of the retired steps; an error if anything is violated."""
    if found := violations.limit(20).collect():
        raise ValueError("correction refused: " + "; ".join(f"{r.source_id}/{r.id}: {r.code}" for r in found))
    seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
    dead = requests.select("source_id", F.lit("steps").alias("tbl"), "id", F.lit(None).cast("string").alias("payload"), F.lit(seq).cast("long").alias("seq"), F.lit("retire").alias("batch_id"), F.lit(True).alias("tombstone"))
    return log.unionByName(dead)


def history(log: DataFrame) -> DataFrame:
    """Every earlier version of every record, with the batch that replaced or deleted it."""
    w = W.partitionBy("source_id", "tbl", "id").orderBy("seq")
    return log.withColumns({"replaced_by": F.lead("batch_id").over(w), "deleted": F.coalesce(F.lead("tombstone").over(w), F.lit(False))}).where(F.col("replaced_by").isNotNull() & ~F.col("tombstone"))


def table_fingerprint(rows: DataFrame, keys: list[str], order: str, parts: list[Column], block: int = 10_000) -> DataFrame:
    """SHA-256 of the rows of each key in order, over the hashes of blocks of ``block`` ordinals."""
    line = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts))
    blocks = rows.groupBy(*keys, F.floor(F.col(order) / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    hashed = blocks.select(*keys, "b", F.sha2(F.array_join(F.transform("x", lambda v: v["l"]), "\n"), 256).alias("h"))
    whole = hashed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "h"))).alias("x"))
    return whole.select(*keys, F.sha2(F.array_join(F.transform("x", lambda v: v["h"]), "\n"), 256).alias("fingerprint"))
