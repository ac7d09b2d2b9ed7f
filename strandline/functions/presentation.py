"""Record values as text for people: labels, parameters, links, times, ranges and roles.

The wording is fixed. Columns in, columns out; only values that nest without bound are
walked in Python, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import intervals
from ..operators.records import issue_is_resolved
from .scalars import MARKDOWN, UNKNOWN_WORDS, clock_format, escape_text, finite, nonblank

#: Wording; fixed values.
UNRECORDED, NO_RECORD, UNKNOWN, NONE = "未记录", "无记录", "未知", "无"
STATUS = {"confirmed": "已确认（步骤登记）", "partial": "部分确认，待核实", "unresolved": "待核实"}
PARTLY, NO_STATUS = "部分确认，待核实（步骤登记为已确认）", "状态未记录"
ROLES = {"before": "操作前", "during": "操作中", "after": "操作后", "confirmation": "确认动作", "result": "结果"}
NO_ROLE, PARAMETER = "角色未记录", "参数："
HIDDEN = "控件不可见"
UNVERIFIED, CONFLICT, BROKEN, NO_PROOF = "生效未核实", "生效未核实（审计发现冲突或证据缺口）", "生效未核实（记录完整性待修复）", "生效未核实（确认或结果依据未记录）"
AFTER_STEP = " 完成后（按该步骤记录）"
#: Findings that bear on single steps.
STEP_CODES = (
    "final_parameter_mismatch", "state_discontinuity", "confirmation_gap", "result_gap", "step_transition_missing", "step_state_missing", "state_fact_invalid", "state_value_unknown", "step_ranges_overlap",
    "audit_evidence_missing", "audit_evidence_unreviewed",
)


@F.pandas_udf(T.StringType())
def readable(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text as words: lists and objects spelt out, texts escaped; invalid or missing JSON reads as unknown."""
    marks = str.maketrans({c: "\\" + c for c in MARKDOWN} | {"\\": "\\\\", "&": "&amp;", "<": "&lt;", ">": "&gt;"})

    def spell(x):
        match x:
            case None:
                return UNKNOWN
            case bool():
                return "是" if x else "否"
            case "":
                return UNRECORDED
            case dict():
                return "；".join(f"{spell_key(k)}：{spell(v)}" for k, v in x.items()) or UNRECORDED
            case list():
                return "、".join(map(spell, x)) or NO_RECORD
        return " / ".join(str(x).translate(marks).splitlines())

    def spell_key(k):
        return " / ".join(k.translate(marks).splitlines())

    def parse(t):
        try:
            return json.loads(t) if isinstance(t, str) else None
        except ValueError:
            return None

    for series in values:
        yield pd.Series([spell(parse(t)) for t in series], dtype=object)


@F.pandas_udf(T.BooleanType())
def unknown_value(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a JSON value, or any part of it but evidence, is not known. Empty lists and objects are not."""

    def none_inside(top):
        todo = [top]
        while todo:
            x = todo.pop()
            if x is None or x == "" or x == [] or x == {}:
                return True
            if isinstance(x, str) and x.strip().lower() in UNKNOWN_WORDS:
                return True
            if isinstance(x, dict):
                todo += [v for k, v in x.items() if k != "evidence"]
            elif isinstance(x, list):
                todo += x
        return False

    def judge(t):
        try:
            return none_inside(json.loads(t)) if isinstance(t, str) else True
        except ValueError:
            return True

    for series in values:
        yield pd.Series([judge(t) for t in series], dtype=bool)


def percent(text: Column) -> Column:
    """Percent-encoding that leaves ``/`` and ``:`` and the unreserved characters."""
    t = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def link(label: Column, path: Column, root: Column | None = None) -> Column:
    """A Markdown link; absolute paths below ``root`` become relative."""
    if root is not None:
        below = F.concat(root, F.lit("/"))
        path = F.when(F.startswith(path, below), F.substring(path, F.length(below) + 1, F.length(path))).otherwise(path)
    return F.concat(F.lit("["), escape_text(label), F.lit("](<"), percent(F.translate(path, "\\", "/")), F.lit(">)"))


def seconds(value: Column) -> Column:
    """Seconds with three decimals; halves of a millisecond go to the even one."""
    ms = F.bround(F.abs(value) * 1000, 0).cast("long")
    return F.when(ms.isNotNull(), F.concat(F.when((value < 0) & (ms > 0), "-").otherwise(""), F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)))


def timestamp(frame_no: Column, pts_time: Column, best_effort_time: Column, time_source: Column, time_s: Column, first_time: Column) -> Column:
    """A frame's own times and its time since the first frame, unknown ones said to be so."""
    pts, best = finite(pts_time), finite(best_effort_time)
    raw = F.coalesce(F.concat(F.lit("原始 PTS："), seconds(pts), F.lit(" s")), F.lit("原始 PTS：未知"))
    estimate = F.coalesce(F.concat(F.lit("；best-effort："), seconds(best), F.lit(" s")), F.lit("；best-effort：未知"))
    raw = F.when(pts.isNull() & time_source.eqNullSafe("best_effort"), F.concat(raw, estimate)).otherwise(raw)
    since = F.coalesce(clock_format(time_s - first_time), F.lit(UNKNOWN))
    return F.concat(F.lit("源帧 "), frame_no.cast("string"), F.lit("；"), raw, F.lit("；相对视频首帧："), since)


def step_label(status: Column, doubtful: Column) -> Column:
    """A step's status; ``doubtful``: findings or open issues bear on it."""
    out = F.when((status == "confirmed") & doubtful, PARTLY)
    for k, v in STATUS.items():
        out = out.when(status == k, v)
    return out.otherwise(NO_STATUS)


def parameter_value(value: Column) -> Column:
    """A final parameter (JSON text): its value with its unit, or that the control was not visible."""
    v = F.try_parse_json(value)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    unit = F.try_variant_get(v, "$.unit", "string")
    said = readable(F.coalesce(F.to_json(field("value")), F.lit("null")))
    hidden = F.coalesce(F.try_variant_get(v, "$.visible", "boolean") == F.lit(False), F.lit(False)) & field("value").isNull()
    whole = F.when(nonblank(unit), F.concat(said, F.lit(" "), escape_text(unit))).otherwise(said)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.when(hidden, HIDDEN).otherwise(whole)).otherwise(readable(value))


def parameter_scope(step: Column, record_valid: Column, conflicting: Column, settled: Column, proven: Column) -> Column:
    """From when a parameter holds, or why that is not verified. ``settled``: the step is confirmed without
    doubts or open issues and the value known; ``proven``: confirmation and result are observed, or explained."""
    return F.when(~record_valid, BROKEN).when(conflicting, CONFLICT).when(~settled, UNVERIFIED).when(~proven, NO_PROOF).otherwise(F.concat(escape_text(step), F.lit(AFTER_STEP)))


def proven(transition: Column) -> Column:
    """Confirmation and result are each observed, or not applicable with a note."""
    ok = F.lit(True)
    for role in ("confirmation", "result"):
        item = transition[role]
        ok = ok & F.coalesce((item["status"] == "observed") | ((item["status"] == "not_applicable") & (F.length(item["note"]) > 0)), F.lit(False))
    return ok


def affected_steps(steps: DataFrame, findings: DataFrame) -> DataFrame:
    """(source_id, id, code, reference, parameter_key, ambiguous) of findings that bear on single steps.

    A finding whose ``attrs`` name its steps (step_id, previous_step, next_step) bears on these.
    Otherwise its reference names a step, or begins with it before a dot; ids may hold dots
    too, so a reference may fit several steps; then none is certain, and all are kept.
    """
    some = findings.where(F.col("code").isin(*STEP_CODES))
    attrs = F.coalesce("attrs", F.expr("cast(map() as map<string,string>)")) if "attrs" in findings.columns else F.expr("cast(map() as map<string,string>)")
    owners = F.array_distinct(F.array_compact(F.array(*(F.try_element_at(attrs, F.lit(n)) for n in ("step_id", "previous_step", "next_step")))))
    some = some.select("source_id", "code", "reference", owners.alias("owners"), F.try_element_at(attrs, F.lit("parameter_key")).alias("parameter_key")).distinct()
    parts = F.split("reference", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    known = steps.select("source_id", "id")
    own = some.where(F.size("owners") > 0).withColumn("id", F.explode("owners")).join(known, ["source_id", "id"]).withColumn("ambiguous", F.lit(False))
    hits = some.where(F.size("owners") <= 0).withColumn("id", F.explode(heads)).join(known, ["source_id", "id"])
    many = hits.groupBy("source_id", "code", "reference").agg((F.count_distinct("id") > 1).alias("ambiguous"))
    columns = ["source_id", "id", "code", "reference", "parameter_key", "ambiguous"]
    return own.select(*columns).unionByName(hits.join(many, ["source_id", "code", "reference"]).select(*columns)).distinct()


def labels(steps: DataFrame, issues: DataFrame, findings: DataFrame) -> DataFrame:
    """(source_id, id, label) of each step, from its status, open issues and findings that bear on it."""
    open_ = issues.where(~issue_is_resolved())
    spans = steps.select("source_id", F.col("id").alias("step_id"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    asked = open_.select("source_id", F.col("id").alias("issue_id"), "step_ids", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    doubted = intervals.linked_steps(asked, spans, ["source_id"]).select("source_id", F.col("step_id").alias("id"))
    doubted = doubted.unionByName(affected_steps(steps, findings).select("source_id", "id")).distinct().withColumn("d", F.lit(True))
    return steps.join(doubted, ["source_id", "id"], "left").select("source_id", "id", step_label(F.col("status"), F.coalesce("d", F.lit(False))).alias("label"))


def evidence_roles(steps: DataFrame) -> DataFrame:
    """(source_id, id, asset_id, roles): what each cited asset shows of a step.

    Roles come in their fixed order, then the parameters that name the asset, by name.
    """
    named = lambda part, order, role, refs: part.select("source_id", "id", F.explode(refs).alias("asset_id"), F.lit(order).alias("o"), role.alias("role"))
    own = lambda k: F.coalesce(F.try_element_at("role_evidence", F.lit(k)), F.array().cast("array<string>"))
    proof = lambda k: F.coalesce(F.col(f"transition.{k}.evidence"), F.array().cast("array<string>"))
    rows = None
    for i, (k, label) in enumerate(ROLES.items()):
        part = named(steps, i, F.lit(label), own(k) if k in ("before", "during", "after") else proof(k))
        rows = part if rows is None else rows.unionByName(part)
    each = steps.select("source_id", "id", F.explode("final_parameters").alias("name", "value"))
    refs = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.evidence", "array<string>"), F.array().cast("array<string>"))
    rows = rows.unionByName(named(each, len(ROLES), F.concat(F.lit(PARAMETER), escape_text(F.col("name"))), refs)).distinct()
    said = rows.groupBy("source_id", "id", "asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "role"))), lambda x: x["role"]), "、").alias("roles"))
    cited = steps.select("source_id", "id", F.explode("evidence").alias("asset_id")).distinct()
    return cited.join(said, ["source_id", "id", "asset_id"], "left").withColumn("roles", F.coalesce("roles", F.lit(NO_ROLE)))


def narration(audio_tracks: Column, tracks_checked: Column, imported: Column, used: Column) -> Column:
    """One sentence on sound and language sources. ``imported``: their number; ``used``: array of
    (id, kind, path) of those the delivery declares used."""
    audio = F.when(~tracks_checked, "音轨未检查").when(audio_tracks > 0, "有音轨").otherwise("无音轨")
    kind = lambda u: F.when(u["kind"] == "asr_interchange", "外部转写").otherwise("字幕")
    one = lambda u: F.concat(kind(u), F.lit(" "), u["id"], F.lit("（"), F.coalesce(u["path"], F.lit("来源待核对")), F.lit("）"))
    told = F.when(F.size(used) > 0, F.concat(F.lit("按审阅者记录已使用"), F.array_join(F.transform(used, one), "、"), F.lit("；导入文本不表示实际听取音频。")))
    told = told.when(imported > 0, F.concat(F.lit("已导入 "), imported.cast("string"), F.lit(" 份文本，未声明使用；本报告不声称已利用旁白。")))
    told = told.when(tracks_checked & (audio_tracks > 0), "旁白未转写，本次无已使用的语言来源。").otherwise("无已使用的字幕或转写记录。")
    return F.concat(F.lit("旁白与语言："), audio, F.lit("；"), told)


#: Freshness and outcome of reproduction checks as words; fixed values.
FRESH = {"current": "当前内容", "stale": "已过期，需按当前内容重验", "evidence_changed": "证据文件缺失或变化，结果待核对", "record_invalid": "审阅记录完整性待修复"}
OUTCOME = {"passed": "通过", "failed": "失败", "partial": "部分完成"}


def _worded(value: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), value)


def reproduction_line(check: Column) -> Column:
    """One sentence on a reproduction check (id, freshness, outcome, scope, environment, reviewer, result)."""
    plain = lambda name: F.coalesce(check[name].cast("string"), F.lit(UNKNOWN))
    return F.concat(
        F.lit("复现验收 "), plain("id"), F.lit("："), _worded(check["freshness"], FRESH), F.lit("；记录结果："), _worded(check["outcome"], OUTCOME), F.lit("；范围："), plain("scope"), F.lit("；环境："), plain("environment"),
        F.lit("；记录者："), plain("reviewer"), F.lit("；"), plain("result"), F.lit("。"),
    )


def references(ids: Column, paths: Column) -> Column:
    """Links to assets; ``paths``: map of asset id to path. Unknown ones are said to be missing."""
    one = lambda i: F.coalesce(link(i, F.try_element_at(paths, i)), F.concat(escape_text(i), F.lit("（证据缺失）")))
    said = F.array_join(F.transform(ids, one), "、")
    return F.when(said == "", UNRECORDED).otherwise(said)


def range_text(ranges: Column) -> Column:
    """Closed ranges as ``a–b；c–d``; none, or unknown if there is no list."""
    said = F.array_join(F.transform(ranges, lambda r: F.concat(r["start"].cast("string"), F.lit("–"), r["end"].cast("string"))), "；")
    return F.when(ranges.isNull(), UNKNOWN).when(F.size(ranges) == 0, NONE).otherwise(said)


def parameter_findings(findings: DataFrame, parameters: DataFrame) -> DataFrame:
    """(source_id, id, name, code) of findings that bear on single parameters.

    ``findings``: source_id, id, code, parameter_key (null: all of the step's); only mismatches
    name a parameter. ``parameters``: source_id, id, name.
    """
    j = parameters.join(findings, ["source_id", "id"])
    return j.where((F.col("code") != "final_parameter_mismatch") | F.col("parameter_key").isNull() | (F.col("parameter_key") == F.col("name"))).select("source_id", "id", "name", "code")


#: Wording of files, resolutions and follow-ups; fixed values.
FILE_FIELDS = {"visible_name": "可见名称", "full_path": "完整路径", "role": "用途", "version": "版本", "path": "路径", "evidence": "证据", "note": "说明"}
RESOLUTION = {"evidence": "证据确认", "withdrawn": "撤回误设问题"}
NO_MESSAGE, MISSING_PROOF = "需核实记录和证据", "记录者查看依据待补。"
AMBIGUOUS, UNSURE = "（旧发现的步骤引用存在歧义，候选：", "；归属待核实）"


@F.pandas_udf(T.StringType())
def file_fields(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON of a file object with its known fields under their labels; other JSON as it is."""

    def relabel(t):
        try:
            x = json.loads(t) if isinstance(t, str) else None
        except ValueError:
            return None
        return json.dumps({FILE_FIELDS.get(k, k): v for k, v in x.items()}, ensure_ascii=False) if isinstance(x, dict) else t

    for series in names:
        yield pd.Series([relabel(t) for t in series], dtype=object)


def file_text(item: Column) -> Column:
    """An input or output file (JSON text or object) in words."""
    return readable(file_fields(item))


def finding_reason(code: Column, message: Column, candidates: Column) -> Column:
    """Why a step is doubted; ``candidates``: ids that an ambiguous reference fits, else an empty list."""
    said = F.concat(F.lit("`"), code, F.lit("`："), F.coalesce(F.when(message.isNotNull(), escape_text(message)), F.lit(NO_MESSAGE)))
    listed = F.concat(F.lit(AMBIGUOUS), F.array_join(F.transform(F.array_sort(candidates), escape_text), "、"), F.lit(UNSURE))
    return F.when(F.size(candidates) > 1, F.concat(said, listed)).otherwise(said)


def resolution_lines(resolution: Column, paths: Column) -> Column:
    """Lines on how an issue was closed, none if it was not. ``paths``: map of asset id to path."""
    mode = F.coalesce(_worded(resolution["mode"], RESOLUTION), F.lit(STATUS["unresolved"]))
    basis, proof = resolution["basis"], resolution["evidence"]
    lines = F.array(
        F.lit("解决依据："), F.concat(F.lit("- 结案方式："), mode, F.lit("。")), F.concat(F.lit("- 记录者："), escape_text(resolution["reviewer"]), F.lit("。")), F.concat(F.lit("- 理由："), escape_text(resolution["reason"]), F.lit("。")),
        F.when(F.length(basis) > 0, F.concat(F.lit("- 核对依据："), escape_text(basis), F.lit("。"))), F.when(F.size(proof) > 0, F.concat(F.lit("- 结案证据："), references(proof, paths), F.lit("。"))),
    )
    return F.when(resolution.isNotNull(), F.array_compact(lines)).otherwise(F.array().cast("array<string>"))


def followup_lines(issues: DataFrame, snapshots: DataFrame, assets: DataFrame, views: DataFrame) -> DataFrame:
    """(source_id, id, n, line) on later material: the claim, its limits, and each reference with what backs it.

    ``issues``: source_id, id, followup struct (claim, original_record_limit, reviewer, supplement_refs);
    ``snapshots``: source_id, id, valid; ``assets``: source_id, id, asset_id, path; ``views``: source_id,
    id, asset_id, actor, of valid views.
    """
    told = issues.where("followup is not null")
    head = F.array(
        F.concat(F.lit("后续主张（按审阅者记录）："), escape_text(F.col("followup.claim")), F.lit("。")), F.concat(F.lit("原片限制："), escape_text(F.col("followup.original_record_limit")), F.lit("。")),
        F.lit("补证不补写原片过程，不计入原片的候选查看、确认动作或审阅完成度。"), F.concat(F.lit("记录者："), escape_text(F.col("followup.reviewer")), F.lit("。")),
    )
    top = told.select("source_id", "id", F.posexplode(head).alias("n", "line"))
    refs = told.select("source_id", "id", F.col("followup.reviewer").alias("actor"), F.posexplode("followup.supplement_refs").alias("k", "r"))
    refs = refs.select("source_id", "id", "actor", (F.col("k") + 4).alias("n"), F.col("r.supplement_id").alias("sid"), F.col("r.asset_id").alias("asset_id"))
    s = snapshots.select("source_id", F.col("id").alias("sid"), "valid")
    a = assets.select("source_id", F.col("id").alias("sid"), "asset_id", "path")
    v = views.select("source_id", F.col("id").alias("sid"), "asset_id", "actor").distinct().withColumn("seen", F.lit(True))
    j = refs.join(s, ["source_id", "sid"], "left").join(a, ["source_id", "sid", "asset_id"], "left").join(v, ["source_id", "sid", "asset_id", "actor"], "left")
    sid, asset = escape_text(F.col("sid")), escape_text(F.col("asset_id"))
    line = (
        F.when(~F.coalesce("valid", F.lit(False)), F.concat(F.lit("- "), sid, F.lit("：补证不存在或完整性待修复，本条主张待核对。")))
        .when(F.col("path").isNull() | F.col("seen").isNull(), F.concat(F.lit("- "), sid, F.lit(" / "), asset, F.lit("："), F.lit(MISSING_PROOF)))
        .otherwise(F.concat(F.lit("- "), sid, F.lit(" · "), link(F.col("asset_id"), F.col("path"))))
    )
    return top.unionByName(j.select("source_id", "id", "n", line.alias("line")))
