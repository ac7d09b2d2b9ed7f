"""The report and the handoff of one source as Markdown.

Rows are put into words by columns; the driver reads the lines of one source, in order, and
joins them. A whole corpus of reports is ``report_lines``, which stays a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import presentation as pr
from ..functions.scalars import anchor, clock_format, escape_text, nonblank
from ..sources.ledger import Ledger

INPUT_UNKNOWN = "输入过程未单独记录；请结合确认动作与前后画面核对，阶段参数不代表输入动作。"


def _line(rows: DataFrame, part: int, order: list[Column], text: Column) -> DataFrame:
    return rows.select("source_id", F.lit(part).alias("part"), F.array(*(o.cast("string") for o in order)).alias("sort"), text.alias("line"))


def _sorted(n: str) -> Column:
    return F.lpad(F.col(n).cast("string"), 19, "0")


def report_lines(led: Ledger, findings: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """(source_id, part, sort, line): status, steps with label and roles, open issues and findings, in order."""
    steps = led.steps.join(pr.labels(led.steps, led.issues, findings), ["source_id", "id"])
    times = led.frames.select("source_id", F.col("frame_no").alias("start_frame"), F.col("time_s").alias("t"))
    zero = led.frames.where("frame_no = 0").select("source_id", F.col("time_s").alias("t0"))
    steps = steps.join(times, ["source_id", "start_frame"], "left").join(zero, "source_id", "left")
    head = F.concat(F.lit('## <a id="'), anchor(F.col("id")), F.lit('"></a>'), escape_text(F.col("id")), F.lit("："), F.col("label"))
    span = F.concat(F.lit("帧 "), F.col("start_frame").cast("string"), F.lit("–"), F.col("end_frame").cast("string"), F.lit("；"), F.coalesce(clock_format(F.col("t") - F.col("t0")), F.lit(pr.UNKNOWN)))
    asked = pr.evidence_roles(led.steps).join(led.steps.select("source_id", "id", "start_frame"), ["source_id", "id"])
    role = F.concat(F.lit("- "), escape_text(F.col("asset_id")), F.lit("："), F.col("roles"))
    doubts = steps.select("source_id", "id", "start_frame", F.posexplode("uncertainties").alias("n", "u"))
    by = [_sorted("start_frame"), F.col("id")]
    issue = F.concat(F.lit("- "), escape_text(F.col("id")), F.lit("："), escape_text(F.col("question")))
    found = F.concat(F.lit("- `"), F.col("code"), F.lit("`："), F.coalesce(escape_text(F.col("reference")), F.lit("")))
    out = _line(steps, 2, [*by, F.lit("0")], head).unionByName(_line(steps, 2, [*by, F.lit("1")], span)).unionByName(_line(asked, 2, [*by, F.concat(F.lit("2"), F.col("asset_id"))], role))
    out = out.unionByName(_line(doubts, 2, [*by, F.concat(F.lit("3"), F.lpad(F.col("n").cast("string"), 9, "0"))], F.concat(F.lit("- 待核对："), escape_text(F.col("u")))))
    out = out.unionByName(_line(led.issues.where(~_resolved()), 3, [F.col("id")], issue)).unionByName(_line(findings, 4, [F.col("code"), F.coalesce("reference", F.lit(""))], found))
    if status is not None:
        told = F.concat(F.lit("已计算帧："), F.col("computed_frames").cast("string"), F.lit("；待查看候选："), F.col("candidates_pending").cast("string"), F.lit("；登记查看源帧："), F.col("visual_frames").cast("string"))
        out = out.unionByName(_line(status, 1, [F.lit("")], told))
    return out


def _resolved() -> Column:
    from ..operators.records import issue_is_resolved

    return issue_is_resolved()


def render(lines: DataFrame, source, generation: str) -> str:
    """The report of one source."""
    rows = lines.where(F.col("source_id") == F.lit(source)).orderBy("part", "sort", "line").select("line").toLocalIterator()
    return "\n\n".join(["# 审阅报告", *(r.line for r in rows), f"<!-- export_generation: {generation} -->", ""])


def action_fields(steps: DataFrame) -> DataFrame:
    """(source_id, id, where, what, typed, confirmed, expected): what to do in a step, in words.

    ``menu_path`` and ``selected_objects`` are JSON texts.
    """
    typed = F.when(nonblank(F.col("input_action")), escape_text(F.col("input_action"))).otherwise(INPUT_UNKNOWN)
    path = F.array_join(F.transform(F.from_json("menu_path", "array<string>"), escape_text), " → ")
    return steps.select(
        "source_id", "id", F.when(F.coalesce(path, F.lit("")) == "", "入口未记录").otherwise(path).alias("where"), pr.readable("selected_objects").alias("what"), typed.alias("typed"),
        escape_text(F.col("confirmation_action")).alias("confirmed"), escape_text(F.col("visible_result")).alias("expected"),
    )


def handoff(source: dict, status: dict, context: dict, summary: list[str], generation: str) -> str:
    """The handoff of one source: where it lies, what was asked, what is open and what comes next."""
    plain = lambda v: pr.UNKNOWN if v is None else str(v)
    flag = {True: "是", False: "否", None: pr.UNKNOWN}[status.get("full_compute_complete")]
    lines = ["# 继续审阅", "", f"素材：{plain(source.get('path'))}", f"源 SHA-256：{plain(source.get('sha256'))}", "", *(f"- {s}" for s in summary), ""]
    lines += [f"已计算帧：{plain(status.get('computed_frames'))}；全帧计算完成：{flag}。", f"待查看候选：{plain(status.get('candidates_pending'))}；登记查看源帧：{plain(status.get('visual_frames'))}。", ""]
    lines += ["## 下一步", "", plain(context.get("next_action", "本轮问题和下一步未记录；先核对现有报告与疑点并确认范围。")), "", f"<!-- export_generation: {generation} -->", ""]
    return "\n".join(lines)
