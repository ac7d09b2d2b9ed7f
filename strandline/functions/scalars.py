"""Scalar functions: clocks, escapes, ids, ranges as text, JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(text: Column) -> Column:
    """A finite double, else null."""
    v = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def frame_time(pts: Column, best_effort: Column) -> tuple[Column, Column]:
    """(time_s, time_source) of a frame's two time texts."""
    a, b = finite(pts), finite(best_effort)
    return F.coalesce(a, b), F.when(a.isNotNull(), "pts").when(b.isNotNull(), "best_effort").otherwise("missing")


def clock_parse(text: Column) -> Column:
    """``H:MM:SS,mmm`` as seconds."""
    p = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def clock_format(seconds: Column) -> Column:
    """``[HH:]MM:SS.mmm`` with sign; milliseconds round half to even."""
    ms = F.bround(F.abs(seconds) * 1000, 0).cast("long")
    hours, minutes = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60
    rest = F.format_string("%02d:%02d.%03d", minutes, F.floor(ms / 1000) % 60, ms % 1000)
    sign = F.when(seconds < 0, "-").otherwise("")
    return F.when(ms.isNotNull(), F.concat(sign, F.when(hours > 0, F.concat(F.format_string("%02d", hours), F.lit(":"))).otherwise(F.lit("")), rest))


#: Characters that Markdown gives a meaning; fixed values.
MARKDOWN = "`*_[]|#"


def escape_text(text: Column) -> Column:
    """Record text for Markdown: HTML escapes (quotes stay), then backslashes and Markdown
    characters; lines are joined with `` / ``. Null reads as unknown."""
    t = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for c in MARKDOWN:
        t = F.replace(t, F.lit(c), F.lit("\\" + c))
    lines = F.regexp_replace(F.regexp_replace(t, "(\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029])$", ""), "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]", " / ")
    return F.coalesce(lines, F.lit("未知"))


def escape_flag(flag: Column) -> Column:
    """A boolean as text; null reads as unknown."""
    return F.when(flag.isNull(), "未知").when(flag, "是").otherwise("否")


def asset_id(frame_no: Column) -> Column:
    return F.format_string("f%09d", frame_no)


def crop_id(parent: Column, box: Column) -> Column:
    """Id of a crop: its parent's id and its corners."""
    return F.concat_ws("-", parent, F.lit("crop"), F.array_join(F.transform(box, lambda x: x.cast("string")), "-"))


def anchor(step_id: Column) -> Column:
    return F.concat(F.lit("step-"), F.lower(F.hex(F.encode(step_id, "UTF-8"))))


#: Texts that mean "not known", in lower case; fixed values.
UNKNOWN_WORDS = ("unknown", "n/a", "null", "未知", "未展示", "待核实", "待辨认", "未记录")


def unknown(text: Column) -> Column:
    """Null, the empty text, or one of the words above within blanks. (A text of blanks only is not.)"""
    return text.isNull() | (text == "") | F.lower(F.trim(text, F.lit(" \t\n\r\f\u000b"))).isin(*UNKNOWN_WORDS)


def nonblank(text: Column) -> Column:
    """A text with more than white space of any kind."""
    return F.coalesce(F.rlike(text, F.lit(r"(?U)\S")), F.lit(False))


def nonblank_list(items: Column) -> Column:
    """A list with members, none of them blank."""
    return F.coalesce((F.size(items) > 0) & F.forall(items, nonblank), F.lit(False))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it does not parse. Equal numbers have one spelling."""
    return F.to_json(F.try_parse_json(text))


def safe_path(path: Column) -> Column:
    """A relative path that stays inside its folder: no drive, no empty, dot or parent parts."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.coalesce(nonblank(path) & ~F.contains(path, F.lit(":")) & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def distinct_nonblank(items: Column) -> Column:
    return F.coalesce(F.forall(items, nonblank) & (F.size(items) == F.size(F.array_distinct(items))), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("^[0-9a-f]{64}$")), F.lit(False))


def hash_pick(key: Column, n: Column) -> Column:
    """Index below ``n`` from the first 16 hex digits of the key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def pixel_digest(width: Column, height: Column, pixels: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.format_string("%dx%d:rgb24:", width, height), "UTF-8"), pixels), 256)


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON object with sorted keys and no blanks."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)
