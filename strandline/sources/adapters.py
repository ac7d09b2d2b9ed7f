"""Ledger tables from Parquet inputs and text formats.

Every table carries ``source_id``, so one DataFrame holds many timelines.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have the package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without time zone; no session zone is involved."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})") / F.lit(1e6)


def frames(events: DataFrame) -> DataFrame:
    """Frames of each user: ordinal, seconds, digest and change against the frame before.

    The local change and the share of changed elements vary with the payload number ``k``.
    """
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = events.withColumn("delta", F.abs(F.col("value") - F.lag("value").over(w)))
    return rows.select(
        F.col("user_id").alias("source_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_no"), epoch_seconds("ts").alias("time_s"), F.col("event_type").alias("digest"),
        F.col("delta").alias("global_delta"), (F.col("delta") * (1 + k / 100)).alias("max_local_delta"), F.floor("delta").cast("long").alias("changed_pixels"), (F.col("delta") / 500 * (k / 50)).alias("changed_fraction"), "event_id", "props",
    )


def key_value_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``k=v|k=v`` lines as maps; ``N/A`` and empty values are null, lines without a size are skipped."""
    pairs = F.str_to_map(F.col(line), F.lit("\\|"), F.lit("="))
    clean = F.transform_values(pairs, lambda _, v: F.when(~v.isin("N/A", ""), v))
    return lines.withColumn("fields", clean).where(F.col("fields")["width"].isNotNull() & F.col("fields")["height"].isNotNull())


def index_frames(lines: DataFrame, line: str = "line") -> DataFrame:
    """Frames from index lines (source_id, frame_no, line), one for each presented frame.

    Time texts are kept beside the time, which is the presentation time if it is finite, else
    the best estimate; ``time_source`` tells which.
    """
    from ..functions.scalars import frame_time

    f = lambda name: F.try_element_at("fields", F.lit(name))
    time, source = frame_time(f("pts_time"), f("best_effort_timestamp_time"))
    return key_value_lines(lines, line).select(
        "source_id", "frame_no", f("pts").alias("pts"), f("pts_time").alias("pts_time"), f("best_effort_timestamp").alias("best_effort_timestamp"), f("best_effort_timestamp_time").alias("best_effort_time"),
        time.alias("time_s"), source.alias("time_source"), f("width").cast("int").alias("width"), f("height").cast("int").alias("height"), F.coalesce(f("key_frame").cast("int"), F.lit(0)).alias("key_frame"), f("duration_time").alias("duration_time"),
    )


def replay_mismatches(stored: DataFrame, again: DataFrame, columns: list[str]) -> DataFrame:
    """(source_id, frame_no) of stored frames that a second reading of the same media gives differently or not at all."""
    keys = ["source_id", "frame_no"]
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}"))
    pairs = stored.alias("s").join(again.withColumn("__there", F.lit(True)).alias("a"), (F.col("s.source_id") == F.col("a.source_id")) & (F.col("s.frame_no") == F.col("a.frame_no")), "left")
    return pairs.where(F.col("__there").isNull() | ~same).select(*(F.col(f"s.{k}") for k in keys))


_SRT_TIME = r"(\d+:\d{2}:\d{2},\d{3}) --> (\d+:\d{2}:\d{2},\d{3})"


def srt_blocks(texts: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of normalised SRT texts: source_id, pos, start_time, end_time, text_original, sound.

    A sound block has a number, a time line and at least one line of text, each exactly so.
    """
    from ..functions.scalars import clock_parse

    body = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    blocks = texts.select("source_id", F.posexplode(F.split(F.trim(body, F.lit(" \t\n\r\f\u000b")), "\n\\s*\n")).alias("pos", "block"))
    lines = F.split("block", "\n")
    time = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    part = lambda i: F.regexp_extract(time, f"^{_SRT_TIME}$", i)
    sound = (F.size(lines) >= 3) & F.rlike(lines[0], F.lit(r"^\d+$")) & F.rlike(time, F.lit(f"^{_SRT_TIME}$"))
    clock = lambda i: F.when(sound, clock_parse(part(i)))
    said = F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return blocks.select("source_id", "pos", clock(1).alias("start_time"), clock(2).alias("end_time"), F.when(sound, said).alias("text_original"), sound.alias("sound"))


def srt_cues(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cues of normalised SRT texts; a text with any unsound block is refused with an error when read."""
    blocks = srt_blocks(texts, text)
    wrong = F.raise_error(F.format_string("source %s: unexpected subtitle block %d", F.col("source_id").cast("string"), F.col("pos")))
    return blocks.select("source_id", "pos", F.when(F.col("sound"), F.col("start_time")).otherwise(wrong.cast("double")).alias("start_time"), "end_time", "text_original")


def first_times(frames: DataFrame) -> DataFrame:
    """(source_id, first_time): the time of each source's first frame, known or not."""
    return frames.groupBy("source_id").agg(F.min_by("time_s", "frame_no").alias("first_time"))


def transcript_cues(docs: DataFrame, frames: DataFrame) -> DataFrame:
    """Segments of transcripts: source_id, pos, begin, end, offset, text, and translation, language,
    speaker and confidence where segments have them; a translation that is no text is refused.

    ``docs``: source_id, time_base, offset_seconds, segments array of structs. Times relative to
    the video get its first frame's time on top; without one, or with another time base,
    reading raises an error.
    """
    joined = docs.join(first_times(frames), "source_id", "left")
    told = F.coalesce("offset_seconds", F.lit(0.0))
    refuse = lambda why: F.raise_error(F.concat(F.lit("source "), F.col("source_id").cast("string"), F.lit(f": {why}"))).cast("double")
    relative = F.when(F.col("first_time").isNull(), refuse("first frame has no time")).otherwise(told + F.col("first_time"))
    shift = F.when(F.col("time_base") == "original", told).when(F.col("time_base") == "video_relative", relative).otherwise(refuse("unknown time base"))
    rows = joined.select("source_id", shift.alias("offset"), F.posexplode("segments").alias("pos", "s"))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema["segments"].dataType.elementType.fields}
    more = [F.col(f"s.{n}").alias(n) for n in ("language", "speaker", "confidence") if n in fields]
    if fields.get("translation") == "variant":  # as read from JSON, where it may be anything
        kind = F.schema_of_variant("s.translation")
        refused = F.raise_error(F.format_string("source %s: translation of segment %d is no text", F.col("source_id").cast("string"), F.col("pos"))).cast("string")
        text = F.when(F.col("s.translation").isNull() | (kind == "VOID"), F.lit(None)).when(kind == "STRING", F.try_variant_get("s.translation", "$", "string")).otherwise(refused)
        more.append(text.alias("translation"))
    elif "translation" in fields:
        more.append(F.col("s.translation").alias("translation"))
    return rows.select("source_id", "pos", "offset", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), F.col("s.text").alias("text"), *more)


def tracks(streams: DataFrame) -> DataFrame:
    """Audio and subtitle streams. ``streams``: source_id, streams array of (index, codec_name, codec_type, …)."""
    kind = lambda k: F.filter("streams", lambda s: s["codec_type"] == k)
    return streams.select("source_id", kind("audio").alias("audio"), kind("subtitle").alias("subtitles"))


#: First four bytes, or the type of the first box, of accepted containers; fixed values.
MATROSKA, RIFF, AVI = "1A45DFA3", "52494646", "41564920"
MOV_BOXES = ("ftyp", "moov", "mdat", "wide", "free", "skip")
_VTT = r"^WEBVTT([ \t]|\r?\n|$)"
_SRT = r"^\d+\r?\n\d+:\d{2}:\d{2}[,.]\d{3}\s+-->\s+\d+:\d{2}:\d{2}[,.]\d{3}"


def container_kind(content: Column | str, subtitles: bool = False) -> Column:
    """Accepted container by its first bytes: matroska, avi, mov; with ``subtitles`` also webvtt and srt; else null.

    A ``mov`` still has to pass ``mov_problem``.
    """
    c = F.col(content) if isinstance(content, str) else content
    at = lambda pos, n: F.hex(F.substring(c, pos, n))
    boxes = [b.encode().hex().upper() for b in MOV_BOXES]
    kind = F.when(at(1, 4) == MATROSKA, "matroska").when((at(1, 4) == RIFF) & (at(9, 4) == AVI), "avi").when(at(5, 4).isin(*boxes), "mov")
    if not subtitles:
        return kind
    head = F.decode(F.substring(c, 1, 4096), "ISO-8859-1")
    text = F.ltrim(F.regexp_replace(head, "^\u00ef\u00bb\u00bf", ""), F.lit("\r\n \t"))
    return kind.when(F.rlike(text, F.lit(_VTT)), "webvtt").when(F.rlike(text, F.lit(_SRT)), "srt")


_PPM = re.compile(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s")


def ppm_frames(streams: DataFrame, content: str = "content") -> DataFrame:
    """Frames of decoded RGB24 streams: source_id, frame_no, width, height, pixels.

    A stream is images one after the other, each with its own header; one that ends within an
    image, or holds anything else, raises an error. Frames leave one by one, so a stream's
    images are never held twice.
    """
    streams = streams.select("source_id", F.col(content).alias("content"))
    kind = streams.schema["source_id"].dataType
    schema = T.StructType([T.StructField("source_id", kind), T.StructField("frame_no", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in enumerate(batch.column(1)):
                raw, at, n = whole.as_py() or b"", 0, 0
                while at < len(raw):
                    head = _PPM.match(raw, at)
                    wide, high = (int(x) for x in head.groups()) if head else (0, 0)
                    end = head.end() + wide * high * 3 if head else 0
                    if not head or not wide or not high or end > len(raw):
                        raise ValueError(f"source {batch.column(0)[i]}: no whole image at byte {at}")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([n], pa.int64()), pa.array([wide], pa.int32()), pa.array([high], pa.int32()), pa.array([raw[head.end() : end]], pa.binary())], schema.fieldNames())
                    at, n = end, n + 1

    return streams.mapInArrow(run, schema)


#: Boxes that hold boxes, and boxes that point out of the file; fixed values.
MOV_CONTAINERS = ("moov", "trak", "mdia", "minf", "dinf", "stbl", "udta")
MOV_FOREIGN = ("cmov", "rmra", "rmda", "rdrf", "iloc")
MOV_DEPTH, MOV_LIMIT, MOV_REFERENCES = 16, 100_000, 4096


def mov_problem(read: Callable[[int, int], bytes], length: int) -> str | None:
    """Why a MOV or MP4 is not self-contained, or null.

    ``read(at, n)`` gives bytes of the file. Spans of boxes still to be looked into are kept
    in a list; each box costs a read of its head, sample data none.
    """
    number = lambda at, n=4: int.from_bytes(read(at, n), "big")
    spans: list[tuple[int, int, int, int | None]] = [(0, length, 0, None)]  # from, to, depth, references that it must hold
    boxes, movie = 0, False
    while spans:
        at, end, depth, due = spans.pop()
        if depth > MOV_DEPTH:
            return "nested too deep"
        first = boxes
        while at < end:
            boxes += 1
            if boxes > MOV_LIMIT or end - at < 8:
                return "malformed or too many boxes"
            head = read(at, 8)
            size, kind, body = int.from_bytes(head[:4], "big"), head[4:].decode("latin-1"), at + 8
            if size == 1 and end - at < 16:
                return "incomplete box"
            if size == 1:  # the size follows in eight bytes
                size, body = number(at + 8, 8), at + 16
            stop = at + size if size else end
            if not body <= stop <= end:
                return "box outside its parent"
            if due is not None:
                if kind != "url " or stop - body != 4 or number(body) != 1:
                    return "external reference"
            elif kind in MOV_FOREIGN:
                return "reference or compressed movie"
            elif kind == "dref":
                if stop - body < 8 or number(body) or not 1 <= number(body + 4) <= MOV_REFERENCES:
                    return "reference table"
                spans.append((body + 8, stop, depth, number(body + 4)))
            elif kind == "meta":
                if stop - body < 4 or number(body):
                    return "metadata layout"
                spans.append((body + 4, stop, depth + 1, None))
            elif kind in MOV_CONTAINERS:
                movie = movie or kind == "moov"
                spans.append((body, stop, depth + 1, None))
            at = stop
        if due is not None and boxes - first != due:
            return "reference count"
    return None if movie else "no movie metadata"


@F.pandas_udf(T.StringType())
def mov_problems(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``mov_problem`` of each file; binary trees without bound are walked in Python."""
    for series in contents:
        yield pd.Series([None if c is None else mov_problem(lambda at, n, c=c: bytes(c[at : at + n]), len(c)) for c in series], dtype=object)


def compare_inventories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per relative name: missing, extra, changed or same."""
    l, r = left.select("name", F.col("sha256").alias("l")), right.select("name", F.col("sha256").alias("r"))
    state = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l") != F.col("r"), "changed").otherwise("same")
    return l.join(r, "name", "full_outer").select("name", state.alias("state"))
