"""A ledger on disk: one change log, frames and views, and a schema version; all of it in versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from .versions import Versioned

SCHEMA_VERSION, READABLE = 3, (1, 2, 3)
#: Columns of the stored tables; fixed values.
TABLES = {
    "meta": "source_id string, key string, value string, seq long",
    "frames": "source_id string, frame_no long, pts string, pts_time string, best_effort_timestamp string, best_effort_time string, time_s double, time_source string, width int, height int, key_frame int, duration_time string, digest string, exact_start long, global_delta double, max_local_delta double, changed_pixels long, changed_fraction double, tiles array<struct<box:array<int>,mean_delta:double>>",
    "attempts": "source_id string, id string, kind string, event string, at timestamp, status string, decoded_frames long, new_frames long, error string, log_path string",
    "requests": "source_id string, frame_no long, reason string, origin string",
    "assets": "source_id string, id string, frame_no long, kind string, path string, sha256 string, parent_id string, crop array<int>, created timestamp",
    "views": "source_id string, id string, asset_id string, frame_no long, actor string, tool string, trace_ref string, observation string, asset_sha256 string, created timestamp, presentation string, sheet_id string",
    "records": "source_id string, tbl string, id string, payload string, seq long, batch_id string, tombstone boolean",
    "plans": "source_id string, id string, start_frame long, end_frame long, start_time double, end_time double, boundary_clue string, representative_frames array<long>, distinct_states long, small_change_frames array<long>, retrace_frames array<long>, one_frame_states array<long>, merge string",
    "languages": "source_id string, id string, kind string, path string, sha256 string, offset double, language string, time_base string, provenance string, created timestamp",
    "cues": "source_id string, key string, pos long, id string, original_start double, original_end double, start_time double, end_time double, text_original string, translation string, language string, speaker string, confidence double, frame_ranges array<struct<start:long,end:long>>, alignment string, warnings array<string>",
}


def versions(spark: SparkSession, path: str) -> Versioned:
    return Versioned(spark, path, TABLES)


def open_ledger(spark: SparkSession, path: str, create: bool = False) -> dict[str, DataFrame]:
    """All tables of a ledger's newest version. A new one is only made on request; schema versions
    that are not known are refused.

    Ledgers of schema versions 1 and 2 read as they are and keep the strict mode of review; plain
    folders of tables, as written before there were versions, are read too and stay in use.
    """
    held = versions(spark, path)
    newest = held.latest()
    if newest is None:
        if not create:
            raise FileNotFoundError(f"no ledger at {path}")
        first = spark.createDataFrame([("", "schema_version", str(SCHEMA_VERSION), 1), ("", "review_mode", '"layered"', 1)], TABLES["meta"])
        newest = held.commit(None, append={"meta": first})
    tables = held.read(newest)
    version = meta(tables["meta"]).where("key = 'schema_version' and source_id = ''").first()
    if version is None or int(version.value) not in READABLE:
        raise ValueError(f"schema version {version and version.value} is not readable")
    return tables


def typed_as(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the columns of a stored table; those it lacks are null."""
    schema = rows.sparkSession.createDataFrame([], TABLES[table]).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def append(rows: DataFrame, path: str, table: str) -> None:
    """Rows added to one table of the newest version."""
    held = versions(rows.sparkSession, path)
    held.commit(held.latest(), append={table: typed_as(rows, table)})


def set_meta(rows: DataFrame, path: str) -> None:
    """Append key-value rows; the one with the largest ``seq`` counts."""
    append(rows, path, "meta")


def meta(rows: DataFrame) -> DataFrame:
    """Current values of (source_id, key)."""
    return records.latest(rows, ["source_id", "key"], [F.col("seq").desc()])


def review_mode(rows: DataFrame) -> str:
    """``strict`` or ``layered``; ledgers of older versions are strict."""
    held = {r.key: r.value for r in meta(rows).where("source_id = '' and key in ('schema_version', 'review_mode')").collect()}
    return held.get("review_mode", '"strict"' if int(held["schema_version"]) < 3 else '"layered"').strip('"')


def open_attempts(attempts: DataFrame) -> DataFrame:
    """Runs that were opened and never closed: what a crash leaves behind."""
    closed = attempts.where("event = 'closed'").select("source_id", "id")
    return attempts.where("event = 'opened'").join(closed, ["source_id", "id"], "left_anti").withColumn("status", F.lit("running_or_unfinalized"))


def updated(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``table`` with ``columns`` replaced where ``changes`` has the key; other rows stay."""
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    joined = table.join(new, keys, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in table.columns))


def has_columns(rows: DataFrame, *names: str) -> list[str]:
    """Those of ``names`` that a table lacks."""
    return [n for n in names if n not in rows.columns]
