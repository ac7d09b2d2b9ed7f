"""Staged tables."""

from pyspark.sql import functions as F

from strandline.sources.tables import staged


def test_staged_tables_are_not_taken_for_as_small_as_their_files(spark):
    """The guess that decides on a broadcast covers the rows of a table of ids."""
    n = 200_000
    held = staged(spark.range(n).select(F.col("id").alias("source_id"), F.format_string("f%09d", "id").alias("id")), "ids")
    guess = int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert guess >= n * 40  # null bits, two words, and a text of ten bytes


def test_exploded_rows_of_a_staged_table_are_not_broadcast_on_a_guess(spark):
    """Few columns of a wide staged table, exploded, are guessed small; only what has run may be broadcast."""
    n = 20_000
    ref = F.format_string("f%09d", "id")
    wide = staged(spark.range(n).select(F.col("id").alias("source_id"), F.array(*[ref] * 30).alias("refs"), *(F.lit("x").alias(f"c{i}") for i in range(40))), "wide")
    ids = staged(spark.range(n).select(F.col("id").alias("source_id"), ref.alias("asset_id")), "targets")
    pairs = wide.select("source_id", F.explode("refs").alias("asset_id")).join(ids, ["source_id", "asset_id"])
    held = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("false", "true"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert pairs.count() == 30 * n
    small = staged(spark.range(5).select(F.col("id").alias("source_id")), "small")
    joined = wide.select("source_id").join(small, "source_id")
    assert joined.count() == 5
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_what_has_run_is_broadcast_up_to_a_megabyte(spark):
    """A union of many joins holds all its broadcasts at once, so each must be small."""
    ids = lambda n, name: staged(spark.range(n).select(F.col("id").alias("source_id"), F.format_string("f%09d", "id").alias("id")), name)
    joined = ids(60_000, "many").join(ids(50_000, "fewer"), ["source_id", "id"])  # rows of 40 bytes
    joined.collect()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
