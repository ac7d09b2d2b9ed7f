"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where none is set and all tasks run here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/strandline-{os.getuid()}"


#: How many times its files' size a staged table may take as rows: ids and ordinals compress well.
INFLATION = 16.0
#: Bytes of rows that have run up to which they are broadcast: an audit's union joins dozens of tables at
#: the same time, all of them held by the driver, and as hash tables some three times as large.
MEASURED = 1 << 20


def _sized(spark: SparkSession) -> None:
    """Lets the session size tables as rows, not as files, and broadcast only what is small once it has run.

    A guess knows nothing of how well ids compress, of the narrow columns of a wide table, or of the rows
    that an explode makes. So the session's limit moves to what adaptive execution has measured.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) < INFLATION:
        spark.conf.set(key, str(INFLATION))
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(guessed)
    if not limit.startswith("-"):
        if spark.conf.get(measured, None) is None:
            limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
            spark.conf.set(measured, str(min(limit, MEASURED)))
        spark.conf.set(guessed, "-1")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, with its lineage cut.

    The files go when the application ends.
    """
    spark = df.sparkSession
    _sized(spark)
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
