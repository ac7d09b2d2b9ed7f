"""Files of any size: hashed in chunks, containers checked by seeking, unchanged ones not read again.

Reading a file as one value stops at 2 GB and holds it whole. Here tables of paths go to the
tasks, and each file is opened there, on the file system its address names: chunks for the
hash, a few bytes at a time for the boxes of a container. What holds a file's bytes is one
chunk.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import container_kind, mov_problem

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have the package

CHUNK, HEAD = 4 << 20, 4096
STAT = ["path", "length", "modificationTime"]


def _opened(path: str):
    """A seekable file; null if there is none."""
    from pyarrow import fs

    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    elif "://" in path:
        system, name = fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), path
    return system.open_input_file(name) if system.get_file_info(name).type == fs.FileType.File else None


def examined(rows: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with n_bytes, sha256, head (the first bytes) and mov_problem of the file at ``path``: all
    null if there is no such file; sha256 null if it cannot be read."""
    rows = rows.drop("n_bytes", "sha256", "head", "mov_problem")
    at = rows.columns.index(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("head", T.BinaryType()), T.StructField("mov_problem", T.StringType())])

    def look(name: str | None) -> tuple:
        file = _opened(name) if name else None
        if file is None:
            return None, None, None, None
        with file:
            size = file.size()
            try:
                digest, head = hashlib.sha256(), file.read(HEAD)
                digest.update(head)
                while chunk := file.read(CHUNK):
                    digest.update(chunk)

                def ranged(start: int, n: int) -> bytes:
                    file.seek(start)
                    return file.read(n)

                return size, digest.hexdigest(), head, mov_problem(ranged, size)
            except OSError:
                return size, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row for each file, as soon as it is read
                told = look(batch.column(at)[i].as_py())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([v], t) for v, t in zip(told, (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def with_kind(looked: DataFrame, subtitles: bool = False) -> DataFrame:
    """``examined`` files with ``kind``: their container, null where it is not accepted or, for ``mov``, not self-contained."""
    kind = container_kind("head", subtitles)
    return looked.withColumn("kind", F.when((kind != "mov") | F.col("mov_problem").isNull(), kind)).drop("head", "mov_problem")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of all files; empty ones, which scans leave out, without a time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = lambda name: re.sub("^file:/+", "file:/", unquote(name))
    names = spark.createDataFrame([(plain(n),) for n in found.inputFiles()], "path string")  # the listing that the driver holds anyway
    full = found.select(*STAT)
    empty = names.join(full, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return full.unionByName(empty)


def inventory(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(path, length, modificationTime, sha256, kind, reused) of all files below ``path``.

    ``known``: an earlier inventory; files whose path, size and time are as there keep its
    hash and are not opened. The listing itself reads no contents.
    """
    listed = _listed(spark, path)
    columns = [*STAT, "sha256", "kind"]
    if known is None:
        return with_kind(examined(listed)).select(*columns, F.lit(False).alias("reused"))
    held = known.where(F.col("sha256").isNotNull()).select(*columns).dropDuplicates(STAT)
    same = listed.join(held, STAT).select(*columns, F.lit(True).alias("reused"))
    other = with_kind(examined(listed.join(held, STAT, "left_anti"))).select(*columns, F.lit(False).alias("reused"))
    return same.unionByName(other)


def named(files: DataFrame, root: str) -> DataFrame:
    """``files`` with ``name``, their path below ``root``, for comparing trees."""
    lead = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.withColumn("name", F.when(F.startswith(plain, F.concat(lead, F.lit("/"))), F.substr(plain, F.length(lead) + 2)))
