"""Shared-folder tables that cut lineage, and session settings these operators rely on.

Every table goes to the folder named by ``spark.checkpoint.dir``, which all executors
and the driver can see; so a lost executor costs a re-read, never a re-run of the plan.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes per Arrow batch: texts may be long, so batches are bounded by size, not by rows.
ARROW_BYTES = 512 << 10


def prepare(spark: SparkSession) -> None:
    """Ship this package to Python workers and keep Arrow batches small.

    Plans read the batch size when they run, which may be after the operator returned; so a
    larger size of the session is lowered, and a smaller one left alone.
    """
    held = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(held, "64m")) <= ARROW_BYTES:
        spark.conf.set(held, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # else the package already came as a zip
        target = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
        spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def _bytes(size: str) -> int:
    """A setting such as ``64m`` or ``67108864b`` in bytes."""
    size = size.strip().lower().removesuffix("b")
    unit = "kmgt".find(size[-1:]) + 1 if size[-1:].isalpha() else 0
    return int(size[:-1] if unit else size) << 10 * unit


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is set and
    all tasks run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/strandline-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """A folder of intermediate tables below the shared folder; it goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, so that what follows starts from files."""
        path = f"{self.root}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        schema = df.schema
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        # shuffle files of the finished job go as soon as nothing refers to them
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names = [n for n in self.names if n not in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
