"""Versioned Parquet tables, bucketed tables and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a fresh temporary folder; on a cluster that
    is refused, because executors could not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cvegrid-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Makes Spark delete the shuffle files of a query when it ends, not when the driver next collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


# Codec of stored rows with long texts, such as records; JSON takes half of what it does by default.
PACKED = "zstd"


class VersionedTable:
    """A Parquet table kept as numbered versions.

    Spark writes a version's ``_SUCCESS`` marker only after all its files are in place, so
    the newest marked version is the current one: a refresh never blocks or disturbs a
    reader, and a job that dies half-way leaves the previous version current.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _listing(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith("v") and name[1:].isdigit():
                done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
                found.append((int(name[1:]), done))
        return sorted(found)

    def version(self) -> int | None:
        """Number of the current version, or None before the first write."""
        return max((number for number, done in self._listing() if done), default=None)

    def read(self) -> DataFrame:
        current = self.version()
        if current is None:
            raise FileNotFoundError(f"no complete version below {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{current:010d}")

    def write(self, frame: DataFrame) -> int:
        """Write the next version and return its row count, taken while writing."""
        number = max((n for n, _ in self._listing()), default=0) + 1
        rows = Observation(f"rows-{uuid.uuid4().hex}")
        counted = frame.observe(rows, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("errorifexists").parquet(f"{self.path}/v{number:010d}")
        return rows.get["rows"]


    def expire(self, keep: int = 2) -> list[int]:
        """Delete all but the newest complete versions; readers of the kept ones are safe."""
        if keep < 1:
            raise ValueError("at least the current version must be kept")
        done = [number for number, complete in self._listing() if complete]
        old = done[:-keep]
        jvm = self.spark.sparkContext._jvm
        for number in old:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{number:010d}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return old


def save_bucketed(frame: DataFrame, table: str, buckets: int, key: str = "cve_id") -> None:
    """Store a table hashed and sorted by its key so later joins on it need no shuffle."""
    frame.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
