"""A folder of per-batch results that a stream can write again without doubling them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.sources.tables import PACKED, shuffles_go


class DeltaFolder:
    """Micro-batch outputs kept apart by batch number.

    A batch that is replayed after a failure overwrites its own folder, so every batch
    counts exactly once.  The stored table is untouched until the deltas are folded in,
    which costs one merge for any number of micro-batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def put(self, frame: DataFrame, batch: int) -> None:
        with shuffles_go(frame.sparkSession):
            frame.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch}", compression=PACKED)

    def read(self) -> DataFrame:
        """All deltas with their batch number; an untouched folder reads as empty."""
        schema = f"{self.schema}, batch_id bigint"
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        return rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def folded(self) -> int:
        """The highest batch that has been folded into the stored table, -1 before the first."""
        if not self._exists(f"{self.path}-folded"):
            return -1
        return self.spark.read.schema("batch bigint").parquet(f"{self.path}-folded").agg(F.max("batch")).first()[0]

    def unfolded(self) -> DataFrame:
        """Deltas of the batches behind the last fold."""
        return self.read().where(F.col("batch_id") > self.folded())

    def mark_folded(self, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).write.mode("append").parquet(
            f"{self.path}-folded"
        )

    def expire(self) -> list[int]:
        """Delete the batches that have been folded, and return their numbers."""
        if not self._exists():
            return []
        jvm, folded = self.spark.sparkContext._jvm, self.folded()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))
        gone = [number for number in numbers if number <= folded]
        for number in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={number}"), True)
        return gone

    def _exists(self, path: str | None = None) -> bool:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path or self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(folder) and len(fs.listStatus(folder)) > 0
