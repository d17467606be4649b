"""What several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.sources.tables import scratch_path, shuffles_go

# Fixed by the contract: a word is a run of anything but these six white-space characters.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut in the lineage that
    survives lost executors.  What was shuffled on the way to it is deleted."""
    return _stored(frame, scratch_path(frame.sparkSession, name))


def _stored(frame: DataFrame, path: str) -> DataFrame:
    spark = frame.sparkSession
    with shuffles_go(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Frames stored for one piece of work, whose files are deleted once nothing reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def stored(self, frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        found = _stored(frame, path)
        self.held.append((found, path))
        return found

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of these frames; other frames made of them must not be used any more."""
        self._delete(lambda frame: any(frame is f for f in frames))

    def keep(self, *frames: DataFrame) -> None:
        """Delete the files of all frames but these."""
        self._delete(lambda frame: all(frame is not f for f in frames))

    def _delete(self, spent: Callable[[DataFrame], bool]) -> None:
        context = self.spark.sparkContext
        for _, name in [pair for pair in self.held if spent(pair[0])]:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self.held = [pair for pair in self.held if not spent(pair[0])]


def whole_text(text: Column | str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; no words for null or blank texts."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_PATTERN)
    )


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Arrow types of the result columns that Python code yields.
_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples; integers stay exact beside nulls."""
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batch_of(rows: list[tuple], columns: str) -> pa.RecordBatch:
    """An Arrow batch of rows under a schema such as "doc_id bigint, text string"."""
    named = [column.split() for column in columns.split(", ")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in named])
    sides = list(zip(*rows, strict=True)) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays(
        [pa.array(side, field.type) for side, field in zip(sides, schema, strict=True)], schema=schema
    )
