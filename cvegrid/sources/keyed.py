"""Tables stored by the hash of their key, so that a merge or a look-up touches few files.

A store keeps its columns in families, each a Parquet tree of its own with one folder for each part
of the key's hash: narrow columns that analytics scan, and wide ones, JSON and vectors, apart from
them.  A version holds only the parts it changed; the other parts stay where an earlier version has
put them.  Files are never changed in place, so readers keep what they have opened, and a version
counts only once its marker is there, so a load that dies half-way leaves the table as it was.

What reaches the driver is folder names: at most families x parts that are current, and those of
superseded parts until ``expire`` has deleted them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvegrid.sources.tables import PACKED, scratch_path, shuffles_go

PART = "key_part"
MARKER = "_DONE"
# Rows, of a batch and stored ones, that are merged by one query; bounds what it shuffles.
ROWS_TOGETHER = 250_000


class KeyedStore:
    """A keyed table in `parts` hash parts and one or more column families.

    `families` maps a family's name to its columns without the key; every column belongs to one, and
    without families to a single one.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        families: dict[str, list[str]] | None = None,
        key: str = "cve_id",
        parts: int = 64,
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key
        self.parts = parts
        empty = spark.createDataFrame([], schema)
        self.types = {f.name: f.dataType for f in empty.schema.fields}
        self.families = families or {"rows": [c for c in self.types if c != key]}
        spread = [c for columns in self.families.values() for c in columns]
        if sorted([key, *spread]) != sorted(self.types):
            raise ValueError("every column except the key belongs to exactly one family")

    # -- files ---------------------------------------------------------------------------

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        fs, folder = self._fs(), self._path(*names)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        found = [name for name in self._names() if name.startswith("v") and name[1:].isdigit()]
        return sorted(int(n[1:]) for n in found if self._fs().exists(self._path(n, MARKER)))

    def folders(self, version: int | None = None) -> dict[tuple[str, int], str]:
        """Where each part of each family lies in a version; the current one unless named."""
        found: dict[tuple[str, int], str] = {}
        for number in self.versions():
            if version is None or number <= version:
                for family in self.families:
                    for name in self._names(f"v{number:010d}", family):
                        if name.startswith(f"{PART}="):
                            found[family, int(name.partition("=")[2])] = f"{self.path}/v{number:010d}/{family}/{name}"
        return found

    def _claim(self) -> int:
        """A version number no other writer has: only one of them can create its claim.

        File systems without that promise, such as object stores, need a single writer.
        """
        fs = self._fs()
        number = 1 + max((int(n[1:]) for n in self._names("_claims") if n[1:].isdigit()), default=0)
        while not fs.createNewFile(self._path("_claims", f"v{number:010d}")):
            number += 1
        return number

    def expire(self, keep: int = 2) -> list[str]:
        """Delete parts that none of the newest `keep` versions shows, and return their folders."""
        if keep < 1:
            raise ValueError("at least the current version must be kept")
        numbers = self.versions()
        shown = {place for number in numbers[-keep:] for place in self.folders(number).values()}
        fs, gone = self._fs(), []
        for number in numbers[:-keep]:
            for family in self.families:
                for name in self._names(f"v{number:010d}", family):
                    place = f"{self.path}/v{number:010d}/{family}/{name}"
                    if name.startswith(f"{PART}=") and place not in shown:
                        fs.delete(self._path(f"v{number:010d}", family, name), True)
                        gone.append(place)
        return gone

    # -- reading -------------------------------------------------------------------------

    def part_of(self, key: Column | str) -> Column:
        """The part a key belongs to."""
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _frame(self, family: str, places: list[str]) -> DataFrame:
        columns = [self.key, *self.families[family]]
        schema = ", ".join(f"`{c}` {self.types[c].simpleString()}" for c in columns)
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def family(self, name: str, parts: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """One family's rows, of all parts or only the named ones."""
        wanted = None if parts is None else set(parts)
        held = sorted(self.folders(version).items())
        return self._frame(name, [p for (f, n), p in held if f == name and (wanted is None or n in wanted)])

    def read(self, columns: list[str] | None = None, parts: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some columns of it; only families that hold one of them are opened."""
        chosen = list(self.types) if columns is None else columns
        names = [n for n, own in self.families.items() if set(own) & set(chosen)] or list(self.families)[:1]
        parts = None if parts is None else list(parts)
        first, *rest = [self.family(name, parts, version) for name in names]
        for other in rest:
            # Every family holds every key once.
            first = first.join(other, self.key, "left")
        return first.select(*chosen)

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The parts that hold some keys: at most as many numbers as the store has parts."""
        rows = keys.where(F.col(self.key).isNotNull()).select(self.part_of(self.key).alias(PART)).distinct()
        return sorted(r[PART] for r in rows.collect())

    def look_up(self, keys: DataFrame, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Stored rows of the given keys; files of other parts are not opened."""
        chosen = None if columns is None else [self.key, *[c for c in columns if c != self.key]]
        rows = self.read(chosen, self.parts_of(keys), version)
        return rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    # -- writing -------------------------------------------------------------------------

    def _write(self, number: int, family: str, frame: DataFrame) -> None:
        columns = [self.key, *self.families[family]]
        rows = frame.select(*[F.col(c).cast(self.types[c]) for c in columns], self.part_of(self.key).alias(PART))
        target = f"{self.path}/v{number:010d}/{family}"
        # By hash alone some tasks would get several parts; a rebalance also splits parts that have grown.
        with shuffles_go(rows.sparkSession):
            dealt = rows.hint("rebalance", PART).sortWithinPartitions(PART, self.key)
            # Portions of a family follow each other.
            dealt.write.mode("append").partitionBy(PART).parquet(target, compression=PACKED)

    def _publish(self, number: int, base: int | None) -> int:
        if self.version() != base:
            raise RuntimeError(f"{self.path} has changed since version {base}; merge again")
        self._fs().createNewFile(self._path(f"v{number:010d}", MARKER))
        return number

    def version(self) -> int | None:
        """Number of the current version, or None before the first."""
        return max(self.versions(), default=None)

    def _landed(self, batch: DataFrame, path: str) -> DataFrame:
        # By part, so that portions are read without the others.  Rows without a key are left out on
        # reading: Spark would push the filter down through the batch's shuffles and so evaluate the
        # key, which may be parsed from JSON, twice.
        with shuffles_go(batch.sparkSession):
            batch.withColumn(PART, self.part_of(self.key)).write.partitionBy(PART).parquet(path, compression=PACKED)
        schema = T.StructType([*batch.schema.fields, T.StructField(PART, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(path).where(F.col(self.key).isNotNull())

    def land(self, batch: DataFrame, path: str | None = None) -> tuple[DataFrame, list[int]]:
        """The batch, evaluated and written once to the shared folder, and the parts its keys belong to.

        Beside its columns it has the number of each row's part.
        """
        rows = self._landed(batch, path or scratch_path(self.spark, "batch"))
        return rows, self.parts_of(rows)

    def discard(self, path: str) -> None:
        """Delete a landed batch that has been published."""
        self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)

    @staticmethod
    def portions(parts: list[int], rows: int) -> list[list[int]]:
        """The parts, so many together as hold about ROWS_TOGETHER of the rows, one at least."""
        together = max(1, len(parts) * ROWS_TOGETHER // max(1, rows))
        return [parts[n : n + together] for n in range(0, len(parts), together)]

    def rewrite(
        self, frames: dict[str, DataFrame | list[DataFrame]], base: int | None, whole: bool = False
    ) -> tuple[int, int]:
        """Publish new contents of some parts, or of `whole` families, as the next version.

        A family's contents are a frame, or several of different parts that are written in turn.
        Returns the version's number and the rows written to a family.  ``base`` is the version
        the contents were made from; if another one was published since, they are refused.
        """
        number, current = self._claim(), self.folders(base)
        rows = 0
        for family, frame in frames.items():
            for portion in frame if isinstance(frame, list) else [frame]:
                self._write(number, family, portion)
            held = {n for n in self._names(f"v{number:010d}", family) if n.startswith(f"{PART}=")}
            # A count reads only the footers of what was written.
            rows = self._frame(family, [f"{self.path}/v{number:010d}/{family}/{name}" for name in sorted(held)]).count()
            if whole:
                for name in {f"{PART}={n}" for f, n in current if f == family} - held:
                    self._fs().mkdirs(self._path(f"v{number:010d}", family, name))
        return self._publish(number, base), rows

    def replace(self, frame: DataFrame) -> tuple[int, int]:
        """Store a whole table as the next version; its number and rows.

        Keys must be unique.  With more than one family the frame is landed first, so that it is
        evaluated once.  A part without a row is stored empty.
        """
        base = self.version()
        if len(self.families) == 1:
            return self.rewrite(dict.fromkeys(self.families, frame), base, whole=True)
        path = scratch_path(self.spark, "batch")
        written = self.rewrite(dict.fromkeys(self.families, self._landed(frame, path)), base, whole=True)
        self.discard(path)
        return written
