"""The four-table blend, its stored forms, and scoring of named ids."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvegrid.functions.risk import (
    COMPONENTS,
    CVE_ID_PATTERN,
    cvss_imputed,
    cvss_score,
    merged_weaknesses,
    risk_band,
    risk_components,
    risk_rationale,
    risk_total,
    score_points,
    top_weakness,
)
from cvegrid.sources.keyed import KeyedStore
from cvegrid.sources.tables import VersionedTable

# The columns and order of the risk result.
RISK_COLUMNS = (
    "cve_id", "risk_score", *COMPONENTS, "cvss_score", "cvss_imputed",
    "epss_probability", "epss_percentile", "epss_previous_probability",
    "epss_previous_scored_at", "epss_scored_at", "kev_listed", "kev_date_added",
    "known_ransomware_campaign_use", "ssvc_exploitation", "ssvc_automatable",
    "ssvc_technical_impact", "cwe_top",
)

UNKNOWN_NOTE = "Not found in KEV or NVD — unscored, not low risk."


def universe(nvd: DataFrame, kev: DataFrame) -> DataFrame:
    """Every id either catalog knows, once.

    The key is never NULL, yet the filter matters: Spark 4.1 takes a union of two bare
    bucketed scans for one that keeps their buckets and skips the distinct's shuffle, which
    leaves repeated ids.  Behind a filter the ids, and only they, are shuffled.
    """
    known = F.col("cve_id").isNotNull()
    return nvd.where(known).select("cve_id").union(kev.where(known).select("cve_id")).distinct()


def four_way_left(nvd: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """The universe with whatever each table knows about an id.

    All joins use ``cve_id`` and keep the left side's partitioning, so after the distinct
    each table moves at most once; a table small enough at run time is broadcast instead.
    Only the narrow columns the blend reads are selected, never documents or vectors.
    """
    vulnerability = nvd.select(
        "cve_id", "cvss_v31_score", "cvss_v2_score", F.col("cwes").alias("nvd_cwes"),
        "ssvc_exploitation", "ssvc_automatable", "ssvc_technical_impact",
    )
    listing = kev.select(
        "cve_id", F.lit(True).alias("kev_listed"), F.col("date_added").alias("kev_date_added"),
        "known_ransomware_campaign_use", F.col("cwes").alias("kev_cwes"),
    )
    previous = [
        F.col(name).alias(f"epss_{name}") if name in epss.columns else F.lit(None).cast(kind).alias(f"epss_{name}")
        for name, kind in (("previous_probability", "decimal(6,5)"), ("previous_scored_at", "date"))
    ]
    likelihood = epss.select(
        "cve_id",
        F.col("probability").alias("epss_probability"),
        F.col("percentile").alias("epss_percentile"),
        *previous,
        F.col("scored_at").alias("epss_scored_at"),
    )
    return (
        universe(nvd, kev)
        .join(vulnerability, "cve_id", "left")
        .join(listing, "cve_id", "left")
        .join(likelihood, "cve_id", "left")
        .withColumn("kev_listed", F.coalesce("kev_listed", F.lit(False)))
    )


def risk_scores(nvd: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """One row per id of either catalog with its score, parts and the inputs behind them."""
    joined = four_way_left(nvd, kev, epss).withColumn(
        "cwe_top", top_weakness(merged_weaknesses(F.col("nvd_cwes"), F.col("kev_cwes")))
    )
    v31, v2 = F.col("cvss_v31_score"), F.col("cvss_v2_score")
    parts = risk_components(
        v31=v31,
        v2=v2,
        probability=F.col("epss_probability"),
        listed=F.col("kev_listed"),
        ransomware=F.col("known_ransomware_campaign_use"),
        exploitation=F.col("ssvc_exploitation"),
        automatable=F.col("ssvc_automatable"),
        impact=F.col("ssvc_technical_impact"),
        top_cwe=F.col("cwe_top"),
    )
    return (
        joined.withColumns(parts | {"cvss_score": cvss_score(v31, v2), "cvss_imputed": cvss_imputed(v31, v2)})
        .withColumn("risk_score", risk_total())
        .select(*RISK_COLUMNS)
    )


def risk_of(nvd: DataFrame, kev: DataFrame, epss: DataFrame, ids: DataFrame) -> DataFrame:
    """Risk rows of the requested ids: the tables are cut to them before anything is blended."""
    wanted = ids.select("cve_id").distinct()
    return risk_scores(*[t.join(wanted, "cve_id", "left_semi") for t in (nvd, kev, epss)])


class RiskSnapshot:
    """The stored risk result in both orders: by falling score, and by the hash of the id.

    A refresh evaluates the blend once, into the copy by id; the ranked copy is sorted from there.
    Its files follow one another in the order of (score, id), and a small table holds where each
    begins and how many rows it has, so the best k rows are in the leading files.  That table also
    names the version of the other copy and is written last: readers see both copies change at once.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.spark = spark
        self.parts = parts
        self.path = path.rstrip("/")
        self.bounds = VersionedTable(spark, f"{self.path}/bounds")
        self.ranked = VersionedTable(spark, f"{self.path}/ranked")
        self._held: tuple[int, list[Row], T.StructType] | None = None

    def _by_id(self, schema: T.StructType) -> KeyedStore:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        return KeyedStore(self.spark, f"{self.path}/by_id", columns, parts=self.parts)

    def refresh(self, risk: DataFrame, files: int | None = None) -> int:
        """Store the blend in both orders and return its row count.

        Range partitioning on (score, id) splits a popular score over several files.
        """
        by_id = self._by_id(risk.schema)
        version, rows = by_id.replace(risk)
        order = [F.col("risk_score").desc(), F.col("cve_id")]
        held = by_id.read(risk.columns, version=version)
        spread = held.repartitionByRange(files, *order) if files else held.repartitionByRange(*order)
        self.ranked.write(spread.sortWithinPartitions(*order))
        first = F.min_by(F.struct("risk_score", "cve_id"), F.struct(-F.col("risk_score"), "cve_id"))
        files_read = self.ranked.read().groupBy(F.input_file_name().alias("file"))
        self.bounds.write(
            files_read.agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).select(
                "file", "first.*", "rows", F.lit(version).cast("bigint").alias("by_id")
            )
        )
        return rows

    def _current(self) -> tuple[list[Row], T.StructType]:
        """Bounds of the ranked files, the first file first, and the result's schema.

        There are as many files as the sort had partitions; they are read once a version.
        """
        version = self.bounds.version()
        if version is None:
            raise FileNotFoundError(f"no snapshot below {self.path}")
        if self._held is None or self._held[0] != version:
            bounds = self.bounds.read().orderBy(F.col("risk_score").desc(), "cve_id").collect()
            self._held = version, bounds, self.ranked.read().schema
        return self._held[1:]

    def _open(self, files: list[str]) -> DataFrame:
        schema = self._current()[1]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows of the current snapshot."""
        return self._open([bound["file"] for bound in self._current()[0]])

    def top(self, limit: int) -> DataFrame:
        """The best rows; opens only the leading files that hold them."""
        files, rows = [], 0
        for bound in self._current()[0]:
            if rows >= limit:
                break
            files.append(bound["file"])
            rows += bound["rows"]
        return self._open(files).orderBy(F.col("risk_score").desc(), "cve_id").limit(limit)

    def look_up(self, ids: DataFrame) -> DataFrame:
        """Rows of the requested ids; opens only the parts they belong to."""
        bounds, schema = self._current()
        if not bounds:
            return self._open([])
        return self._by_id(schema).look_up(ids, schema.names, bounds[0]["by_id"])


def split_ids(ids: DataFrame, column: str = "cve_id") -> DataFrame:
    """Ids with a flag saying whether they have the documented form."""
    return ids.withColumn("well_formed", F.col(column).rlike(CVE_ID_PATTERN))


def score_ids(risk: DataFrame, ids: DataFrame) -> DataFrame:
    """Ranked entry per distinct requested id; unknown ids are reported, not dropped."""
    found = F.col("risk_score").isNotNull()
    entry = ids.select("cve_id").distinct().join(risk, "cve_id", "left")
    points = score_points(F.col("risk_score"))
    # Sorting evaluates what is below it twice, once for its bounds, so the prose is written above it.
    return entry.orderBy(points.desc_nulls_last(), "cve_id").select(
        "cve_id",
        points.alias("score"),
        F.when(found, risk_band(F.col("risk_score"))).alias("band"),
        *COMPONENTS,
        F.when(found, risk_rationale()).otherwise(UNKNOWN_NOTE).alias("rationale"),
    )


def score_id_list(spark: SparkSession, risk: DataFrame | Callable[[DataFrame], DataFrame], ids: list[str]) -> DataFrame:
    """``score_ids`` for ids typed by a caller: refuses an empty or malformed list.

    ``risk`` is the result, or a look-up such as ``Catalog.risk_of`` that reads only those ids.
    """
    if not ids:
        raise ValueError("no CVE IDs supplied")
    malformed = [i for i in ids if not re.match(CVE_ID_PATTERN.replace(r"\z", r"\Z"), i)]
    if malformed:
        raise ValueError(f"malformed CVE ID(s): {', '.join(malformed)}")
    asked = spark.createDataFrame([(i,) for i in ids], "cve_id string")
    return score_ids(risk(asked) if callable(risk) else risk, asked)


def component_mismatches(risk: DataFrame) -> DataFrame:
    """Number of rows whose score is not the rounded sum of their parts; expected zero."""
    return risk.agg(F.count_if(F.col("risk_score") != risk_total()).alias("mismatches"))


def universe_coverage(risk: DataFrame, nvd: DataFrame, kev: DataFrame) -> DataFrame:
    """Row count of the result beside that of the universe, and rows without a score."""
    result = risk.select(
        F.lit(1).alias("view"), F.col("risk_score").isNull().cast("int").alias("null"), F.lit(0).alias("known")
    )
    known = universe(nvd, kev).select(F.lit(0).alias("view"), F.lit(0).alias("null"), F.lit(1).alias("known"))
    return result.unionByName(known).agg(
        F.sum("view").alias("view_rows"), F.sum("null").alias("null_scores"), F.sum("known").alias("universe_rows")
    )
