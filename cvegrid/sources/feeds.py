"""Readers for the landed feed files."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid import schemas
from cvegrid.functions.shaping import (
    count_malformed_scores,
    dedupe_last_wins,
    parse_record,
    skip_malformed_scores,
)
from cvegrid.functions.text import strip, stripped_or_null
from cvegrid.sources.tables import scratch_path

SCORE_COLUMNS = ("cve", "epss", "percentile")
WEAKNESS_COLUMNS = ("CWE-ID", "Name", "Weakness Abstraction", "Description")
WEAKNESS_URL = "https://cwe.mitre.org/data/definitions/{}.html"


class FeedError(ValueError):
    """A feed file that does not have the documented shape."""


def read_exploited_catalog(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Entries of the exploited catalog, one row each.

    ``path`` holds one JSON document per file, or one per line with ``per_line``.
    """
    feed = spark.read.schema(schemas.KEV_FEED).json(path, multiLine=not per_line)
    return feed.select(F.explode("vulnerabilities").alias("entry")).select("entry.*")


def page_records(text: Column) -> Column:
    """The records of one page as JSON texts, wrappers without a record dropped."""
    wrappers = F.from_json(text, schemas.NVD_PAGE)["vulnerabilities"]
    return F.filter(F.transform(wrappers, lambda wrapper: wrapper["cve"]), lambda cve: cve.isNotNull())


def read_vuln_pages(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Vulnerability records of landed pages: the text as it came and the parsed struct.

    ``path`` holds one page per file, or one per line with ``per_line``.  A page has at most
    a few thousand records, so one row never grows with the corpus.
    """
    pages = spark.read.text(path, wholetext=not per_line)
    records = pages.select(F.explode(page_records(F.col("value"))).alias("raw_json"))
    return records.withColumn("parsed", parse_record(F.col("raw_json")))


@dataclass
class ScoreFeedMeta:
    """What a score feed says of itself; malformed rows are counted when they are asked for."""

    model_version: str | None
    scored_at: datetime.date
    counts: DataFrame

    @cached_property
    def skipped(self) -> int:
        return self.counts.first()["skipped"]


def _opening(lines: DataFrame) -> DataFrame:
    """Per file: where its header stands, the header, model version and score date."""
    text = strip(F.col("value"))
    comment = text.startswith("#")
    named = comment & (text.contains("model_version:") | text.contains("score_date:"))
    found = lines.groupBy("file").agg(
        F.min_by(F.struct("place", "value"), F.when((text != "") & ~comment, F.col("place"))).alias("header"),
        F.min_by(F.struct("place", "value"), F.when(named, F.col("place"))).alias("named"),
    )
    # Only a line before the header is metadata; a later one is an ordinary malformed row.
    line = F.when(F.col("named.place") < F.col("header.place"), F.regexp_replace(strip(F.col("named.value")), "^#+", ""))
    fields = F.transform_keys(F.str_to_map(line, F.lit(","), F.lit(":")), lambda k, _: F.trim(k))
    day = F.regexp_extract(F.trim(fields["score_date"]), r"^\d{4}-\d{2}-\d{2}(?=$|[T ])", 0)
    return found.select(
        "file",
        F.col("header.place").alias("start"),
        F.col("header.value").alias("header"),
        F.trim(fields["model_version"]).alias("model_version"),
        day.try_cast("date").alias("scored_at"),
    )


def read_score_feed(
    spark: SparkSession, path: str, load_date: datetime.date
) -> tuple[DataFrame, ScoreFeedMeta]:
    """Likelihood scores of one publication, in one or several (gzip) CSV files.

    Each file opens with ``#`` metadata and blank lines, then a header.  Files are taken by
    name and lines as they stand in them, so the last of a repeated id is the same however
    Spark splits the files.  Text is read once and its lines landed with file and place, so that
    a gzip file is unpacked once; openings and rows come from there.  One opening a file goes to
    every task, and the line stays where it is.  Files that disagree on header, model version or
    score date are refused.
    """
    landed = scratch_path(spark, "score-lines")
    read = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
    )
    read.write.parquet(landed)
    lines = spark.read.schema(read.schema).parquet(landed)
    opening = _opening(lines)
    kinds = opening.where("header IS NOT NULL").select("header", "model_version", "scored_at").distinct().limit(2).collect()
    if not kinds:
        raise FeedError("score feed has no CSV header")
    if len(kinds) > 1:
        raise FeedError(f"score feed files disagree: {[tuple(kind) for kind in kinds]}")
    header, model_version, scored_at = kinds[0]
    columns = [name.strip().strip('"') for name in header.split(",")]
    missing = [name for name in SCORE_COLUMNS if name not in columns]
    if missing:
        raise FeedError(f"score feed misses columns {missing} (found {columns})")

    schema = ", ".join(f"`{name}` string" for name in columns)
    rows = (
        lines.join(F.broadcast(opening.select("file", "start")), "file")
        .where((F.col("place") > F.col("start")) & (F.col("value") != ""))
        .select(F.from_csv("value", schema).alias("row"), "place")
        .select(*[F.col("row")[name].alias(name) for name in SCORE_COLUMNS], F.col("place").alias("position"))
    )
    meta = ScoreFeedMeta(model_version, scored_at or load_date, count_malformed_scores(rows))
    typed = skip_malformed_scores(rows).select("cve_id", "probability", "percentile", "position")
    scores = dedupe_last_wins(typed, ["cve_id"], "position").select(
        "cve_id",
        "probability",
        "percentile",
        F.lit(meta.scored_at).cast("date").alias("scored_at"),
        F.lit(meta.model_version).cast("string").alias("model_version"),
    )
    return scores, meta


def read_weakness_csv(spark: SparkSession, path: str) -> DataFrame:
    """Weakness definitions: trimmed, blank ids skipped, blank optional fields NULL."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [name for name in WEAKNESS_COLUMNS if name not in rows.columns]
    if missing:
        raise FeedError(f"weakness file misses columns {missing}")
    number, name, abstraction, description = [F.col(f"`{column}`") for column in WEAKNESS_COLUMNS]
    before, after = WEAKNESS_URL.split("{}")
    return rows.where(stripped_or_null(number).isNotNull()).select(
        F.concat(F.lit("CWE-"), strip(number)).alias("cwe_id"),
        F.coalesce(strip(name), F.lit("")).alias("name"),
        stripped_or_null(abstraction).alias("abstraction"),
        stripped_or_null(description).alias("description"),
        F.concat(F.lit(before), strip(number), F.lit(after)).alias("url"),
    )
