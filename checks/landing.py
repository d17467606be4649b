"""Feed files written from the derived corpus, in the layouts the readers expect.

Pages hold a bounded block of order keys, so no page grows with the corpus, and every file
is written by Spark tasks into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus
from cvegrid.sources.tables import scratch_path, shuffles_go

PAGE = 2000
FILE = 100_000


def _block(size: int):
    return F.floor(F.col("k") / size).cast("bigint")


def _pages(rows: DataFrame, entry: str, opening: str) -> DataFrame:
    grouped = rows.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("k", F.col(entry).alias("entry")))).alias("entries")
    )
    entries = F.array_join(F.transform("entries", lambda e: e["entry"]), ",")
    return grouped.select(F.concat(F.lit(opening), entries, F.lit("]}")).alias("value"))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries under the feed's field names."""
    return corpus.kev(spark, sf_dir).select(
        F.col("cve_id").alias("cveID"),
        F.col("vendor_project").alias("vendorProject"),
        "product",
        F.col("vulnerability_name").alias("vulnerabilityName"),
        F.col("short_description").alias("shortDescription"),
        F.col("required_action").alias("requiredAction"),
        "notes",
        F.col("date_added").cast("string").alias("dateAdded"),
        F.col("due_date").cast("string").alias("dueDate"),
        F.col("known_ransomware_campaign_use").alias("knownRansomwareCampaignUse"),
        "cwes",
    )


def land_catalog(spark: SparkSession, sf_dir: str) -> str:
    """Catalog documents, one per line."""
    entries = feed_entries(spark, sf_dir)
    rows = entries.select(
        F.substring_index("cveID", "-", -1).cast("bigint").alias("k"),
        F.to_json(F.struct(*entries.columns)).alias("json"),
    ).withColumn("page", _block(PAGE))
    path = scratch_path(spark, "catalog-feed")
    _pages(rows, "json", '{"title":"catalog","vulnerabilities":[').write.text(path)
    return path


def revised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of two thirds of the records on the day of the first one.

    Those of every third key are from the last second of that day, after all first ones but those
    written at 23:30 eight hours west; the others are from its first second, before all of them.
    """
    later = F.col("k") % 3 == 0
    clock = F.when(later, F.lit("T23:59:59Z")).otherwise(F.lit("T00:00:01Z"))
    text = F.regexp_replace(F.col("raw_json"), F.lit(r'("lastModified":"[0-9-]{10})[^"]*"'), F.concat(F.lit("$1"), clock, F.lit('"')))
    worded = F.when(later, F.lit("Later flaw number")).otherwise(F.lit("Earlier flaw number"))
    rows = corpus.raw(spark, sf_dir, paged=PAGE).where("k % 3 < 2")
    return rows.withColumn("raw_json", F.regexp_replace(text, F.lit("Flaw number"), worded))


def land_vuln_pages(
    spark: SparkSession, sf_dir: str, records: DataFrame | None = None, path: str | None = None
) -> str:
    """API pages, one per line of gzip files; the first wrapper of each page lacks a record.

    The records come dealt by page, so the texts don't move; each task writes one file of its pages.
    """
    rows = (corpus.raw(spark, sf_dir, paged=PAGE) if records is None else records).select(
        "k", "page", F.concat(F.lit('{"cve":'), F.col("raw_json"), F.lit("}")).alias("wrapper")
    )
    pages = _pages(rows, "wrapper", '{"resultsPerPage":2000,"vulnerabilities":[{"note":"no record"},')
    path = path or scratch_path(spark, "vuln-pages")
    with shuffles_go(spark):
        pages.write.mode("append").option("compression", "gzip").text(path)
    return path


def land_scores(spark: SparkSession, sf_dir: str) -> str:
    """The second publication as gzip CSV files, each with its own metadata and header.

    Ids outside the publication turn into malformed rows; some ids come twice, the earlier
    row with a value that must not survive.
    """
    base = corpus.base(spark, sf_dir).withColumns(
        {
            "probability": F.expr(corpus.fraction(7933)),
            "percentile": F.expr(corpus.fraction(7927)),
            "scored": F.expr(corpus.IN_SECOND_PUBLICATION),
        }
    )
    good = F.concat_ws(",", F.concat(F.lit(" "), F.col("cve_id")), F.col("probability"), F.col("percentile"))
    bad = F.expr(
        "CASE k % 3 WHEN 0 THEN concat(cve_id, ',n/a,0.5') WHEN 1 THEN ' ,0.1,0.1' ELSE '#late remark,here' END"
    )
    lines = F.when(~F.col("scored"), F.array(bad)).when(
        F.col("k") % 50 == 1, F.array(F.concat(F.col("cve_id"), F.lit(",0.00001,0.00001")), good)
    ).otherwise(F.array(good))
    rows = base.select("k", _block(FILE).alias("file"), F.posexplode(lines).alias("place", "line"))
    opening = (
        f"#model_version:{corpus.MODEL_VERSION},score_date:{corpus.PUBLICATION_DATES[1]}T12:00:27Z\n"
        "\n# more\ncve,epss,percentile\n"
    )
    files = rows.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("k", "place", "line"))).alias("lines")
    ).select(
        "file",
        F.concat(F.lit(opening), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("value"),
    )
    path = scratch_path(spark, "score-feed")
    files.write.partitionBy("file").option("compression", "gzip").text(path)
    return path


def land_weaknesses(spark: SparkSession, sf_dir: str) -> str:
    """Definitions as quoted CSV with padded names and some blank fields."""
    rows = corpus.cwe(spark, sf_dir).select(
        F.substring("cwe_id", 5, 20).alias("CWE-ID"),
        F.concat(F.lit("  "), F.col("name"), F.lit("\t")).alias("Name"),
        F.when(F.col("abstraction") != "Pillar", F.col("abstraction")).otherwise(" ").alias("Weakness Abstraction"),
        F.col("description").alias("Description"),
        F.lit("Draft").alias("Status"),
    )
    path = scratch_path(spark, "weakness-csv")
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return path
