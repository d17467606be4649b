"""Named analytical questions over the catalog tables, as DataFrame plans.

Every function takes a ``Catalog`` and returns a lazy DataFrame.  Orders end in the id, so
top-k results are the same on every run.  Array members are counted once per row.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvegrid.catalog import Catalog
from cvegrid.functions.risk import (
    BAND_CUTS,
    CLASS_OF,
    COMPONENTS,
    likelihood_band,
    risk_band,
    weakness_class,
)

CRITICAL = "CRITICAL"


def severity(prefix: str = "") -> Column:
    """v3.1 score where there is one, else v2."""
    return F.coalesce(F.col(f"{prefix}cvss_v31_score"), F.col(f"{prefix}cvss_v2_score"))


def mean(column: Column) -> Column:
    """Mean of decimals from their exact sum, so it does not depend on the order of rows."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column))


def members(frame: DataFrame, *columns: str) -> DataFrame:
    """One row per distinct weakness of a row."""
    return frame.select(*columns, F.explode(F.array_distinct("cwes")).alias("cwe_id"))


def look_up(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join of many facts with unique lookup rows.

    A plain equi-join, so that adaptive execution can broadcast a side that turns out small
    and else splits the partition of a very common key into as many tasks as its size needs.
    """
    return facts.join(lookup, key)


# -- filters -----------------------------------------------------------------------------

def lookup_cve(c: Catalog, cve_id: str) -> DataFrame:
    """What both catalogs hold about one id."""
    listed = c.kev.where(F.col("cve_id") == cve_id).select(
        "cve_id", F.lit("kev").alias("catalog"), "vendor_project", "product", "date_added"
    )
    known = c.nvd.where(F.col("cve_id") == cve_id).select(
        "cve_id", F.lit("nvd").alias("catalog"), "description", "cvss_v31_score", "cvss_v2_score", "published"
    )
    return listed.unionByName(known, allowMissingColumns=True)


def lookup_cve_batch(c: Catalog, ids: DataFrame) -> DataFrame:
    """Risk rows of the requested ids."""
    return c.risk_of(ids)


def patch_now_ssvc(c: Catalog) -> DataFrame:
    urgent = (
        (F.col("ssvc_exploitation") == "active")
        & (F.col("ssvc_automatable") == "yes")
        & (F.col("ssvc_technical_impact") == "total")
    )
    return (
        c.nvd.where(urgent)
        .select("cve_id", "cvss_v31_score")
        .orderBy(F.col("cvss_v31_score").desc_nulls_last(), "cve_id")
    )


def threshold_exact(c: Catalog, probability: str = "0.9") -> DataFrame:
    """Decimal comparison, so a score on the boundary is kept."""
    at_least = F.col("probability") >= F.lit(probability).cast("decimal(6,5)")
    return c.epss.where(at_least).select("cve_id", "probability")


def severity_band_filter(c: Catalog) -> DataFrame:
    """Severe but unlikely, the unscored included."""
    unlikely = (F.col("probability") < F.lit("0.01").cast("decimal(6,5)")) | F.col("probability").isNull()
    return (
        c.nvd.select("cve_id", severity().alias("severity"))
        .where(F.col("severity") >= 9)
        .join(c.epss.select("cve_id", "probability"), "cve_id", "left")
        .where(unlikely)
    )


def text_match_ci(c: Catalog, text: str = "injection", abstraction: str = "Base") -> DataFrame:
    pattern = f"%{text}%"
    matches = F.col("name").ilike(pattern) | F.col("description").ilike(pattern)
    return c.cwe.where((F.col("abstraction") == abstraction) & matches).select("cwe_id", "name", "description")


def json_path_exists(vulns: DataFrame) -> DataFrame:
    """Ids whose record holds SSVC data, from the column stored at load; no JSON is read."""
    return vulns.where("has_ssvc").select("cve_id")


def json_status_filter(vulns: DataFrame, status: str) -> DataFrame:
    """Ids whose record has a status, from the column stored at load; no JSON is read."""
    return vulns.where(F.col("status") == status).select("cve_id")


def json_subdocument(records: DataFrame) -> DataFrame:
    """Two sub-documents as JSON text."""
    return records.select(
        "cve_id",
        F.get_json_object("raw_json", "$.affected").alias("affected"),
        F.get_json_object("raw_json", "$.metrics.ssvcV203").alias("ssvc"),
    )


def measured_only(c: Catalog) -> DataFrame:
    return c.risk.where(~F.col("cvss_imputed")).select("cve_id", "risk_score", "cvss_score")


def recently_added(c: Catalog, as_of: datetime.date, days: int = 30) -> DataFrame:
    since = F.date_sub(F.lit(as_of), days)
    return c.kev.where((F.col("date_added") >= since) & (F.col("date_added") <= F.lit(as_of))).select(
        "cve_id", "vendor_project", "product", "date_added"
    )


def added_in_year(c: Catalog, year: int) -> DataFrame:
    return c.kev.where(_in_year("date_added", year)).agg(F.count("*").alias("added"))


def _in_year(column: str, year: int) -> Column:
    """A date range rather than ``year(column)``, so the scan can prune on it."""
    first, last = datetime.date(year, 1, 1), datetime.date(year, 12, 31)
    return F.col(column).between(F.lit(first), F.lit(last))


def max_cvss_not_exploited(c: Catalog) -> DataFrame:
    return c.nvd.where((F.col("cvss_v31_score") == 10) & (F.col("ssvc_exploitation") == "none")).select(
        "cve_id", "cvss_v31_score", "published"
    )


def vendor_products(c: Catalog, vendor: str) -> DataFrame:
    return c.kev.where(F.col("vendor_project") == vendor).select("product").distinct()


def critical_in_year(c: Catalog, year: int) -> DataFrame:
    critical = F.col("cvss_v31_severity") == CRITICAL
    return c.nvd.where(critical & _in_year("published", year)).select("cve_id", "cvss_v31_score", "published")


def listed_with_ransomware(c: Catalog) -> DataFrame:
    known = F.col("known_ransomware_campaign_use") == "Known"
    return c.kev.where(known).select("cve_id", "vendor_project", "product", "date_added")


def urls_for_cve(vulns: DataFrame, cve_id: str) -> DataFrame:
    """Every reference of one record, from its stored JSON: the stored column keeps only the first ten."""
    urls = F.from_json("raw_json", "references array<struct<url:string>>")["references"]["url"]
    return vulns.where(F.col("cve_id") == cve_id).select("cve_id", F.explode(urls).alias("url"))


def topic_in_year_by_cvss(c: Catalog, text: str, year: int, limit: int = 10) -> DataFrame:
    return (
        c.nvd.where(F.col("description").ilike(f"%{text}%") & _in_year("published", year))
        .select("cve_id", severity().alias("severity"))
        .orderBy(F.col("severity").desc_nulls_last(), "cve_id")
        .limit(limit)
    )


def likelihood_bands(c: Catalog) -> DataFrame:
    """Every known vulnerability with the reading of its likelihood."""
    scores = c.epss.select("cve_id", "probability", "percentile")
    return (
        c.nvd.select("cve_id")
        .join(scores, "cve_id", "left")
        .withColumn("likelihood", likelihood_band(F.col("probability"), F.col("percentile")))
    )


# -- joins -------------------------------------------------------------------------------

def exploited_with_severity(c: Catalog) -> DataFrame:
    return c.kev.select("cve_id", "vendor_project", "product", "date_added").join(
        c.nvd.select("cve_id", "cvss_v31_score", "cvss_v31_severity"), "cve_id"
    )


def left_join_scores(c: Catalog) -> DataFrame:
    scores = c.epss.select("cve_id", "probability", "percentile")
    return c.nvd.select("cve_id", "cvss_v31_score").join(scores, "cve_id", "left")


def leading_indicator(c: Catalog) -> DataFrame:
    """Likely to be exploited and not listed yet."""
    likely = c.epss.where(F.col("probability") >= F.lit("0.5").cast("decimal(6,5)"))
    return (
        c.nvd.select("cve_id", "cvss_v31_score")
        .join(likely.select("cve_id", "probability", "percentile"), "cve_id")
        .join(c.kev.select("cve_id"), "cve_id", "left_anti")
        .orderBy(F.col("probability").desc(), "cve_id")
    )


def resolve_weakness(c: Catalog, cve_id: str | None = None) -> DataFrame:
    """Names of the weaknesses of one vulnerability, or of all."""
    rows = c.nvd if cve_id is None else c.nvd.where(F.col("cve_id") == cve_id)
    return look_up(members(rows, "cve_id"), c.cwe.select("cwe_id", "name", "abstraction"), "cwe_id")


def score_and_urgency_agree(c: Catalog) -> DataFrame:
    active = c.nvd.where(F.col("ssvc_exploitation") == "active")
    likely = c.epss.where(F.col("probability") >= F.lit("0.5").cast("decimal(6,5)"))
    return (
        active.select("cve_id", "cvss_v31_score", "ssvc_exploitation")
        .join(likely.select("cve_id", "probability"), "cve_id")
        .orderBy(F.col("probability").desc(), "cve_id")
    )


def exploited_three_way_weakness(c: Catalog) -> DataFrame:
    """Weaknesses of listed vulnerabilities with a v3.1 score, counted and averaged."""
    scored = c.nvd.where(F.col("cvss_v31_score").isNotNull())
    rows = scored.join(c.kev.select("cve_id"), "cve_id", "left_semi")
    return _named(_weakness_sums(rows), c).orderBy(F.col("cve_count").desc(), "cwe_id")


def _weakness_sums(rows: DataFrame) -> DataFrame:
    """Count and mean v3.1 score per weakness, summed before any join so no id is hot."""
    return members(rows, "cvss_v31_score").groupBy("cwe_id").agg(
        F.count("*").alias("cve_count"),
        mean(F.col("cvss_v31_score")).alias("avg_cvss"),
    )


def _named(sums: DataFrame, c: Catalog) -> DataFrame:
    return sums.join(c.cwe.select("cwe_id", "name"), "cwe_id")


def join_coverage(c: Catalog) -> DataFrame:
    scores = c.epss.select("cve_id", F.lit(True).alias("scored"))
    return c.nvd.select("cve_id").join(scores, "cve_id", "left").agg(
        F.count_if(F.col("scored").isNull()).alias("unscored"), F.count("*").alias("total")
    )


def critical_listed(c: Catalog) -> DataFrame:
    critical = c.nvd.where(F.col("cvss_v31_severity") == CRITICAL)
    return critical.select("cve_id", "cvss_v31_score").join(
        c.kev.select("cve_id", "vendor_project", "product"), "cve_id"
    )


def listed_with_product(c: Catalog, name: str) -> DataFrame:
    """Listed vulnerabilities whose affected products mention a name."""
    mentions = F.exists("affected_products", lambda product: product.ilike(f"%{name}%"))
    return c.kev.select("cve_id", "vendor_project", "product").join(
        c.nvd.where(mentions).select("cve_id"), "cve_id", "left_semi"
    )


def critical_vendor_ransomware(c: Catalog, vendor: str) -> DataFrame:
    listed = c.kev.where(
        (F.col("vendor_project") == vendor) & (F.col("known_ransomware_campaign_use") == "Known")
    )
    critical = c.nvd.where(F.col("cvss_v31_severity") == CRITICAL)
    return listed.select("cve_id", "vendor_project", "product").join(
        critical.select("cve_id", "cvss_v31_score"), "cve_id"
    )


def weakness_detail_with_cves(c: Catalog, cwe_id: str) -> DataFrame:
    """One weakness and the listed vulnerabilities it is behind, by either catalog."""
    holds = F.array_contains("cwes", cwe_id)
    listed = c.kev.select("cve_id", "cwes")
    by_catalog = listed.where(holds).select("cve_id")
    by_record = c.nvd.where(holds).select("cve_id").join(listed.select("cve_id"), "cve_id", "left_semi")
    found = by_catalog.unionByName(by_record).distinct()
    # The one definition is a value, not a side of a join on a constant.
    definition = c.cwe.where(F.col("cwe_id") == cwe_id).agg(F.first(F.struct("cwe_id", "name", "description"))).scalar()
    return found.withColumn("_detail", definition).where("_detail IS NOT NULL").select("cve_id", "_detail.*")


def listed_in_weakness_class(c: Catalog, text: str = "injection") -> DataFrame:
    """Listed vulnerabilities with a weakness whose name mentions the text."""
    named = c.cwe.where(F.col("name").ilike(f"%{text}%")).select("cwe_id", "name")
    return look_up(members(c.kev, "cve_id", "vendor_project"), named, "cwe_id")


# -- aggregates --------------------------------------------------------------------------

def count_by_exploitation(c: Catalog) -> DataFrame:
    return c.nvd.groupBy("ssvc_exploitation").agg(F.count("*").alias("cve_count"))


def band_distribution(c: Catalog) -> DataFrame:
    band = risk_band(F.col("risk_score")).alias("band")
    return c.risk.groupBy(band).agg(F.count("*").alias("cve_count")).orderBy("band")


def band_by_listing(c: Catalog) -> DataFrame:
    """Bands with their share of all rows, split by listing.

    The total is a window over the four band rows, not over the corpus.
    """
    from pyspark.sql import Window

    bands = c.risk.groupBy(risk_band(F.col("risk_score")).alias("band")).agg(
        F.count("*").alias("cve_count"),
        F.count_if("kev_listed").alias("listed"),
        F.count_if(~F.col("kev_listed")).alias("not_listed"),
    )
    total = F.sum("cve_count").over(Window.partitionBy(F.lit(1)))
    return bands.withColumn("share", F.round(F.col("cve_count") * 100.0 / total, 2))


def top_weaknesses(c: Catalog, limit: int = 10) -> DataFrame:
    """Most common weaknesses of listed entries; counted first, named afterwards."""
    counts = members(c.kev, "cve_id").groupBy("cwe_id").agg(F.count("*").alias("cve_count"))
    return _named(counts, c).orderBy(F.col("cve_count").desc(), "cwe_id").limit(limit)


def top_weaknesses_severity(c: Catalog, limit: int = 10) -> DataFrame:
    return exploited_three_way_weakness(c).limit(limit)


def filtered_counts(c: Catalog) -> DataFrame:
    return c.risk.agg(
        F.count_if("cvss_imputed").alias("imputed"),
        F.count_if(F.col("epss_probability").isNull()).alias("unscored"),
        F.count("*").alias("total"),
    )


def _discrete_percentiles(column: str, points: dict[str, float]) -> Column:
    """Several discrete percentiles from one aggregate buffer, as a struct.

    The buffer counts distinct values; both columns it is used on are decimals with a fixed
    number of possible values, so it does not grow with the rows.
    """
    wanted = ", ".join(str(p) for p in points.values())
    found = F.expr(f"percentile_disc(array({wanted})) WITHIN GROUP (ORDER BY {column})")
    return F.struct(*[F.get(found, F.lit(i)).cast("double").alias(name) for i, name in enumerate(points)])


def calibration_percentiles(c: Catalog) -> DataFrame:
    points = _discrete_percentiles("risk_score", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999})
    return c.risk.agg(
        points.alias("points"),
        F.min("risk_score").alias("min_score"),
        F.max("risk_score").alias("max_score"),
        F.max(F.when(~F.col("kev_listed"), F.col("risk_score"))).alias("max_not_listed"),
    ).select("points.*", "min_score", "max_score", "max_not_listed")


def freshness(c: Catalog) -> DataFrame:
    return c.epss.agg(
        F.count("*").alias("scores"),
        F.min("scored_at").alias("oldest"),
        F.max("scored_at").alias("newest"),
        F.max("model_version").alias("model_version"),
    )


def component_means(c: Catalog) -> DataFrame:
    return c.risk.agg(*[mean(F.col(name)).alias(name) for name in COMPONENTS])


def top_vendors(c: Catalog, limit: int = 5) -> DataFrame:
    counts = c.kev.groupBy("vendor_project").agg(F.count("*").alias("entries"))
    return counts.orderBy(F.col("entries").desc(), "vendor_project").limit(limit)


def top_vendors_critical(c: Catalog, limit: int = 5) -> DataFrame:
    critical = c.nvd.where(F.col("cvss_v31_severity") == CRITICAL).select("cve_id")
    rows = c.kev.select("cve_id", "vendor_project").join(critical, "cve_id", "left_semi")
    counts = rows.groupBy("vendor_project").agg(F.count("*").alias("entries"))
    return counts.orderBy(F.col("entries").desc(), "vendor_project").limit(limit)


def _listed_scores(c: Catalog) -> DataFrame:
    listed = c.kev.select("cve_id", (F.col("known_ransomware_campaign_use") == "Known").alias("ransomware"))
    return listed.join(c.nvd.select("cve_id", "cvss_v31_score"), "cve_id")


def ransomware_compare(c: Catalog) -> DataFrame:
    average = mean(F.col("cvss_v31_score")).alias("avg_cvss")
    return _listed_scores(c).groupBy("ransomware").agg(F.count("*").alias("entries"), average)


def severity_distribution(c: Catalog) -> DataFrame:
    return c.nvd.groupBy("cvss_v31_severity").agg(F.count("*").alias("cve_count"))


def days_publish_to_listing(c: Catalog, year: int) -> DataFrame:
    """Mean days from publication to listing, by year of listing."""
    listed = c.kev.where(_in_year("date_added", year)).select("cve_id", "date_added")
    rows = listed.join(c.nvd.select("cve_id", "published"), "cve_id")
    gap = F.datediff("date_added", "published")
    return rows.agg(F.avg(gap).alias("avg_days"), F.count("*").alias("entries"))


def ransomware_count(c: Catalog) -> DataFrame:
    return c.kev.agg(F.count_if(F.col("known_ransomware_campaign_use") == "Known").alias("entries"))


def widest_products(c: Catalog, limit: int = 10) -> DataFrame:
    width = F.size("affected_products").alias("products")
    rows = c.kev.select("cve_id").join(c.nvd.select("cve_id", width), "cve_id")
    return rows.orderBy(F.col("products").desc(), "cve_id").limit(limit)


def weakness_by_avg_cvss(c: Catalog, limit: int = 10) -> DataFrame:
    scored = c.nvd.where(F.col("cvss_v31_score").isNotNull())
    return (
        _named(_weakness_sums(scored), c)
        .withColumn("avg_cvss", F.round("avg_cvss", 6))
        .orderBy(F.col("avg_cvss").desc(), "cwe_id")
        .limit(limit)
    )


def _in_class(label: str, *arrays: str) -> Column:
    """Whether a row has a member of a weakness class in any of its arrays."""
    ids = [member for member, name in CLASS_OF.items() if name == label]
    tests = [F.coalesce(F.arrays_overlap(a, F.array(*[F.lit(i) for i in ids])), F.lit(False)) for a in arrays]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def vendors_by_weakness_class(c: Catalog, label: str = "Memory corruption", limit: int = 10) -> DataFrame:
    counts = c.kev.where(_in_class(label, "cwes")).groupBy("vendor_project").agg(F.count("*").alias("entries"))
    return counts.orderBy(F.col("entries").desc(), "vendor_project").limit(limit)


def max_watermarks(c: Catalog) -> DataFrame:
    return c.nvd.agg(F.max("last_modified").alias("max_modified"), F.max("published").alias("max_published"))


def exploitation_vs_listing(c: Catalog) -> DataFrame:
    active = F.coalesce(F.col("ssvc_exploitation") == "active", F.lit(False)).alias("active")
    return c.risk.groupBy(active, "kev_listed").agg(F.count("*").alias("cve_count"))


def severity_coverage(c: Catalog) -> DataFrame:
    v31, v2 = F.col("cvss_v31_score").isNotNull(), F.col("cvss_v2_score").isNotNull()
    counts = c.nvd.agg(F.count("*").alias("total"), F.count_if(v31).alias("v31"), F.count_if(~v31 & v2).alias("v2_only"))
    rows = F.expr(
        "stack(3, 'v3.1', v31, total, 'v2 only', v2_only, total, 'neither', total - v31 - v2_only, total)"
        " AS (coverage, cve_count, total)"
    )
    return counts.select(rows).select(
        "coverage", "cve_count", F.round(F.col("cve_count") * 100.0 / F.col("total"), 1).alias("share")
    )


def ssvc_factor_population(c: Catalog) -> DataFrame:
    active = F.coalesce(F.col("ssvc_exploitation") == "active", F.lit(False))
    automatable, total = F.col("ssvc_automatable") == "yes", F.col("ssvc_technical_impact") == "total"
    return c.nvd.agg(
        F.count_if(F.col("ssvc_exploitation") == "active").alias("active"),
        F.count_if(F.col("ssvc_exploitation") == "poc").alias("poc"),
        F.count_if(automatable).alias("automatable"),
        F.count_if(total).alias("total_impact"),
        F.count_if(automatable & total & ~active).alias("automatable_total_not_active"),
    )


def likelihood_distribution(c: Catalog) -> DataFrame:
    def at_least(value: str) -> Column:
        return F.count_if(F.col("probability") >= F.lit(value).cast("decimal(6,5)"))

    points = _discrete_percentiles("probability", {"median": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999})
    return c.epss.agg(
        points.alias("points"),
        F.min("probability").alias("min_probability"),
        F.max("probability").alias("max_probability"),
        at_least("0.5").alias("at_least_half"),
        at_least("0.1").alias("at_least_tenth"),
    ).select("points.*", "min_probability", "max_probability", "at_least_half", "at_least_tenth")


def weakness_occurrences(c: Catalog) -> DataFrame:
    """Occurrences of every raw id, repeats counted; the NULL row counts records without one."""
    return (
        c.nvd.select(F.explode_outer("cwes").alias("cwe_id")).groupBy("cwe_id").agg(F.count("*").alias("occurrences"))
    )


def unassessed_by_year(c: Catalog) -> DataFrame:
    """Records without any severity per publication year, and how many are likely anyway."""
    rows = c.nvd.where(severity().isNull()).select("cve_id", F.year("published").alias("year"))
    likely = F.col("probability") >= F.lit("0.1").cast("decimal(6,5)")
    return (
        rows.join(c.epss.select("cve_id", "probability"), "cve_id", "left")
        .groupBy("year")
        .agg(F.count("*").alias("unassessed"), F.count_if(likely).alias("likely"))
        .orderBy("year")
    )


def count_at_score(c: Catalog, score: int = 10) -> DataFrame:
    return c.nvd.agg(F.count_if(F.col("cvss_v31_score") == score).alias("cve_count"))


def avg_score(c: Catalog) -> DataFrame:
    return c.nvd.agg(mean(severity()).alias("avg_cvss"))


def frequent_weaknesses_all(c: Catalog, limit: int = 10) -> DataFrame:
    counts = members(c.nvd, "cve_id").groupBy("cwe_id").agg(F.count("*").alias("cve_count"))
    return counts.orderBy(F.col("cve_count").desc(), "cwe_id").limit(limit)


def ransomware_avg_score(c: Catalog) -> DataFrame:
    return _listed_scores(c).where("ransomware").agg(mean(F.col("cvss_v31_score")).alias("avg_cvss"))


def critical_memory_corruption(c: Catalog, label: str = "Memory corruption") -> DataFrame:
    critical = F.col("cvss_v31_severity") == CRITICAL
    return c.nvd.agg(F.count_if(critical & _in_class(label, "cwes")).alias("cve_count"))


def weakness_class_counts(c: Catalog) -> DataFrame:
    """Class label behind each scored row."""
    label = weakness_class(F.col("cwe_top")).alias("weakness_class")
    return c.risk.groupBy(label).agg(F.count("*").alias("cve_count"))


def movement_coverage(c: Catalog) -> DataFrame:
    return c.epss.agg(F.count("previous_probability").alias("with_previous"))


def load_verification(c: Catalog, vectors: DataFrame) -> DataFrame:
    """Row counts of the tables and how many records lack a vector."""
    counts = [
        frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        for name, frame in (("kev", c.kev), ("nvd", c.nvd), ("cwe", c.cwe))
    ]
    lacking = vectors.agg(F.count_if(F.col("embedding").isNull()).alias("n"))
    counts.append(lacking.select(F.lit("missing_embedding").alias("relation"), "n"))
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def document_count(kev: DataFrame, nvd: DataFrame) -> DataFrame:
    ones = kev.select(F.lit(1).alias("one")).unionByName(nvd.select(F.lit(1).alias("one")))
    return ones.agg(F.count("one").alias("documents"))


# -- rankings ----------------------------------------------------------------------------

def _by_risk(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.col("risk_score").desc(), "cve_id")


def patch_first(c: Catalog, limit: int = 20) -> DataFrame:
    columns = ("cve_id", "risk_score", "cvss_score", "epss_probability", "kev_listed")
    return c.riskiest(limit).select(*columns)


def early_warning(c: Catalog) -> DataFrame:
    """High band without confirmed exploitation."""
    cut = dict(BAND_CUTS)["high"]
    rows = c.risk.where(~F.col("kev_listed") & (F.col("risk_score") >= cut))
    return _by_risk(rows.select("cve_id", "risk_score", "epss_probability", "epss_percentile"))


def biggest_movers(c: Catalog, limit: int = 20) -> DataFrame:
    return (
        c.epss.where(F.col("previous_probability").isNotNull())
        .select(
            "cve_id",
            "previous_probability",
            "probability",
            (F.col("probability") - F.col("previous_probability")).alias("delta"),
        )
        .orderBy(F.col("delta").desc(), "cve_id")
        .limit(limit)
    )


def newest_listed(c: Catalog, limit: int = 10) -> DataFrame:
    return (
        c.kev.select("cve_id", "vendor_project", "product", "date_added")
        .orderBy(F.col("date_added").desc_nulls_last(), "cve_id")
        .limit(limit)
    )


def explain_row(c: Catalog, cve_id: str) -> DataFrame:
    asked = c.nvd.sparkSession.createDataFrame([(cve_id,)], "cve_id string")
    return c.risk_of(asked).select("cve_id", "risk_score", *COMPONENTS, "cwe_top")


def active_not_listed(c: Catalog) -> DataFrame:
    rows = c.risk.where(~F.col("kev_listed") & (F.col("ssvc_exploitation") == "active"))
    return _by_risk(rows.select("cve_id", "risk_score", "cvss_score", "epss_probability", "ssvc_exploitation"))


def overdue_by_severity(c: Catalog, as_of: datetime.date, vendors: list[str] | None = None) -> DataFrame:
    """Entries past their due date, most severe first; optionally of some vendors only."""
    overdue = c.kev.where(F.col("due_date") < F.lit(as_of))
    if vendors:
        overdue = overdue.where(F.col("vendor_project").isin(vendors))
    return (
        overdue.select("cve_id", "vendor_project", "due_date")
        .join(c.nvd.select("cve_id", severity().alias("severity")), "cve_id", "left")
        .orderBy(F.col("severity").desc_nulls_last(), "cve_id")
    )


def listed_above_nine(c: Catalog) -> DataFrame:
    severe = c.nvd.where(F.col("cvss_v31_score") > 9).select("cve_id", "cvss_v31_score")
    return (
        c.kev.select("cve_id", "vendor_project", "date_added")
        .join(severe, "cve_id")
        .orderBy(F.col("date_added").desc(), "cve_id")
    )


def top_severe_listed(c: Catalog, limit: int = 10) -> DataFrame:
    return (
        c.kev.select("cve_id", "vendor_project", "product")
        .join(c.nvd.select("cve_id", "cvss_v31_score"), "cve_id")
        .orderBy(F.col("cvss_v31_score").desc_nulls_last(), "cve_id")
        .limit(limit)
    )
