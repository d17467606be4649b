"""Vulnerability-shaped tables derived from the generic test tables.

The test tables hold orders, events, documents and vectors but no vulnerability records.
Every row of ``orders`` becomes one CVE id; integer arithmetic on the order key decides
which catalogs list it and what its attributes are.  Nothing is sampled or cut: each
relation is a projection of the whole source table, so its size follows the table's.

The expressions are written once in the SQL both Spark and DuckDB understand.  The only
differences (array literals, array slices, the string type) go through ``Dialect``.
The values are synthetic and say nothing about real CVEs.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.catalog import Catalog

# Rows of JSON that one task writes, so that its time stays bounded.
ROWS_A_TASK = 50_000

AS_OF = datetime.date(2001, 8, 1)
PUBLICATION_DATES = ("2026-07-27", "2026-07-28")
MODEL_VERSION = "v2026.06.15"

WEAKNESS_CYCLE = (
    "CWE-79", "NVD-CWE-noinfo", "CWE-89", "CWE-787", "CWE-20",
    "CWE-502", "CWE-22", "CWE-287", "CWE-200", "CWE-476",
)

WEAKNESS_NAMES = {
    "CWE-79": ("Cross-site Scripting", "Base"),
    "CWE-89": ("SQL Injection", "Base"),
    "CWE-787": ("Out-of-bounds Write", "Base"),
    "CWE-20": ("Improper Input Validation", "Class"),
    "CWE-502": ("Deserialization of Untrusted Data", "Base"),
    "CWE-22": ("Path Traversal", "Base"),
    "CWE-287": ("Improper Authentication", "Class"),
    "CWE-200": ("Exposure of Sensitive Information", "Class"),
    "CWE-476": ("NULL Pointer Dereference", "Base"),
}


@dataclass(frozen=True)
class Dialect:
    """The few spellings on which the two SQL engines differ."""

    name: str

    def array(self, *items: str) -> str:
        inner = ", ".join(items)
        return f"array({inner})" if self.name == "spark" else f"[{inner}]"

    def first_n(self, array: str, n: str) -> str:
        if self.name == "spark":
            return f"slice({array}, 1, CAST({n} AS INT))"
        return f"list_slice({array}, 1, {n})"

    def no_strings(self) -> str:
        return "CAST(NULL AS ARRAY<STRING>)" if self.name == "spark" else "CAST(NULL AS VARCHAR[])"

    @property
    def string(self) -> str:
        return "STRING" if self.name == "spark" else "VARCHAR"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")


def pick(selector: str, options: tuple[str, ...]) -> str:
    """``options[selector]`` as a CASE both engines read the same way."""
    arms = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"(CASE {selector} {arms} END)"


def tenths(multiplier: int) -> str:
    """A score from 0.0 to 10.0 in exact decimal."""
    return f"CAST(CAST(k * {multiplier} % 101 AS DECIMAL(5,1)) * 0.1 AS DECIMAL(3,1))"


def fraction(multiplier: int) -> str:
    """A five-place decimal in [0, 1)."""
    return f"CAST(CAST(k * {multiplier} % 100000 AS DECIMAL(10,5)) * 0.00001 AS DECIMAL(6,5))"


def repeated(count: str, most: int, item) -> str:
    """Comma-joined text of ``item(1)``..``item(count)``; ``count`` is at most ``most``."""
    parts = []
    for i in range(1, most + 1):
        lead = "','  || " if i > 1 else ""
        parts.append(f"(CASE WHEN {count} >= {i} THEN {lead}{item(i)} ELSE '' END)")
    return "(" + " || ".join(parts) + ")"


# -- orders -> the four catalog tables ---------------------------------------------------

BASE = [
    "o_orderkey AS k",
    "CAST(o_orderdate AS DATE) AS d",
    "o_orderpriority AS pri",
    "'CVE-' || year(o_orderdate) || '-' || (o_orderkey + 10000) AS cve_id",
]

_V31 = f"(CASE WHEN k % 10 < 6 THEN {tenths(37)} END)"
_V2 = f"(CASE WHEN k % 10 BETWEEN 4 AND 8 THEN {tenths(53)} END)"


def _even(options: str) -> str:
    return f"CASE WHEN k % 2 = 0 THEN {options} END"


# Attributes of a vulnerability, each a column before anything uses it.
DETAIL = [
    "*",
    f"{_V31} AS v31",
    f"{_V2} AS v2",
    f"{pick('k % 10', WEAKNESS_CYCLE)} AS cwe_a",
    f"{pick('k % 7', WEAKNESS_CYCLE[:7])} AS cwe_b",
    f"{_even(pick('k % 3', ('none', 'poc', 'active')))} AS exploitation",
    f"{_even(pick('k % 5 % 2', ('yes', 'no')))} AS automatable",
    f"{_even(pick('k % 7 % 2', ('total', 'partial')))} AS impact",
    "(d + CAST(k % 400 AS INT)) AS modified",
    "'vendor-' || (k % 40) AS vendor",
    "'Flaw number ' || k || ' in vendor-' || (k % 40) || ' gear, triage class ' || lower(pri) AS prose",
    f"{pick('k % 4', ('T23:30:00.000-08:00', 'T00:15:00Z', 'T12:00:00.000', 'T06:45:10.123'))} AS clock",
]
MORE_DETAIL = [
    "*",
    "CASE WHEN v31 >= 9 THEN 'CRITICAL' WHEN v31 >= 7 THEN 'HIGH' WHEN v31 >= 4 THEN 'MEDIUM' "
    "WHEN v31 IS NOT NULL THEN 'LOW' END AS v31_severity",
    "CASE WHEN v2 >= 7 THEN 'HIGH' WHEN v2 >= 4 THEN 'MEDIUM' WHEN v2 IS NOT NULL THEN 'LOW' END AS v2_severity",
    "CASE WHEN v31 IS NOT NULL THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:' || "
    f"{pick('k % 3', ('N', 'L', 'H'))} END AS v31_vector",
]

IN_NVD = "k % 97 <> 0"
IN_KEV = "(k % 29 = 0 OR k % 97 = 0)"
IN_FIRST_PUBLICATION = "k % 21 <> 0"
IN_SECOND_PUBLICATION = "(k % 21 <> 0 AND k % 5 <> 0)"


def product_name(i: int) -> str:
    return f"('cpe:2.3:a:' || vendor || ':item-{i}:' || (k % 9))"


def reference_url(i: int) -> str:
    return f"('https://advisories.example/' || k || '/{i}')"


def nvd_columns(dialect: Dialect) -> list[str]:
    products = dialect.array(*[product_name(i) for i in (1, 2, 3)])
    urls = dialect.array(*[reference_url(i) for i in range(1, 11)])
    return [
        "cve_id",
        "prose AS description",
        "v31 AS cvss_v31_score",
        "v31_severity AS cvss_v31_severity",
        "v31_vector AS cvss_v31_vector",
        "v2 AS cvss_v2_score",
        "v2_severity AS cvss_v2_severity",
        f"CASE WHEN k % 11 = 0 THEN {dialect.no_strings()} WHEN k % 3 = 0 THEN {dialect.array('cwe_a', 'cwe_b')} "
        f"ELSE {dialect.array('cwe_a')} END AS cwes",
        f"{dialect.first_n(products, 'k % 4')} AS affected_products",
        f"{dialect.first_n(urls, 'least(k % 13, 10)')} AS reference_urls",
        "d AS published",
        "modified AS last_modified",
        "exploitation AS ssvc_exploitation",
        "automatable AS ssvc_automatable",
        "impact AS ssvc_technical_impact",
    ]


def kev_columns(dialect: Dialect) -> list[str]:
    return [
        "cve_id",
        "'vendor-' || (k % 40) AS vendor_project",
        "'product-' || (k % 300) AS product",
        "'Vendor ' || (k % 40) || ' product ' || (k % 300) || ' flaw' AS vulnerability_name",
        "'Short text for order ' || k AS short_description",
        "'Apply update ' || (k % 12) AS required_action",
        "CASE WHEN k % 6 <> 0 THEN 'note ' || (k % 6) END AS notes",
        "d AS date_added",
        "d + 21 AS due_date",
        "CASE WHEN k % 4 = 0 THEN 'Known' ELSE 'Unknown' END AS known_ransomware_campaign_use",
        f"{dialect.array(pick('k % 9', WEAKNESS_CYCLE[:9]))} AS cwes",
    ]


def publication_columns(number: int) -> list[str]:
    """One score publication as the feed carries it."""
    multiplier = 7919 if number == 1 else 7933
    return [
        "cve_id",
        f"{fraction(multiplier)} AS probability",
        f"{fraction(7927)} AS percentile",
        f"DATE '{PUBLICATION_DATES[number - 1]}' AS scored_at",
        f"'{MODEL_VERSION}' AS model_version",
    ]


def epss_columns() -> list[str]:
    """The stored table after both publications: the second shifts the first to previous."""
    second = IN_SECOND_PUBLICATION
    first_date, second_date = PUBLICATION_DATES
    return [
        "cve_id",
        f"CASE WHEN {second} THEN {fraction(7933)} ELSE {fraction(7919)} END AS probability",
        f"{fraction(7927)} AS percentile",
        f"CASE WHEN {second} THEN DATE '{second_date}' ELSE DATE '{first_date}' END AS scored_at",
        f"'{MODEL_VERSION}' AS model_version",
        f"CASE WHEN {second} THEN {fraction(7919)} END AS previous_probability",
        f"CASE WHEN {second} THEN DATE '{first_date}' END AS previous_scored_at",
    ]


# -- raw JSON in the shape of the upstream API ------------------------------------------

def raw_json() -> str:
    """One record as JSON text, built by concatenation so both engines write the same bytes.

    Decoys that must not change the result ride along: later CVSS entries, foreign-language
    texts, a non-object SSVC option, repeated SSVC keys (the last counts), legacy
    automatable words, non-vulnerable matches, blank and repeated vendor names.
    """
    v31_entry = (
        f"'{{\"source\":\"primary\",\"cvssData\":{{\"version\":\"3.1\",\"baseScore\":' || v31 || "
        f"',\"baseSeverity\":\"' || v31_severity || '\",\"vectorString\":\"' || v31_vector || '\"}}}}'"
    )
    v31_decoy = "',{\"source\":\"secondary\",\"cvssData\":{\"baseScore\":1.1,\"baseSeverity\":\"LOW\",\"vectorString\":\"x\"}}'"
    v31_block = (
        f"(CASE WHEN v31 IS NULL THEN '' ELSE '\"cvssMetricV31\":[' || {v31_entry} || "
        f"(CASE WHEN k % 5 = 0 THEN {v31_decoy} ELSE '' END) || '],' END)"
    )
    v2_block = (
        f"(CASE WHEN v2 IS NULL THEN '' ELSE '\"cvssMetricV2\":[{{\"baseSeverity\":\"' || v2_severity || "
        f"'\",\"cvssData\":{{\"baseScore\":' || v2 || '}}}}],' END)"
    )
    automatable = (
        f"(CASE WHEN k % 12 = 0 AND automatable = 'yes' THEN 'rapid' "
        f"WHEN k % 12 = 0 AND automatable = 'no' THEN 'slow' ELSE automatable END)"
    )
    ssvc_block = (
        f"(CASE WHEN exploitation IS NULL THEN '' ELSE '\"ssvcV203\":[{{\"source\":\"adp\",\"ssvcData\":"
        f"{{\"version\":\"2.0.3\",\"options\":[' || "
        f"(CASE WHEN k % 14 = 0 THEN '\"stray\",' ELSE '' END) || "
        f"(CASE WHEN k % 10 = 0 THEN '{{\"exploitation\":\"none\"}},' ELSE '' END) || "
        f"'{{\"exploitation\":\"' || exploitation || '\"}},{{\"automatable\":\"' || {automatable} || "
        f"'\"}},{{\"technicalImpact\":\"' || impact || '\"}}]}}}}],' END)"
    )
    english = "'{{\"lang\":\"en\",\"value\":\"' || {0} || '\"}}'"
    weaknesses = (
        "(CASE WHEN k % 11 = 0 THEN '' ELSE '{\"type\":\"Primary\",\"description\":[' || "
        + english.format("cwe_a")
        + " || ',{\"lang\":\"fr\",\"value\":\"CWE-0\"}]}' || (CASE WHEN k % 3 = 0 THEN ',{\"type\":\"Secondary\",\"description\":[' || "
        + english.format("cwe_b")
        + " || ']}' ELSE '' END) END)"
    )
    matches = repeated(
        "k % 4", 3, lambda i: f"('{{\"vulnerable\":true,\"criteria\":\"' || {product_name(i)} || '\"}}')"
    )
    configurations = (
        f"(CASE WHEN k % 4 = 0 THEN '' ELSE '{{\"nodes\":[{{\"cpeMatch\":[' || {matches} || "
        "',{\"vulnerable\":false,\"criteria\":\"cpe:skip\"}]}]}' END)"
    )
    references = repeated("k % 13", 12, lambda i: f"('{{\"url\":\"' || {reference_url(i)} || '\"}}')")
    affected = repeated(
        "k % 7",
        6,
        lambda i: (
            f"('{{\"vendor\":\" ' || vendor || '\",\"product\":\"' || "
            f"{pick(f'(k + {i}) % 4', ('alpha', ' ', 'beta ', 'alpha'))} || '\"}}')"
        ),
    )
    status = pick("k % 4", ("Analyzed", "Modified", "Rejected", "Awaiting Analysis"))
    return (
        f"'{{\"id\":\"' || cve_id || '\",\"published\":\"' || d || clock || '\",\"lastModified\":\"' || "
        f"modified || clock || '\",\"vulnStatus\":\"' || {status} || "
        f"'\",\"descriptions\":[{{\"lang\":\"es\",\"value\":\"texto ' || k || '\"}},{{\"lang\":\"en\",\"value\":\"' || "
        f"prose || '\"}}],\"metrics\":{{' || {v31_block} || {v2_block} || {ssvc_block} || "
        f"'\"other\":[]}},\"weaknesses\":[' || {weaknesses} || '],\"configurations\":[' || {configurations} || "
        f"'],\"references\":[' || {references} || '],\"affected\":[{{\"source\":\"cna\",\"affectedData\":[' || "
        f"{affected} || ']}}]}}'"
    )


def raw_columns() -> list[str]:
    return ["cve_id", "k", f"{raw_json()} AS raw_json"]


# -- weakness definitions: the named ids plus one definition per document ---------------

def weakness_values() -> str:
    return ", ".join(f"('{i}', '{n}', '{a}')" for i, (n, a) in WEAKNESS_NAMES.items())


WEAKNESS_URL = "'https://cwe.mitre.org/data/definitions/' || substring(cwe_id, 5) || '.html'"
DOCUMENT_WEAKNESS = [
    "'CWE-' || (doc_id + 10000) AS cwe_id",
    "lang || ' entry from ' || source AS name",
    f"{pick('doc_id % 4', ('Pillar', 'Class', 'Base', 'Variant'))} AS abstraction",
    "text AS description",
]


# -- Spark side -------------------------------------------------------------------------

@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Handle on a source table; footers are read for the schema once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*BASE)


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(IN_NVD).selectExpr(*DETAIL).selectExpr(*MORE_DETAIL)


def nvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(spark, sf_dir).selectExpr(*nvd_columns(SPARK))


def kev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(IN_KEV).selectExpr(*kev_columns(SPARK))


def publication(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    rows = IN_FIRST_PUBLICATION if number == 1 else IN_SECOND_PUBLICATION
    return base(spark, sf_dir).where(rows).selectExpr(*publication_columns(number))


def epss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(IN_FIRST_PUBLICATION).selectExpr(*epss_columns())


def cwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.sql(
        f"SELECT *, CAST(NULL AS STRING) AS description FROM VALUES {weakness_values()} AS t(cwe_id, name, abstraction)"
    )
    written = table(spark, sf_dir, "documents").selectExpr(*DOCUMENT_WEAKNESS)
    return named.unionByName(written).withColumn("url", F.expr(WEAKNESS_URL))


def tasks_for(frame: DataFrame) -> int:
    """As many tasks as there are cores, and more for many rows, so that none grows with the table."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(frame.count() / ROWS_A_TASK))


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the files are too few to occupy them or hold too many rows."""
    tasks = tasks_for(frame)
    return frame.repartition(tasks) if frame.rdd.getNumPartitions() < tasks else frame


# A lambda keeps the text out of whole-stage code, which would make one method of it, too long for
# the JVM to compile; outside, Spark splits it.
RAW_COLUMNS = [f"transform(array({raw_json()}), text -> text)[0] AS raw_json" if c.endswith(" AS raw_json") else c for c in raw_columns()]


def raw(spark: SparkSession, sf_dir: str, paged: int | None = None) -> DataFrame:
    """Records as JSON text; writing and parsing them is most of the work of their queries.

    With ``paged`` the rows of a page, a block of so many keys, are in one task, and ``page`` is its
    number: the keys move before the texts are made, which are many times longer.
    """
    keys = base(spark, sf_dir).where(IN_NVD)
    if paged:
        rows = keys.withColumn("page", F.floor(F.col("k") / paged).cast("bigint")).repartition(tasks_for(keys), "page")
    else:
        rows = spread(keys)
    return rows.selectExpr(*DETAIL).selectExpr(*MORE_DETAIL).selectExpr(*RAW_COLUMNS, *(["page"] if paged else []))


# The moments a record carries, on the clock it is written with.
FEED_MOMENTS = [
    "CAST((d || substring(clock, 1, 9)) AS {0}) AS published_at",
    "CAST((modified || substring(clock, 1, 9)) AS {0}) AS modified_at",
]


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shaped rows with their moments, as a landed feed holds them."""
    moments = [m.format("TIMESTAMP_NTZ") for m in FEED_MOMENTS]
    return detailed(spark, sf_dir).selectExpr(
        *nvd_columns(SPARK), *moments, "CAST(NULL AS ARRAY<FLOAT>) AS embedding"
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(
        kev=kev(spark, sf_dir), nvd=nvd(spark, sf_dir), epss=epss(spark, sf_dir), cwe=cwe(spark, sf_dir)
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS user_identifier",
        "ts",
        "event_id",
        "CAST(floor(value * 10) AS BIGINT) AS input_tokens",
        "event_id % 500 AS output_tokens",
    )


def vectors(spark: SparkSession, sf_dir: str, listed: bool) -> DataFrame:
    """One of the two searched tables: label parity splits ``embeddings`` between them."""
    return table(spark, sf_dir, "embeddings").where(F.col("label") % 2 == (0 if listed else 1)).select(
        F.col("vec_id"),
        F.concat(F.lit("vector "), F.col("vec_id")).alias("content"),
        F.col("embedding"),
        F.col("label"),
    )

