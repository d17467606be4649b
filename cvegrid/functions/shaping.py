"""Raw feed records to stored columns, all as Column expressions.

The record functions take the struct column parsed with ``schemas.RECORD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvegrid import schemas
from cvegrid.functions.text import strip, stripped_or_null

# Old words of one SSVC factor and their present form.
LEGACY_AUTOMATABLE = {"slow": "no", "rapid": "yes"}

MAX_REFERENCES = 10
CONTENT_ITEMS = 5


def parse_record(raw_json: Column, schema: str = schemas.RECORD) -> Column:
    return F.from_json(raw_json, schema)


def _nested(rows: Column, field: str) -> Column:
    """One list out of a list of structs that each hold a list."""
    lists = F.transform(rows, lambda row: row[field])
    return F.flatten(F.filter(lists, lambda inner: inner.isNotNull()))


def _or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def cvss_v31(record: Column) -> dict[str, Column]:
    """Score, severity and vector of the first v3.1 entry, even when that one is empty."""
    first = F.get(record["metrics"]["cvssMetricV31"], F.lit(0))["cvssData"]
    return {
        "cvss_v31_score": first["baseScore"].cast("decimal(3,1)"),
        "cvss_v31_severity": first["baseSeverity"],
        "cvss_v31_vector": first["vectorString"],
    }


def cvss_v2(record: Column) -> dict[str, Column]:
    """Score of the first v2 entry; the severity sits on the entry, not in its data."""
    first = F.get(record["metrics"]["cvssMetricV2"], F.lit(0))
    return {
        "cvss_v2_score": first["cvssData"]["baseScore"].cast("decimal(3,1)"),
        "cvss_v2_severity": first["baseSeverity"],
    }


def normalize_automatable(value: Column) -> Column:
    expression = value
    for old, new in LEGACY_AUTOMATABLE.items():
        expression = F.when(value == old, new).otherwise(expression)
    return expression


def _ssvc_data(record: Column) -> Column:
    return F.get(record["metrics"]["ssvcV203"], F.lit(0))["ssvcData"]


def ssvc_options(record: Column) -> Column:
    """Options of the first SSVC block as maps, parsed together; non-objects are left out."""
    objects = F.filter(_ssvc_data(record)["options"], lambda text: F.ltrim(text).startswith("{"))
    return F.from_json(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")), "array<map<string,string>>")


def _factors(options: Column, version: Column) -> dict[str, Column]:
    def factor(key: str) -> Column:
        holders = F.filter(options, lambda option: F.map_contains_key(option, key))
        return F.try_element_at(F.try_element_at(holders, F.lit(-1)), F.lit(key))

    return {
        "ssvc_exploitation": factor("exploitation"),
        "ssvc_automatable": normalize_automatable(factor("automatable")),
        "ssvc_technical_impact": factor("technicalImpact"),
        "ssvc_decision": factor("decision"),
        "ssvc_version": version,
    }


def ssvc_factors(record: Column, options: Column | None = None) -> dict[str, Column]:
    """Factors of the first SSVC block; a repeated key keeps its last value.

    ``options`` is a column that holds ``ssvc_options``; without it each factor parses them anew.
    """
    return _factors(ssvc_options(record) if options is None else options, _ssvc_data(record)["version"])


def extract_cwes(record: Column) -> Column:
    """English weakness ids in order, repeats kept."""
    english = F.filter(_nested(record["weaknesses"], "description"), lambda d: d["lang"] == "en")
    return _or_empty(F.transform(english, lambda d: d["value"]))


def affected_products(record: Column) -> Column:
    """Criteria of every match marked vulnerable."""
    matches = _nested(_nested(record["configurations"], "nodes"), "cpeMatch")
    vulnerable = F.filter(matches, lambda match: match["vulnerable"])
    return _or_empty(F.transform(vulnerable, lambda match: F.coalesce(match["criteria"], F.lit(""))))


def affected_names(record: Column) -> Column:
    """Distinct "vendor product" names in first-seen order."""
    items = _nested(record["affected"], "affectedData")
    names = F.transform(
        items,
        lambda item: F.concat_ws(" ", stripped_or_null(item["vendor"]), stripped_or_null(item["product"])),
    )
    return _or_empty(F.array_distinct(F.filter(names, lambda name: name != "")))


def english_description(record: Column) -> Column:
    english = F.filter(record["descriptions"], lambda d: d["lang"] == "en")
    return F.coalesce(F.get(english, F.lit(0))["value"], F.lit(""))


def reference_urls(record: Column) -> Column:
    first = F.slice(record["references"], 1, MAX_REFERENCES)
    return _or_empty(F.transform(first, lambda ref: F.coalesce(ref["url"], F.lit(""))))


def iso_date(text: Column) -> Column:
    """The calendar day as written, whatever offset follows; blank is NULL, junk fails."""
    written = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})($|[T ]\d{2}:\d{2}.*$)", 1)
    day = F.try_to_date(written, "yyyy-MM-dd")
    failure = F.raise_error(F.concat(F.lit("not an ISO-8601 date: "), text)).cast("date")
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(day, failure))


def _extracted(records: DataFrame, keep: list[str]) -> DataFrame:
    """Every fact of the ``parsed`` record as a column of its own.

    Facts used more than once are columns before they are used, so each JSON text and list
    is walked once per record.
    """
    record = F.col("parsed")
    score = F.get(record["metrics"]["cvssMetricV31"], F.lit(0))["cvssData"]
    facts = {
        "cve_id": record["id"],
        "description": english_description(record),
        "_score_text": score["baseScore"],
        **cvss_v31(record),
        **cvss_v2(record),
        "cwes": extract_cwes(record),
        "affected_products": affected_products(record),
        "_names": affected_names(record),
        "reference_urls": reference_urls(record),
        "published": iso_date(record["published"]),
        "last_modified": iso_date(record["lastModified"]),
        "_options": ssvc_options(record),
        "_version": _ssvc_data(record)["version"],
    }
    staged = records.select(*keep, *[column.alias(name) for name, column in facts.items()])
    factors = _factors(F.col("_options"), F.col("_version"))
    return staged.select("*", *[column.alias(name) for name, column in factors.items()])


def _content() -> Column:
    """The document text from the extracted columns."""
    labels = (
        ("exploitation", "ssvc_exploitation"),
        ("automatable", "ssvc_automatable"),
        ("technicalImpact", "ssvc_technical_impact"),
        ("decision", "ssvc_decision"),
    )
    urgency = F.concat_ws(
        ", ", *[F.when(F.col(name) != "", F.concat(F.lit(f"{label}="), F.col(name))) for label, name in labels]
    )

    def listed(prefix: str, name: str, most: int | None = None) -> Column:
        shown = F.slice(name, 1, most) if most else F.col(name)
        return F.when(F.size(name) > 0, F.concat(F.lit(prefix), F.array_join(shown, ", ")))

    severity = F.coalesce("cvss_v31_severity", F.lit("None"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CVE ID: "), F.coalesce("cve_id", F.lit(""))),
        F.concat(F.lit("Description: "), F.col("description")),
        F.when(
            F.col("_score_text").isNotNull(),
            F.concat(F.lit("CVSS v3.1 Score: "), F.col("_score_text"), F.lit(" ("), severity, F.lit(")")),
        ),
        F.when(F.col("cvss_v31_vector") != "", F.concat(F.lit("CVSS Vector: "), F.col("cvss_v31_vector"))),
        listed("CWEs: ", "cwes"),
        listed("Affected Products: ", "affected_products", CONTENT_ITEMS),
        F.when(urgency != "", F.concat(F.lit("SSVC: "), urgency)),
        listed("Affected: ", "_names", CONTENT_ITEMS),
    )


def vuln_content(records: DataFrame) -> DataFrame:
    """The searchable document of each parsed record; absent facts leave no line."""
    return _extracted(records, []).select("cve_id", _content().alias("content"))


def vuln_row(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Stored vulnerability row from ``raw_json`` and its ``parsed`` struct; no vector yet.

    ``keep`` names further input columns to carry along.
    """
    kept = keep or []
    return _extracted(records, ["raw_json", *kept]).select(
        "cve_id", "description", "cvss_v31_score", "cvss_v31_severity", "cvss_v31_vector",
        "cvss_v2_score", "cvss_v2_severity", "cwes", "affected_products", "reference_urls",
        "published", "last_modified", "ssvc_exploitation", "ssvc_automatable",
        "ssvc_technical_impact", "ssvc_decision", "ssvc_version", "raw_json",
        _content().alias("content"), F.lit(None).cast("array<float>").alias("embedding"), *kept,
    )


def moment(text: Column) -> Column:
    """The instant of an ISO-8601 text; without an offset it is UTC, junk is NULL."""
    zoned = F.when(text.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def stored_row(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``vuln_row`` with the columns that a load adds to it, taken from the record once.

    ``status`` and ``has_ssvc`` answer the usual JSON filters, ``modified_at`` orders revisions of
    one day.
    """
    record = F.col("parsed")
    added = {
        "status": record["vulnStatus"],
        "has_ssvc": record["metrics"]["ssvcV203"].isNotNull(),
        "modified_at": moment(record["lastModified"]),
    }
    kept = [*added, *(keep or [])]
    return vuln_row(records.withColumns(added), kept)


def ssvc_backfill(vulns: DataFrame) -> DataFrame:
    """Recompute the five SSVC columns from the stored JSON of rows that hold the block."""
    record = F.col("_record")
    staged = vulns.withColumn("_record", F.from_json("raw_json", schemas.SSVC_RECORD)).withColumns(
        {
            "_held": record["metrics"]["ssvcV203"].isNotNull(),
            "_options": ssvc_options(record),
            "_version": _ssvc_data(record)["version"],
        }
    )
    kept = {
        name: F.when(F.col("_held"), column).otherwise(F.col(name) if name in vulns.columns else F.lit(None))
        for name, column in _factors(F.col("_options"), F.col("_version")).items()
    }
    return staged.withColumns(kept).drop("_record", "_held", "_options", "_version")


def exploited_content(entry: Column | None = None) -> Column:
    """The searchable document of a catalog entry: nine fixed lines, two optional ones."""

    def field(name: str) -> Column:
        return F.col(name) if entry is None else entry[name]

    # The labels, in this order.
    lines = (
        ("CVE ID", "cveID"),
        ("Vendor/Project", "vendorProject"),
        ("Product", "product"),
        ("Vulnerability Name", "vulnerabilityName"),
        ("Description", "shortDescription"),
        ("Required Action", "requiredAction"),
        ("Date Added", "dateAdded"),
        ("Due Date", "dueDate"),
        ("Known Ransomware Campaign Use", "knownRansomwareCampaignUse"),
    )
    always = [F.concat(F.lit(f"{label}: "), F.coalesce(field(name), F.lit(""))) for label, name in lines]
    notes = F.when(field("notes") != "", F.concat(F.lit("Notes: "), field("notes")))
    cwes = F.when(F.size(field("cwes")) > 0, F.concat(F.lit("CWEs: "), F.array_join(field("cwes"), ", ")))
    return F.concat_ws("\n", *always, notes, cwes)


def exploited_row(entries: DataFrame) -> DataFrame:
    """Stored catalog row from a feed entry; a missing weakness list becomes empty."""
    return entries.select(
        F.col("cveID").alias("cve_id"),
        F.col("vendorProject").alias("vendor_project"),
        "product",
        F.col("vulnerabilityName").alias("vulnerability_name"),
        F.col("shortDescription").alias("short_description"),
        F.col("requiredAction").alias("required_action"),
        "notes",
        iso_date(F.col("dateAdded")).alias("date_added"),
        iso_date(F.col("dueDate")).alias("due_date"),
        F.col("knownRansomwareCampaignUse").alias("known_ransomware_campaign_use"),
        _or_empty(F.col("cwes")).alias("cwes"),
        exploited_content().alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


# -- score feed rows ---------------------------------------------------------------------

def typed_scores(rows: DataFrame) -> DataFrame:
    """Text columns ``cve, epss, percentile`` to typed ones; unusable values become NULL."""
    return rows.withColumns(
        {
            "cve_id": stripped_or_null(F.col("cve")),
            "probability": strip(F.col("epss")).try_cast("decimal(6,5)"),
            "percentile": strip(F.col("percentile")).try_cast("decimal(6,5)"),
        }
    )


def _usable() -> Column:
    return F.col("cve_id").isNotNull() & F.col("probability").isNotNull() & F.col("percentile").isNotNull()


def skip_malformed_scores(rows: DataFrame) -> DataFrame:
    """Typed rows with an id and both numbers."""
    return typed_scores(rows).where(_usable())


def count_malformed_scores(rows: DataFrame) -> DataFrame:
    """How many rows were kept and skipped, in one aggregate."""
    return typed_scores(rows).agg(F.count_if(_usable()).alias("kept"), F.count_if(~_usable()).alias("skipped"))


def dedupe_last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row per key in file order.

    ``max_by`` over a struct keeps one candidate per key and task before the shuffle, so a
    key repeated through a third of the file still sends a handful of rows.
    """
    values = [c for c in rows.columns if c not in keys and c != position]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(position)).alias("_row"))
    return last.select(*keys, "_row.*").select(*[c for c in rows.columns if c != position])
