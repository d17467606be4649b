"""SQL side of the derived corpus: the relations the oracle queries select from."""

from __future__ import annotations

import re

from checks import corpus
from checks.corpus import DUCKDB

# Fixed values of the model, spelt out again so that the SQL does not depend on the package.
CLASS_VALUES = """
    ('CWE-787', 1.0), ('CWE-119', 1.0), ('CWE-125', 1.0), ('CWE-416', 1.0), ('CWE-120', 1.0),
    ('CWE-121', 1.0), ('CWE-122', 1.0), ('CWE-190', 1.0), ('CWE-89', 1.0), ('CWE-78', 1.0),
    ('CWE-94', 1.0), ('CWE-74', 1.0), ('CWE-434', 1.0), ('CWE-77', 1.0), ('CWE-502', 1.0),
    ('CWE-22', 0.8), ('CWE-862', 0.8), ('CWE-284', 0.8), ('CWE-863', 0.8), ('CWE-269', 0.8),
    ('CWE-59', 0.8), ('CWE-287', 0.8), ('CWE-306', 0.8), ('CWE-288', 0.8), ('CWE-352', 0.6),
    ('CWE-918', 0.6), ('CWE-79', 0.6), ('CWE-200', 0.4), ('CWE-203', 0.4), ('CWE-400', 0.3),
    ('CWE-476', 0.3)
"""

CLASS_LABEL = """CASE
    WHEN {0} IN ('CWE-787','CWE-119','CWE-125','CWE-416','CWE-120','CWE-121','CWE-122','CWE-190') THEN 'Memory corruption'
    WHEN {0} IN ('CWE-89','CWE-78','CWE-94','CWE-74','CWE-434','CWE-77','CWE-502') THEN 'Injection / code execution'
    WHEN {0} IN ('CWE-22','CWE-862','CWE-284','CWE-863','CWE-269','CWE-59') THEN 'Access control / traversal'
    WHEN {0} IN ('CWE-287','CWE-306','CWE-288') THEN 'Authentication bypass'
    WHEN {0} IN ('CWE-352','CWE-918','CWE-79') THEN 'Request forgery / XSS'
    WHEN {0} IN ('CWE-200','CWE-203') THEN 'Information disclosure'
    WHEN {0} IN ('CWE-400','CWE-476') THEN 'DoS / resource exhaustion'
    ELSE 'Weakness' END"""

BAND = """CASE WHEN {0} >= 65 THEN 'critical' WHEN {0} >= 45 THEN 'high'
    WHEN {0} >= 25 THEN 'moderate' ELSE 'low' END"""


def _select(columns: list[str], where: str) -> str:
    return f"SELECT {', '.join(columns)} FROM base WHERE {where}"


RECORD_SHAPE = """{"id":"VARCHAR","published":"VARCHAR","lastModified":"VARCHAR","vulnStatus":"VARCHAR",
 "descriptions":[{"lang":"VARCHAR","value":"VARCHAR"}],
 "metrics":{
  "cvssMetricV31":[{"cvssData":{"baseScore":"VARCHAR","baseSeverity":"VARCHAR","vectorString":"VARCHAR"}}],
  "cvssMetricV2":[{"baseSeverity":"VARCHAR","cvssData":{"baseScore":"VARCHAR"}}],
  "ssvcV203":[{"ssvcData":{"version":"VARCHAR","options":"JSON"}}]},
 "weaknesses":[{"description":[{"lang":"VARCHAR","value":"VARCHAR"}]}],
 "configurations":[{"nodes":[{"cpeMatch":[{"vulnerable":"BOOLEAN","criteria":"VARCHAR"}]}]}],
 "references":[{"url":"VARCHAR"}],
 "affected":[{"affectedData":[{"vendor":"VARCHAR","product":"VARCHAR"}]}]}"""


def _factor(key: str) -> str:
    return f"json_extract_string(r.metrics.ssvcV203[1].ssvcData.options, '$[*].{key}')[-1]"


RELATIONS = {
    "base": f"SELECT {', '.join(corpus.BASE)} FROM orders",
    "detailed": f"""SELECT {', '.join(corpus.MORE_DETAIL)} FROM (
        SELECT {', '.join(corpus.DETAIL)} FROM base WHERE {corpus.IN_NVD})""",
    "nvd_vulnerabilities": f"SELECT {', '.join(corpus.nvd_columns(DUCKDB))} FROM detailed",
    "kev_vulnerabilities": _select(corpus.kev_columns(DUCKDB), corpus.IN_KEV),
    "publication_one": _select(corpus.publication_columns(1), corpus.IN_FIRST_PUBLICATION),
    "publication_two": _select(corpus.publication_columns(2), corpus.IN_SECOND_PUBLICATION),
    "epss_scores": _select(corpus.epss_columns(), corpus.IN_FIRST_PUBLICATION),
    "cwe_definitions": f"""SELECT *, {corpus.WEAKNESS_URL} AS url FROM (
        SELECT cwe_id, name, abstraction, CAST(NULL AS VARCHAR) AS description
        FROM (VALUES {corpus.weakness_values()}) t(cwe_id, name, abstraction)
        UNION ALL SELECT {', '.join(corpus.DOCUMENT_WEAKNESS)} FROM documents)""",
    "raw_records": f"SELECT {', '.join(corpus.raw_columns())} FROM detailed",
    "universe": """SELECT cve_id FROM nvd_vulnerabilities UNION SELECT cve_id FROM kev_vulnerabilities""",
    "cwe_class": f"SELECT * FROM (VALUES {CLASS_VALUES}) t(cwe_id, severity)",
    # One row per id of either catalog, from the three tables laid under each other.
    "signals": """SELECT cve_id, bool_or(rated IS TRUE) AS rated, bool_or(listed IS TRUE) AS kev_listed,
        max(cvss_v31_score) AS v31, max(cvss_v2_score) AS v2, max(ssvc_exploitation) AS ssvc_exploitation,
        max(ssvc_automatable) AS ssvc_automatable, max(ssvc_technical_impact) AS ssvc_technical_impact,
        max(date_added) AS kev_date_added, max(known_ransomware_campaign_use) AS known_ransomware_campaign_use,
        max(probability) AS epss_probability, max(percentile) AS epss_percentile,
        max(previous_probability) AS epss_previous_probability, max(previous_scored_at) AS epss_previous_scored_at,
        max(scored_at) AS epss_scored_at, flatten(list(cwes) FILTER (cwes IS NOT NULL)) AS cwes
        FROM (SELECT cve_id, true AS rated, cvss_v31_score, cvss_v2_score, ssvc_exploitation, ssvc_automatable,
                ssvc_technical_impact, cwes FROM nvd_vulnerabilities
            UNION ALL BY NAME SELECT cve_id, true AS listed, date_added, known_ransomware_campaign_use, cwes
                FROM kev_vulnerabilities
            UNION ALL BY NAME SELECT cve_id, probability, percentile, previous_probability, previous_scored_at, scored_at
                FROM epss_scores)
        GROUP BY cve_id HAVING bool_or(rated IS TRUE) OR bool_or(listed IS TRUE)""",
    # The rated ids in order of severity and id; the first one that a row has is its worst.
    "ranking": "SELECT list(cwe_id ORDER BY severity DESC, cwe_id) AS ranked FROM cwe_class",
    "worst": """SELECT s.*, list_filter(ranked, lambda id: list_contains(s.cwes, id))[1] AS cwe_top
        FROM signals s, ranking""",
    "components": """SELECT w.cve_id,
        CAST(round(coalesce(v31, v2, 5.0) * 0.025, 4) AS DECIMAL(6,4)) AS c_cvss,
        CAST(round(coalesce(epss_probability, 0) * CAST(0.30 AS DECIMAL(3,2)), 4) AS DECIMAL(6,4)) AS c_epss,
        CAST(if(kev_listed, 0.20, 0) AS DECIMAL(6,4)) AS c_kev,
        CAST(if(known_ransomware_campaign_use = 'Known', 0.10, 0) AS DECIMAL(6,4)) AS c_ransomware,
        CAST(if(ssvc_exploitation = 'active', 0.06, 0) + if(ssvc_automatable = 'yes', 0.02, 0)
            + if(ssvc_technical_impact = 'total', 0.02, 0) AS DECIMAL(6,4)) AS c_ssvc,
        CAST(round(coalesce(c.severity, 0.5) * 0.05, 4) AS DECIMAL(6,4)) AS c_cwe,
        coalesce(v31, v2) AS cvss_score, v31 IS NULL AND v2 IS NULL AS cvss_imputed,
        epss_probability, epss_percentile, epss_previous_probability, epss_previous_scored_at, epss_scored_at,
        kev_listed, kev_date_added, known_ransomware_campaign_use, ssvc_exploitation, ssvc_automatable,
        ssvc_technical_impact, cwe_top
        FROM worst w LEFT JOIN cwe_class c ON c.cwe_id = w.cwe_top""",
    "v_cve_risk": """SELECT *, CAST(round((c_kev + c_ransomware + c_epss + c_cvss + c_ssvc + c_cwe) * 100, 1)
        AS DECIMAL(5,1)) AS risk_score FROM components""",
    "records": f"SELECT cve_id AS key_id, k, raw_json, from_json(raw_json, '{RECORD_SHAPE}') AS r FROM raw_records",
    "shaped": f"""SELECT r.id AS cve_id, k, raw_json, r,
        CAST(r.metrics.cvssMetricV31[1].cvssData.baseScore AS DECIMAL(3,1)) AS cvss_v31_score,
        r.metrics.cvssMetricV31[1].cvssData.baseScore AS score_text,
        r.metrics.cvssMetricV31[1].cvssData.baseSeverity AS cvss_v31_severity,
        r.metrics.cvssMetricV31[1].cvssData.vectorString AS cvss_v31_vector,
        CAST(r.metrics.cvssMetricV2[1].cvssData.baseScore AS DECIMAL(3,1)) AS cvss_v2_score,
        r.metrics.cvssMetricV2[1].baseSeverity AS cvss_v2_severity,
        {_factor('exploitation')} AS ssvc_exploitation,
        CASE {_factor('automatable')} WHEN 'slow' THEN 'no' WHEN 'rapid' THEN 'yes'
             ELSE {_factor('automatable')} END AS ssvc_automatable,
        {_factor('technicalImpact')} AS ssvc_technical_impact,
        {_factor('decision')} AS ssvc_decision,
        r.metrics.ssvcV203[1].ssvcData.version AS ssvc_version,
        [d.value for d in flatten([w.description for w in r.weaknesses]) if d.lang = 'en'] AS cwes,
        [m.criteria for m in flatten([n.cpeMatch for n in flatten([c.nodes for c in r.configurations])])
            if m.vulnerable] AS affected_products,
        coalesce([d.value for d in r.descriptions if d.lang = 'en'][1], '') AS description,
        [u.url for u in list_slice(r.references, 1, 10)] AS reference_urls,
        [trim(coalesce(a.vendor, '') || ' ' || trim(coalesce(a.product, '')))
            for a in flatten([f.affectedData for f in r.affected])] AS all_names,
        CAST(substring(r.published, 1, 10) AS DATE) AS published,
        CAST(substring(r.lastModified, 1, 10) AS DATE) AS last_modified
        FROM records""",
    "named": """SELECT *, [n for n, i in all_names if n <> '' AND list_position(all_names, n) = i] AS names FROM shaped""",
    "contents": """SELECT *, concat_ws(chr(10),
        'CVE ID: ' || cve_id, 'Description: ' || description,
        'CVSS v3.1 Score: ' || score_text || ' (' || coalesce(cvss_v31_severity, 'None') || ')',
        'CVSS Vector: ' || cvss_v31_vector,
        CASE WHEN len(cwes) > 0 THEN 'CWEs: ' || array_to_string(cwes, ', ') END,
        CASE WHEN len(affected_products) > 0 THEN 'Affected Products: ' || array_to_string(affected_products[1:5], ', ') END,
        'SSVC: ' || nullif(concat_ws(', ', 'exploitation=' || ssvc_exploitation, 'automatable=' || ssvc_automatable,
            'technicalImpact=' || ssvc_technical_impact, 'decision=' || ssvc_decision), ''),
        CASE WHEN len(names) > 0 THEN 'Affected: ' || array_to_string(names[1:5], ', ') END) AS content FROM named""",
    "feed_entries": """SELECT cve_id AS "cveID", vendor_project AS "vendorProject", product,
        vulnerability_name AS "vulnerabilityName", short_description AS "shortDescription",
        required_action AS "requiredAction", notes, CAST(date_added AS VARCHAR) AS "dateAdded",
        CAST(due_date AS VARCHAR) AS "dueDate",
        known_ransomware_campaign_use AS "knownRansomwareCampaignUse", cwes FROM kev_vulnerabilities""",
    "requested_ids": """SELECT DISTINCT 'CVE-' || year(l_shipdate) || '-' || (l_orderkey + 10000) AS cve_id FROM lineitem""",
    "usage_events": """SELECT CAST(user_id AS VARCHAR) AS user_identifier, ts, event_id,
        CAST(floor(value * 10) AS BIGINT) AS input_tokens, event_id % 500 AS output_tokens FROM events""",
    "user_usage": """SELECT user_identifier, CAST(ts AS DATE) AS query_date, count(*) AS query_count,
        CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
        FROM usage_events GROUP BY 1, 2""",
    "run_parts": """SELECT CAST(ts AS DATE) AS run_at, event_type AS label, count(*) AS n,
        NOT (event_type = 'error' AND count(*) % 2 = 1) AS ok,
        CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS elapsed FROM events GROUP BY 1, 2""",
    "etl_runs": """SELECT run_at, CASE WHEN bool_and(ok) THEN 'SUCCESS' ELSE 'FAILED' END AS status,
        CAST(round(sum(elapsed), 2) AS DECIMAL(8,2)) AS total_elapsed, count(*) AS steps FROM run_parts GROUP BY 1""",
    "listed_vectors": """SELECT vec_id, 'vector ' || vec_id AS content, embedding FROM embeddings WHERE label % 2 = 0""",
    "known_vectors": """SELECT vec_id, 'vector ' || vec_id AS content, embedding FROM embeddings WHERE label % 2 = 1""",
    "distances": """SELECT vec_id, content, round(1 - list_cosine_similarity(embedding::DOUBLE[],
        (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS distance
        FROM (SELECT * FROM listed_vectors UNION ALL SELECT * FROM known_vectors)""",
    "content_rows": """SELECT doc_id, text AS content, doc_id % 3 = 0 AS missing FROM documents""",
}


def _needs(sql: str, seen: dict[str, None]) -> None:
    for name, body in RELATIONS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needs(body, seen)
            seen[name] = None


def with_relations(sql: str) -> str:
    """The query with every derived relation it mentions in front, in dependency order."""
    used: dict[str, None] = {}
    _needs(sql, used)
    if not used:
        return sql.strip()
    heads = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in used)
    return f"WITH {heads}\n{sql.strip()}"


def text(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


def number(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def joined(*names: str) -> str:
    return ", ".join(f"array_to_string({n}, '|') AS {n}" for n in names)
