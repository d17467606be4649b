"""Explicit schemas: stored tables, feed envelopes and the raw record."""

from __future__ import annotations

# Column names and types of the stored tables.
KEV = """
    cve_id string, vendor_project string, product string, vulnerability_name string,
    short_description string, required_action string, notes string, date_added date,
    due_date date, known_ransomware_campaign_use string, cwes array<string>,
    content string, embedding array<float>
"""

NVD = """
    cve_id string, description string, cvss_v31_score decimal(3,1), cvss_v31_severity string,
    cvss_v31_vector string, cvss_v2_score decimal(3,1), cvss_v2_severity string,
    cwes array<string>, affected_products array<string>, reference_urls array<string>,
    published date, last_modified date, ssvc_exploitation string, ssvc_automatable string,
    ssvc_technical_impact string, ssvc_decision string, ssvc_version string,
    raw_json string, content string, embedding array<float>
"""

# What a load stores besides the reference columns, so that filters on them never parse JSON.
STORED_NVD = f"{NVD}, status string, has_ssvc boolean, modified_at timestamp"
NVD_WIDE = ["raw_json", "content", "embedding"]

EPSS = """
    cve_id string, probability decimal(6,5), percentile decimal(6,5), scored_at date,
    model_version string, previous_probability decimal(6,5), previous_scored_at date
"""

CWE = "cwe_id string, name string, abstraction string, description string, url string"

STEP = "struct<label:string,ok:boolean,elapsed:double,summary:string,metrics:map<string,bigint>,error:string>"
# Seconds in cents: wide enough for a run of any length, which eight places are not.
RUN_SECONDS = "decimal(22,2)"
RUNS = f"run_at timestamp, status string, total_elapsed {RUN_SECONDS}, results array<{STEP}>"

USAGE = "user_identifier string, query_date date, query_count bigint, input_tokens bigint, output_tokens bigint"

# Field names of the upstream feeds.
KEV_ENTRY = (
    "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,"
    "shortDescription:string,requiredAction:string,notes:string,dateAdded:string,"
    "dueDate:string,knownRansomwareCampaignUse:string,cwes:array<string>>"
)
KEV_FEED = f"vulnerabilities array<{KEV_ENTRY}>"

# A page keeps each record as text, so the stored JSON is the text that arrived.
NVD_PAGE = "vulnerabilities array<struct<cve:string>>"

# All that the SSVC factors need of a record.
SSVC_RECORD = "metrics struct<ssvcV203:array<struct<ssvcData:struct<version:string,options:array<string>>>>>"

# ``options`` stays an array of JSON texts: one element that is not an object would
# otherwise turn the whole list into NULL.  Scores stay text to print as written.
RECORD = """
    id string, published string, lastModified string, vulnStatus string,
    descriptions array<struct<lang:string,value:string>>,
    metrics struct<
        cvssMetricV31:array<struct<cvssData:struct<baseScore:string,baseSeverity:string,vectorString:string>>>,
        cvssMetricV2:array<struct<baseSeverity:string,cvssData:struct<baseScore:string>>>,
        ssvcV203:array<struct<ssvcData:struct<version:string,options:array<string>>>>>,
    weaknesses array<struct<description:array<struct<lang:string,value:string>>>>,
    configurations array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,
    references array<struct<url:string>>,
    affected array<struct<affectedData:array<struct<vendor:string,product:string>>>>
"""
