"""Record shaping on the documented edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from cvegrid.functions import shaping


def parsed(spark, *records):
    frame = spark.createDataFrame([(json.dumps(r),) for r in records], "raw_json string")
    return frame.withColumn("parsed", shaping.parse_record(F.col("raw_json")))


def fields(spark, record, build):
    made = build(F.col("parsed"))
    columns = [c.alias(n) for n, c in made.items()] if isinstance(made, dict) else [made.alias("value")]
    return parsed(spark, record).select(*columns).first()


def ssvc(options, **data):
    return {"id": "CVE-1", "metrics": {"ssvcV203": [{"ssvcData": {"version": "2.0.3", "options": options, **data}}]}}


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ([{"exploitation": "active"}, {"automatable": "yes"}, {"technicalImpact": "total"}], ("active", "yes", "total", None)),
        ([{"automatable": "rapid"}], (None, "yes", None, None)),
        ([{"automatable": "slow"}], (None, "no", None, None)),
        ([{"automatable": "sometimes"}], (None, "sometimes", None, None)),
        ([{"exploitation": "poc"}, {"decision": "Act"}], ("poc", None, None, "Act")),
        (["stray", 5, None, ["x"], {"exploitation": "none"}], ("none", None, None, None)),
        ([{"exploitation": "none"}, {"exploitation": "active"}], ("active", None, None, None)),
        ([{"exploitation": "none"}, {"exploitation": None}], (None, None, None, None)),
        ([], (None, None, None, None)),
    ],
)
def test_ssvc_factors(spark, options, expected):
    row = fields(spark, ssvc(options), shaping.ssvc_factors)
    assert tuple(row) == (*expected, "2.0.3")


@pytest.mark.parametrize("metrics", [{}, {"ssvcV203": []}, {"ssvcV203": [{"source": "x"}]}])
def test_ssvc_absent(spark, metrics):
    assert tuple(fields(spark, {"id": "CVE-1", "metrics": metrics}, shaping.ssvc_factors)) == (None,) * 5


def test_first_cvss_entry_wins_even_when_empty(spark):
    full = {"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL", "vectorString": "V"}}
    assert tuple(fields(spark, {"metrics": {"cvssMetricV31": [{}, full]}}, shaping.cvss_v31)) == (None, None, None)
    row = fields(spark, {"metrics": {"cvssMetricV31": [full, {}]}}, shaping.cvss_v31)
    assert (str(row[0]), row[1], row[2]) == ("9.8", "CRITICAL", "V")
    v2 = {"metrics": {"cvssMetricV2": [{"baseSeverity": "HIGH", "cvssData": {"baseScore": 7.5, "baseSeverity": "x"}}]}}
    row = fields(spark, v2, shaping.cvss_v2)
    assert (str(row[0]), row[1]) == ("7.5", "HIGH")


def test_lists(spark):
    record = {
        "weaknesses": [
            {"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "es", "value": "CWE-1"}]},
            {"description": [{"lang": "en", "value": "CWE-79"}]},
            {},
        ],
        "configurations": [
            {"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "a"}, {"vulnerable": False, "criteria": "b"}]}]},
            {"nodes": [{}, {"cpeMatch": [{"vulnerable": True}]}]},
        ],
        "references": [{"url": f"u{i}"} for i in range(11)] + [{}],
        "affected": [
            {"affectedData": [{"vendor": " Acme ", "product": "Box"}, {"vendor": "Acme", "product": "Box"}]},
            {"affectedData": [{"vendor": "Solo"}, {"product": "Thing"}, {"vendor": " ", "product": None}, {"vendor": "Acme", "product": "Box"}]},
        ],
    }
    assert fields(spark, record, shaping.extract_cwes).value == ["CWE-79", "CWE-79"]
    assert fields(spark, record, shaping.affected_products).value == ["a", ""]
    assert fields(spark, record, shaping.affected_names).value == ["Acme Box", "Solo", "Thing"]
    assert fields(spark, record, shaping.reference_urls).value == [f"u{i}" for i in range(10)]
    assert fields(spark, {"references": [{}]}, shaping.reference_urls).value == [""]
    for build in (shaping.extract_cwes, shaping.affected_products, shaping.affected_names, shaping.reference_urls):
        assert fields(spark, {"id": "x"}, build).value == []


def test_description(spark):
    texts = [{"lang": "es", "value": "no"}, {"lang": "en", "value": "first"}, {"lang": "en", "value": "second"}]
    assert fields(spark, {"descriptions": texts}, shaping.english_description).value == "first"
    assert fields(spark, {"descriptions": [{"lang": "en"}]}, shaping.english_description).value == ""
    assert fields(spark, {}, shaping.english_description).value == ""


@pytest.mark.parametrize(
    ("text", "day"),
    [("2024-01-01T23:30:00.000-08:00", "2024-01-01"), ("2024-02-29T00:15:00Z", "2024-02-29"), ("2024-03-01", "2024-03-01"),
     ("", None), (None, None)],
)
def test_iso_date_keeps_the_written_day(spark, text, day):
    for zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            frame = spark.createDataFrame([(text,)], "t string")
            found = frame.select(shaping.iso_date(F.col("t")).cast("string")).first()[0]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert found == day


def test_iso_date_fails_on_junk(spark):
    for junk in ("soon", "2024-01-01junk", "2024-02-30"):
        frame = spark.createDataFrame([(junk,)], "t string")
        with pytest.raises(Exception, match="not an ISO-8601 date"):
            frame.select(shaping.iso_date(F.col("t"))).collect()


def test_content_lines(spark):
    record = {
        "id": "CVE-2024-1",
        "descriptions": [{"lang": "en", "value": "Bad\nthing"}],
        "metrics": {
            "cvssMetricV31": [{"cvssData": {"baseScore": 10.0, "vectorString": "CVSS:3.1/X"}}],
            **ssvc([{"exploitation": "active"}, {"technicalImpact": "total"}])["metrics"],
        },
        "weaknesses": [{"description": [{"lang": "en", "value": "CWE-1"}, {"lang": "en", "value": "CWE-2"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": f"p{i}"} for i in range(6)]}]}],
        "affected": [{"affectedData": [{"vendor": "Acme", "product": "Box"}]}],
    }
    rows = shaping.vuln_content(parsed(spark, record, {"id": "CVE-2024-2"})).collect()
    assert rows[0].content == (
        "CVE ID: CVE-2024-1\nDescription: Bad\nthing\nCVSS v3.1 Score: 10.0 (None)\nCVSS Vector: CVSS:3.1/X\n"
        "CWEs: CWE-1, CWE-2\nAffected Products: p0, p1, p2, p3, p4\n"
        "SSVC: exploitation=active, technicalImpact=total\nAffected: Acme Box"
    )
    assert rows[1].content == "CVE ID: CVE-2024-2\nDescription: "


def test_exploited_rows(spark, tmp_path):
    from cvegrid.sources.feeds import read_exploited_catalog

    feed = {
        "title": "t",
        "vulnerabilities": [
            {"cveID": "CVE-1"},
            {"cveID": "CVE-2", "vendorProject": "V", "product": "P", "vulnerabilityName": "N", "shortDescription": "S",
             "requiredAction": "R", "dateAdded": "2024-01-02", "dueDate": "2024-01-23",
             "knownRansomwareCampaignUse": "Known", "notes": "see", "cwes": ["CWE-1", "CWE-2"]},
        ],
    }
    (tmp_path / "kev.json").write_text(json.dumps(feed, indent=1))
    entries = read_exploited_catalog(spark, str(tmp_path / "kev.json"))
    first, second = shaping.exploited_row(entries).orderBy("cve_id").collect()
    assert first.cwes == [] and first.date_added is None
    assert first.content.splitlines()[0] == "CVE ID: CVE-1" and len(first.content.splitlines()) == 9
    assert str(second.due_date) == "2024-01-23"
    assert second.content.endswith("Known Ransomware Campaign Use: Known\nNotes: see\nCWEs: CWE-1, CWE-2")


def test_dedupe_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2), ("a", None, 3)], "k string, v int, p long")
    found = {r.k: r.v for r in shaping.dedupe_last_wins(rows, ["k"], "p").collect()}
    assert found == {"a": None, "b": 2}


def test_ssvc_backfill_touches_only_rows_with_the_block(spark):
    stored = parsed(spark, ssvc([{"exploitation": "poc"}]), {"id": "CVE-2"}).select(
        F.get_json_object("raw_json", "$.id").alias("cve_id"), "raw_json", F.lit("old").alias("ssvc_exploitation")
    )
    once = shaping.ssvc_backfill(stored)
    assert {r.cve_id: r.ssvc_exploitation for r in once.collect()} == {"CVE-1": "poc", "CVE-2": "old"}
    assert sorted(map(str, shaping.ssvc_backfill(once).collect())) == sorted(map(str, once.collect()))
