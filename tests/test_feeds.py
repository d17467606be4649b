"""Readers on small landed files."""

import datetime
import gzip
import json
from decimal import Decimal as D

import pytest

from cvegrid.sources.feeds import (
    FeedError,
    read_score_feed,
    read_vuln_pages,
    read_weakness_csv,
)

LOAD_DAY = datetime.date(2035, 12, 24)
HEAD = "cve,epss,percentile"


def told(version="m-7.1", day="2034-05-06T07:08:09Z"):
    return f"#model_version:{version},score_date:{day}"


def gzipped(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    return str(folder)


def scores(spark, folder, **files):
    """Rows by id, and what the feed says of itself."""
    rows, meta = read_score_feed(spark, gzipped(folder, **files), LOAD_DAY)
    return {r.cve_id: (r.probability, r.percentile) for r in rows.collect()}, meta


# Lines of one file, the rows they give, and how many are skipped.
ONE_FILE = {
    "all columns swapped": (
        [told(), "percentile,epss,cve", "0.61,0.25,CVE-2034-77", "0.11,0.5,CVE-2034-78"],
        {"CVE-2034-77": ("0.25", "0.61"), "CVE-2034-78": ("0.5", "0.11")},
        0,
    ),
    "blanks around values, blank lines, several comments": (
        ["", told(), "  ", "# a word", HEAD, "", " CVE-2034-5 , 0.75,0.8 ", ""],
        {"CVE-2034-5": ("0.75", "0.8")},
        0,
    ),
    "no id, no number, too few fields, a comment behind the header": (
        [told(), HEAD, " ,0.2,0.3", "CVE-2034-1,none,0.3", "CVE-2034-2,0.2,", "CVE-2034-3", "#0.2", "CVE-2034-4,1,1"],
        {"CVE-2034-4": ("1", "1")},
        5,
    ),
    "an id three times": (
        [told(), HEAD, "CVE-2034-9,0.7,0.7", "CVE-2034-8,0.1,0.1", "CVE-2034-9,0.2,0.9", "CVE-2034-9,0.4,0.3"],
        {"CVE-2034-9": ("0.4", "0.3"), "CVE-2034-8": ("0.1", "0.1")},
        0,
    ),
    "a header and nothing else": ([told(), HEAD], {}, 0),
}


@pytest.mark.parametrize("case", ONE_FILE)
def test_rows_of_one_file(spark, tmp_path, case):
    lines, expected, skipped = ONE_FILE[case]
    rows, meta = scores(spark, tmp_path, only=lines)
    assert rows == {i: (D(p), D(q)) for i, (p, q) in expected.items()}
    assert (meta.model_version, meta.scored_at, meta.skipped) == ("m-7.1", datetime.date(2034, 5, 6), skipped)


@pytest.mark.parametrize(
    ("opening", "version", "day"),
    [
        ([], None, LOAD_DAY),
        (["# nothing to say"], None, LOAD_DAY),
        (["### score_date:2033-01-31,  model_version: beta 2 "], "beta 2", datetime.date(2033, 1, 31)),
        ([told(day="yesterday")], "m-7.1", LOAD_DAY),
        ([told(day="2033-02-30")], "m-7.1", LOAD_DAY),
    ],
)
def test_what_a_feed_says_of_itself(spark, tmp_path, opening, version, day):
    _, meta = scores(spark, tmp_path, only=[*opening, HEAD, "CVE-2034-1,0.5,0.5"])
    assert (meta.model_version, meta.scored_at) == (version, day)


def test_the_last_file_by_name_counts_whatever_the_sizes(spark, tmp_path):
    filler = [f"CVE-2034-{n},0.5,0.5" for n in range(10, 3000)]
    files = {
        "one": [told(), HEAD, "CVE-2034-1,0.6,0.6", "CVE-2034-2,0.2,0.2"],
        "two": [told(), HEAD, "CVE-2034-1,0.9,0.1", *filler],
    }
    rows, _ = scores(spark, tmp_path, **files)
    # "one" < "two" by name, so the second one's value stays.
    assert len(rows) == 2992 and rows["CVE-2034-1"] == (D("0.9"), D("0.1")) and rows["CVE-2034-2"] == (D("0.2"), D("0.2"))
    rows, _ = scores(spark, tmp_path, zero=[told(), HEAD, "CVE-2034-1,0.3,0.3"])
    assert rows["CVE-2034-1"] == (D("0.3"), D("0.3")) and len(rows) == 2992


@pytest.mark.parametrize(
    ("files", "complaint"),
    [
        ({"a": [told(), "cve,percentile", "CVE-2034-1,0.5"]}, "misses columns"),
        ({"a": [told(), "# only", ""]}, "no CSV header"),
        ({"a": [told(), HEAD], "b": [told(day="2034-05-07"), HEAD]}, "disagree"),
        ({"a": [told(), HEAD], "b": [told(version="m-8"), HEAD]}, "disagree"),
    ],
)
def test_unusable_feeds_fail(spark, tmp_path, files, complaint):
    with pytest.raises(FeedError, match=complaint):
        scores(spark, tmp_path, **files)


def test_a_feed_is_unpacked_once(spark, tmp_path):
    rows, meta = read_score_feed(spark, gzipped(tmp_path, a=[told(), HEAD, "CVE-2034-1,0.5,0.5", "x"]), LOAD_DAY)
    (tmp_path / "a.csv.gz").unlink()
    # Rows and counts come from the landed lines.
    assert rows.count() == 1 and meta.skipped == 1


@pytest.mark.parametrize("per_line", [False, True])
def test_vuln_pages_keep_the_text(spark, tmp_path, per_line):
    page = {"totalResults": 2, "vulnerabilities": [{"cve": {"id": "CVE-1", "score": 10.0}}, {"other": 1}, {"cve": {"id": "CVE-2"}}]}
    indent = None if per_line else 2
    (tmp_path / "p1.json").write_text(json.dumps(page, indent=indent) + "\n")
    rows = read_vuln_pages(spark, str(tmp_path), per_line=per_line).collect()
    assert sorted(r.parsed.id for r in rows) == ["CVE-1", "CVE-2"]
    first = next(r for r in rows if r.parsed.id == "CVE-1")
    assert json.loads(first.raw_json) == {"id": "CVE-1", "score": 10.0} and "10.0" in first.raw_json


def test_weakness_csv(spark, tmp_path):
    (tmp_path / "1000.csv").write_text(
        'CWE-ID,Name,Weakness Abstraction,Status,Description\n'
        '79, Cross-site ,Base,Stable,"Says ""hi"",\nthen leaves"\n'
        ' ,Nameless,Base,Draft,x\n'
        '5,J2EE,  ,Draft,\n'
    )
    rows = {r.cwe_id: r for r in read_weakness_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"CWE-79", "CWE-5"}
    assert rows["CWE-79"].name == "Cross-site" and rows["CWE-79"].description == 'Says "hi",\nthen leaves'
    assert rows["CWE-5"].abstraction is None and rows["CWE-5"].description is None
    assert rows["CWE-79"].url == "https://cwe.mitre.org/data/definitions/79.html"
    (tmp_path / "1000.csv").write_text("CWE-ID,Name\n1,x\n")
    with pytest.raises(FeedError, match="misses columns"):
        read_weakness_csv(spark, str(tmp_path))
