"""Main text of written pages, the vote of hosts, and the article of the test pages."""

import html
import re

import pytest

from cvegrid.llm import hostpaths as hp

SCHEMA = "page_id bigint, url string, html string"
LONG = "word " * 60

PAGES = [
    ("", ""),
    ("plain  text\n only", "plain text only"),
    ("<p>a<p>b &amp; c&nbsp;d<div class='comments'><p>no</div>", "a b & c d"),
    ("<!-- open <p>x", ""),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p>one <b>bo</b>ld<br>two</p><script>if(a<b){'<p>no</p>'}</script>", "one bold two"),
    (
        "<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>x < y &lt; z</p>"
        f"<section class='comments'><p>{LONG}</p></section></article></main><footer>f</footer>",
        "T x < y < z",
    ),
    (
        f"<div id=a><nav><a href=x>menu</a></nav><div class='post-12 text'><h2>T</h2><p>{LONG}</p><ul><li>one<li>two</ul></div>"
        "<div class='sidebar'>side</div><div class='cookie-notice'>ok</div></div><form><p>f</form>",
        f"T {LONG}one two",
    ),
    ("<article><p>a&amp;amp; &notin; &#8211;</p><div class=ad>buy</div><p hidden>h</p></article>", "a&amp; ∉ –"),
    ("<article><p>unclosed <b>bold<p>next</article><div class=widget>w</div>", "unclosed bold next"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert hp.main_text(page, []) == text


@pytest.mark.parametrize(
    "inner",
    [
        "<p>The <span class='share'>share</span> rose.</p>",
        "<p class='related-work'>Earlier work.</p>",
        "<h2 id='search'>Search</h2><p>How.</p>",
        "<h3 id='social-history' class='tags'>Social history</h3>",
        "<ul><li class='promo'>one<li>two</ul><blockquote class='comment'>said</blockquote>",
    ],
)
def test_names_inside_an_article_mark_no_prose(inner):
    text = " ".join(re.sub("<[^>]+>", "|", inner).replace("|share|", "share").replace("|", " ").split())
    assert hp.main_text(f"<article><h1>T</h1>{inner}<div class='share'>x</div></article>", []) == f"T {text}"
    # Outside, a heading's id marks nothing either, but a paragraph's class does.
    assert hp.main_text("<div><h2 id='search'>S</h2><p>a</p><p class='cookie-notice'>c</p></div>", []) == "S a"


def test_deep_and_long_pages():
    for opening, closing in (("<div class='x1'>", "</div>"), ("<a href=x>", ""), ("<b>", "</b>")):
        page = opening * 10_000 + "<p>kept text</p>" + closing * 10_000
        assert hp.main_text(page, []) == "kept text", opening
    # A sidebar within a sidebar stays one.
    assert hp.main_text("<div class='sidebar'>" * 10_000 + "<p>side</p>", []) == ""
    nested = hp.tree("<div>" * 10_000 + "deep" + "</div>" * 10_000)
    chosen = hp.best(nested)
    assert hp.text_of(hp.at_path(nested, chosen.path)) == "deep"
    long = "<article>" + "<p>word word word</p>" * 60_000 + "</article>"
    assert len(hp.main_text(long, [])) == 60_000 * 15 - 1


def test_equal_votes_go_by_path(spark):
    page = "<div class='{}'><p>{}</p></div><div class='{}'><p>tail</p></div>"
    rows = [(1, "http://h/1", page.format("b", LONG, "a")), (2, "http://h/2", page.format("a", LONG, "b"))]
    rows += [(3, "http://h/3", page.format("c", LONG, "a"))]
    found = {r["page_id"]: r["text"] for r in hp.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Each path has one vote, so a comes first on every page that has it.
    assert found == {1: "tail", 2: LONG.strip(), 3: "tail"}


def test_votes_against_a_plain_count(spark):
    layouts = ["<main><p>{}</p></main>", "<div class='p{}'><p>{}</p></div>", "<section><div><p>{}</p></div></section>"]
    rows = []
    for n in range(60):
        layout = layouts[n * n % 3] if n % 4 else layouts[1]
        rows.append((n, f"https://h{n % 5}.example/{n}", layout.format(*([n, LONG] if "p{}" in layout else [LONG]))))
    plain = {}
    for _, url, page in rows:
        host = url.split("/")[2]
        path = hp.best(hp.tree(page)).path
        plain.setdefault(host, {}).setdefault(path, 0)
        plain[host][path] += 1
    wanted = {h: sorted(v, key=lambda p, v=v: (-v[p], p))[: hp.PATHS_KEPT] for h, v in plain.items()}
    found = {r["_host"]: list(r["_paths"]) for r in hp.host_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == wanted and any(len(p) > 1 for p in found.values())


ENTRY = f"<div class='entry'><p>{LONG}</p></div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='top'><a href=x>menu</a></div><div class='post'><h1>T</h1><p>lead</p>{ENTRY}</div>", f"T lead {LONG.strip()}"),
        (f"<div class='post'><div class='title'><h1>T</h1></div>{ENTRY}<div class='comments'>c</div></div>", f"T {LONG.strip()}"),
        (f"<div class='container no-sidebar'><h1>T</h1>{ENTRY}</div>", f"T {LONG.strip()}"),
        (f"<div class='has-sidebar'>{ENTRY}<div class='sidebar'>side</div></div>", LONG.strip()),
        (f"<div class='with-comments'>{ENTRY}<div class='comments'>no</div></div>", LONG.strip()),
        (f"<div class='page sidebar-right'><h1>T</h1>{ENTRY}</div><p>f</p>", f"T {LONG.strip()} f"),
        (f"<div class='sidebar-left'>{ENTRY}</div>", LONG.strip()),
        (f"<h1>Site</h1><main><article><h1>T</h1>{ENTRY}</article></main>", f"T {LONG.strip()}"),
        (f"<p>short</p><div class='comments'><p>{LONG}</p></div>", "short"),
    ],
)
def test_pages_of_divisions(page, text):
    assert hp.main_text(page, []) == text
    assert hp.main_text(page, [hp.best(hp.tree(page)).path]) == text


def test_hosts_agree(spark):
    layout = "<div class='main'><p>{}</p></div><div class='more'><p>{}</p></div>"
    # Two pages show where the article stands; the third has more text beside it than in it.
    rows = [(n, "http://a.example/" + str(n), layout.format(LONG, "few words")) for n in (1, 2)]
    rows += [(3, "http://A.example/3", layout.format("the article", LONG)), (4, "http://b.example/", layout.format("s", LONG))]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "1 AS _host")
    found = {r["page_id"]: r["text"] for r in hp.extract(frame.drop("_host")).collect()}
    assert found[1] == LONG.strip() and found[3] == "the article" and found[4] == LONG.strip()


@pytest.mark.parametrize("limit", [hp.SENT_TO_ALL, 0])
def test_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(hp, "SENT_TO_ALL", limit)
    rows = [(1, None, None), (None, "http://a.b/c", ""), (2, "no url", "<p>hi</p>"), (2, "no url", "<p>hi</p>")]
    found = hp.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"] for r in found) == ["", "", "hi", "hi"]
    assert hp.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = hp.op4_host_paths(spark, sf).collect()
    assert len(found) == len(pages)
    for row in found:
        article = re.search("<article>(.*?)</article>", pages[row["page_id"]], re.S).group(1)
        spaced = re.sub("<br>|</?p>|</?h1>", " ", article).replace("<b>", "").replace("</b>", "")
        assert row["text"] == " ".join(html.unescape(spaced).split())
        assert row["n_chars"] == len(row["text"])
