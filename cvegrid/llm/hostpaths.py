"""Main text of web pages by paths that the pages of a host agree on.

A page is read into a tree of its block elements; elements that by tag, role, class or id are
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
are left out with all they hold.  Containers are scored by the share of the page's unlinked text
that they hold; the smallest dominant one, widened to the article or main element around it,
votes for its path (without such an element, the container ends where headings, paragraphs or
larger blocks of unlinked text stand beside it; names such as no-sidebar mark nothing): tags with their classes, digits generalised.  Spark adds up the votes by
host, and every page is read again with its host's paths, the one with the most votes first; a
page that has none of them gives its own best container.

Text is that of the chosen elements' blocks: character references decoded, white space inside a
block made one space, blocks joined by one space.

Defined cases: null or empty html gives an empty text; pages without a host (or a null url) vote
together; paths with equal votes go by code point; elements that share the path are all taken, in
page order; repeated rows are read alike, each votes; an empty table gives an empty result; other
columns are not read.  A page is held whole, once, by the task that reads it.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batch_of, rows_of, stored, table, whole_text

PATHS_KEPT = 3
# Share of a container's text that one of its children must hold to be looked into.
DOMINANT = 0.7
# Share of the text from which a container beside the largest one belongs to the article.
ASIDE = 0.05
# Bytes of paths up to which they are sent to all tasks instead of being joined.
SENT_TO_ALL = 32 << 20

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)/?>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
LEFT_OUT = {
    "head", "script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "object", "canvas",
    "nav", "footer", "aside", "form", "button", "select", "input", "dialog", "menu", "noembed", "noframes", "xmp",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var",
}
CONTAINERS = {"body", "main", "article", "section", "div", "td", "center"}
# Start tags that end an open element of the same set, no further up than the holders named.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of a class, id or role that mark what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "hidden", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar",
    "widget", "widgets", "alert", "complementary", "search",
}
# Names that begin so tell what a layout has or lacks.
LAYOUT = {"no", "not", "non", "without", "has", "have", "with"}
HEADINGS = {"h1", "h2", "h3"}
HEADINGS_ALL = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS_ALL | INLINE | {"p", "blockquote", "pre", "figcaption", "li", "dt", "dd"}
ARTICLES = {"article", "main"}


@dataclass(eq=False)
class Element:
    tag: str
    # Tag and classes; an inline element has none and stands at its parent's path.
    step: str
    up: Element | None
    out: bool = False
    linked: bool = False
    # Left out by its class, id or role only.
    named: bool = False
    # Pieces of text and child elements in page order; None stands for the end of a block.
    parts: list = field(default_factory=list)
    # Unlinked letters, and characters that show, of what it holds; see `measured`.
    letters: int = 0
    shown: int = 0

    def __post_init__(self) -> None:
        # Whether it is, or stands in, an article or main element.
        self.within = self.tag in ARTICLES or (self.up is not None and self.up.within)

    @property
    def path(self) -> str:
        steps, at = [], self
        while at is not None:
            if at.step:
                steps.append(at.step)
            at = at.up
        return ">".join(reversed(steps))

    def inside(self, tags: set[str]) -> Element | None:
        at = self
        while at is not None and at.tag not in tags:
            at = at.up
        return at

    def size(self) -> int:
        """Unlinked letters of the element and what it holds."""
        return 0 if self.out or self.linked else self.letters

    def holds(self, tags: set[str]) -> bool:
        waiting = [self]
        while waiting:
            at = waiting.pop()
            if at.tag in tags:
                return True
            waiting += [p for p in at.parts if isinstance(p, Element) and not p.out]
        return False

    def show(self) -> None:
        """Take the element back in: its text counts in all that hold it, up to one that is out."""
        self.out = False
        letters, shown, at = 0 if self.linked else self.letters, self.shown, self.up
        while at is not None:
            at.letters += letters
            at.shown += shown
            if at.out:
                break
            letters, at = 0 if at.linked else letters, at.up

    def blocks(self) -> Iterator[str | None]:
        """Text in page order, with None at the edges of blocks."""
        waiting = [iter(self.parts)]
        edges = [False]
        while waiting:
            part = next(waiting[-1], waiting)
            if part is waiting:
                waiting.pop()
                if edges.pop():
                    yield None
            elif not isinstance(part, Element):
                yield part
            elif not part.out:
                edges.append(part.tag not in INLINE)
                if edges[-1]:
                    yield None
                waiting.append(iter(part.parts))


def measured(root: Element) -> None:
    """Add up the text of all elements, inner ones first, however deep they are nested."""
    order, waiting = [], [root]
    while waiting:
        at = waiting.pop()
        order.append(at)
        waiting += [p for p in at.parts if isinstance(p, Element)]
    for at in reversed(order):
        for part in at.parts:
            if isinstance(part, str):
                at.letters += len(part)
                at.shown += len("".join(part.split()))
            elif part is not None and not part.out:
                at.letters += part.size()
                at.shown += part.shown


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in reversed(ATTRIBUTE.findall(text))}


def _left_out(tag: str, named: dict[str, str], up: Element) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in {"html", "body", "main", "article"}:
        return False
    # A header inside the article holds its headline; one of the page doesn't.
    if tag == "header":
        return not up.within
    if "hidden" in named or named.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", named.get("style", "")):
        return True
    return False


def _marked(tag: str, named: dict[str, str], up: Element) -> bool:
    # Inside an article, names of headings, paragraphs and inline elements tell of its subject or
    # look; anywhere, the id of a heading is an anchor.
    if up.within and tag in PROSE:
        return False
    words = set()
    marks = ("class", "role") if tag in HEADINGS_ALL else ("class", "id", "role")
    for name in " ".join(named.get(a) or "" for a in marks).lower().split():
        own = WORD.findall(name)
        if own and own[0] not in LAYOUT:
            words.update(own)
    return bool(words & MARKS) or ("header" in words and not up.within)


def _step(tag: str, named: dict[str, str]) -> str:
    names = sorted(DIGITS.sub("#", name) for name in named.get("class", "").lower().replace(">", "").split())
    return ".".join([tag, *names])


def tree(page: str) -> Element:
    """The page's elements; text directly in the root counts as the body's."""
    root = Element("body", "body", None)
    at, place = root, 0
    while place < len(page):
        found = MARKUP.search(page, place)
        text = page[place : found.start() if found else len(page)]
        if text:
            at.parts.append(references.unescape(text))
        if found is None:
            break
        place = found.end()
        if found.group(2) is None:
            continue
        tag, named = found.group(2).lower(), None
        if found.group(1):
            if tag in INLINE and tag != "a" and at.tag != tag:
                continue
            if tag in {"html", "body"}:
                continue
            holder = at.inside({tag})
            if holder is not None and holder is not root:
                at = holder.up
            elif tag in {"p", "br"}:
                at.parts.append(None)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        if tag in {"html", "body"}:
            continue
        if tag in VOID:
            if tag in {"br", "hr"}:
                at.parts.append(None)
            continue
        if found.group(3):
            named = _attributes(found.group(3))
        out = _left_out(tag, named or {}, at)
        by_name = not out and tag not in {"main", "article", "header"} and _marked(tag, named or {}, at)
        out = out or by_name
        if tag in INLINE and tag != "a" and not out:
            continue
        if tag in INLINE:
            # An anchor ends one that is still open.
            if tag == "a" and at.tag == "a":
                at = at.up
            new = Element(tag, "", at, out, linked=tag == "a", named=by_name)
            at.parts.append(new)
            at = new
            continue
        while at.tag == "a" or (at.tag == "p" and at is not root):
            at = at.up
        if tag in ENDS:
            ended, holders = ENDS[tag]
            holder = at.inside(ended | holders)
            while holder is not None and holder.tag in ended:
                at = holder.up
                holder = at.inside(ended | holders)
        new = Element(tag, _step(tag, named or {}), at, out, named=by_name)
        at.parts.append(new)
        at = new
    measured(root)
    _taken_back(root)
    return root


def _taken_back(root: Element) -> None:
    """Marks by name are void on what wraps a page's headline and most of its text, or all its text."""
    waiting = [root]
    while waiting:
        at = waiting.pop()
        if at.tag in ARTICLES:
            continue
        marked = [p for p in at.parts if isinstance(p, Element) and p.named and p.out]
        sizes = [0 if p.linked or not p.shown else p.letters for p in marked]
        if sizes and max(sizes):
            largest = marked[sizes.index(max(sizes))]
            wraps = max(sizes) >= DOMINANT * (root.size() + max(sizes)) and largest.holds({"h1", "main"})
            if wraps or not root.shown:
                largest.show()
        waiting += [p for p in at.parts if isinstance(p, Element) and not p.out]


def _belongs(part: str | Element | None, whole: int) -> bool:
    """Whether what stands beside the largest container has unlinked text of the article."""
    if not isinstance(part, Element):
        return bool(part and part.strip())
    text = text_of([part])
    size = part.size()
    if part.out or not text or 2 * size < len(text):
        return False
    return part.tag not in CONTAINERS or part.holds(HEADINGS) or size >= ASIDE * whole


def best(root: Element) -> Element:
    """The smallest container that holds most of the page's unlinked text, widened to its article.

    Without an article or main element it ends where text of the article stands beside it.
    """
    at, widest = root, None
    while True:
        whole = at.size()
        inner = [p for p in at.parts if isinstance(p, Element) and not p.out and p.tag not in INLINE]
        sizes = [p.size() for p in inner]
        if not inner or max(sizes) < DOMINANT * whole or not whole:
            break
        largest = inner[sizes.index(max(sizes))]
        # A block of one paragraph is not a container; look through what only wraps.
        if largest.tag not in CONTAINERS and not any(isinstance(p, Element) and p.tag in CONTAINERS for p in largest.parts):
            break
        if widest is None and not at.within and any(p is not largest and _belongs(p, whole) for p in at.parts):
            widest = at
        at = largest
    return at.inside({"article"}) or at.inside({"main"}) or widest or at


def text_of(elements: list[Element]) -> str:
    blocks, pieces = [], []
    for element in elements:
        for part in [*element.blocks(), None]:
            if part is not None:
                pieces.append(part)
            elif pieces:
                blocks.append(" ".join("".join(pieces).split()))
                pieces = []
    return " ".join(b for b in blocks if b)


def at_path(root: Element, path: str) -> list[Element]:
    """The outermost elements with a path, in page order."""
    steps, found, waiting = path.split(">"), [], [(root, 0)]
    while waiting:
        at, depth = waiting.pop()
        if at.step:
            if at.step != steps[depth]:
                continue
            depth += 1
            if depth == len(steps):
                found.append(at)
                continue
        waiting += [(p, depth) for p in reversed(at.parts) if isinstance(p, Element) and not p.out]
    return found


def main_text(page: str, paths: list[str]) -> str:
    """Text at the first of the paths that the page has text at, else of its best container."""
    root = tree(page)
    for path in paths:
        if text := text_of(at_path(root, path)):
            return text
    return text_of([best(root)])


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for host, page in rows_of(batch):
            chosen = best(tree(page))
            if chosen.size():
                counts[host, chosen.path] = counts.get((host, chosen.path), 0) + 1
        yield batch_of([(h, p, n) for (h, p), n in counts.items()], "_host string, _path string, _votes bigint")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(page_id, url, main_text(page, paths or [])) for page_id, url, page, paths in rows_of(batch)]
        yield batch_of(rows, "page_id bigint, url string, text string")


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(_host, _paths): the paths with the most votes of each host."""
    votes = (
        pages.select(host_of("url").alias("_host"), whole_text("html").alias("_html"))
        .mapInArrow(_voted, "_host string, _path string, _votes bigint")
        .groupBy("_host", "_path")
        .agg(F.sum("_votes").alias("_votes"))
    )
    place = F.row_number().over(Window.partitionBy("_host").orderBy(F.desc("_votes"), "_path"))
    best_ = votes.withColumn("_place", place).where(F.col("_place") <= PATHS_KEPT)
    listed = F.array_sort(F.collect_list(F.struct("_place", "_path")))
    return best_.groupBy("_host").agg(F.transform(listed, lambda p: p["_path"]).alias("_paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    paths = stored(host_paths(pages), "host-paths")
    size = paths.agg(F.sum(F.length("_host") + F.length(F.array_join("_paths", "")))).first()[0] or 0
    told = pages.select("page_id", "url", whole_text("html").alias("_html"), host_of("url").alias("_host"))
    told = told.join(F.broadcast(paths) if size <= SENT_TO_ALL else paths, "_host", "left")
    return told.select("page_id", "url", "_html", "_paths").mapInArrow(_read, "page_id bigint, url string, text string")


def op4_host_paths(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
