"""Operator 6: main text of web pages, by page structure and nearest-URL page differencing.

A page is cut into lines: the text of a block element, character references decoded, white space folded. Lines in
elements that are never article text (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts)
are left out by tag, role and class or id word. Words never judge html, body, main and headings, nor an element that holds all of the marked
article; inside it a class has to be such a word as a whole, and an id only counts for comments.

Every page is then differenced: pages are ordered by host and URL path, and each one is paired with its nearest neighbours of the same host, before and
after it; lines are aligned by longest common subsequence (one bit-parallel method at every size), and lines shared with a neighbour are deleted. A neighbour
that shares more than half of a page's text is a copy of the article if it also shares more than half of the lines that not all neighbours share;
the next one out is tried then, REACH of them at most. (Where all neighbours share everything, nothing tells an article from its template, and all stays.) Last, a check
against the parsed tree: shared lines inside a marked article (article) come back, as neighbours may quote or mirror each other's articles, and where a page
marks its text (article, main, role=main), lines outside go. main only bounds the text (it also holds share bars and lists of other pages), so what no
article in it holds is text if the neighbours do not share it; if they share all of it between them, all of it is text.

The order by (host, path, page_id, url) is cut into ranges of at least GROUP pages, by a pass over the URLs alone; the REACH pages on either side of a range
come with it. So texts are shuffled once, no host, however large, meets in one task, and every page meets its neighbours. A range is read in order and
holds 2 * REACH + 1 pages at a time.

Defined results: null and empty html give an empty text; a null URL belongs to the empty host; repeated rows and page_ids give a row each; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, only, table, wide

GROUP = 256
REACH = 3
STORED = 256
COPY = 0.5
MAIN, ARTICLE = 1, 2

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video", "fieldset", "datalist"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Words of class and id attributes of elements that are not article text (fixed values).
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup",
    "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "tags", "toolbar", "topbar", "widget",
}
#: Inside a marked article: ids there are mostly anchors of its sections, and these classes are also set on its own parts.
_COMMENTS = {"comments", "commentlist", "disqus", "respond", "replies"}
_OWN_PARTS = {"notice", "header"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag of these closes what was left open inside.
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: What a paragraph cannot reach beyond.
_BOUNDS = {"p", "div", "article", "main", "section", "td", "li", "body", "nav", "aside", "footer", "header", "form"}


def _by_words(name: str, key: str, value: str, inside: bool) -> bool:
    if name in _HEADINGS or key not in ("class", "id"):
        return False
    if name == "article":
        return key == "class" and not {"comment", "comments", "reply", "replies", "related", "comment-body"}.isdisjoint(value.split())
    if inside:
        return not (_COMMENTS if key == "id" else _WORDS - _OWN_PARTS).isdisjoint(value.split())
    return not _WORDS.isdisjoint(re.split(r"[\s_-]+", value))


def _unwanted(name: str, attributes: str, inside: bool, words: bool = True) -> bool:
    if name in _NEVER or name == "header" and not inside:
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    found = [(key.lower(), (a or b or c).lower()) for key, a, b, c in _ATTRIBUTE.findall(attributes)]
    if words and ("role", "main") not in found and any(_by_words(name, key, value, inside) for key, value in found):
        return True
    if name == "article":
        return False
    for key, value in found:
        if key == "role" and value in _ROLES or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|=|$)", attributes, re.I))


def lines(page: str) -> list[tuple[int, str]]:
    """The lines of a page that may be article text; with each, whether it stands in a marked ARTICLE, in MAIN only, or in neither (0)."""
    found = _lines(page, True)
    if not any(main for main, _ in found) and re.search(_MARKED, page):
        # the article may stand in an element that was left out by a word
        again = _lines(page, False)
        return again if any(main for main, _ in again) else found
    return found


def _lines(page: str, words: bool) -> list[tuple[int, str]]:
    """lines, with or without elements outside the marked article judged by words."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, unwanted, marks the text as
    skipping = at = 0
    marked = [0, 0, 0]  # open elements by mark
    opened: dict[str, int] = {}  # open elements by name
    bounds: list[int] = []  # places in the stack of elements that a paragraph ends at

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((ARTICLE if marked[ARTICLE] else MAIN if marked[MAIN] else 0, text))

    def leave(to: int) -> None:
        nonlocal skipping
        while len(stack) > to:
            name, bad, mark = stack.pop()
            opened[name] -= 1
            skipping -= bad
            marked[mark] -= 1
        while bounds and bounds[-1] >= to:
            bounds.pop()

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at and not skipping:
            held.append(page[at:start])
        if start == len(page):
            break
        m = _MARKUP.match(page, start) or _LOOSE.match(page, start)
        if not m:
            if not skipping:
                held.append("<")
            at = start + 1
            continue
        at = m.end()
        if m.re is _MARKUP and m.group(2) is None:
            continue
        name, attributes = m.group(2).lower(), m.group(3)
        block = name not in _INLINE
        if m.group(1):
            # stray end tags end nothing and are not looked for; those that are found take what they passed with them
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name) if opened.get(name) else None
            if block and not skipping:
                flush()
            if depth is not None:
                leave(depth)
            continue
        if block and not skipping:
            flush()
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        if name in _CLOSES_P and stack:
            if bounds and stack[bounds[-1]][0] == "p":
                leave(bounds[-1])
        elif name == "li" and stack and stack[-1][0] == "li":
            leave(len(stack) - 1)
        inside = marked[MAIN] + marked[ARTICLE] > 0
        bad = _unwanted(name, attributes, inside, words or inside or name == "article")
        mark = 0 if bad or skipping else ARTICLE if name == "article" else MAIN if name == "main" or 'role="main"' in attributes else 0
        if name in _BOUNDS:
            bounds.append(len(stack))
        stack.append((name, bad, mark))
        opened[name] = opened.get(name, 0) + 1
        skipping += bad
        marked[mark] += 1
    flush()
    return out


def shared(own: list[str], other: list[str]) -> set[int]:
    """Line numbers of own in a longest common subsequence of lines with other.

    A row of the table of lengths is one integer: bit j is 0 where one line more of other lengthens the subsequence. Every STORED-th
    row is kept; going back, the rows between are made again, so memory is that of a few rows at any size. Lines that only one side has
    are in no common subsequence, and equal ends are in a longest one: both are left out before.
    """
    both = set(own).intersection(other)
    if not both:
        return set()
    kept = [i for i, line in enumerate(own) if line in both]
    own, other = [own[i] for i in kept], [line for line in other if line in both]
    most, head, tail = min(len(own), len(other)), 0, 0
    while head < most and own[head] == other[head]:
        head += 1
    while tail < most - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    to = len(own) - tail
    out = {*kept[:head], *kept[to:]}
    kept, own, other = kept[head:to], own[head:to], other[head : len(other) - tail]
    places: dict[str, int] = {}
    for j, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1

    def row_after(row: int, line: str) -> int:
        same = row & places.get(line, 0)
        return (row + same | row - same) & full

    stored, row = [full], full
    for i, line in enumerate(own, 1):
        row = row_after(row, line)
        if i % STORED == 0:
            stored.append(row)
    i, j = len(own), len(other)
    while i and j:
        first = (i - 1) // STORED * STORED
        rows = [stored[first // STORED]]
        for line in own[first:i]:
            rows.append(row_after(rows[-1], line))
        while i > first and j:
            if own[i - 1] == other[j - 1]:
                i, j = i - 1, j - 1
                out.add(kept[i])
            elif rows[i - first] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
    return out


def unshared(pages: list[list[str]], k: int, hosts: list[str], marks: list[int] | None = None) -> str:
    """The text of page k among its neighbours in URL order: lines that the nearest ones of its host share are deleted; the page's marks are checked then."""
    own = pages[k]
    gone: set[int] = set()
    near: dict[int, set[int]] = {}

    def same_as(other: int) -> set[int]:
        if other not in near:
            near[other] = shared(own, pages[other])
        return near[other]

    def length(numbers: set[int]) -> int:
        return sum(len(own[i]) for i in numbers)

    reach = [[k + step * far for far in range(1, REACH + 1)] for step in (-1, 1)]
    sides = [list(takewhile(lambda j: 0 <= j < len(pages) and hosts[j] == hosts[k], side)) for side in reach]
    rare: set[int] | None = None  # lines that not all neighbours share
    for side in sides:
        for other in side:
            same = same_as(other)
            if length(same) > COPY * (sum(map(len, own)) or 1):
                # a copy of the article, or another page under a template longer than its text: what is rare around tells
                if rare is None:
                    rare = set(range(len(own))) - set.intersection(*(same_as(j) for each in sides for j in each))
                if not rare or length(same & rare) > COPY * length(rare):
                    continue
            gone |= same
            break
    if marks and any(marks):
        gone = {i for i, mark in enumerate(marks) if mark != ARTICLE and (i in gone or not mark)}
        if len(gone) == len(own):
            gone = {i for i, mark in enumerate(marks) if not mark}
    return "\n".join(x for i, x in enumerate(own) if i not in gone)


_MARKED = r"(?i)<(article|main)[\s>]|role=\"main\""


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, lines and their marks, of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "html"):
                found = [lines(page or "") for page in batch.column("html").to_pylist()]
                texts = pa.array([[t for _, t in page] for page in found], pa.list_(pa.string()))
                marks = pa.array([[m for m, _ in page] for page in found], pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts, marks], ["page_id", "url", "lines", "marks"])

    return only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, lines array<string>, marks array<tinyint>")


_ORDER = ("host", "path", "page_id", "url")
_KEY = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string())])


def _placed(pages: DataFrame, *others: str) -> DataFrame:
    """The columns of the URL order, and others."""
    url: Column = F.coalesce(pages["url"], F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return pages.select(host.alias("host"), path.alias("path"), pages["page_id"].cast("long").alias("page_id"), pages["url"], *(pages[x] for x in others))


def _key(host: str, path: str, page_id: int | None, url: str | None) -> tuple:
    """Sorts as Spark does: nulls first, strings by code points."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or ""


def ranges(pages: DataFrame, group: int = GROUP) -> list[tuple[int, list[tuple], list[tuple]]]:
    """Ranges of the URL order, of at least `group` pages: the number of pages, the first REACH keys, the last REACH keys. Reads page_id and url only."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last = 0, [], []
        for batch in batches:
            n += batch.num_rows
            first += batch.slice(0, REACH - len(first)).to_pylist() if len(first) < REACH else []
            last = (last + batch.slice(max(0, batch.num_rows - REACH)).to_pylist())[-REACH:]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([first], pa.list_(_KEY)), pa.array([last], pa.list_(_KEY))], ["n", "first", "last"])

    keys = "array<struct<host string, path string, page_id long, url string>>"
    cut = _placed(pages).repartitionByRange(2 * wide(pages.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(ends, f"n long, first {keys}, last {keys}")
    found = sorted((([_key(*x) for x in r.first], r.n, [_key(*x) for x in r.last]) for r in cut.collect()), key=lambda x: x[0][0])
    out: list[tuple[int, list[tuple], list[tuple]]] = []
    least = max(group, REACH)  # a page's neighbours are in its own range or in the next one
    left = sum(n for _, n, _ in found)
    for first, n, last in found:
        if out and (out[-1][0] < least or left < least):
            before = out.pop()
            out.append((before[0] + n, (before[1] + first)[:REACH], (before[2] + last)[-REACH:]))
        else:
            out.append((n, first, last))
        left -= n
    return out


def differenced(pages: DataFrame, group: int = GROUP, cut: list[tuple[int, list[tuple], list[tuple]]] | None = None) -> DataFrame:
    """page_id, url and text of pages given as lines and marks, each differenced with its nearest neighbours by URL."""
    cut = ranges(pages, group) if cut is None else cut
    starts, heads, tails = [first[0] for _, first, _ in cut[1:]], [first[-1] for _, first, _ in cut], [last[0] for _, _, last in cut]

    def blocks(host: pa.Array, path: pa.Array, page_id: pa.Array, url: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(x.to_pylist() for x in (host, path, page_id, url)), strict=True):
            key = _key(*row)
            own = bisect_right(starts, key)
            out.append([own, *([own - 1] if own and key <= heads[own] else []), *([own + 1] if own < len(starts) and key >= tails[own] else [])])
        return pa.array(out, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the page at `at`, REACH before it and REACH after it
        out: list[tuple] = []
        at = 0

        def solve(upto: int) -> None:
            nonlocal at
            while at < upto:
                r = held[at]
                if r["own"]:
                    from_ = max(0, at - REACH)
                    near = held[from_ : at + REACH + 1]
                    out.append((r["page_id"], r["url"], unshared([x["lines"] for x in near], at - from_, [x["host"] for x in near], r["marks"])))
                at += 1
            del held[: max(0, at - REACH)]
            at = min(at, REACH)

        def solved() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "text"])
            out.clear()
            return batch

        for row in chain.from_iterable(part.to_pylist() for whole in batches for part in (whole.slice(k, GROUP) for k in range(0, whole.num_rows, GROUP))):
            if held and held[-1]["block"] != row["block"]:
                solve(len(held))
                held.clear()
                at = 0
            held.append(row)
            solve(len(held) - REACH)
            if len(out) >= GROUP:
                yield solved()
        solve(len(held))
        yield solved()

    # never empty; outer, as Spark would ask for the blocks twice to filter empty ones
    near = F.arrow_udf(blocks, "array<int>")(*_ORDER)
    dealt = _placed(pages, "lines", "marks").withColumn("blocks", near).select(*_ORDER, "lines", "marks", F.posexplode_outer("blocks").alias("place", "block")).withColumn("own", F.col("place") == 0).drop("place")
    return dealt.repartitionById(max(1, len(cut)), "block").sortWithinPartitions("block", *_ORDER, F.hash("lines")).mapInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    return differenced(parsed(pages), cut=ranges(pages))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: For pages that mark their article and hold nothing else in it than headings, paragraphs, line breaks and bold text.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
l AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '</?(?:h1|p|br)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'))), lambda x: x <> ''), chr(10)) AS text FROM l)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
