"""Main-text extraction by tag-path ratios.

A page's text blocks are grouped by their root-to-leaf tag path. For each path the
text length and the punctuation per block are aggregated, fused with the share of
text outside links and smoothed over the tree of paths: what a path has counts for
another one less by ``SPREAD`` with each step between them. Paths whose ratio is
``THRESHOLD`` of the best one's or more select the content nodes.

Parts that their element, role, class or id names as something else (menus,
headers and footers of the page, sidebars, notices, adverts, forms, reader
comments) make paths of their own, whose ratio is divided by ``LOWERED``. So
names alone don't take a part out, but one needs a ratio out of all proportion to
stay. A class or id names such a part if it is a known name, or a compound of known
names and words for place or shape; words for comments, sharing and sidebars win
over post, entry and content. Headings, paragraphs and other running text aren't
judged by class or id, and a section, or an element inside ``article``, isn't by an
id that its heading may have given it.

The selected nodes are content, and they choose its root: the outermost ``main``
and ``article`` elements that hold such nodes, if ``INSIDE`` of their unlinked text
is in there, or else the innermost container around them all. What else is in the
root, short and linked blocks too, is content as well unless its path is lowered.
Within a block, white space becomes one space and character references
are decoded; blocks are joined in page order by a blank line.

Time and memory are linear in the page: blocks know their path and element by
number, and smoothing pushes sums up and down the tree of paths.

Defined results: a null or empty page gives an empty text; unclosed and stray
tags are repaired as far as they nest; where all text is linked every block is
content; repeated rows are extracted one by one. Scripts, styles, templates and
other raw elements aren't text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_slices

#: A path's nodes are content from this share of the best path's smoothed ratio on.
THRESHOLD = 0.5
#: What a path's ratio counts for a path one step away.
SPREAD = 0.25
#: The ratio of a path through a part named as something else is divided by this.
LOWERED = 100
#: The share of the selected nodes' text that ``main`` and ``article`` must hold to be the root.
INSIDE = 0.6

#: How HTML elements nest and show.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math object video audio canvas select noframes xmp".split())
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = {"p": "article body div td th section main blockquote li", "li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table thead tbody tfoot", "td": "tr table", "th": "tr table", "option": "select"}
BLOCK_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Elements and names of parts that aren't the article.
OTHER_ELEMENTS = frozenset("head nav footer aside form button dialog menu".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
OTHER_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets ad ads advert adverts advertisement "
    "advertising adsense adslot banner promo promos promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search pagination "
    "pager toolbar skip header responses discussion trackbacks pingbacks adsbygoogle adunit dfp taboola outbrain sponsors paywall disclaimer copyright colophon "
    "sidemenu sidenav topnav dropdown offcanvas lightbox tooltip snackbar toast rail teaser teasers tagcloud toc".split()
)
#: Words that name a place or shape; a name of these and OTHER_NAMES alone is a compound that counts.
PLAIN_WORDS = frozenset(
    "site page main global top bottom left right primary secondary inner outer middle upper lower small large mobile desktop fixed sticky floating first last "
    "box bar block area zone slot unit container wrap wrapper panel pane row col column section region group module part inline holder frame layer "
    "list links link item items button buttons btn icon icons form field input title heading label text body bg image img logo count trail drawer toggle bottom "
    "post posts entry entries article articles content contents story stories news blog user reader new number next previous prev more all my the "
    "media network facebook twitter by this on in to of for and cta google gpt wp js jp mw vector ui div html a an".split()
)
#: Words that win over post, entry and content beside them.
WINNING_NAMES = frozenset("comment comments commentlist respond reply replies responses discussion disqus trackbacks pingbacks share sharing social sidebar aside related recommended".split())
CONTENT_NAMES = frozenset("article content entry post".split())
#: Names that a heading's generated id doesn't give to a section of an article by chance.
UNMISTAKABLE = frozenset("gpt navbar breadcrumbs masthead topbar sidebar adverts adsense adslot promo gdpr comments commentlist disqus trackbacks pingbacks pager toolbar adsbygoogle adunit dfp taboola outbrain paywall colophon sidemenu sidenav topnav offcanvas lightbox snackbar tagcloud".split())
#: Elements of running text, which neither class nor id makes another part.
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p dt dd blockquote pre code figcaption caption".split())
_SEMANTIC_ROOTS = frozenset(("main", "article"))
_CONTAINERS = frozenset("html body main article section div center".split())
_KEPT_ROOTS = frozenset(("html", "body", "main", "article"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?…。，；：！？、]")


def _names_other(tag: str, value: str, by_heading: bool) -> bool:
    """Whether a class or an id is a name of another part, or a compound of such names and plain words."""
    parts = [[w.lower() for w in _NAME.findall(part)] for part in value.split()]
    content = any(w in CONTENT_NAMES for words in parts for w in words)
    for words in parts:
        names = [w for w in words if w in OTHER_NAMES and not (tag == "header" and w == "header")]
        if not names or not all(w in OTHER_NAMES or w in PLAIN_WORDS or w.isdigit() for w in words):
            continue
        if content and not WINNING_NAMES.intersection(names):
            continue
        if "content" in words and "wrap" in words and "sidebar" in words:
            continue  # a theme's wrapper of both
        if by_heading and not UNMISTAKABLE.intersection(words):
            continue
        return True
    return False


def _is_other(tag: str, attributes: str, opened: Counter) -> bool:
    if tag in OTHER_ELEMENTS or tag == "header" and not opened["article"] and not opened["main"]:
        return True
    if not attributes or tag in _KEPT_ROOTS and tag != "article":
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if tag == "article":
            if name == "class" and WINNING_NAMES.intersection(w.lower() for w in _NAME.findall(value)) and _names_other(tag, value, False):
                return True
            continue
        if name == "hidden" or name == "role" and value.lower() in OTHER_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and tag not in TEXT_ELEMENTS and not opened["pre"] and not opened["code"]:
            by_heading = name == "id" and (tag == "section" or opened["article"] > 0)
            if _names_other(tag, value, by_heading):
                return True
    return False


class Page:
    """A page's blocks, its elements but inline ones, and the tree of their paths; number 0 is the page itself.

    A block is (path, element, text, characters in links). Parents come before their children."""

    def __init__(self, page: str, lists: bool = True):
        self.blocks: list[tuple[int, int, str, int]] = []
        self.tags, self.parents, self.semantic, self.element_paths = [""], [0], [0], [0]
        self.path_parents, self.lowered = [0], [False]
        self._paths: dict[tuple[int, str, bool], int] = {}
        self._lists = lists
        self._stack: list[tuple[str, int]] = []  # open elements: tag and number, for inline ones that of the element around them
        self._open: Counter[str] = Counter()
        self._words: list[str] = []
        self._linked, self._at = 0, 0
        self._read(page)

    def _flush(self) -> None:
        if self._words:
            text = " ".join("".join(self._words).split())
            self._words.clear()
            if text:
                self.blocks.append((self.element_paths[self._at], self._at, text, min(self._linked, len(text))))
        self._linked = 0

    def _add(self, raw: str, decode: bool = True) -> None:
        if not raw:
            return
        text = html.unescape(raw) if decode and "&" in raw else raw
        if not self._words:
            if not text.strip():
                return
            self._at = self._stack[-1][1] if self._stack else 0
        self._words.append(text)
        if self._open["a"]:
            self._linked += len(text)

    def _cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        if any(t not in INLINE for t, _ in self._stack[depth:]):
            self._flush()
        for t, _ in self._stack[depth:]:
            self._open[t] -= 1
        del self._stack[depth:]

    def _enter(self, tag: str, attributes: str) -> None:
        around = self._stack[-1][1] if self._stack else 0
        self._open[tag] += 1
        if tag in INLINE and not (self._lists and attributes and _is_other(tag, attributes, self._open)):
            self._stack.append((tag, around))
            return
        self._flush()
        own = len(self.tags)
        other = self._lists and _is_other(tag, attributes, self._open)
        key = (self.element_paths[around], tag, other)
        path = self._paths.get(key)
        if path is None:
            path = self._paths[key] = len(self.path_parents)
            self.path_parents.append(key[0])
            self.lowered.append(other or self.lowered[key[0]])
        self.tags.append(tag)
        self.parents.append(around)
        self.element_paths.append(path)
        self.semantic.append(self.semantic[around] or (own if tag in _SEMANTIC_ROOTS else 0))
        self._stack.append((tag, own))

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            if tag not in INLINE:
                self._flush()
            return
        for i in range(len(self._stack) - 1, -1, -1):
            t = self._stack[i][0]
            if t == tag:
                return self._cut(i)
            if tag in INLINE and t not in INLINE:
                return None  # an inline end tag doesn't close a block
        return None

    def _close_for(self, tag: str) -> None:
        """Close what a start tag closes."""
        closes = set(CLOSED_BY.get(tag, "").split()) | ({"p"} if tag in BLOCK_ENDS_P else set())
        if not any(self._open[t] for t in closes):
            return
        scope = set(SCOPES.get(tag, SCOPES["p"]).split())
        lowest = None
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in closes:
                lowest = i
            elif self._stack[i][0] in scope:
                break
        if lowest is not None:
            self._cut(lowest)

    def _read(self, page: str) -> None:
        at, n, endless = 0, len(page), set()
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                self._add(page[at:])
                break
            self._add(page[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self._add(m[1], decode=False)
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                self._end(tag)
            elif tag in RAW:
                if m[4].rstrip().endswith("/"):
                    continue
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if tag not in endless else None
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = n  # unclosed: the rest is its text
                else:
                    endless.add(tag)
            elif tag == "br":
                self._add(" ")
            elif tag in VOID:
                if tag not in INLINE:
                    self._flush()
            else:
                if tag not in INLINE:
                    self._close_for(tag)
                    self._flush()
                if not (tag in ("html", "body") and self._open[tag]):
                    self._enter(tag, m[4])
        self._flush()


def path_ratios(page: Page) -> list[float]:
    """The fused, smoothed ratio of each path; zero for those without blocks."""
    n = len(page.path_parents)
    count, length, marks, links = [0] * n, [0] * n, [0] * n, [0] * n
    for path, _, text, linked in page.blocks:
        count[path] += 1
        length[path] += len(text)
        marks[path] += len(_MARKS.findall(text))
        links[path] += linked
    weight, value = [0.0] * n, [0.0] * n  # of each path, and then of all paths seen from it
    for p in range(n):
        if count[p]:
            free = 1 - links[p] / length[p]
            weight[p] = math.sqrt(count[p])
            value[p] = weight[p] * math.sqrt(length[p] / count[p] * (1 + marks[p] / count[p])) * free * free / (LOWERED if page.lowered[p] else 1)
    for sums in (weight, value):
        for p in range(n - 1, 0, -1):
            sums[page.path_parents[p]] += SPREAD * sums[p]
        for p in range(1, n):
            sums[p] += SPREAD * (sums[page.path_parents[p]] - SPREAD * sums[p])
    return [value[p] / weight[p] * (1 - links[p] / length[p]) / (LOWERED if page.lowered[p] else 1) if count[p] else 0.0 for p in range(n)]


def content_root(page: Page, selected: list[tuple[int, int, str, int]]) -> set[int]:
    """Numbers of the elements whose blocks are content; 0 is the page itself."""
    roots: Counter[int] = Counter()
    for _, element, text, linked in selected:
        roots[page.semantic[element]] += len(text) - linked
    free = sum(roots.values())
    if free - roots[0] >= INSIDE * free and roots.keys() - {0}:
        return set(roots) - {0}
    elements = {element for _, element, _, _ in selected}
    low, high = min(elements), max(elements)
    alone = low == high
    while low != high:  # elements are numbered in page order, so this one is around all of them
        if low > high:
            low = page.parents[low]
        else:
            high = page.parents[high]
    if alone:
        low = page.parents[low]  # a lone block isn't around its neighbours
    while low and page.tags[low] not in _CONTAINERS:
        low = page.parents[low]
    return {low}


def extract_text(page: str | None, threshold: float = THRESHOLD, lists: bool = True) -> str:
    """The main text of one page. Without ``lists`` no part is known by its name."""
    read = Page(page or "", lists)
    if not read.blocks:
        return ""
    ratios = path_ratios(read)
    least = threshold * max(ratios)
    roots = content_root(read, [b for b in read.blocks if ratios[b[0]] >= least])
    inside = [False] * len(read.tags)
    for e in range(len(inside)):
        inside[e] = e in roots or inside[read.parents[e]]
    return "\n\n".join(text for path, element, text, _ in read.blocks if ratios[path] >= least or inside[element] and not read.lowered[path])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text) of every row."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    source = pages.select(F.col(id_col).alias("id"), *kept, F.col(html_col).cast("string").alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([extract_text(p) for p in part.column("text").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*part.columns[:-1], texts], part.schema.names)

    out = map_slices(source, run, source.schema)
    return out.select("id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def extraction_report(pages: DataFrame) -> DataFrame:
    """The digest of ``extract`` per page row."""
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The same for pages whose article is one ``article`` element of h1, p, b and br, as those of the tables are.
REPORT_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
t AS (
  SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS blocks FROM a),
j AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""
