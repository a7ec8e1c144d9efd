"""Main text of web pages by tree scoring.

A page is read once into a tree of elements and runs of text. Furniture is marked by element (nav, aside, form,
script ...), by role, or by a word of its class or id (sidebar, cookie, comments ...). Each paragraph then
passes points, for itself, its length and its commas, to its parent, half of them to the grandparent and ever
less further up. Elements start with a bonus or malus for their name and class, and a score is
discounted by the share of an element's text that is links. The best container is kept, widened to the
article element it lies in if there is one; otherwise with those siblings that score well themselves or read like
headings and paragraphs of it. Lists of links are left out, but not those of an article element: they are its
sources, unless element, role or class say otherwise. In an article a class such as ``share-price`` that only contains a
telling word is no sign by itself: it takes links in more than half of the text as well.
All is done in a few passes over the elements, so time does not depend on their depth.

The text is the runs of the kept elements, one block per block-level run, character references decoded, white space
within a block turned into one space, blocks in page order. Defined cases: a null or empty page, and a page
without text, give the empty text; markup may be broken, open or deeply nested; repeated rows are read alike.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    " caption legend option optgroup".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption th caption summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form button select input textarea iframe svg canvas object"
    " dialog menu audio video title option".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
UNLIKELY = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar sidenav nav navbar"
    " navigation menu submenu breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related"
    " recommended recommendations toolbar widget widgets pagination pager alert banner copyright skip hidden".split()
)
#: Parts of class names that say nothing about the content, so that ``ad-box`` tells as much as ``ad``.
FRAME = frozenset(
    "area bar block bottom box btn button buttons card cell col column container group holder icon icons inner item items"
    " left link links list outer panel right row section slot small large title heading top unit wrap wrapper".split()
)
#: Points go no further up than this; a paragraph's share is below a 190th there.
REACH = 64
LIKELY = frozenset("article body content entry hentry main page post text blog story".split())
START = {"article": 25, "main": 25, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3}
START |= {"ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5} | {h: -5 for h in HEADING}
#: Start tags that end an open element of these names, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

_token = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[\s/]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^\s/>=]++|=)*+)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
_attribute = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_part = re.compile(r"[^a-zA-Z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "block", "words", "sure", "drop", "mute", "score", "chars", "links")

    def __init__(self, tag: str, parent: Node | None, words: frozenset, sure: bool, drop: bool):
        self.tag, self.parent, self.words, self.sure, self.drop = tag, parent, words, sure, drop
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.mute = False  # an inline element whose text is left out
        self.score, self.chars, self.links = 0.0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _attribute.finditer(text)}


def _words(attrs: dict[str, str]) -> tuple[frozenset, bool]:
    """Words of class and id, and whether some name among them has telling words and nothing else of meaning."""
    words: set[str] = set()
    sure = False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = {w.lower() for part in _part.split(name) for w in _camel.split(part) if w}
        words |= parts
        rest = parts - UNLIKELY
        sure = sure or len(rest) < len(parts) and all(w in FRAME or not w.isalpha() or len(w) == 1 for w in rest)
    return frozenset(words), sure


class Page:
    """The elements of a page and its runs of text: (block element, text, length in links)."""

    def __init__(self, source: str):
        self.root = Node("html", None, frozenset(), False, False)
        self.stack = [self.root]
        self.open: Counter[str] = Counter()
        self.nodes = [self.root]
        self.runs: list[tuple[Node, str, int]] = []
        self._block: Node = self.root
        self._pieces: list[str] = []
        self._linked = 0
        at, n = 0, len(source)
        while at < n:
            found = _token.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["close"]:
                self._close(name)
            else:
                self._open(name, found["attrs"])
                if name in RAW:
                    end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                    at = end.start() if end else n
        self._flush()

    def _text(self, raw: str) -> None:
        if self.stack[-1].mute:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self.open["a"]:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self.runs.append((self._block, text, self._linked))
            self._pieces = []
        self._linked = 0
        self._block = self.stack[-1].block

    def _open(self, name: str, raw: str) -> None:
        if name == "br":
            self._pieces.append(" ")
            return
        if name in VOID:
            if name in BLOCK:
                self._flush()
            return
        if name in BLOCK:
            if name in ENDS:
                self._end(*ENDS[name])
            if self.open["p"] and name not in ("html", "body", "option", "caption"):
                self._end({"p"}, {"table", "td", "th", "button"})
            if name in HEADING and self.stack[-1].tag in HEADING:
                self._cut(len(self.stack) - 1)
        attrs = _attributes(raw)
        words, sure = _words(attrs)
        drop = (
            name in FURNITURE
            or attrs.get("role", "").lower() in ROLES
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
        )
        node = Node(name, self.stack[-1], words, sure, drop)
        if name in ("article", "main") and not words & COMMENTS:
            for above in reversed(self.stack):  # a class alone does not condemn what holds the article
                if not above.words & COMMENTS:
                    above.words = frozenset()
                    if above.tag in ("article", "main"):
                        break  # what holds that one was cleared when it came
        if name not in BLOCK:
            in_article = self.open["article"] + self.open["main"] > 0
            node.mute = self.stack[-1].mute or _is_furniture(node, in_article, set())
        self.stack.append(node)
        self.open[name] += 1
        self.nodes.append(node)
        if name in BLOCK:
            self._flush()

    def _cut(self, at: int) -> None:
        """Close all elements from a place of the stack on."""
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def _end(self, names: set, limits: set) -> None:
        if not any(self.open[name] for name in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                self._cut(i)
                self._flush()
                if names == {"p"}:
                    return
                return self._end(names, limits)
            if self.stack[i].tag in limits:
                return

    def _close(self, name: str) -> None:
        if name == "br":
            self._pieces.append(" ")
            return
        if not self.open[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == name:
                self._cut(i)
                if name in BLOCK:
                    self._flush()
                return
            if name not in BLOCK and self.stack[i].tag in BLOCK:
                return


def _is_furniture(node: Node, in_article: bool, heads: set[int]) -> bool:
    if node.drop:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return bool(node.words & COMMENTS)
    if node.tag == "header":
        return not (in_article and id(node) in heads)
    if in_article and not node.sure:
        return False
    found = node.words & UNLIKELY
    return bool(found) and (bool(found & COMMENTS) or not node.words & LIKELY)


def _is_doubtful(node: Node) -> bool:
    """An element of an article with a telling word in a longer name, mostly links."""
    return bool(node.words & UNLIKELY) and not node.words & LIKELY and node.links > 0.5 * node.chars


def main_text(source: str | None) -> str:
    """The main text of one page, blocks joined by line breaks."""
    if not source:
        return ""
    page = Page(source)
    heads: set[int] = set()
    for node in page.nodes:
        above = node.parent if node.tag in HEADING else None
        while above is not None and id(above) not in heads:
            heads.add(id(above))
            above = above.parent
    out: set[int] = set()  # furniture and all in it
    article: set[int] = set()  # in an article or main element
    for node in page.nodes:
        above = node.parent
        if above is not None and id(above) in article or node.tag in ("article", "main"):
            article.add(id(node))
        if above is not None and id(above) in out or _is_furniture(node, id(node) in article, heads):
            out.add(id(node))
    runs = [r for r in page.runs if id(r[0]) not in out]
    if not runs:
        return ""
    for block, text, linked in runs:
        block.chars += len(text)
        block.links += linked
    for node in reversed(page.nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
    touched = {id(node): node for node in page.nodes if node.chars}
    paid: set[int] = set()
    for block, text, _ in runs:
        points = min(1.0, len(text) / 25) + text.count(",") + min(len(text) / 100, 3.0)
        node = block.parent if block.tag in PARAGRAPH and block.parent else block
        paid.add(id(node))
        level = 0
        while node is not None and level < REACH:
            node.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            node, level = node.parent, level + 1
    for node in touched.values():
        node.score += START.get(node.tag, 0) + (25 if node.words & LIKELY else 0)
        node.score *= 1 - min(1.0, node.links / max(1, node.chars))
    order = {id(n): i for i, n in enumerate(page.nodes)}
    rows = ("tr", "tbody", "thead", "tfoot")
    above = [n for n in touched.values() if (id(n) in paid or n.tag not in PARAGRAPH) and n.tag not in rows]
    best = max(above, key=lambda n: (n.score, -order[id(n)]))
    kept = {id(n) for n in _chosen(best, touched)}
    inside: set[int] = set()
    for node in page.nodes:
        at = id(node)
        if at in kept:
            inside.add(at)
        elif node.parent is not None and id(node.parent) in inside:
            left_out = _is_doubtful(node) if at in article else _is_link_list(node)
            if not left_out:
                inside.add(at)
    return "\n".join(text for block, text, _ in runs if id(block) in inside)


def _is_link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links > 0.6 * node.chars > 0


def _chosen(best: Node, touched: dict[int, Node]) -> list[Node]:
    """The best container and what belongs to it."""
    for wanted in ("article", "main"):
        widest, node = None, best
        while node is not None:
            if node.tag == wanted and not node.words & COMMENTS:
                widest = node
            node = node.parent
        if widest is not None:
            best = widest
            break
    chosen = [best]
    if best.parent is None or best.tag == "main":
        return chosen
    least = max(10.0, 0.2 * best.score)
    for node in touched.values():
        if node.parent is not best.parent or node is best:
            continue
        dense = node.links / max(1, node.chars)
        if node.score >= least and node.tag != "body" and dense < 0.25:
            chosen.append(node)
        elif best.tag != "article" and dense == 0 and (node.tag in HEADING or node.tag in ("p", "blockquote", "pre")):
            chosen.append(node)
    return chosen


def _extract_task(html_col: str, out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index(html_col))
            texts = pa.array([main_text(p.as_py()) for p in pages], pa.string())
            rest = [n for n in batch.schema.names if n.lower() != out.lower()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), texts], [*rest, out])

    return run


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` plus the main text of each page, in place of a column of that name if there is one."""
    rest = [f for f in pages.schema.fields if f.name.lower() != out.lower()]
    schema = T.StructType([*rest, T.StructField(out, T.StringType())])
    return pages.mapInArrow(_extract_task(html_col, out), schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).selectExpr("page_id", "url", "text", "cast(length(text) AS bigint) AS n_chars")
