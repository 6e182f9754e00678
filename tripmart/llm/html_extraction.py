"""Main text of web pages by tag-path ratios.

Text blocks carry the path of tags from the root. For each path of a page, text length and punctuation are added up
over its blocks and divided by their number; the block sequence of both ratios is smoothed, the two are
fused by multiplication, and paths whose mean exceeds a share of the page's spread are content. The container that holds
most of the selected text is the article; all of its blocks that are not boilerplate by their tags are its text. The search for
it ends at an article or main element; where there is none, content paths outside the container belong to the text, too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.llm.common import named

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas math audio video map".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea input option dialog menu".split())
CLOSES = {  # an opening tag that ends an open element, up to the nearest container
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
CONTAINERS = frozenset("ul ol dl table article section div main body html nav aside footer header form blockquote".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments respond reply replies discussion "
    "pagination pager widget toolbar skip copyright disclaimer".split()
)
# A name says what a container is by its last part that is none of these; names that begin with a switch say what it has.
FILLERS = frozenset(
    "area bar block body box button buttons container content group holder icons inner item items left link links list outer panel post "
    "posts right row section slot top bottom unit wrap wrapper zone".split()
)
SWITCHES = frozenset("with without has have no not is are hide show enable disable".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

CONTENT_SHARE = 0.8  # of the selected text that one child must hold for the descent to go on
SMOOTHING = (0.25, 0.5, 0.25)


def bad_name(name: str) -> bool:
    """Whether one class or id names boilerplate: ``primary-sidebar`` and ``share-buttons`` do, ``with-sidebar`` and ``related-work`` not."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()]
    if not parts or (parts[0] in SWITCHES and len(parts) > 1):
        return False
    while len(parts) > 1 and parts[-1] in FILLERS:
        parts.pop()
    return parts[-1] in BAD_NAMES


class _Node:
    __slots__ = ("tag", "path", "parent", "bad")

    def __init__(self, tag: str, parent: _Node | None, bad: bool, label: str):
        self.tag, self.parent = tag, parent
        self.path = (*(parent.path if parent else ()), label)
        self.bad = bad or (parent is not None and parent.bad)


class _Blocks(HTMLParser):
    """Collects (node, text) for each run of text between block boundaries; tolerant of unclosed tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = _Node("", None, False, "")
        self.hidden = 0
        self.parts: list[str] = []
        self.blocks: list[tuple[_Node, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            node = self.node
            while node.tag in INLINE and node.parent is not None:
                node = node.parent
            self.blocks.append((node, text))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            while self.node.tag in INLINE:  # an inline element left open ends with its block
                self.node = self.node.parent
            if self.node.tag == "p":  # paragraphs hold no blocks
                self.node = self.node.parent
            self._close_implied(CLOSES.get(tag, ()))
        if tag in VOID:
            return
        values = {k: (v or "").lower() for k, v in attrs}
        names = f"{values.get('class', '')} {values.get('id', '')}".split()
        outside = not any(n in ("article", "main") for n in self._tags())
        bad = (
            tag in HIDDEN or tag in BOILERPLATE or (tag == "header" and outside)
            or (tag not in ("html", "body", "article", "main") and (any(map(bad_name, names)) or values.get("role") in BAD_ROLES))
            or "hidden" in values or values.get("aria-hidden") == "true"
        )
        label = tag if tag in ("html", "body") else ".".join([tag, *sorted(filter(None, values.get("class", "").split()))])
        self.node = _Node(tag, self.node, bad, label)

    def _tags(self):
        node = self.node
        while node is not None:
            yield node.tag
            node = node.parent

    def _close_implied(self, closed: tuple[str, ...]) -> None:
        node = self.node
        while closed and node.parent is not None and node.tag not in CONTAINERS:
            if node.tag in closed:
                self.node = node.parent
            node = node.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self._tags():
            return
        if tag not in INLINE:
            self.flush()
        elif any(t not in INLINE for t in self._until(tag)):
            return  # an inline end does not close blocks
        while self.node.tag != tag:
            self.node = self.node.parent
        self.node = self.node.parent

    def _until(self, tag):
        for t in self._tags():
            if t == tag:
                return
            yield t

    def handle_data(self, data):
        if self.node.tag not in HIDDEN:
            self.parts.append(data)


def text_blocks(html: str) -> list[tuple[_Node, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def content_blocks(blocks: list[tuple[_Node, str]]) -> np.ndarray:
    """Which blocks lie on content paths: fused, smoothed ratios above half of the page's standard deviation."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in blocks:
        length[node.path] += len(text)
        marks[node.path] += len(PUNCTUATION.findall(text))
        count[node.path] += 1

    def smooth(ratio: dict) -> np.ndarray:
        values = np.array([ratio[node.path] / count[node.path] for node, _ in blocks], float)
        return np.convolve(np.pad(values, 1, mode="edge"), SMOOTHING, mode="valid")

    fused = smooth(length) * (1 + smooth(marks))
    by_path = defaultdict(list)
    for (node, _), value in zip(blocks, fused, strict=True):
        by_path[node.path].append(value)
    floor = min(fused.std() / 2, fused.max() / 2)
    chosen = {path for path, values in by_path.items() if np.mean(values) >= floor}
    return np.array([node.path in chosen for node, _ in blocks])


def main_text(html: str | None) -> str:
    """The article of a page; blocks in page order, joined by a blank. Null, empty and textless pages give the empty text."""
    blocks = [b for b in text_blocks(html or "") if not b[0].bad]
    if not blocks:
        return ""
    selected = content_blocks(blocks)
    inside: dict[int, int] = defaultdict(int)  # selected text below each element
    children: dict[int, dict[int, _Node]] = defaultdict(dict)
    root = None
    for (node, text), chosen in zip(blocks, selected, strict=True):
        while True:
            if chosen:
                inside[id(node)] += len(text)
            if node.parent is None:
                root = node
                break
            children[id(node.parent)][id(node)] = node
            node = node.parent
    total, top = inside[id(root)], root
    while top.tag not in ("article", "main"):  # these are articles as a whole
        heavy = [c for c in children[id(top)].values() if inside[id(c)] >= CONTENT_SHARE * total and _holds_blocks(c)]
        if not heavy:
            break
        top = heavy[0]
    whole = top.tag in ("article", "main")
    return " ".join(text for (node, text), chosen in zip(blocks, selected, strict=True) if (chosen and not whole) or _under(node, top))


def _holds_blocks(node: _Node) -> bool:
    """Only containers are articles; a single long paragraph is part of one."""
    return node.tag in CONTAINERS and node.tag not in ("ul", "ol", "dl", "table", "blockquote")


def _under(node: _Node | None, top: _Node) -> bool:
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, html = (batch.column(batch.schema.get_field_index(name)) for name in ("row", "html"))
        texts = [main_text(h.as_py()) for h in html]
        made = pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([row, *made], ["row", "text", "n_chars"])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` (its code points) in place of the html column; columns of those names are replaced.

    Each row by itself and without a shuffle, whole pages of any length; repeated rows give repeated results.
    """
    kept = [named(pages, c) for c in pages.columns if c not in (html, "text", "n_chars")]
    inputs = pages.select((F.struct(*kept) if kept else F.struct(F.lit(0))).alias("row"), named(pages, html).alias("html"))
    schema = T.StructType([inputs.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = inputs.mapInArrow(_extract_batches, schema)
    return found.select("row.*", "text", "n_chars") if kept else found.select("text", "n_chars")
