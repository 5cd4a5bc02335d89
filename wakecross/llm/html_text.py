"""The main text of web pages, from parser events and smoothed text-to-tag ratios."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import words

CHUNK_BYTES = 8 << 20
SIGMA = 1.0

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead "
    "title tr ul".split()
)
# Never part of a text, wherever they stand.
_OUT = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea title video".split()
)
_LANDMARKS = frozenset(["article", "main"])
_WHOLE = frozenset(["html", "body", "article", "main"])
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split()
)
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu submenu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments commentlist disqus replies respond "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share "
    "sharing social related recommended recommendations pagination pager widget widgets login signin signup search toolbar "
    "skip hidden".split()
)
_TEXTUAL = re.compile(r"content|article|entry|story|post-?body|main", re.I)
_REMARKS = frozenset(["comment", "comments", "commentlist", "disqus", "replies", "respond"])
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# A paragraph or list item that is not closed ends where the next one begins.
_ENDS_BEFORE = {
    "p": _BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "option": frozenset(["option"]),
}


def _set_aside(tag: str, attributes: list, within: bool) -> bool:
    """Whether an element is no part of a text by its name, role, state or class; a header is one only outside a landmark."""
    if tag in _OUT or tag == "header" and not within:
        return True
    for name, value in attributes:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if tag in _WHOLE:
            continue
        if name == "role" and value.lower() in _ROLES or name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id"):
            parts = {part.lower() for part in _PARTS.findall(value)}
            if parts & _REMARKS or parts & _NAMES and not _TEXTUAL.search(value):
                return True
    return False


class _Lines(HTMLParser):
    """Collects lines of text: one per block, with its tags, the text in links, and the elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Open elements: tag, set aside, landmark around it (0: none), number.
        self.open = [("", False, 0, 0)]
        self.elements = self.landmarks = self.links = 0
        self.lines = []
        self._fresh()

    def _fresh(self):
        self.parts, self.tags, self.linked = [], 0, 0

    def _end_line(self):
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            _, aside, landmark, _ = self.open[-1]
            parent = next((number for tag, _, _, number in reversed(self.open) if tag != "p" and tag in _BLOCKS), 0)
            self.lines.append((text, self.tags, self.linked, aside, landmark, parent))
        self._fresh()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end_line()
            for k in range(len(self.open) - 1, 0, -1):
                name = self.open[k][0]
                if tag in _ENDS_BEFORE.get(name, ()):
                    del self.open[k:]
                    break
                if name in _BLOCKS:
                    break
        elif tag in ("br", "td", "th", "img"):
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        _, aside, landmark, _ = self.open[-1]
        if not aside and _set_aside(tag, attrs, landmark > 0):
            self._end_line()
            aside = True
        if tag in _LANDMARKS and not landmark and not aside:
            self.landmarks += 1
            landmark = self.landmarks
        self.elements += 1
        self.open.append((tag, aside, landmark, self.elements))
        self.links += tag == "a"

    def handle_endtag(self, tag):
        self.tags += 1
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in _BLOCKS or self.open[k][1] != self.open[k - 1][1]:
                    self._end_line()
                self.links = max(0, self.links - sum(name == "a" for name, *_ in self.open[k:]))
                del self.open[k:]
                return
        if tag in _BLOCKS:
            self._end_line()

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def result(self, html: str) -> list[tuple]:
        self.feed(html)
        self.close()
        self._end_line()
        return self.lines


def _smoothed(values: np.ndarray) -> np.ndarray:
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    return np.convolve(values, kernel / kernel.sum())[3 : 3 + len(values)]


def main_text(html: str | None) -> str:
    """The text of the content regions, one block per line.

    A line's ratio is its characters outside links per tag, and 0 for what is set aside. Ratios are
    smoothed; lines above the mean form clusters. Where clusters lie in landmarks (article, main),
    the regions are the landmarks that hold them; else they reach from cluster to cluster
    and over all blocks beside them in the same element. Nothing in a region is left out but what is set aside.
    """
    lines = _Lines().result(html or "")
    texts = [k for k, line in enumerate(lines) if line[0] and not line[3]]
    if not texts:
        return ""
    ratio = np.array([0 if aside else max(len(t) - linked, 0) / max(tags, 1) for t, tags, linked, aside, _, _ in lines], float)
    smooth = _smoothed(ratio)
    level = min(smooth[texts].mean(), smooth[texts].max())
    dense = {k for k in texts if smooth[k] >= level and ratio[k] > 0} or {max(texts, key=lambda k: len(lines[k][0]))}
    landmarks = {lines[k][4] for k in dense} - {0}
    if landmarks:
        chosen = [k for k in texts if lines[k][4] in landmarks]
    else:
        clusters, last = [], None
        for k in sorted(dense):
            if last is None or any(lines[j][3] and lines[j][0] for j in range(last, k)):
                clusters.append([])
            clusters[-1].append(k)
            last = k
        size = [sum(len(lines[k][0]) for k in cluster) for cluster in clusters]
        kept = [c for c, n in zip(clusters, size, strict=True) if 4 * n >= max(size)]
        parents = {lines[k][5] for cluster in kept for k in cluster}
        inside = {k for cluster in kept for k in range(cluster[0], cluster[-1] + 1)}
        chosen = [k for k in texts if k in inside or lines[k][5] in parents]
    return "\n".join(lines[k][0] for k in chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "_html", CHUNK_BYTES):
            texts = [main_text(html) for html in part.column("_html").to_pylist()]
            rest = part.drop_columns(["_html"])
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *added], names=[*rest.schema.names, "text", "n_chars"])


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """text and n_chars (code points) for every row of html; a null or empty page has an empty text.

    Character references are decoded, white space in a block becomes one space, blocks are joined by line feeds.
    Columns in ``keep`` are passed on, repeated rows are treated alike.
    """
    frame = pages.select(*keep, F.col("html").cast("string").alias("_html"))
    return frame.mapInArrow(_extract, words.extended(frame, "text string, n_chars long"))
