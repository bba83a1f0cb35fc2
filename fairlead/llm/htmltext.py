"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Each page is read by the standard library's streaming HTML parser. Its events are cut into lines: a line ends where a
block element starts or ends and at ``<br>``. A line holds the text of its data events and the number of tags seen in it.
Scripts, styles, the document head, menus, headers, footers, sidebars, notices, adverts, forms, comment sections and hidden
elements are boilerplate containers: their text never reaches a line, their tags count against the line they sit in.

The text-to-tag ratio of a line is its number of non-blank characters over its number of tags (at least one). Ratios are
smoothed by a Gaussian kernel over neighbouring lines, so that a short heading inside an article inherits its paragraphs'
weight. The smoothed ratios of lines with text are then clustered by one-dimensional k-means with three centroids, one of
them held at zero: lines nearest to zero are link lists and other tag-dense leftovers, the rest are content regions.

Output text: the content lines' text in page order, character references decoded, runs of HTML white space (space, tab,
line feed, form feed, carriage return) turned into one space, each line trimmed, lines with text joined by one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values. Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Fixed values. Elements that never hold main text.
SKIPPED = frozenset(
    "aside button canvas dialog footer form head iframe input menu nav noscript object option script select style svg template "
    "textarea title".split())
#: Fixed values. Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values. Words of class, id or role that mark a boilerplate container.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|"
    r"disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|reply|replies|share|"
    r"sidebar|social|sponsored|subscribe|widget)(?:$|[\s_-])", re.I)
HTML_SPACE = re.compile(r"[ \t\n\f\r]+")
#: Gaussian kernel over lines: standard deviation and reach in lines.
SIGMA, REACH = 1.0, 3


class _Lines(HTMLParser):
    """Parser events into lines of (text, tags)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0]]
        self.stack: list[str] = []
        self.skip_from: int | None = None
        self.articles = 0

    def _break(self):
        if self.lines[-1][0] or self.lines[-1][1]:
            self.lines.append([[], 0])

    def _boilerplate(self, tag: str, attrs) -> bool:
        found = dict((k, v or "") for k, v in attrs)
        if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return True
        if tag == "header" and not self.articles:
            return True
        if tag in SKIPPED:
            return True
        return any(BOILERPLATE.search(found.get(k, "")) for k in ("class", "id", "role"))

    def handle_starttag(self, tag, attrs):
        self.lines[-1][1] += 1
        if tag in VOID:
            if tag in ("br", "hr") and self.skip_from is None:
                self._break()
            return
        if tag in BLOCKS and self.skip_from is None:
            self._break()
        if self.skip_from is None and self._boilerplate(tag, attrs):
            self.skip_from = len(self.stack)
        self.stack.append(tag)
        if tag in ("article", "main"):
            self.articles += 1

    def handle_startendtag(self, tag, attrs):
        self.lines[-1][1] += 1
        if tag in ("br", "hr") and self.skip_from is None:
            self._break()

    def handle_endtag(self, tag):
        self.lines[-1][1] += 1
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if top in ("article", "main"):
                self.articles -= 1
            if self.skip_from is not None and len(self.stack) <= self.skip_from:
                self.skip_from = None
            if top == tag:
                break
        if tag in BLOCKS and self.skip_from is None:
            self._break()

    def handle_data(self, data):
        if self.skip_from is None:
            self.lines[-1][0].append(data)


def _smooth(values: np.ndarray) -> np.ndarray:
    offsets = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-0.5 * (offsets / SIGMA) ** 2)
    padded = np.pad(values, REACH, mode="constant")
    weights = np.convolve(np.pad(np.ones_like(values), REACH, mode="constant"), kernel, mode="valid")
    return np.convolve(padded, kernel, mode="valid") / weights


def _content(smoothed: np.ndarray) -> np.ndarray:
    """Lines not nearest to the centroid held at zero, by k-means with two free centroids."""
    if smoothed.size == 0:
        return np.zeros(0, dtype=bool)
    free = np.array([np.quantile(smoothed, 0.5), smoothed.max()], dtype=float)
    for _ in range(100):
        centres = np.concatenate([[0.0], free])
        nearest = np.abs(smoothed[:, None] - centres[None, :]).argmin(axis=1)
        moved = np.array([smoothed[nearest == k + 1].mean() if (nearest == k + 1).any() else free[k] for k in range(2)])
        if np.allclose(moved, free):
            break
        free = moved
    return nearest > 0


def main_text(html: str | None) -> str:
    """Main text of one page; '' for null, empty or text-free pages. Malformed markup is read as the parser reads it."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    texts = [HTML_SPACE.sub(" ", "".join(parts)).strip(" ") for parts, _ in parser.lines]
    tags = np.array([max(1, n) for _, n in parser.lines], dtype=float)
    chars = np.array([len(t.replace(" ", "")) for t in texts], dtype=float)
    smoothed = _smooth(chars / tags)
    has_text = chars > 0
    keep = np.zeros(len(texts), dtype=bool)
    keep[has_text] = _content(smoothed[has_text])
    return " ".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of column ``html`` in ``text`` and its number of code points in ``n_chars``.

    One output row per input row, in any order, repeated rows and null keys included; null html gives '' and 0. Existing
    columns named ``text`` or ``n_chars`` are replaced; other columns pass through the Arrow batches unchanged.
    """
    rest = [c for c in pages.columns if c not in (text, n_chars)]
    schema = T.StructType([pages.schema[c] for c in rest]
                          + [T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(h) for h in batch[html]]
            out = batch[rest].copy()
            out[text] = found
            out[n_chars] = np.array([len(t) for t in found], dtype=np.int64)
            yield out

    return pages.mapInPandas(run, schema)
