"""HTML extraction by text-to-tag ratios.

Pages are read as a stream of events of the standard library's parser and cut
into lines: at line breaks of the source and at block-level tags.  Each line
has the ratio of its characters to its tags; ratios are smoothed by a Gaussian
and split by a threshold, and runs of lines above it are the content regions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory

SIGMA = 1.0
_HIDDEN = frozenset("script style noscript template head svg math iframe object select textarea title".split())
_VOID_HIDDEN = frozenset("svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button canvas dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol "
    "option p pre section table tbody td tfoot th thead tr ul".split()
)

#: Start tags that don't end a head whose end tag is left out.
_IN_HEAD = {"head", "title", "meta", "link", "style", "script", "base", "basefont", "bgsound", "noscript", "template"}


class _Lines(HTMLParser):
    """Collects (text, tags) of each line from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.now: list[str] = []
        self.count = 0
        self.hidden: list[str] = []

    def line(self) -> None:
        text = " ".join("".join(self.now).split())
        if text or self.count:
            self.texts.append(text)
            self.tags.append(self.count)
        self.now, self.count = [], 0

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a declaration that the parser doesn't know
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if self.hidden[-1:] == ["head"] and tag not in _IN_HEAD:
            self.hidden.pop()  # a head without end tag
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()  # a head that was never closed
        if tag in _BLOCK:
            self.line()
        self.count += 1

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.line()
        self.count += 1

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        self.count += 1
        if tag in _BLOCK:
            self.line()

    def handle_data(self, data):
        if self.hidden:
            return
        first, *rest = data.split("\n")
        self.now.append(first)
        for part in rest:
            self.line()
            self.now.append(part)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends."""
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    ones = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / ones


def content_lines(texts: list[str], tags: list[int], sigma: float = SIGMA) -> np.ndarray:
    """Which lines are content: smoothed ratio at least the standard deviation of the smoothed ratios, or their mean if that is less.

    Lines without text are none.
    """
    if not texts:
        return np.zeros(0, bool)
    size = np.array([len(t) for t in texts], float)
    even = smooth(size / np.maximum(1, np.array(tags)), sigma)
    return (even >= min(even.std(), even.mean())) & (size > 0) if even.std() > 0 else size > 0


def extract(html: str, sigma: float = SIGMA) -> tuple[str, int, int]:
    """Content text (a line for a content line, an empty one between regions), regions, lines."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.line()
    keep = content_lines(parser.texts, parser.tags, sigma)
    out: list[str] = []
    regions, last = 0, -2
    worded = [i for i, t in enumerate(parser.texts) if t]
    for place, i in enumerate(worded):
        if keep[i]:
            if place != last + 1:
                regions += 1
                if out:
                    out.append("")
            out.append(parser.texts[i])
            last = place
    return "\n".join(out), regions, len(worded)


def extract_pages(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """``page_id, text, n_regions, n_lines`` of every row, from its whole html.

    A null html has a null text and no lines, an empty one an empty text.
    Markup that doesn't parse is read as far as the parser's events go,
    declarations it doesn't know are comments; text outside any tag is a line
    of its own.  A page is read whole, however long.  Rows are read one by one: repeated
    rows repeat, a null page_id stays null, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [(None, 0, 0) if h is None else extract(h, sigma) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], ["page_id", "text", "n_regions", "n_lines"]
                )

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_memory.lean(run), "page_id bigint, text string, n_regions int, n_lines int")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
