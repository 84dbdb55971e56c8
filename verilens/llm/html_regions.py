"""Main text of web pages from streamed parser events (operator 2).

The standard library's parser is fed the page and its events build lines, one for
each block of text, with the characters and tags that belong to it; scripts, styles
and other invisible elements give none.  A line's text-to-tag ratio is smoothed over
its neighbours with a Gaussian, and clustering the smoothed ratios into two gives
the threshold between content and boilerplate.

Content regions: lines inside ``article`` or ``main`` belong to their container,
which is taken as a whole if one of its lines reaches the threshold (or if no
container does).  On pages without containers, the lines of a ``div``, ``section``,
``td`` or the page itself are one region; ratios are smoothed and clustered as
logarithms, and it is content if its mean, weighted by characters, reaches the
threshold; its lines that are mostly links go.  Where the clusters lie less than ``APART`` times
apart all lines are alike, and all regions are content.  Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, known by element, role, class or id, never are
content and count as ratio 0.  That holds for each piece of a line, so an inline
button leaves the rest of its paragraph; a class or id drops no element that holds an
``article``, ``main`` or most of the page's text.

Scale: one pass, no shuffle; a page is held by one task only while it is read.

Cases: null, empty and tagless pages give an empty text, or for plain text the text
itself; unclosed elements end with what holds them or with the page; repeated rows
and null ids are pages of their own; extra columns are left aside; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav aside footer form menu button select textarea label dialog input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CONTAINERS = frozenset(("article", "main"))
#: Words of a class or id that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie"
    " cookies consent disclaimer disqus footer form hidden masthead menu modal nav navbar navigation newsletter"
    " notice notices notification pagination pager popup promo promoted promotion related replies respond share"
    " sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget"
    " widgets".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose own lines are judged together on pages without containers.
REGIONS = frozenset(("div", "section", "td"))
SIGMA = 1.0
#: How many times the ratio of boilerplate that of content is at least.
APART = 2.0
#: An open element of the key's kind ends where one of the values' kinds starts.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option",)),
}


class Line:
    """A block's text in pieces: text, dropped, class marks around it, linked, container."""

    __slots__ = ("pieces", "region", "tags")

    def __init__(self, region: int) -> None:
        self.pieces: list[tuple[str, bool, tuple[int, ...], bool, int]] = []
        self.region, self.tags = region, 0


class Lines(HTMLParser):
    """Collects lines from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # tag, dropped, hidden, container, class marks, region
        self.open: list[tuple[str, bool, bool, int, tuple[int, ...], int]] = []
        self.containers = self.marks = self.regions = 0
        #: Class marks that hold an article or main.
        self.holders: set[int] = set()
        self.line: Line | None = None
        self.pending = 0

    def state(self) -> tuple[bool, bool, int, tuple[int, ...], int]:
        return self.open[-1][1:] if self.open else (False, False, 0, (), 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.pending += 1
        if tag in BLOCKS:
            self.line = None
            self.end_implied(tag)
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        dropped, hidden, container, marks, region = self.state()
        if tag in REGIONS:
            self.regions += 1
            region = self.regions
        hidden = hidden or tag in HIDDEN
        dropped = dropped or self.boilerplate(tag, dict(attrs), container)
        if self.named(tag, dict(attrs)):
            self.marks += 1
            marks = (*marks, self.marks)
        if tag in CONTAINERS and not dropped and not hidden and not container:
            self.containers += 1
            container = self.containers
            self.holders.update(marks)
        self.open.append((tag, dropped, hidden, container, marks, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def boilerplate(self, tag: str, attrs: dict[str, str | None], container: int) -> bool:
        if tag in BOILERPLATE or tag == "header" and not container:
            return True
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES

    def named(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in ("html", "body", "main", "article"):
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return any(w.lower() in MARKS for w in WORD.findall(names))

    def end_implied(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if tag in ENDED_BY.get(name, ()):
                del self.open[at:]
                return
            if name in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.pending += 1
        if tag in BLOCKS:
            self.line = None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return
            # an inline end tag without its start does not reach out of its block
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        dropped, hidden, container, marks, region = self.state()
        if hidden:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(region)
            self.lines.append(self.line)
        self.line.pieces.append((data, dropped, marks, any(tag == "a" for tag, *_ in self.open), container))
        self.line.tags += self.pending
        self.pending = 0

    def boilerplate_marks(self) -> set[int]:
        """Class marks but those that hold an article, main or most of the page's text."""
        held: Counter[int] = Counter()
        total = 0
        for line in self.lines:
            for text, dropped, marks, _, _ in line.pieces:
                if not dropped:
                    size = len("".join(text.split()))
                    total += size
                    held.update(dict.fromkeys(marks, size))
        return {m for m in range(1, self.marks + 1) if m not in self.holders and 2 * held[m] <= total}


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, weights)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of the values (2-means on the line)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        border = (low + high) / 2
        below, above = values[values <= border], values[values > border]
        if not len(above) or not len(below):
            return low
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_regions(regions: np.ndarray, smooth: np.ndarray, sizes: np.ndarray) -> set[int]:
    """Regions whose mean of ``smooth``, weighted by ``sizes``, reaches the border between the lines' two clusters."""
    logs = smooth[sizes > 0]
    border = threshold(logs)
    above = logs >= border
    if above.all() or logs[above].mean() - logs[~above].mean() < np.log(APART):
        return set(regions.tolist())
    weight, total = np.bincount(regions, sizes), np.bincount(regions, sizes * smooth)
    return set(np.flatnonzero((weight > 0) & (total >= border * weight)).tolist())


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    off = parser.boilerplate_marks()
    rows = []  # text, tags, linked characters, container; without what is dropped
    for line in parser.lines:
        kept = [p for p in line.pieces if not p[1] and off.isdisjoint(p[2])]
        text = " ".join("".join(p[0] for p in kept).split())
        linked = sum(len(p[0]) for p in kept if p[3])
        rows.append((text, line.tags, linked, next((p[4] for p in kept if p[0].strip()), 0)))
    if not any(text for text, *_ in rows):
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, *_ in rows])
    smooth = smoothed(ratios)
    border = threshold(smooth)
    high = (smooth >= border) & (ratios > 0)
    inside = {container for text, _, _, container in rows if container and text}
    if inside:
        reached = {row[3] for row, up in zip(rows, high, strict=True) if up} & inside
        chosen = reached or inside
        return "\n".join(text for text, _, _, container in rows if container in chosen and text)
    regions = np.array([line.region for line in parser.lines])
    sizes = np.array([len(text) if 2 * linked <= len(text) else 0 for text, _, linked, _ in rows])
    if not sizes.any():
        return ""
    content = content_regions(regions, smoothed(np.log1p(ratios)), sizes)
    return "\n".join(row[0] for row, at, size in zip(rows, regions, sizes, strict=True) if size and at in content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [main_text(html) for html in rows["html"]]
            yield pd.DataFrame(
                {
                    "page_id": rows["page_id"],
                    "url": rows["url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                }
            )

    # ids as text: pandas has no exact long column with nulls
    return (
        pages.select(
            F.col("page_id").cast("long").cast("string").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        )
        .mapInPandas(read, "page_id string, url string, text string, n_chars long")
        .withColumn("page_id", F.col("page_id").cast("long"))
    )
