"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser is fed in pieces and gives events; block-level tags cut them into lines. Subtrees that are
navigation, forms, adverts, notices, comments and the like by tag, role, class or id are vetoed; of the other lines, a
line's ratio is its characters over its tags. The smoothed ratios are split into two clusters, and the lines of the upper
cluster are the seeds. The seeds choose the content region: the innermost container that holds four fifths of their text,
widened to the article or main element around it, if there is one. In an article every line is content, however short.
In a plain container, the containers within it that hold no seed (link lists, teasers) are not, but for headings.

The parser keeps a stack and counters, and each container its parent's number, so the work is in proportion to the page.

Defined results: a null html gives an empty text, a null url stays null; a page without markup is one line; a page whose
lines are all vetoed has no text; rows that repeat give repeated rows; other columns are ignored; a tag
that the page's end cuts off is no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship_by_value

ship_by_value(__name__)

PIECE = 1 << 16
SEED_SHARE = 0.8  # of the seeds' text, in the region
#: Fixed by HTML: elements without end tags, and elements that start a new line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input map menu meter nav noembed noframes noscript object option progress script select style svg template textarea title video".split())
REGION = frozenset("article main section div body td blockquote".split())
EXTENT = frozenset(("article", "main"))
#: An open element that the start of another ends: a paragraph by any block, an item by the next one.
ENDED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
SKIP_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIP_WORD = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert(?:s|isement|ising|orial)?|sponsor(?:ed|s)?|promo(?:tion|ted)?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscri(?:be|ption)"
    r"|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side-bar|footer|header|masthead|toolbar|pagination|pager|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|comments?|disqus|respond|replies|login|signup|search)(?:$|[^a-z])"
)
UNFINISHED = re.compile("<[a-zA-Z/!?]")
SPACE = re.compile(r"\s+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Lines(HTMLParser):
    """Collects lines that no veto covers: (text, tags, innermost container, whether a heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.regions: list[str] = []  # tag of each container, by number; numbers grow inwards
        self.parent: list[int] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it starts a vetoed subtree, container number or -1
        self.at: dict[str, list[int]] = {}  # places in `open`, by tag
        self.blocks: list[int] = []  # places in `open` of block elements
        self.inner: list[int] = []  # places in `open` of containers
        self.skipping = self.extents = self.headings = 0
        self.parts: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.open[self.inner[-1]][2] if self.inner else -1, self.headings > 0))
            self.tags = 0
        self.parts.clear()

    def _vetoed(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SKIP or (tag == "header" and not self.extents):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if value and (name == "role" and value.lower() in SKIP_ROLE or name in ("class", "id") and SKIP_WORD.search(value.lower())):
                return not (self.extents and tag in ("h1", "header") and name != "role")
            if name in ("hidden", "aria-hidden") and (value or "").lower() != "false" or name == "style" and UNSEEN.search((value or "").lower()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            while self.blocks and tag in ENDED_BY.get(self.open[self.blocks[-1]][0], ()):
                self._close(self.blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        vetoed, number, place = self._vetoed(tag, attrs), -1, len(self.open)
        if tag in REGION:
            number = len(self.regions)
            self.regions.append(tag)
            self.parent.append(self.open[self.inner[-1]][2] if self.inner else -1)
            self.inner.append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        self.open.append((tag, vetoed, number))
        self.at.setdefault(tag, []).append(place)
        self.skipping += vetoed
        self.extents += tag in EXTENT
        self.headings += tag in HEADING

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def _close(self, at: int) -> None:
        """Close the element at a place of `open`, and all inside."""
        while len(self.open) > at:
            tag, vetoed, number = self.open.pop()
            self.at[tag].pop()
            self.skipping -= vetoed
            self.extents -= tag in EXTENT
            self.headings -= tag in HEADING
            if number >= 0:
                self.inner.pop()
            if tag in BLOCK:
                self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if not self.at.get(tag):
            return
        at = self.at[tag][-1]
        # An inline end tag doesn't close the block around it, nor anything a container that it lies outside of.
        if tag in BLOCK or tag in SKIP or not (self.blocks and self.blocks[-1] > at):
            if tag in REGION or tag in SKIP or not (self.inner and self.inner[-1] > at):
                self._close(at)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)


def _smooth(ratio: np.ndarray, radius: int = 1) -> np.ndarray:
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / (2.0 * max(radius, 1) ** 2))
    return np.convolve(np.pad(ratio, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def _threshold(values: np.ndarray) -> float:
    """Two clusters on a line: the threshold halfway between their means, moved until it stays."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values < at], values[values >= at]
        now = at if not len(low) or not len(high) else (low.mean() + high.mean()) / 2
        if abs(now - at) < 1e-9:
            break
        at = now
    return at


def seed_lines(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Which lines are in the upper cluster of smoothed text-to-tag ratios."""
    smooth = _smooth(np.array([len(text) / max(1, tags) for text, tags, _, _ in lines], dtype=float))
    return smooth >= _threshold(smooth)


def _sums(values: list[int], parent: list[int]) -> list[int]:
    """Each container's own value and all those inside it."""
    for number in range(len(values) - 1, -1, -1):
        if parent[number] >= 0:
            values[parent[number]] += values[number]
    return values


def content_lines(parser: _Lines, seeds: np.ndarray) -> list[str]:
    """The lines of the region that the seeds choose."""
    lines, parent = parser.lines, parser.parent
    held, plain = [0] * len(parent), [0] * len(parent)
    total = 0
    for (text, _, inside, heading), seed in zip(lines, seeds, strict=True):
        if seed:
            total += len(text)
        if inside >= 0:
            held[inside] += len(text) * bool(seed)
            plain[inside] += not heading
    held, plain = _sums(held, parent), _sums(plain, parent)
    region = max((r for r, n in enumerate(held) if n >= SEED_SHARE * total and n), default=-1)
    extent = region
    while extent >= 0 and parser.regions[extent] not in EXTENT:
        extent = parent[extent]
    named = extent >= 0
    region = extent if named else region
    # from the outermost inwards: containers outside the region, and seedless ones inside a plain region, aren't content
    chosen = [False] * len(parent)
    for r, above in enumerate(parent):
        if r == region or above < 0 and region < 0:
            chosen[r] = region >= 0 or held[r] > 0 or not plain[r]
        elif above >= 0 and chosen[above]:
            chosen[r] = named or held[r] > 0 or not plain[r]
    return [text for text, _, inside, _ in lines if (chosen[inside] if inside >= 0 else region < 0)]


def parsed(html: str | None) -> _Lines:
    parser = _Lines()
    html = html or ""
    cut = UNFINISHED.search(html, html.rfind(">") + 1)
    html = html[: cut.start()] if cut else html
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    parser.close()
    parser.end_line()
    return parser


def main_text(html: str | None) -> str:
    """The lines of the content region, joined by line feeds."""
    parser = parsed(html)
    return "\n".join(content_lines(parser, seed_lines(parser.lines))) if parser.lines else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
