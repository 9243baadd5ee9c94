"""Main text of article pages by text-to-tag ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
OUTSIDE = frozenset("script style noscript template head nav header footer aside form button select option textarea label iframe object "
                    "svg canvas audio video map dialog menu".split())
#: Elements that end a block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                  "h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that may hold the article.
CONTAINER = frozenset("body article main section div td".split())
#: Names in class, id or role that mark menus, notices, adverts and reader comments.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|breadcrumbs?|comments?|replies|cookies?|consent|notice|gdpr|disclaimer|copyright|"
    r"footer|header|masthead|menu|nav|navbar|navigation|newsletter|subscribe|pagination|pager|popup|modal|related|recommended|share|sharing|"
    r"sidebar|side|social|toolbar|widget|login|search|complementary|contentinfo)(?:$|[\s_-])", re.IGNORECASE)
#: Width of the smoothing, in lines, and the share of content that article or main elements must hold to be the region.
SIGMA, SHARE = 1.0, 0.9


class Lines(HTMLParser):
    """Collects one line per block from the parser's events: its text, its tags, its containers, is it a headline."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.kinds: list[str] = []  # of every container seen
        self.stack: list[tuple[str, bool, int | None]] = []  # tag, left out, container
        self.text: list[str] = []
        self.tags = 0
        self.outside = 0

    def close_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            block = next((tag for tag, _, _ in reversed(self.stack) if tag in BLOCK), "")
            self.lines.append((text, self.tags, tuple(c for _, _, c in self.stack if c is not None), block == "h1"))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.close_line()
            # A new block ends an open paragraph.
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    self.cut(k)
                    break
                if self.stack[k][0] in CONTAINER:
                    break
        elif tag == "br":
            self.text.append(" ")
        if not self.outside:
            self.tags += 1
        if tag in VOID:
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        out = tag in OUTSIDE or hidden or (tag not in ("html", "body", "article", "main") and bool(MARKS.search(names)))
        if out and not self.outside:
            self.close_line()
        container = None
        if tag in CONTAINER:
            container = len(self.kinds)
            self.kinds.append("main" if "main" in [v for k, v in attrs if k == "role"] else tag)
        self.stack.append((tag, out, container))
        self.outside += out

    def cut(self, k: int) -> None:
        for tag, out, _ in self.stack[k:]:
            self.outside -= out
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.close_line()
        if not self.outside:
            self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if any(out for _, out, _ in self.stack[k:]):
                    self.text = []
                self.cut(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.outside:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self.close_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel, "full")[reach:len(ratios) + reach]
    return total / np.convolve(np.ones(len(ratios)), kernel, "full")[reach:len(ratios) + reach]


def main_text(html: str | None) -> str:
    """The article of one page; empty if there is none."""
    # A page cut inside a tag or comment has no text there.
    html = re.sub(r"<(?:[A-Za-z/!][^<>]*|!--(?:(?!-->).)*)$", "", html or "", flags=re.DOTALL)
    parser = Lines()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, *_ in parser.lines]))
    # Lines from the spread of the smoothed ratios on are content; at least the densest one is.
    content = ratios >= min(ratios.std(), ratios.max())
    mass: dict[int, int] = {}
    total = 0
    for (text, _, containers, _), is_content in zip(parser.lines, content, strict=True):
        if is_content:
            total += len(text)
            for c in containers:
                mass[c] = mass.get(c, 0) + len(text)

    def held(region: set[int]) -> int:
        return sum(len(text) for (text, _, containers, _), k in zip(parser.lines, content, strict=True) if k and region.intersection(containers))

    for kind in ("article", "main"):
        region = {c for c in mass if parser.kinds[c] == kind}
        if region and held(region) >= SHARE * total:
            break
    else:
        # The innermost container around all of the content; the whole page if there is none.
        region = {c for c in [max((c for c in mass if mass[c] == total), default=None)] if c is not None}
    # Content and headlines beside the region are text too.
    return "\n".join(text for (text, _, containers, headline), k in zip(parser.lines, content, strict=True)
                     if not region or k or headline or region.intersection(containers))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of downloaded article pages.

    Input: ``article_id``, ``source_url``, ``html`` (the whole page; other columns are ignored).
    Output per input row: ``article_id``, ``source_url``, ``text``.  Parser events are gathered
    into one line per block, each with its ratio of text to tags; ratios are smoothed with
    a Gaussian, lines from the spread of the ratios on are content.  The region is the article
    elements, or else main, if they hold nearly all of the content, or else the innermost
    block around all of it.  All lines of the region and all content and h1 headlines beside it
    are kept, in page order, but for menus, headers, footers, asides, notices, adverts, forms
    and reader comments.

    A null or empty page, or one without text, has an empty text; broken markup is read as
    far as it goes; rows without an id, repeated rows and very long pages are read alike.
    """
    rows = pages.select("article_id", "source_url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["article_id", "source_url", "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")
