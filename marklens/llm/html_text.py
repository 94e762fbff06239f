"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block of the page. Every line weighs as much as the text in it that is not
link text; lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments weigh nothing. The
weights are summed over a sliding window of lines. Where the sum surges above a threshold the main text begins, where it
dives to nothing it ends, and what stands between is kept. The threshold is lower on a page without any such sum.

Tags still decide two things: lines that a page puts into its article weigh more, so the surge is there also for an
article of a few words, and if the article holds most of the text that is not furniture, other lines weigh nothing.

One Arrow stage, each page in its row: no shuffle, and time linear in the size of a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table

WINDOW = 3
SURGE = 86
ARTICLE_BONUS = 100

# --- fixed values: HTML element names (HTML standard) -------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video map datalist".split())
# What may stand in a head; any other element ends it, with or without an end tag.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
_FURNITURE = frozenset("nav aside footer button select textarea option fieldset label dialog menu".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "caption legend option select textarea".split()
)
# Start tag -> open elements that it ends, up to the nearest element of the second set.
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_KEEPS_PARAGRAPH_OPEN = frozenset("td th li dd dt tr tbody thead tfoot caption option body html head".split())

# --- fixed values: words by which pages name what is not main text -------------------------------

_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus dropdown footer form header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promos promoted promotion recommended recommendations related "
    "replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe "
    "subscription tagcloud teaser teasers toolbar topbar widget widgets".split()
)
_FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split()
)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT_TAG = re.compile(r"</?[a-zA-Z]")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_furniture(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    if tag in _FURNITURE or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if (attributes.get("role") or "").lower() in _FURNITURE_ROLES or _NOT_SHOWN.search(attributes.get("style") or ""):
        return True
    if tag == "form":  # what it holds decides
        return False
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
    return any(part.lower() in _FURNITURE_WORDS for part in _NAME_PARTS.findall(names))


@dataclass(slots=True)
class Line:
    text: str
    link_length: int
    furniture: bool
    in_article: bool
    form: int = 0

    @property
    def weight(self) -> int:
        """Zero for furniture and for lines of nothing but links outside an article."""
        if self.furniture:
            return 0
        own = len(self.text) - self.link_length
        return max(1, own) + ARTICLE_BONUS if self.in_article else own


class _Lines(HTMLParser):
    """Cuts a page into lines; open elements are tracked just far enough to know what a line is part of."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Open elements: tag, whether it or one around it is unseen, furniture, article, and the number of its form.
        self.open: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
        self.count: Counter[str] = Counter()
        self.forms = 0
        self.text: list[str] = []
        self.linked = 0
        self.in_link = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, furniture, article, form = self.open[-1]
            self.lines.append(Line(text, min(self.linked, len(text)), furniture, article, form))
        self.text.clear()
        self.linked = 0

    def _close(self, depth: int) -> None:
        """Ends the open elements from `depth` on; where what a line is part of changes, so does the line."""
        for tag, *state in reversed(self.open[depth:]):
            if tag in _BLOCKS or state != list(self.open[depth - 1][1:]):
                self.end_line()
            self.in_link -= tag == "a"
            self.count[tag] -= 1
            self.open.pop()

    def _find(self, tags, barriers) -> int:
        if not any(self.count[tag] for tag in tags):
            return 0
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] in tags:
                return depth
            if self.open[depth][0] in barriers:
                break
        return 0

    def _end_head(self) -> None:
        if self.count["head"] and self.open[-1][0] == "head":
            self._close(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _IN_HEAD:
            self._end_head()
        if tag in _VOID:
            if tag in _BLOCKS:
                self.end_line()
            elif tag == "br":
                self.text.append("\n")
            return
        if tag in _BLOCKS:
            self.end_line()
            if tag not in _KEEPS_PARAGRAPH_OPEN and (depth := self._find({"p"}, _BLOCKS - {"p"})):
                self._close(depth)
            if tag in _ENDED_BY and (depth := self._find(*_ENDED_BY[tag])):
                self._close(depth)
        if tag == "a" and (depth := self._find({"a"}, _BLOCKS)):
            self._close(depth)
        _, unseen, furniture, article, form = self.open[-1]
        article = article or tag in ("article", "main")
        if tag == "form" and not form:
            self.forms += 1
            form = self.forms
        if tag in _UNSEEN:
            self.open.append((tag, True, furniture, article, form))
        else:
            now = furniture or _is_furniture(tag, dict(attrs), article)
            if now != furniture:
                self.end_line()
            self.open.append((tag, unseen, now, article, form))
        self.count[tag] += 1
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        barriers = () if tag in _BLOCKS or tag in _UNSEEN else _BLOCKS
        depth = self._find({tag}, barriers)
        if depth:
            self._close(depth)
        elif tag in _BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if self.open[-1][1]:
            return
        self.text.append(data)
        if self.in_link:
            self.linked += len(data.strip())


def page_lines(html: str) -> list[Line]:
    """The lines of a page; a form is furniture unless it holds most of the page's other text."""
    reader = _Lines()
    reader.feed(html)
    if _CUT_TAG.match(reader.rawdata):  # the page stops inside a tag
        reader.rawdata = ""
    reader.close()
    reader.end_line()
    held: Counter[int] = Counter()
    for line in reader.lines:
        held[line.form] += 0 if line.furniture else len(line.text)
    most = held.total() / 2
    for line in reader.lines:
        if line.form and held[line.form] <= most:
            line.furniture = True
    return reader.lines


def _weights(lines: list[Line]) -> list[int]:
    """Weights of the lines; if the article holds most of the text, only its lines have any."""
    inside = sum(len(line.text) for line in lines if line.in_article and not line.furniture)
    outside = sum(len(line.text) for line in lines if not line.in_article and not line.furniture)
    if inside and inside >= outside:
        return [line.weight if line.in_article else 0 for line in lines]
    return [line.weight for line in lines]


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The lines between surge and dive points, without furniture.

    Block i is the sum of the weights of lines i to i + window - 1. Main text begins at a line whose block is above
    the threshold and that has weight itself, and ends where a block is empty. The threshold is `surge`, or half the
    largest block of a page whose blocks are all below it.
    """
    weights = _weights(lines)
    blocks, total = [0] * len(lines), 0
    for at in range(len(lines) - 1, -1, -1):
        total += weights[at] - (weights[at + window] if at + window < len(lines) else 0)
        blocks[at] = total
    most = max(blocks, default=0)
    threshold = surge if most > surge else most / 2
    kept: list[Line] = []
    inside = False
    for line, weight, block in zip(lines, weights, blocks, strict=True):
        if not inside:
            inside = block > threshold and weight > 0
        elif block == 0:
            inside = False
        if inside and weight > 0:
            kept.append(line)
    return kept


def main_text(html: Column, window: int = WINDOW, surge: int = SURGE) -> Column:
    """The main text of a page, its blocks joined by an empty line; empty where there is none, or the page is NULL."""

    def rows(pages: list[str]) -> Iterator[tuple]:
        for page in pages:
            yield ("\n\n".join(line.text for line in main_lines(page_lines(page), window, surge)),)

    return per_text("text string", rows)(F.coalesce(html, F.lit("")))["text"]


def extracted(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row per page: the given columns, `text` and `n_chars`, its number of code points.

    NULL and empty pages have an empty text. Repeated rows and NULL ids are rows like any other. An empty input gives
    an empty result.
    """
    texts = pages.select(*columns, main_text(F.col(html)).alias("text"))
    return texts.select(*columns, "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
