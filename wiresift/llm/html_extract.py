"""Main text of web pages by tag ratios.

A streaming parser turns a page into lines, one per block. Each line's text length
over its number of tags is smoothed along the page with a Gaussian, and a
threshold between the two clusters of ratios selects the content regions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm.common import pieces

SIGMA = 1.5
FEED = 1 << 16

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold no article text, whatever their length.
_NEVER = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea "
    "fieldset svg math iframe object canvas audio video dialog menu map datalist".split())
_SECTION = frozenset("html body main article section div td th table tr tbody ul ol dl blockquote figure details".split())
_ARTICLE = frozenset(("article", "main"))
# Words of class, id, role or aria-label that name a page's furniture,
_FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments "
    "contentinfo cookie cookies consent disqus footer gdpr masthead menu menus "
    "modal nav navbar navigation navigational newsletter "
    "popup promo promoted promotion sidebar sidebars sponsor sponsored talkback".split())
# those that do so on a part of a page alone or beside words like the ones below,
_SOFT = frozenset(
    "complementary disclaimer discussion feedback header login notice notices overlay pager pagination reactions related "
    "reply replies respond response responses search share sharing signup social subscribe subscription toolbar topbar "
    "widget widgets".split())
# and words that say nothing of what a part holds.
_NEUTRAL = frozenset(
    "area article articles bar block body box btn bottom button buttons col column container content el form group icons "
    "inner item items left link links list main module more news outer page panel post posts reader row section site "
    "stories story top right text thread user users wrap wrapper".split())
# Parts for which soft names count; on a paragraph or heading they tell its style or anchor.
_PARTS = frozenset("div section ul ol dl table td figure details center footer header nav".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Names that tell what an element has or how it is set, and not what it is: has-sidebar, comments-open.
_MODIFIER = re.compile(r"(?:has|with|without|no|is|not)(?:[-_]|(?=[A-Z])).*|.*[-_](?:open|closed|enabled|disabled|on|off)")


class _Lines(HTMLParser):
    """Blocks of a page with their text, tags, and whether furniture or an article holds them."""

    def __init__(self, names: bool = True) -> None:
        """``names``: whether names of elements tell furniture."""
        self.names = names
        super().__init__(convert_charrefs=True)
        self.texts: list[list[str]] = [[]]
        self.tags = [0]
        self.holders: list[int] = [0]
        self.off = [False]
        # Open sections: (tag, number of the section, within furniture, within an article, within what is never shown).
        self.open: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.sections = 1
        self.articles: set[int] = set()
        self.parents = [0]
        #: Sections whose names leave it open whether they are furniture.
        self.doubtful: set[int] = set()
        #: Of each line, the links and the characters in them.
        self.links = [0]
        self.linked = [0]
        self.link = False

    def _line(self) -> None:
        self.link = False
        top = self.open[-1]
        if self.texts[-1] or self.tags[-1] > 40:
            self.texts.append([])
            self.tags.append(0)
            self.links.append(0)
            self.linked.append(0)
            self.holders.append(top[1])
            self.off.append(top[2])
        else:
            self.holders[-1], self.off[-1] = top[1], top[2]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _INLINE:
            if attrs and tag not in _VOID and self._furniture(tag, attrs):
                self._push(tag, True, False)
            else:
                self.tags[-1] += 1
                if tag == "a":
                    self.link = True
                    self.links[-1] += 1
            return
        if tag == "body":
            # A head that is never closed ends here.
            while len(self.open) > 1 and self.open[-1][0] in ("head", "title"):
                self.open.pop()
        article = tag in _ARTICLE or tag in _SECTION and any(k == "role" and v in _ARTICLE for k, v in attrs)
        # Articles within one may be comments: their names count.
        exempt = article and not self.open[-1][3]
        if tag in _NEVER or attrs and tag not in _VOID and tag not in ("html", "body") and self._furniture(tag, attrs, exempt):
            self._push(tag, True, False, tag in _NEVER or self._furniture(tag, attrs, True))
        elif tag in _SECTION:
            main = exempt and (tag == "main" or any(k == "role" and v == "main" for k, v in attrs))
            self._push(tag, False, article, main=main)
            if attrs and not exempt and tag not in ("html", "body") and self._names(attrs, _SOFT):
                self.doubtful.add(self.sections - 1)
        else:
            self._line()
        self.tags[-1] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _INLINE:
            self._line()
        self.tags[-1] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                self._line()
                break
            # An inner stray end tag does not close what holds it.
            if self.open[at][0] in ("article", "main", "td") and tag not in _SECTION and tag not in _NEVER:
                break
        else:
            if tag not in _INLINE:
                self._line()
        self.tags[-1] += 1

    def _push(self, tag: str, off: bool, article: bool, never: bool = False, main: bool = False) -> None:
        above = self.open[-1]
        if main and not above[4]:
            # A wrapper that holds the main part is no furniture, whatever its name.
            above = (*above[:2], False, *above[3:])
        number = self.sections
        self.sections += 1
        self.parents.append(above[1])
        if article and not above[2]:
            self.articles.add(number)
        self.open.append((tag, number, off or above[2], article or above[3], never or above[4]))
        self._line()

    def _names(self, attrs: list[tuple[str, str | None]], words: frozenset[str]) -> bool:
        """Whether a name holds one of the words, and is no mere modifier."""
        return self.names and any(
            w.lower() in words for key, value in attrs if value and key in ("class", "id", "role", "aria-label")
            for name in value.split() if not _MODIFIER.fullmatch(name) for w in _WORD.findall(name))

    def _furniture(self, tag: str, attrs: list[tuple[str, str | None]], exempt: bool = False) -> bool:
        """Whether an element's names or what hides it make it furniture; of an ``exempt`` one only what hides it."""
        if any(key == "hidden" or key == "aria-hidden" and value == "true" for key, value in attrs):
            return True
        if exempt or not self.names:
            return False
        if self._names(attrs, _FURNITURE):
            return True
        if tag not in _PARTS:
            return False
        for key, value in attrs:
            for name in (value or "").split() if key in ("class", "id", "role", "aria-label") else ():
                words = [w.lower() for w in _WORD.findall(name)]
                if not _MODIFIER.fullmatch(name) and any(w in _SOFT for w in words) \
                        and all(w in _SOFT or w in _NEUTRAL for w in words):
                    return True
        return False

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.texts[-1].append(data)
            if self.link:
                self.linked[-1] += len(data)
        elif self.texts[-1]:
            self.texts[-1].append(" ")


def _smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratios) < 2:
        return ratios
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weight


def _threshold(values: np.ndarray) -> float:
    """Between two clusters of values on a line (two-means); below all if there is one value."""
    low, high = float(values.min()), float(values.max())
    if high <= low:
        return low - 1
    for _ in range(32):
        split = (low + high) / 2
        under, over = values[values <= split], values[values > split]
        if not len(under) or not len(over):
            break
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _parsed(html: str, names: bool) -> tuple[_Lines, list[tuple[str, int, int]]]:
    parser = _Lines(names)
    for at in range(0, len(html), FEED):
        parser.feed(html[at:at + FEED])
    parser.close()
    lines = []
    for parts, tags, holder, off in zip(parser.texts, parser.tags, parser.holders, parser.off, strict=True):
        text = " ".join("".join(parts).split()) if parts and not off else ""
        lines.append((text, tags, holder))
    return parser, lines


def _dropped(parser: _Lines, lines: list[tuple[str, int, int]], threshold: float) -> set[int]:
    """Sections whose text is below the threshold once their links are left out, or whose doubtful names it confirms."""
    n = parser.sections
    chars, tags, links, linked = ([0] * n for _ in range(4))
    for (text, count, at), many, inside in zip(lines, parser.links, parser.linked, strict=True):
        if text:
            chars[at] += len(text)
            links[at] += many
            linked[at] += min(inside, len(text))
        tags[at] += count
    out = set()
    for at in range(n - 1, 0, -1):
        # A section begins after the one that holds it, which is judged without the parts that are dropped.
        plain = math.log1p((chars[at] - linked[at]) / max(1, tags[at]))
        list_of_links = links[at] >= 3 and 2 * linked[at] >= chars[at]
        if plain <= threshold and (list_of_links or at in parser.doubtful) \
                or at in parser.doubtful and links[at] >= 3 and 3 * linked[at] >= chars[at]:
            out.add(at)
        else:
            for sums in (chars, tags, links, linked):
                sums[parser.parents[at]] += sums[at]
    return out


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of a page; empty for a null, empty or textless one.

    Blocks come in page order, joined by one space; white space inside them is one
    space. Lines in furniture (menus, headers, footers, forms, comments and so on)
    count as empty. A selected line brings in the section that holds it: the
    article around it if there is one, so that its short paragraphs and headings
    stay whole. Inside, parts go whose text without links lies below the threshold, if
    most of it is links or if their names may mean furniture; a part with such a name
    stays if its text is dense. Beside an article, others with less than half its
    selected text are teasers, and go.
    """
    if not html:
        return ""
    parser, lines = _parsed(html, True)
    if not any(t for t, _, _ in lines):
        # Names alone must not empty a page.
        parser, lines = _parsed(html, False)
    if not any(t for t, _, _ in lines):
        return ""
    own = np.log1p([len(t) / max(1, n) for t, n, _ in lines])
    ratios = _smooth(own, sigma)
    filled = np.array([bool(t) for t, _, _ in lines])
    threshold = _threshold(ratios)
    chosen = filled & (ratios > threshold)
    if not chosen.any():
        chosen = filled
    dropped = _dropped(parser, lines, threshold)
    # Of each section: the outermost article around it, or itself; and whether it or one around it is dropped.
    around, gone = list(range(parser.sections)), [False] * parser.sections
    for at in range(1, parser.sections):
        above = parser.parents[at]
        if around[above] in parser.articles:
            around[at] = around[above]
        gone[at] = gone[above] or at in dropped
    groups = [around[h] for _, _, h in lines]
    kept = [bool(t) and not gone[h] for t, _, h in lines]
    if not any(kept):
        # A page of links alone has no other text.
        kept = [bool(t) for t, _, _ in lines]
    found = {g for g, c, k in zip(groups, chosen, kept, strict=True) if c and k}
    wanted = {g for g in found if g in parser.articles}
    if wanted:
        mass = dict.fromkeys(wanted, 0)
        for (text, _, _), g, k in zip(lines, groups, kept, strict=True):
            if k and g in mass:
                mass[g] += len(text)
        most = max(mass.values())
        wanted = {g for g, chars in mass.items() if 2 * chars >= most}
    else:
        # Smoothing lifts what stands beside the text; a section's own ratio tells them apart.
        sizes: dict[int, list[int]] = {g: [0, 0] for g in found}
        for (text, tags, _), g in zip(lines, groups, strict=True):
            if g in sizes:
                sizes[g][0] += len(text)
                sizes[g][1] += tags
        wanted = {g for g, (chars, tags) in sizes.items() if math.log1p(chars / max(1, tags)) > threshold} or found
    return " ".join(t for (t, _, _), g, k in zip(lines, groups, kept, strict=True) if k and g in wanted)


def extract_pages(pages: DataFrame, html_col: str = "html", sigma: float = SIGMA) -> DataFrame:
    """``pages`` with ``text`` (string, empty if none) and ``n_chars``; ``html`` goes.

    Other columns are kept, but for ones of those two names. One pass, no shuffle.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    chosen = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            texts = [extract(h, sigma) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[:len(keep)])
    return chosen.mapInArrow(run, f"{schema}text string, n_chars long")
