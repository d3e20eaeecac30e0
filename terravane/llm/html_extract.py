"""HTML extraction: streaming parser events, text-to-tag ratio per line, smoothing, threshold clustering.

The standard library's parser streams through a page once. Every block boundary starts a new line; a line keeps its text,
its characters outside links, the tags seen in it and its path of open elements. Elements that are furniture by kind (menus, headers, footers,
sidebars, forms, scripts) or by a class, id or role made of nothing but furniture and box words (adverts, notices, comments) are out.

Characters outside links over tags, smoothed by a Gaussian over neighbouring lines, is split by a threshold of one standard
deviation of the smoothed array into two clusters, content and other lines. The clusters decide:
- an element whose class only holds a furniture word among others ("section-header", "social-policy") stays if the smoothed ratios of its
  lines reach the threshold on average, and goes if not;
- a run of lines that are all links has the ratio nought and goes, even where a neighbour lifts its smoothed ratio; a single such line follows its smoothed ratio;
- the content region is the innermost element that holds all content lines: the article (with the articles beside it) or the main
  element around them if there is one; else the articles or the main element that hold most of their characters, which leaves out dense adverts and notices elsewhere, whatever
  they are called; else the deepest block that they share. It adds the short lines between and beside the content lines.

Rows are independent: Arrow batches in, Arrow batches out, no shuffle, memory of a slice of 2 MB of pages (or one page) at a time.

Defined cases: null html counts as empty and gives an empty text; a page without content lines gives the lines outside
furniture; broken nesting closes what it must; white space of any kind, also from character references, is white space; an empty table gives an
empty result; repeated rows are extracted one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.relational import spread
from .chunks import text_slices
from .common import in_batches, table

#: Element kinds. Names are those of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside form script style noscript template menu dialog button select textarea iframe object svg head title".split())
#: Words of class, id or role that mark furniture, matched whole between separators.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs header masthead"
    " footer sidebar aside comment comments disqus respond replies cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe"
    " subscription signup share sharing social related recommended widget toolbar pagination pager search login complementary contentinfo".split()
)
#: Words beside which a furniture word still names furniture: places and shapes of boxes.
BOX_WORDS = frozenset("site page top bottom left right global primary secondary list item items box bar block container wrapper wrap inner outer area panel slot unit form links buttons icons posts thread user reader".split())
#: Furniture words that name furniture at either end of a name, whatever the rest.
END_WORDS = frozenset("ad ads advert adverts advertisement sponsored comment comments cookie cookies gdpr".split())
#: First words of layout names that only tell what stands beside the content, as in "has-sidebar".
LAYOUT_WORDS = frozenset("has with no without main article body layout".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html article section div main".split())
_WORD = re.compile(r"[a-z]+")
#: Standard deviation of the Gaussian in lines.
SIGMA = 1.5
#: A content line's own ratio is at least this share of the threshold; lines that only their neighbours lift are added within the region.
OWN_SHARE = 0.5
#: Articles or a main element hold the region if they hold this share of the content lines' characters, whatever lies outside of them.
LEAST_MASS = 0.3


def cue(tag: str, attrs) -> int:
    """2: the element is furniture; 1: a furniture word stands among others in its class, id or role; 0: neither."""
    if tag in FURNITURE:
        return 2
    found = 0
    if tag not in ("html", "body", "article", "main"):
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                for words in map(_WORD.findall, v.lower().split()):
                    own = sum(w in FURNITURE_WORDS for w in words)
                    if own and words[0] not in LAYOUT_WORDS:
                        plainly = words[0] in END_WORDS or words[-1] in END_WORDS or own + sum(w in BOX_WORDS for w in words) == len(words)
                        found = max(found, 2 if plainly else 1)
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()):
                found = 2
    return found


class _Events(HTMLParser):
    """Lines of a page: (words, tags, innermost open node, furniture, characters outside links, innermost node with a cue). Nodes are numbered as they open; -1 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        self.stack: list[tuple[str, int, bool, int]] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.plain: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        if said:
            _, node, furniture, cued = self.stack[-1] if self.stack else ("", -1, False, -1)
            self.lines.append((said, self.tags, node, furniture, len(" ".join("".join(self.plain).split())), cued))
        self.text, self.plain, self.tags = [], [], 0

    def _pop_to(self, at: int) -> None:
        if any(k not in INLINE for k, _, _, _ in self.stack[at:]):
            self.flush()
        self.open.subtract(k for k, _, _, _ in self.stack[at:])
        del self.stack[at:]

    def _implied(self, tag: str) -> None:
        if tag in CLOSES_P and self.open["p"]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    return self._pop_to(i)
                if self.stack[i][0] not in INLINE:
                    return None
        ends = SELF_CLOSING.get(tag)
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self._pop_to(i)
                    if tag != "tr":
                        return None
                elif self.stack[i][0] in SCOPES:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        self._implied(tag)
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        marked = cue(tag, attrs)
        _, parent, furniture, cued = self.stack[-1] if self.stack else ("", -1, False, -1)
        if marked and not furniture and tag in INLINE:
            self.flush()
        self.parents.append(parent)
        self.stack.append((tag, len(self.kinds), furniture or marked == 2, len(self.kinds) if marked == 1 else cued))
        self.kinds.append(tag)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] > 0 else ():
            if self.stack[i][0] == tag:
                if tag in INLINE and self.stack[i][2:] != (self.stack[i - 1][2:] if i else (False, -1)):
                    self.flush()
                return self._pop_to(i)
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return None
        if tag not in INLINE:
            self.flush()
        return None

    def handle_data(self, data):
        self.text.append(data)
        if not self.open["a"]:
            self.plain.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Values under a normalised Gaussian of three standard deviations each way, edges renormalised."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        own = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(own, values[lo:hi])) / sum(own))
    return out


def clusters(lines) -> tuple[list[float], list[float], float]:
    """Ratio and smoothed ratio of every line (nought in furniture), and the threshold between the clusters: one standard deviation of the smoothed, the largest of them at most."""
    ratios = [0.0 if furniture else plain / max(1, tags) for _, tags, _, furniture, plain, _ in lines]
    smooth = smoothed(ratios)
    if not smooth:
        return [], [], 0.0
    mean = sum(smooth) / len(smooth)
    return ratios, smooth, min(math.sqrt(sum((r - mean) ** 2 for r in smooth) / len(smooth)), max(smooth))


def content_lines(lines) -> tuple[list[int], list[int]]:
    """(indices of the content lines, indices of lines that may be added to them): both by the clusters of smoothed ratios."""
    ratios, smooth, threshold = clusters(lines)
    sums: dict[int, list[float]] = {}
    for r, (_, _, _, furniture, _, cued) in zip(smooth, lines):
        if cued >= 0 and not furniture:
            sums.setdefault(cued, []).append(r)
    gone = {n for n, own in sums.items() if sum(own) / len(own) < threshold}
    left = [i for i, line in enumerate(lines) if not line[3] and line[5] not in gone]
    linked = [lines[i][4] == 0 for i in left]
    chosen, added = [], []
    for k, i in enumerate(left):
        high = smooth[i] >= threshold
        if linked[k] and threshold and ((k and linked[k - 1]) or (k + 1 < len(left) and linked[k + 1]) or not high):
            continue
        (chosen if high and ratios[i] >= OWN_SHARE * threshold else added).append(i)
    return chosen, added


def heaviest(lines, chosen: list[int], kinds: list[str], parents: list[int]) -> set[int]:
    """The articles of one parent, or the main element, that hold the most of the content lines' characters, if that is the share LEAST_MASS of all: what else the clusters took for content is outside of it."""
    mass = [0] * len(kinds)
    for i in chosen:
        if lines[i][2] >= 0:
            mass[lines[i][2]] += lines[i][4]
    for n in range(len(kinds) - 1, -1, -1):
        if parents[n] >= 0:
            mass[parents[n]] += mass[n]
    groups: dict[tuple[str, int], int] = {}
    for n, kind in enumerate(kinds):
        if kind in ("article", "main"):
            groups[kind, parents[n]] = groups.get((kind, parents[n]), 0) + mass[n]
    total, best = sum(lines[i][4] for i in chosen), max(groups, key=lambda g: (groups[g], g[0] == "article", -g[1]), default=None)
    if best is None or groups[best] < LEAST_MASS * max(1, total):
        return set()
    return {n for n, k in enumerate(kinds) if (k, parents[n]) == best}


def region_of(lines, chosen: list[int], kinds: list[str], parents: list[int]) -> set[int] | None:
    """The nodes whose lines are the content: the article that all chosen lines share with its sibling articles, or a shared main element; else those that hold most of their text; else the deepest block they share; None is the page."""
    held = [0] * len(kinds)
    for i in chosen:
        if lines[i][2] >= 0:
            held[lines[i][2]] += 1
    for n in range(len(kinds) - 1, -1, -1):  # children open after their parents
        if parents[n] >= 0:
            held[parents[n]] += held[n]
    shared = [n for n, k in enumerate(held) if k and k == len(chosen)]
    for kind in ("article", "main"):
        if named := [n for n in shared if kinds[n] == kind]:
            return {n for n, k in enumerate(kinds) if k == kind and parents[n] == parents[named[0]]}
    if heavy := heaviest(lines, chosen, kinds, parents):
        return heavy
    holding = [n for n in shared if kinds[n] not in INLINE and kinds[n] not in CLOSES_P - {"div", "table"}]  # a section is a part of what holds it
    return {max(holding)} if holding else None


def extract(html: str) -> str:
    """The main text of a page."""
    events = _Events()
    events.feed(html)
    events.close()
    events.flush()
    lines = events.lines
    chosen, added = content_lines(lines)
    region = region_of(lines, chosen, events.kinds, events.parents)
    within = [region is None] * (len(events.kinds) + 1)  # the last stands for the page, which -1 finds
    for n, parent in enumerate(events.parents):
        within[n] = within[parent] or (region is not None and n in region)
    return " ".join(lines[i][0] for i in sorted(chosen + added) if within[lines[i][2]])


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches):
        for rows, pages_html in text_slices(batches, 2):
            texts = [extract(h.as_py()) for h in pages_html]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return in_batches(pages.select(id_col, url_col, html_col), run, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return html_extract(spread(table(spark, sf_dir, "pages"), "page_id"))
