"""Text functions as column expressions; edit ratios, which no expression states, are Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Latin letters with marks and the letters they fold to (NFKD without combining marks).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrsssstt" + "uuuuuuwyzzz"
#: Words dropped from organization names, and texts that stand for a missing value.
LEGAL_WORDS = ("inc", "llc", "ltd", "corp", "corporation", "co", "company", "the", "of", "and")
MISSING = ("", "n/a", "na", "none", "null", "unknown", "-", "tbd")
STOP_WORDS = ("the", "of", "and", "for", "in", "at", "a", "an", "de", "la")


def words(value: Column) -> Column:
    """Non-empty tokens between spaces."""
    return F.filter(F.split(value, " "), lambda w: w != "")


def collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def folded(value: Column) -> Column:
    """Lower case without accents of the Latin ranges, inside generated code."""
    return F.translate(F.lower(value), ACCENTED, FOLDED)


@F.pandas_udf(StringType())
def folded_unicode(values: pd.Series) -> pd.Series:
    """Case-folded text without combining marks, for all of Unicode."""
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c)))


def clean_text(value: Column, missing: Sequence[str] = MISSING) -> Column:
    """One-spaced text, null where it only says that a value is missing."""
    text = collapsed(value)
    return F.when(~F.lower(text).isin(*missing), text)


def slugify(value: Column, joint: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(folded(value), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def plain(value: Column) -> Column:
    """Letters and digits of folded text with single spaces."""
    return F.trim(F.regexp_replace(folded(value), "[^a-z0-9]+", " "))


def normalize_name(value: Column) -> Column:
    """plain() without what stands in parentheses."""
    return plain(F.regexp_replace(value, r"\([^)]*\)", " "))


def norm_with_ampersand(value: Column) -> Column:
    """Folded letters, digits and ampersands; parentheses go, their content stays."""
    return F.trim(F.regexp_replace(folded(value), "[^a-z0-9&]+", " "))


def core_name(value: Column, legal: Sequence[str] = LEGAL_WORDS) -> Column:
    return F.array_join(F.filter(words(plain(value)), lambda w: ~w.isin(*legal)), " ")


def acronym(value: Column, stop: Sequence[str] = STOP_WORDS, least: int = 2) -> Column:
    """Initials in word order without stop words; empty for fewer words than `least`."""
    own = F.filter(words(normalize_name(value)), lambda w: ~w.isin(*stop))
    return F.when(F.size(own) >= least, F.array_join(F.transform(own, lambda w: F.substring(w, 1, 1)), "")).otherwise("")


def bracketed(value: Column) -> Column:
    """Normalized texts in parentheses."""
    return F.filter(F.transform(F.regexp_extract_all(value, F.lit(r"\(([^)]*)\)"), F.lit(1)), plain), lambda x: x != "")


def acronym_pair(a: Column, b: Column) -> Column:
    """One name is 2 to 8 capitals that are the other's initials or stand in its brackets."""

    def one(short, long):
        return short.rlike("^[A-Z]{2,8}$") & ((F.lower(short) == acronym(long)) | F.array_contains(bracketed(long), F.lower(short)))

    return one(a, b) | one(b, a)


def singular(word: Column) -> Column:
    """A crude stem: -ies to -y, then -es, then -s, of words over three letters that do not end in -ses."""
    return (
        F.when((F.length(word) <= 3) | word.endswith("ses"), word)
        .when(word.endswith("ies"), F.concat(F.expr("''"), F.regexp_replace(word, "ies$", "y")))
        .when(word.endswith("es"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def stems(value: Column, letters: int = 4) -> Column:
    """First letters of each word of at least so many."""
    return F.array_distinct(F.transform(F.filter(words(plain(value)), lambda w: F.length(w) >= letters), lambda w: F.substring(w, 1, letters)))


def mentions(value: Column, term: Column) -> Column:
    """Every stem of the term occurs among the stems of the text."""
    return (F.size(stems(term)) > 0) & (F.size(F.array_except(stems(term), stems(value))) == 0)


def series_key(value: Column) -> Column:
    """An event's name without years, ordinals and edition words."""
    return plain(F.regexp_replace(F.lower(value), r"\b(19|20)\d{2}\b|\b\d+(st|nd|rd|th)\b|\b(annual|edition|inaugural)\b", " "))


def distinctive_words(value: Column, least: int = 4, stop: Sequence[str] = STOP_WORDS) -> Column:
    return F.array_distinct(F.filter(words(series_key(value)), lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def sentences(value: Column) -> Column:
    """Sentences: split after a mark followed by white space."""
    return F.filter(F.transform(F.split(value, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def quote_on_page(quote: Column, page: Column, share: float = 0.8, least: int = 4) -> Column:
    """The quote is part of the page, or has at least `least` longer words of which the share occur on it."""
    p = plain(page)
    return quote_on_plain(quote, p, words(p), share, least)


def quote_on_plain(quote: Column, page: Column, page_words: Column, share: float = 0.8, least: int = 4) -> Column:
    """quote_on_page() for a page that is plain already, with its words."""
    q = plain(quote)
    own = F.array_distinct(F.filter(words(q), lambda w: F.length(w) > 2))
    held = F.size(F.array_intersect(own, page_words))
    return ((q != "") & F.contains(page, q)) | ((F.size(own) >= least) & (held >= share * F.size(own)))


def name_on_page(name: Column, page: Column, titles: Sequence[str] = ("dr", "prof", "professor", "mr", "mrs", "ms")) -> Column:
    """All parts of the name, titles aside, occur on the page."""
    parts = F.filter(words(plain(name)), lambda w: ~w.isin(*titles))
    return (F.size(parts) > 0) & (F.size(F.array_except(parts, words(plain(page)))) == 0)


def share_on_page(name: Column, page: Column, share: float = 0.6) -> Column:
    """At least the share of the longer words occurs on the page."""
    own = F.array_distinct(F.filter(words(plain(name)), lambda w: F.length(w) > 2))
    return (F.size(own) > 0) & (F.size(F.array_intersect(own, words(plain(page)))) >= share * F.size(own))


def only_profile_slug(html: Column, site: str = r"linkedin\.com/in/") -> Column:
    """The one profile slug that a page links to; null where it links to none or to several."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(rf"{site}([A-Za-z0-9_-]+)"), F.lit(1)), F.lower))
    return F.when(F.size(found) == 1, found[0])


def name_and_acronym(value: Column) -> Column:
    """struct(name, short) of "Name (ABC)", "ABC - Name", "Name - ABC" or a bare name, first pattern that fits."""
    pick = lambda p, n, s: F.struct(F.trim(F.regexp_extract(value, p, n)).alias("name"), F.regexp_extract(value, p, s).alias("short"))
    a, b, c = r"^(.+?)\s*\(([A-Z][A-Za-z&-]{1,11})\)\s*$", r"^([A-Z]{2,12})\s*[-–:]\s*(.+)$", r"^(.+?)\s*[-–]\s*([A-Z]{2,12})$"
    return F.when(value.rlike(a), pick(a, 1, 2)).when(value.rlike(b), pick(b, 2, 1)).when(value.rlike(c), pick(c, 1, 2)).otherwise(F.struct(F.trim(value).alias("name"), F.lit(None).cast("string").alias("short")))


def first_keyword(value: Column, codes: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The code of the first keyword in the list that the text contains."""
    text, out = F.lower(value), F.when(F.lit(False), F.lit(None))
    for keyword, code in codes:
        out = out.when(F.contains(text, F.lit(keyword)), F.lit(code))
    return out.otherwise(F.lit(default))


def without_short_brackets(value: Column) -> Column:
    """The name without a closing bracket of at most 15 characters and two words."""
    inner = F.regexp_extract(value, r"\(([^)]*)\)\s*$", 1)
    return F.when((inner != "") & (F.length(inner) <= 15) & (F.size(words(F.trim(inner))) <= 2), F.trim(F.regexp_replace(value, r"\s*\([^)]*\)\s*$", ""))).otherwise(value)


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 for an empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    """Greater share of distinctive words that the other name has too."""
    return containment(distinctive_words(a), distinctive_words(b))


def name_variants(value: Column, most: int = 5) -> Column:
    """The name, without brackets, its core, and its acronym in capitals; distinct, at most so many."""
    every = F.array(F.trim(value), F.trim(F.regexp_replace(value, r"\s*\([^)]*\)", "")), core_name(value), F.upper(acronym(value)))
    return F.slice(F.array_distinct(F.filter(every, lambda v: v != "")), 1, most)


def markers(value: Column, pattern: str) -> Column:
    """Distinct institution words of a name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(rf"\b({pattern})\b"), F.lit(1))))


def truncated(value: Column, most: int) -> Column:
    """The text up to the last word that fits, with an ellipsis if anything was cut."""
    cut = F.regexp_replace(F.substring(value, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(value) <= most, value).otherwise(F.concat(cut, F.lit("…")))


def formula_like(value: Column) -> Column:
    """A cell that a spreadsheet would run as a formula."""
    return F.coalesce(value.rlike(r"^ *[=+@-]"), F.lit(False))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _pairwise(function):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio of shared words, and shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, [both, " ".join(sorted(r))])) for r in (x - y, y - x))
    tries = [indel_ratio(one, two)] + ([indel_ratio(both, one), indel_ratio(both, two)] if both else [])
    return max(tries) if x and y else 0.0


ratio = _pairwise(indel_ratio)
token_sort_ratio = _pairwise(token_sort)
token_set_ratio = _pairwise(token_set)
sequence_ratio = _pairwise(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())

_UNIT = re.compile(r"\b(department|dept|school|college|faculty|division|center|centre|lab|laboratory|institute) of\b|\b(lab|laboratory|group)$", re.I)
_WHOLE = re.compile(r"\b(university|institute of technology|polytechnic|college|national laboratory|agency|ministry|inc|llc|corporation)\b", re.I)


@F.pandas_udf(StringType())
def employing_institution(values: pd.Series) -> pd.Series:
    """The institution in an affiliation of several parts: the part that names a whole organization, else the last that is no unit."""

    def pick(v):
        if v is None or not v.strip():
            return None
        parts = [p.strip() for p in re.split(r"[,;|/]| - ", v) if p.strip()]
        whole = [p for p in parts if _WHOLE.search(p) and not re.match(r"(?i)(department|dept|school|division) ", p)]
        rest = [p for p in parts if not _UNIT.search(p)]
        return (whole or rest[-1:] or parts)[0]

    return values.map(pick)


def chunked(text: str, size: int = 1200, overlap: int = 200) -> list[str]:
    """Windows of at most `size` characters made of whole paragraphs, else sentences, else hard cuts; each begins with the end of the one before."""
    units = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
        if len(paragraph) <= size:
            units.append(paragraph)
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            units += [sentence[i : i + size] for i in range(0, len(sentence), size)]
    out, now = [], ""
    for unit in units:
        if now and len(now) + 1 + len(unit) > size:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            now = f"{tail} {unit}".strip() if len(tail) + 1 + len(unit) <= size else unit
        else:
            now = f"{now} {unit}".strip()
    return [*out, now] if now else out


@F.pandas_udf(ArrayType(StringType()))
def chunks(values: pd.Series) -> pd.Series:
    return values.map(chunked)
