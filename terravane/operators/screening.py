"""Screening of search results and names: rejection ladders, scopes, places outside the country, plausible names, periods.

Lists of domains are tables and meet hosts by an equi-join on domain suffixes; lists of words and paths are short parameters that
become one pattern. Every ladder gives the reason of its first rule that holds, or null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .relational import domain_suffixes

#: Addresses of files and document stores.
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")
DOCUMENT_PATHS = ("/sites/g/files/", "showdocument", "viewdoc", "virtualfileroom", "/archives/edgar/", "/documents/", "/docs/default-source/", "/uploads/", "/download")
DOCUMENT_HOSTS = ("legislature.", "catalog.data.gov", "documents.", "docs.", "cga.ct.gov")
#: Suffixes of institutions, and the second labels that mark one under a two-letter top domain.
INSTITUTION_SUFFIXES = (".edu", ".gov", ".mil", ".int")
INSTITUTION_LABELS = ("ac", "edu")
#: Words of an address that is read from anywhere, and of a name that stands for a group or for nothing.
ONLINE_WORDS = ("online", "virtual", "webinar", "livestream")
NOISE_NAMES = ("n/a", "none", "tbd", "unknown", "various", "other", "others", "see above")
GROUP_WORDS = ("anchors", "ecosystem", "firms", "startups")
LEAST_NAME = 3


def one_of(words: Sequence[str], case: bool = False) -> str:
    """A pattern for any of the words, not inside a longer one."""
    return f"(^|[^a-z])({'|'.join(map(re.escape, words))})([^a-z]|$)" if words else r"[^\s\S]"


def domain_hits(rows: DataFrame, key: str, host: str, lists: dict[str, DataFrame], domain: str = "domain") -> DataFrame:
    """key and, for each list, the least of its domains that the host is or is below (null without one), in one join for all lists."""
    named = None
    for name, domains in lists.items():
        own = domains.select(F.lower(domain).alias("_suffix"), F.lit(name).alias("_list")).distinct()
        named = own if named is None else named.unionAll(own)
    suffixed = rows.select(key, F.explode(domain_suffixes(F.col(host))).alias("_suffix"))
    found = suffixed.join(named, "_suffix")
    return found.groupBy(key).agg(*[F.min(F.when(F.col("_list") == name, F.col("_suffix"))).alias(name) for name in lists])


def news_page(path: Column) -> Column:
    return F.lower(path).rlike("/(news|newsroom|press|press-releases?|media|blog|stories)(/|$)")


def rejected(results: DataFrame, key: str, url: str, held: DataFrame, seen: DataFrame, blocked: DataFrame, known: DataFrame, non_content: Sequence[str], actor: Column) -> DataFrame:
    """key, host, reason: the first rule that rejects a search result, or null.

    In order: no web address, a held actor's domain, a news page of an actor's own site, an address seen before, a blocked
    domain, a domain that a configured source covers, a path that is no content. held, blocked, known: tables of domain; seen: a
    table of addresses (column named as url). `actor` tells the results that are asked for as organizations.
    """
    rows = results.select(key, url, actor.alias("_actor")).withColumn("host", U.host(F.col(url)))
    hits = domain_hits(rows, key, "host", {"_held": held, "_blocked": blocked, "_known": known})
    before = seen.select(url).distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(hits, key, "left").join(before, url, "left")
    path = F.lower(U.path(F.col(url)))
    fragment = F.coalesce(*[F.when(F.contains(path, F.lit(f.lower())), F.lit(f)) for f in non_content], F.lit(None).cast("string"))
    reason = (
        F.when(~F.coalesce(F.col(url).rlike(r"^https?://[^/?#]*\.[^/?#]*"), F.lit(False)), "invalid URL")
        .when(F.col("_held").isNotNull(), "actor already in database")
        .when(F.col("_actor") & news_page(path), "news or press page on own domain")
        .when(F.col("_seen"), "already read")
        .when(F.col("_blocked").isNotNull(), F.concat(F.lit("blocked domain: "), "_blocked"))
        .when(F.col("_known").isNotNull(), F.concat(F.lit("domain already covered by configured source: "), "_known"))
        .when(fragment.isNotNull(), F.concat(F.lit("obvious non-content URL pattern: "), fragment))
    )
    return rows.select(key, "host", reason.alias("reason"))


def document_hit(url: Column) -> Column:
    """What makes an address that of a file or a document store: a suffix, then a part of the path, then a host; null for a page."""
    path, host = F.lower(U.path(url)), F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(
        *[F.when(path.endswith(s), F.lit(s)) for s in DOCUMENT_SUFFIXES], *[F.when(F.contains(path, F.lit(p)), F.lit(p)) for p in DOCUMENT_PATHS], *[F.when(host.startswith(h), F.lit(h)) for h in DOCUMENT_HOSTS]
    )


def outside_person_scope(rows: DataFrame, key: str, url: str, allowed: DataFrame, suffixes: Sequence[str] = INSTITUTION_SUFFIXES) -> DataFrame:
    """key, outside: whether a person's page is neither on an allowed domain nor an institution's."""
    own = rows.select(key, url).withColumn("_host", U.host(F.col(url)))
    hits = domain_hits(own, key, "_host", {"_allowed": allowed})
    institution = F.col("_host").rlike("|".join(re.escape(s) + "$" for s in suffixes) + r"|[^.]\.(" + "|".join(INSTITUTION_LABELS) + r")\.[a-z]{2}$")
    return own.join(hits, key, "left").select(key, (F.col("_allowed").isNull() & ~institution).alias("outside"))


def outside_country(url: Column, text: Column, foreign: Sequence[str], home: Sequence[str], foreign_tlds: Sequence[str]) -> Column:
    """Why a result lies outside the country: a foreign top domain, else a foreign place named; null where a home place or an online event is named, or nothing tells."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tld = F.element_at(F.split(U.host(url), r"\."), -1)
    place = F.regexp_extract(low, one_of(foreign), 2)
    free = ~low.rlike(one_of(home)) & ~low.rlike(one_of(ONLINE_WORDS))
    return F.when(free & tld.isin(*foreign_tlds), F.concat(F.lit("site: "), tld)).when(free & (place != ""), F.concat(F.lit("place: "), place))


def looks_like_organization(name: Column) -> Column:
    """A name long enough, no noise word, with a letter and a capital."""
    bare = F.regexp_replace(F.lower(name), r"^[.:\- ]+|[.:\- ]+$", "")
    return F.coalesce((F.length(name) >= LEAST_NAME) & ~bare.isin(*NOISE_NAMES) & name.rlike("[A-Z]"), F.lit(False))


def specific_name(name: Column) -> Column:
    """The name holds something that is its own: capitals in a row (AI and R&D aside), an inner capital, a digit."""
    capitals = F.filter(F.regexp_extract_all(name, F.lit(r"\b([A-Z0-9&.-]{2,})\b"), F.lit(1)), lambda t: ~F.regexp_replace(t, r"^[.&-]+|[.&-]+$", "").isin("AI", "R&D", "RD"))
    return (F.size(capitals) > 0) | name.rlike(r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\b") | name.rlike("[0-9]")


def name_class(name: Column, generic: Sequence[str], descriptors: Sequence[str], kind: Column | None = None) -> Column:
    """implausible, placeholder, aggregate or organization: what a string that stands for an actor is.

    A placeholder has up to four words with a generic one among them. An aggregate names examples or a group, or is nothing but generic and
    descriptive words; a consortium of up to six words without anything of its own is one too.
    """
    tokens = T.words(T.plain(name))
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    rest = F.array_except(tokens, F.array(*map(F.lit, [*generic, "labs", "centers", "centres", "institutions", "organizations", "and", "or", "in", "across", "with", "for", "e", "g", "eg"])))
    described = (F.size(rest) > 0) & (F.size(F.array_except(rest, F.array(*map(F.lit, descriptors)))) == 0)
    consortium = F.lit(False) if kind is None else (kind == "consortium") & (F.size(tokens) <= 6)
    return (
        F.when(~looks_like_organization(name), "implausible")
        .when((F.size(tokens) == 0) | ((F.size(tokens) <= 4) & has(generic)), "placeholder")
        .when(F.lower(name).rlike(r"(^|[\s(])(e\.g\.|eg|for example)([\s,.)]|$)") | has(GROUP_WORDS), "aggregate")
        .when(specific_name(name), "organization")
        .when(consortium | (has([*generic, "labs", "centers", "centres", "institutions", "organizations"]) & described), "aggregate")
        .otherwise("organization")
    )


def single_date_rejection(html: Column, run_date: Column, months: int, minable: Column) -> Column:
    """Why a page with exactly one machine-readable date is rejected before it is read: past and not minable, or after the window; else null."""
    found = F.concat(F.regexp_extract_all(html, F.lit(r"<time[^>]+datetime=[\"']([^\"']+)[\"']"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"[\"']startDate[\"']\s*:\s*[\"']([^\"']+)"), F.lit(1)))
    days = F.array_distinct(F.array_compact(F.transform(found, lambda v: F.substring(v, 1, 10).try_cast("date"))))
    day, end = F.get(days, F.lit(0)), F.add_months(run_date, months)
    said = F.concat(F.lit("event date "), day.cast("string"))
    return F.when(
        F.size(days) == 1,
        F.when((day < run_date) & ~minable, F.concat(said, F.lit(" is before run date "), run_date.cast("string"))).when(day > end, F.concat(said, F.lit(" is after window end "), end.cast("string"))),
    )


def names_a_period(text: Column) -> Column:
    """The text says when: a year, a month, a season, or a word of time."""
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    return F.coalesce(F.lower(text).rlike(rf"(^|[^a-z0-9])((19|20)[0-9]{{2}}|{months}|spring|summer|autumn|fall|winter|upcoming|recent|past|next|last|since|until|this (week|month|year))([^a-z0-9]|$)"), F.lit(False))


def window_split(events: DataFrame, last_day: str, named: Column, today: Column, days: int = 365) -> DataFrame:
    """events with why_not: set for past events that ended more than `days` before today, unless the request names a period."""
    old = ~named & (F.col(last_day) < today) & (F.col(last_day) < F.date_sub(today, days))
    return events.withColumn("why_not", F.when(old, "Last edition more than 12 months ago."))


def event_scope(start: Column, state: Column, form: Column, first: Column, last: Column, states: Sequence[str]) -> Column:
    """before, after or elsewhere for an event outside what was asked, else null; an unknown date or place is not outside, nor is an online event anywhere. first, last: the dates asked for, null if open."""
    online = F.coalesce(form == "online", F.lit(False))
    away = F.upper(F.trim(state)).isin(*states) if states else F.lit(True)
    return F.when(start < first, "before").when(start > last, "after").when((F.trim(state) != "") & ~away & ~online, "elsewhere")


#: Words that make another institution of a similar name.
TELLING_WORDS = ("baptist", "central", "christian", "college", "community", "eastern", "institute", "medical", "methodist", "northern", "polytechnic", "southern", "state", "tech", "technological", "technology", "western")


def person_scope(affiliation: Column, asked: Column, small: Sequence[str] = (*T.LEGAL_WORDS, *T.STOP_WORDS), telling: Sequence[str] = TELLING_WORDS) -> Column:
    """Whether a person works elsewhere than asked: a word of the institution asked for is missing, or the affiliation has a telling word more; unknown is not outside."""
    words = lambda c: F.array_distinct(F.filter(T.words(T.plain(F.coalesce(c, F.lit("")))), lambda w: (F.length(w) > 2) & ~w.isin(*small)))
    want, have = words(asked), words(affiliation)
    more = F.arrays_overlap(F.array_except(have, want), F.array(*map(F.lit, telling)))
    return (F.size(want) > 0) & (F.coalesce(F.trim(affiliation), F.lit("")) != "") & ((F.size(F.array_except(want, have)) > 0) | more)
