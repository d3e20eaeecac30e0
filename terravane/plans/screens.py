"""Plans of screening: ladders over addresses and texts of pages, names, dates and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import screening as X
from .registry import plan

#: Addresses of pages as a search would give them: some sections stand for news, documents and institutions.
URL = """CASE WHEN contains(url, '#top') AND starts_with(url, 'http://') THEN replace(url, 'http://', 'ftp://') ELSE replace(replace(replace(replace(url, '/fr/', '/news/'), '/de/', '/documents/'), 'example.net/', 'example.edu/'), '.html', '.Pdf') END"""
KIND = "CASE WHEN contains(url, '/en/') THEN 'actor' WHEN contains(url, '/es/') OR contains(url, '/de/') THEN 'person' ELSE 'event' END"
NON_CONTENT = ("/en/9", "/login")
FOREIGN, HOME, FOREIGN_TLDS = ("auch", "nicht", "queeux", "schst"), ("with", "sich"), ("edu", "fr")


def results(t):
    return t.pages.select("page_id", F.expr(URL.replace("starts_with", "startswith")).alias("u"), F.expr(KIND).alias("kind"), "html")


def held(t):
    host = U.host(F.col("u"))
    return results(t).where(host.startswith("m.")).select(F.substring(host, 3, 1000).alias("domain")).distinct()


def blocked(t):
    host = U.host(F.col("u"))
    return results(t).where(host.startswith("blog.") & host.endswith(".com")).select(host.alias("domain")).distinct().union(t.spark.createDataFrame([("spam-farm.example.org",)], "domain string"))


def screened(t):
    rows = results(t)
    known = t.spark.createDataFrame([("example.org",)], "domain string")
    return X.rejected(rows, "page_id", "u", held(t), rows.where(F.contains("u", F.lit("?page"))), blocked(t), known, NON_CONTENT, F.col("kind") == "actor")


FIRST = "page_id, url, html, " + URL + " AS u, " + KIND + " AS kind"
BASE = rf"""r AS (SELECT {FIRST} FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS host, lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM r),
held AS (SELECT DISTINCT substr(host, 3) AS domain FROM h WHERE starts_with(host, 'm.')),
blocked AS (SELECT DISTINCT host AS domain FROM h WHERE starts_with(host, 'blog.') AND ends_with(host, '.com') UNION SELECT 'spam-farm.example.org'),
hb AS (SELECT page_id, min(domain) AS b FROM h JOIN blocked ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1),
hh AS (SELECT DISTINCT page_id FROM h JOIN held ON host = domain OR ends_with(host, '.' || domain)),
l AS (SELECT h.*, b, page_id IN (SELECT page_id FROM hh) AS is_held FROM h LEFT JOIN hb USING (page_id)),
s AS (SELECT *, CASE WHEN NOT regexp_matches(u, '^https?://[^/?#]*\.[^/?#]*') THEN 'invalid URL' WHEN is_held THEN 'actor already in database'
 WHEN kind = 'actor' AND regexp_matches(path, '/(news|newsroom|press|press-releases?|media|blog|stories)(/|$)') THEN 'news or press page on own domain'
 WHEN u IN (SELECT u FROM r WHERE contains(u, '?page')) THEN 'already read' WHEN b IS NOT NULL THEN 'blocked domain: ' || b
 WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'domain already covered by configured source: example.org'
 WHEN contains(path, '/en/9') THEN 'obvious non-content URL pattern: /en/9' WHEN contains(path, '/login') THEN 'obvious non-content URL pattern: /login' END AS reason FROM l)"""

ADDRESS_SQL = (
    "coalesce("
    + ", ".join(
        [f"CASE WHEN ends_with(path, '{s}') THEN '{s}' END" for s in X.DOCUMENT_SUFFIXES]
        + [f"CASE WHEN contains(path, '{p}') THEN '{p}' END" for p in X.DOCUMENT_PATHS]
        + [f"CASE WHEN starts_with(host, '{h}') THEN '{h}' END" for h in X.DOCUMENT_HOSTS]
    )
    + ")"
)
OUTSIDE_SQL = r"(NOT is_held AND NOT regexp_matches(host, '(\.edu|\.gov|\.mil|\.int)$|[^.]\.(ac|edu)\.[a-z]{2}$'))"
PLACE = "(^|[^a-z])({})([^a-z]|$)"
FREE_SQL = f"NOT regexp_matches(lower(html), '{PLACE.format('|'.join(HOME))}') AND NOT regexp_matches(lower(html), '{PLACE.format('|'.join(X.ONLINE_WORDS))}')"
FOUND_SQL = f"regexp_extract(lower(html), '{PLACE.format('|'.join(FOREIGN))}', 2)"
ABROAD_SQL = f"CASE WHEN {FREE_SQL} AND split_part(host, '.', -1) IN ('edu', 'fr') THEN 'site: ' || split_part(host, '.', -1) WHEN {FREE_SQL} AND {FOUND_SQL} <> '' THEN 'place: ' || {FOUND_SQL} END"


@plan("fi07_rejection_ladder", f"WITH {BASE} SELECT page_id, host, reason FROM s")
def _(t):
    return screened(t)


@plan("fi08_document_address", f"WITH {BASE} SELECT page_id, {ADDRESS_SQL} AS hit FROM s")
def _(t):
    return results(t).select("page_id", X.document_hit(F.col("u")).alias("hit"))


@plan("fi09_person_scope", f"WITH {BASE} SELECT page_id, {OUTSIDE_SQL} AS outside FROM s")
def _(t):
    return X.outside_person_scope(results(t), "page_id", "u", held(t))


@plan("fi10_outside_country", f"WITH {BASE} SELECT page_id, {ABROAD_SQL} AS reason FROM s")
def _(t):
    return results(t).select("page_id", X.outside_country(F.col("u"), F.col("html"), FOREIGN, HOME, FOREIGN_TLDS).alias("reason"))


@plan(
    "fi23_triage_ladder",
    f"""WITH {BASE} SELECT page_id, kind, CASE WHEN v IS NULL THEN 'pending' ELSE 'rejected' END AS verdict, v AS reason FROM (SELECT page_id, kind, CASE WHEN reason IS NOT NULL THEN reason
    WHEN kind = 'actor' AND {ADDRESS_SQL} IS NOT NULL THEN 'document: ' || {ADDRESS_SQL} WHEN kind = 'person' AND {OUTSIDE_SQL} THEN 'not an institutional page'
    WHEN kind = 'person' AND NOT regexp_matches(path, '/(people|person|profile|profiles|faculty|staff|team)/[^/]+|/es/[0-9]+') THEN 'not a profile page'
    WHEN kind <> 'actor' THEN {ABROAD_SQL} END AS v FROM s)""",
)
def _(t):
    first = screened(t).select("page_id", F.col("reason").alias("first"))
    scope = X.outside_person_scope(results(t), "page_id", "u", held(t))
    rows = results(t).join(first, "page_id").join(scope, "page_id")
    document = X.document_hit(F.col("u"))
    profile = F.lower(U.path(F.col("u"))).rlike("/(people|person|profile|profiles|faculty|staff|team)/[^/]+|/es/[0-9]+")
    reason = (
        F.when(F.col("first").isNotNull(), F.col("first"))
        .when((F.col("kind") == "actor") & document.isNotNull(), F.concat(F.lit("document: "), document))
        .when((F.col("kind") == "person") & F.col("outside"), "not an institutional page")
        .when((F.col("kind") == "person") & ~profile, "not a profile page")
        .when(F.col("kind") != "actor", X.outside_country(F.col("u"), F.col("html"), FOREIGN, HOME, FOREIGN_TLDS))
    )
    return rows.select("page_id", "kind", F.when(reason.isNull(), "pending").otherwise("rejected").alias("verdict"), reason.alias("reason"))


#: Names of the kinds that sheets hold: bare words, capitals, group words, brands, brackets with examples.
NAME = "CASE p_type WHEN 'ECONOMY' THEN p_name WHEN 'SMALL' THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' labs' WHEN 'LARGE' THEN upper(p_name) WHEN 'PROMO' THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' firms' WHEN 'MEDIUM' THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' and long labs of the region' ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || p_brand END"
GENERIC, DESCRIPTORS = ("labs", "widget", "ring"), ("small", "red", "hot", "long", "region", "of", "the", "bolt", "gear")
TOKENS_SQL = "list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
WIDE = (*GENERIC, "labs", "centers", "centres", "institutions", "organizations")
listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@plan(
    "fi16_plausible_names",
    rf"""WITH n AS (SELECT p_partkey, {NAME} AS name FROM part), k AS (SELECT *, {TOKENS_SQL} AS w FROM n),
    r AS (SELECT *, list_filter(w, lambda x: NOT list_contains({listed((*WIDE, 'and', 'or', 'in', 'across', 'with', 'for', 'e', 'g', 'eg'))}, x)) AS rest,
     len(list_filter(regexp_extract_all(name, '\b[A-Z0-9&.-]{{2,}}\b'), lambda x: regexp_replace(x, '^[.&-]+|[.&-]+$', '', 'g') NOT IN ('AI', 'R&D', 'RD'))) > 0 OR regexp_matches(name, '\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\b') OR regexp_matches(name, '[0-9]') AS own FROM k)
    SELECT p_partkey, name, CASE WHEN NOT (length(name) >= 3 AND regexp_matches(name, '[A-Z]')) THEN 'implausible'
     WHEN len(w) = 0 OR (len(w) <= 4 AND len(list_intersect(w, {listed(GENERIC)})) > 0) THEN 'placeholder'
     WHEN regexp_matches(lower(name), '(^|[\s(])(e\.g\.|eg|for example)([\s,.)]|$)') OR len(list_intersect(w, {listed(X.GROUP_WORDS)})) > 0 THEN 'aggregate'
     WHEN own THEN 'organization' WHEN len(list_intersect(w, {listed(WIDE)})) > 0 AND len(rest) > 0 AND len(list_filter(rest, lambda x: NOT list_contains({listed(DESCRIPTORS)}, x))) = 0 THEN 'aggregate' ELSE 'organization' END AS class FROM r""",
)
def _(t):
    rows = t.part.select("p_partkey", F.expr(NAME).alias("name"))
    return rows.select("p_partkey", "name", X.name_class(F.col("name"), GENERIC, DESCRIPTORS).alias("class"))


@plan(
    "fi20_single_date",
    """WITH c AS (SELECT o_custkey, o_orderpriority, array_sort(list(DISTINCT CAST(o_orderdate AS DATE))) AS days, max(o_totalprice) > 400000 AS minable FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority, CASE WHEN len(days) = 1 AND days[1] < DATE '1997-01-01' AND NOT minable THEN 'event date ' || days[1] || ' is before run date 1997-01-01'
     WHEN len(days) = 1 AND days[1] > DATE '1998-01-01' THEN 'event date ' || days[1] || ' is after window end 1998-01-01' END AS reason FROM c""",
)
def _(t):
    # a page for each customer and priority, which marks up the days of the orders
    marked = F.concat(F.lit('<li><time class="d" datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), F.lit('">when</time></li>'))
    pages = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.collect_list(marked), "").alias("html"), (F.max("o_totalprice") > 400000).alias("minable"))
    return pages.select("o_custkey", "o_orderpriority", X.single_date_rejection(F.col("html"), F.lit("1997-01-01").cast("date"), 12, F.col("minable")).alias("reason"))


PERIOD_SQL = "regexp_matches(lower({}), '(^|[^a-z0-9])((19|20)[0-9]{{2}}|january|february|march|april|may|june|july|august|september|october|november|december|spring|summer|autumn|fall|winter|upcoming|recent|past|next|last|since|until|this (week|month|year))([^a-z0-9]|$)')"


@plan(
    "fi22_window_split",
    f"""SELECT o_orderkey, CASE WHEN NOT {PERIOD_SQL.format("asked")} AND d < DATE '1998-01-01' AND d < DATE '1997-01-01' THEN 'Last edition more than 12 months ago.' END AS why_not
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_totalprice > 200000 THEN 'orders of ' || year(o_orderdate) ELSE 'orders ' || lower(o_orderpriority) END AS asked FROM orders)""",
)
def _(t):
    asked = F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("orders of "), F.year("o_orderdate").cast("string"))).otherwise(F.concat(F.lit("orders "), F.lower("o_orderpriority")))
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), asked.alias("asked"))
    return X.window_split(rows, "d", X.names_a_period(F.col("asked")), F.lit("1998-01-01").cast("date")).select("o_orderkey", "why_not")
