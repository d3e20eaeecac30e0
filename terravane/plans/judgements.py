"""Plans of judgement: gates of people and events, actor quality, qualification, currency, rankings, score sheets, and comparing facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from ..operators import facts as FA
from ..operators import scoring as S
from ..operators.identity import UNIT_PATH
from .identities import ORG, SITE, organizations, quoted
from .registry import plan

PLAIN = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
NEWS_PATH = "/(news|press|newsroom|press-releases?|blog|stories)/"

# people: candidates read from pages, whose title gives the name, the affiliation and the department

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
KIND = f"CASE WHEN host LIKE '%example.net' THEN 'social' WHEN host LIKE '%example.org' AND starts_with(url, 'http:') THEN 'listing' WHEN regexp_matches(lower(path), '{NEWS_PATH}') THEN 'news' ELSE 'web' END"


def candidates(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    ws = F.split(title, " ")
    part = lambda a, n: F.array_join(F.slice(ws, a, n), " ")
    url = F.col("url")
    has = lambda x: F.contains(url, F.lit(x))
    kind = F.when(url.startswith("http:"), S.source_kind(U.host(url), U.path(url), ["example.net"], [], ["example.org"], [])).otherwise(S.source_kind(U.host(url), U.path(url), ["example.net"], [], [], []))
    return t.pages.select(
        "page_id", title.alias("page"), kind.alias("kind"),
        F.when(has("/fr/"), "Nobody Known").otherwise(part(1, 2)).alias("name"), F.when(has("#"), "").otherwise(part(3, 3)).alias("affiliation"), F.when(has(".html"), " ").otherwise("lead").alias("role"),
        url.alias("public_profile_url"), F.when(~has("?page"), "water").alias("research_area"), F.when(has("ref="), "https://www.linkedin.com/in/x").alias("linkedin_url"),
        F.when(has("/de/"), "expert").alias("expertise"), F.when(F.length("html") > 2500, "bio").alias("bio"), part(6, 1).alias("department"), F.lit(None).cast("string").alias("relevant_work"), F.when(has("/en/"), "here").alias("work_location"),
        url.startswith("https").alias("institution_or_self_published"), (~has("/es/")).alias("sector_intersection"),
    )


def lacking(names, tests) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({x}, false) THEN '{n}' END" for n, x in zip(names, tests)) + "], lambda x: x IS NOT NULL), ', ')"


@plan(
    "ru07_person_gate",
    rf"""WITH c AS (SELECT page_id, url, length(html) AS n, {TITLE} AS page, regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\.', '') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    d AS (SELECT *, {KIND} AS kind, CASE WHEN contains(url, '/fr/') THEN 'Nobody Known' ELSE array_to_string(string_split(page, ' ')[1:2], ' ') END AS name, CASE WHEN contains(url, '#') THEN '' ELSE array_to_string(string_split(page, ' ')[3:5], ' ') END AS affiliation,
     NOT contains(url, '.html') AS has_role, contains(url, 'ref=') AS linked, n > 2500 AS has_bio, NOT contains(url, '?page') OR contains(url, '/de/') AS has_expertise, NOT contains(url, '/es/') AS relevant, trim(coalesce(string_split(page, ' ')[6], '')) <> '' AS has_unit FROM c),
    e AS (SELECT *, {WORDS.format(PLAIN.format('page'))} AS pw, {WORDS.format(PLAIN.format('name'))} AS nw, list_filter(list_distinct({WORDS.format(PLAIN.format('affiliation'))}), lambda w: length(w) > 2) AS aw FROM d),
    f AS (SELECT *, trim(name) <> '' AS has_name, kind = 'web' AND trim(name) <> '' AND len(nw) > 0 AND list_has_all(pw, nw) AND starts_with(url, 'https') AS official, trim(affiliation) <> '' AND len(aw) > 0 AND len(list_intersect(aw, pw)) >= 0.6 * len(aw) AS placed FROM e),
    g AS (SELECT *, {lacking(S.PERSON_MANDATORY, ['has_name', 'official OR linked', 'placed', 'relevant', 'has_role', 'has_expertise', 'has_bio OR linked'])} AS missing, {lacking(S.PERSON_PRIORITY, ['has_unit', 'true', 'false', "contains(url, '/en/')"])} AS missing_priority FROM f)
    SELECT page_id, CASE WHEN missing = '' THEN 'accept' WHEN has_name AND relevant AND kind <> 'social' AND len(list_filter(string_split(missing, ', '), lambda m: NOT list_contains({quoted(S.PERSON_FINDABLE)}, m))) = 0 THEN 'research' ELSE 'exclude' END AS decision,
    missing, missing_priority, CASE WHEN official THEN 'official_profile' WHEN linked THEN 'linkedin' END AS identity FROM g""",
)
def _(t):
    rows = candidates(t)
    c = lambda *names: {n: F.col(n) for n in names}
    gate = S.person_gate(
        F.col("kind"), T.name_on_page(F.col("name"), F.col("page")), T.share_on_page(F.col("affiliation"), F.col("page")), c("institution_or_self_published", "sector_intersection"),
        c("name", "affiliation", "role", "public_profile_url", "research_area"), c("linkedin_url", "expertise", "bio", "department", "relevant_work", "work_location"),
    )
    rows = rows.select("page_id", gate.alias("g"))
    return rows.select("page_id", "g.decision", F.array_join("g.missing", ", ").alias("missing"), F.array_join("g.missing_priority", ", ").alias("missing_priority"), "g.identity")


# events: orders as meetings of their customers


def meetings(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    day = F.to_date("o_orderdate")
    return rows.select(
        "o_orderkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("Meeting of "), "c_name")).otherwise(" ").alias("title"), F.when(F.col("o_orderpriority") != "5-LOW", day).alias("start_date"),
        F.date_add(day, F.when(F.col("o_totalprice") < 60000, -1).otherwise(2)).alias("end_date"), F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment")).otherwise("").alias("city"), F.lit(None).cast("string").alias("country"), F.lit("").alias("location"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("sectors"), F.when(F.col("o_totalprice") > 200000, "summit").alias("event_type"), F.when(F.col("c_acctbal") > 5000, "long").alias("description"),
        F.lit(None).cast("string").alias("access_type"), F.lit("").alias("sponsoring_orgs"),
        F.when(F.col("c_nationkey") == 3, "Online").alias("format"), F.when(F.col("c_acctbal") < 0, "").otherwise("a board").alias("organizer"), F.when(F.col("o_totalprice") > 350000, "https://r").alias("registration_url"), F.lit(None).cast("string").alias("themes"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Ann").alias("speakers"), F.lit(None).cast("string").alias("participating_organizations"), F.when(F.col("c_nationkey") == 9, "Postponed").alias("event_status"),
        F.when(F.col("c_nationkey") == 7, "The meeting will not take place.").when(F.col("c_nationkey") == 8, "It was rescheduled to spring").otherwise("Join us").alias("page"), F.when(F.col("c_nationkey") == 12, "news").otherwise("web").alias("kind"), F.when(F.col("c_nationkey") == 13, "listing").alias("page_kind"),
        (F.col("o_orderstatus") != "F").alias("single_discrete_event"), (F.col("o_orderpriority") > "2").alias("specific_topic"), (F.col("o_orderstatus") == "P").alias("sector_coverage"),
    )


@plan(
    "ru08_event_gate",
    f"""WITH m AS (SELECT o_orderkey, c_nationkey AS k, c_mktsegment AS seg, c_acctbal AS bal, o_totalprice AS price, o_orderpriority AS pri, o_orderstatus AS st, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS d FROM orders JOIN customer ON c_custkey = o_custkey),
    e AS (SELECT *, d + CASE WHEN price < 60000 THEN -1 ELSE 2 END AS ended, CASE WHEN k = 9 THEN 'postponed' WHEN k = 7 THEN 'cancelled' WHEN k = 8 THEN 'postponed' ELSE '' END AS status, k NOT IN (12, 13) AS official, seg <> 'MACHINERY' AND st <> 'F' AS one, k > 4 OR k = 3 AS placed, seg <> 'BUILDING' AND (pri > '2' OR st = 'P') AS relevant FROM m),
    g AS (SELECT *, {lacking(S.EVENT_MANDATORY, ['official', 'one', 'd IS NOT NULL', 'placed', 'relevant'])} AS missing, {lacking(S.EVENT_PRIORITY, ['bal >= 0', 'price > 350000', 'price > 200000', 'bal > 5000', 'false', "pri = '1-URGENT'"])} AS missing_priority,
     CAST(bal >= 0 AS INT) + CAST(price > 350000 AS INT) + CAST(price > 200000 AS INT) + CAST(bal > 5000 AS INT) + CAST(pri = '1-URGENT' AS INT) AS n FROM e)
    SELECT o_orderkey, CASE WHEN status = 'cancelled' OR NOT official OR NOT one OR NOT relevant THEN 'exclude' WHEN missing <> '' THEN 'research' WHEN coalesce(ended < d, false) OR status = 'postponed' THEN 'review' WHEN n >= 2 THEN 'accept' ELSE 'review' END AS decision,
    missing, missing_priority, CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN d IS NULL THEN 'date_unconfirmed' WHEN d < DATE '1998-01-01' THEN 'past' ELSE 'upcoming' END AS freshness FROM g""",
)
def _(t):
    c = lambda *names: {n: F.col(n) for n in names}
    gate = S.event_gate(
        F.col("kind"), F.col("page_kind"), F.col("page"), F.lit("1998-01-01").cast("date"), c("single_discrete_event", "specific_topic", "sector_coverage"),
        c("title", "start_date", "end_date", "city", "country", "location", "sectors", "event_type", "description", "access_type", "sponsoring_orgs"),
        c("event_status", "format", "organizer", "registration_url", "themes", "speakers", "participating_organizations"),
    )
    rows = meetings(t).select("o_orderkey", gate.alias("g"))
    return rows.select("o_orderkey", "g.decision", F.array_join("g.missing", ", ").alias("missing"), F.array_join("g.missing_priority", ", ").alias("missing_priority"), "g.freshness")


@plan(
    "ru10_qualification",
    """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS d, c_mktsegment <> 'BUILDING' AS sectors, o_totalprice > 350000 AS registration, o_totalprice > 200000 AS institutional, o_orderpriority = '1-URGENT' AS minable, c_nationkey > 4 AS judged FROM orders JOIN customer ON c_custkey = o_custkey),
    w AS (SELECT *, d >= DATE '1997-01-01' AND d <= DATE '1998-01-01' AND registration AND institutional AS attendable FROM m),
    r AS (SELECT o_orderkey, CASE WHEN d IS NULL THEN 'missing start date' WHEN NOT judged AND d > DATE '1998-01-01' THEN 'event date ' || d || ' is after window end 1998-01-01' WHEN NOT sectors THEN 'event has no sector match'
     WHEN d < DATE '1997-01-01' THEN CASE WHEN minable THEN 'mined, not stored: event date ' || d || ' is before run date 1997-01-01' ELSE 'event date ' || d || ' is before run date 1997-01-01; fewer than three named participants and no named speakers' END
     WHEN attendable OR minable THEN 'qualified as ' || concat_ws(' and ', CASE WHEN attendable THEN 'attendable' END, CASE WHEN minable THEN 'minable' END)
     ELSE concat_ws('; ', CASE WHEN NOT registration THEN 'registration is not open to external organisations' END, CASE WHEN NOT institutional THEN 'scale or topic does not justify institutional attendance' END, 'fewer than three named participants and no named speakers') END AS reason FROM w)
    SELECT o_orderkey, starts_with(reason, 'mined') OR starts_with(reason, 'qualified') AS accepted, CASE WHEN starts_with(reason, 'mined') THEN 'mined, not stored' WHEN starts_with(reason, 'qualified') THEN substr(reason, 14) END AS class, reason FROM r""",
)
def _(t):
    rows = meetings(t).join(t.customer.select("c_custkey", "c_nationkey").join(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), F.col("c_custkey") == F.col("o_custkey")), "o_orderkey")
    run, d = F.lit("1997-01-01").cast("date"), F.col("start_date")
    window = F.coalesce(d.between(run, F.add_months(run, 12)), F.lit(False))
    q = S.qualified(d, run, 12, F.col("sectors"), window, F.col("registration_url").isNotNull(), F.col("o_totalprice") > 200000, F.col("speakers").isNotNull(), F.col("c_nationkey") > 4)
    return rows.select("o_orderkey", q.alias("q")).select("o_orderkey", "q.accepted", "q.class", "q.reason")


# actors


ITEMS = ("real_operating_entity", "use_cases", "sector_coverage", "own_organisational_page", "open_programmes")
EVIDENCED = ("p_size > 3", "p_size % 4 > 0", "p_retailprice > 1000", "p_size % 3 > 0", "p_size > 30")
ABOUT = "CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'This page is an overview of ' || p_name || ' and of what it does.' WHEN p_size % 5 = 0 THEN 'One. Two. Three. Four sentences of a description of it.' ELSE 'It makes and sells the ' || p_name || ' for farms. It also runs a lab.' END"
PAGE = "CASE WHEN p_size % 9 = 0 THEN 'https://blog.example.com/events/' || CAST(p_partkey AS STRING) WHEN p_size % 8 = 0 THEN 'https://other.example.com/about' ELSE 'https://www.' || replace(p_name, ' ', '-') || '-' || lower(p_type) || '.example.org/about' END"
STATE = "CASE p_type WHEN 'ECONOMY' THEN 'CA' WHEN 'SMALL' THEN 'TX' WHEN 'LARGE' THEN '' ELSE 'OH' END"
QUALITY_NAME = f"CASE WHEN p_size % 13 = 0 THEN '' WHEN p_size = 20 THEN 'Top 10 ' || p_name || ' news' ELSE {ORG} END"


@plan(
    "ru09_actor_quality",
    rf"""WITH a AS (SELECT p_partkey, {QUALITY_NAME} AS name, {SITE} AS website, {PAGE} AS page, coalesce({ABOUT}, '') AS about, {STATE} AS state, p_type, p_size, p_retailprice, p_brand, least(p_retailprice / 2000.0, 1) AS score,
     list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in zip(ITEMS, EVIDENCED))}], lambda x: x IS NOT NULL) AS items FROM part),
    b AS (SELECT *, regexp_replace(regexp_extract(page, '://([^/]*)', 1), '^www\.', '') AS ph, regexp_replace(coalesce(regexp_extract(website, '://([^/]*)', 1), ''), '^www\.', '') AS oh, p_brand <> 'Brand#7' AS in_sector, state NOT IN ('CA', 'TX', '') AS outside, p_size > 40 AS there, CASE WHEN p_size = 33 THEN 'defunct' WHEN p_size = 34 THEN 'stale_own_site' END AS code FROM a),
    r AS (SELECT *, list_filter([CASE WHEN name = '' AND len(items) = 0 THEN 'unreadable_page' WHEN name = '' THEN 'no_name' END, CASE WHEN (name <> '' AND regexp_matches(name, '{S.LIST_NAME}')) OR regexp_matches(regexp_extract(page, '://[^/?#]*([^?#]*)', 1), '{S.LIST_PATH}') THEN 'not_an_organisation' END,
      CASE WHEN NOT in_sector THEN 'outside_requested_sector' END, CASE WHEN outside AND NOT there THEN 'outside_requested_region' END, CASE WHEN code = 'defunct' THEN code END, CASE WHEN score < 0.46 THEN 'below_reject_threshold' END], lambda x: x IS NOT NULL) AS bad,
     len(list_filter(string_split_regex(regexp_replace(about, '([.!?])[ \n\t]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS ns FROM b),
    h AS (SELECT *, list_filter([CASE WHEN outside AND there THEN 'operates_in_area_based_elsewhere' END, CASE WHEN oh = '' THEN 'website_unverified' WHEN array_to_string(string_split(ph, '.')[-2:], '.') <> array_to_string(string_split(oh, '.')[-2:], '.') THEN 'third_party_page' END,
      CASE WHEN len(items) < 3 THEN 'thin_evidence' END, CASE WHEN NOT list_contains(items, 'real_operating_entity') THEN 'entity_unconfirmed' END, CASE WHEN len(list_intersect(items, {quoted(S.SUBSTANCE)})) = 0 THEN 'no_substantive_work' END,
      CASE WHEN regexp_matches(about, '{S.PAGE_WORDS}') THEN 'describes_a_page' END, CASE WHEN length(about) < 40 OR ns NOT BETWEEN 1 AND 3 THEN 'weak_description' END, CASE WHEN code = 'stale_own_site' THEN code END, CASE WHEN p_size % 10 = 1 THEN 'location_unconfirmed' END,
      CASE WHEN state = '' OR about = '' THEN 'incomplete_record' END, CASE WHEN regexp_matches(coalesce(website, ''), '/lab/') THEN 'unit_or_parent_unclear' END, CASE WHEN p_retailprice < 960 THEN 'identity_unreliable' END,
      CASE WHEN score < 0.5 THEN 'below_accept_threshold' WHEN p_size < 10 THEN 'below_auto_verify_priority' END], lambda x: x IS NOT NULL) AS unsure FROM r)
    SELECT p_partkey, CASE WHEN len(bad) > 0 THEN 'REJECT' WHEN len(unsure) > 0 THEN 'REVIEW' ELSE 'ACCEPT' END AS decision, array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE unsure END, ',') AS codes FROM h""",
)
def _(t):
    items = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in zip(ITEMS, EVIDENCED)]))
    website, state = F.expr(SITE), F.expr(STATE)
    record = {
        "name": F.expr(QUALITY_NAME), "website": website, "description": F.expr(ABOUT), "state": state, "place": state, "unit_path": F.coalesce(F.contains(website, F.lit("/lab/")), F.lit(False)),
        "location_basis": F.when(F.col("p_size") % 10 == 1, "unconfirmed"), "operates_in": F.when(F.col("p_size") > 40, F.array(F.lit("TX"))), "sectors": F.array("p_brand"),
    }
    code = F.when(F.col("p_size") == 33, "defunct").when(F.col("p_size") == 34, "stale_own_site")
    v = S.actor_quality(
        record, F.expr(PAGE), F.least(F.col("p_retailprice") / 2000.0, F.lit(1.0)), items, 0.46, 0.5, [f"Brand#{i}" for i in range(1, 26) if i != 7], ["CA", "TX"], currency=(code, F.coalesce(code == "defunct", F.lit(False))),
        identity=F.when(F.col("p_retailprice") < 960, 0.2).otherwise(0.9), priority=F.when(F.col("p_size") < 10, 0.1).otherwise(0.8),
    )
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", "v.decision", F.array_join("v.codes", ",").alias("codes"))


@plan(
    "ru14_score_sheet",
    r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [CAST(l_linenumber AS VARCHAR), CAST(l_quantity / 20 AS VARCHAR), CAST(l_discount * 30 AS VARCHAR), CAST(l_tax * 40 AS VARCHAR), CASE l_returnflag WHEN 'R' THEN 'n/a' ELSE ' 2 ' END, CASE l_linestatus WHEN 'O' THEN '3' ELSE '1.0' END] AS raw, CASE WHEN l_returnflag = 'A' THEN 'TIER ' || l_linenumber ELSE l_returnflag END AS tier_raw FROM lineitem),
    p AS (SELECT *, list_transform(raw, lambda v: CASE WHEN trunc(TRY_CAST(trim(v) AS DOUBLE)) BETWEEN 1 AND 3 THEN CAST(trunc(TRY_CAST(trim(v) AS DOUBLE)) AS INTEGER) END) AS scores FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, len(list_filter(scores, lambda x: x IS NOT NULL)) AS scored, CASE WHEN len(list_filter(scores, lambda x: x IS NULL)) = 0 THEN CAST(list_sum(scores) AS INTEGER) END AS total, CASE WHEN regexp_matches(lower(tier_raw), 'tier\s*[0-9]') THEN 'tier_' || regexp_extract(lower(tier_raw), 'tier\s*([0-9])', 1) END AS tier FROM p""",
)
def _(t):
    raw = F.array(
        F.col("l_linenumber").cast("string"), (F.col("l_quantity") / 20).cast("string"), (F.col("l_discount") * 30).cast("string"), (F.col("l_tax") * 40).cast("string"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise(" 2 "), F.when(F.col("l_linestatus") == "O", "3").otherwise("1.0"),
    )
    tier = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("TIER "), F.col("l_linenumber").cast("string"))).otherwise(F.col("l_returnflag"))
    sheet = S.score_sheet(raw, tier)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sheet.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.scored", "s.total", "s.tier")


@plan(
    "ru13_ranking_items",
    r"""WITH r AS (SELECT p_brand AS entity, CASE WHEN p_size % 3 = 0 THEN 'QS' WHEN p_size % 3 = 1 THEN 'THE' ELSE 'Blog' END AS system, CASE WHEN p_size > 40 THEN 'about ' || p_size WHEN p_size > 30 THEN p_size || '-' || (p_size + 5) WHEN p_size > 25 THEN p_size || '+' ELSE ' =' || p_size || ' ' END AS rank, 1880 + p_size * 4 AS year, CASE WHEN p_type = 'SMALL' THEN 'subject' WHEN p_type = 'PROMO' THEN 'region' ELSE 'overall' END AS scope, CASE WHEN p_size < 10 THEN ' ' ELSE p_name END AS subject, CASE WHEN p_type = 'LARGE' THEN 'https://none.example.com/x' ELSE 'https://' || lower(p_type) || '.example.org/rank/' END AS url FROM part)
    SELECT DISTINCT entity, system, trim(rank) AS rank, year, scope, CASE WHEN scope = 'subject' THEN trim(subject) ELSE '' END AS subject, url FROM r
    WHERE system IN ('QS', 'THE') AND regexp_matches(trim(rank), '^=?[0-9]{1,4}([-–][0-9]{1,4}|\+)?$') AND year BETWEEN 1900 AND 2100 AND scope IN ('overall', 'subject') AND (scope = 'overall' OR trim(subject) <> '') AND url <> 'https://none.example.com/x'""",
)
def _(t):
    size = F.col("p_size").cast("string")
    rank = F.when(F.col("p_size") > 40, F.concat(F.lit("about "), size)).when(F.col("p_size") > 30, F.concat(size, F.lit("-"), (F.col("p_size") + 5).cast("string"))).when(F.col("p_size") > 25, F.concat(size, F.lit("+"))).otherwise(F.concat(F.lit(" ="), size, F.lit(" ")))
    url = F.when(F.col("p_type") == "LARGE", "https://none.example.com/x").otherwise(F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.org/rank/")))
    rows = t.part.select(
        F.col("p_brand").alias("entity"), F.when(F.col("p_size") % 3 == 0, "QS").when(F.col("p_size") % 3 == 1, "THE").otherwise("Blog").alias("system"), rank.alias("rank"), (1880 + F.col("p_size") * 4).alias("year"),
        F.when(F.col("p_type") == "SMALL", "subject").when(F.col("p_type") == "PROMO", "region").otherwise("overall").alias("scope"), F.when(F.col("p_size") < 10, " ").otherwise(F.col("p_name")).alias("subject"), url.alias("url"),
    )
    read = t.part.where("p_type <> 'LARGE'").select(F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.org/rank/")).alias("url"))
    return S.valid_rankings(rows, ["QS", "THE"], read)


DEFUNCT = S.DEFUNCT


@plan(
    "ru11_currency",
    rf"""WITH d AS (SELECT o_orderkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'News of the year. ' || replace(c_name, '#', ' ') || ' was acquired by Acme in spring' WHEN 'MACHINERY' THEN 'Our client was acquired by Acme. All is well' WHEN 'FURNITURE' THEN 'customer ' || c_nationkey || ' has ceased operations' ELSE 'We met in' END || '. Copyright ' || year(o_orderdate) || ', next 2031.' AS page, CASE WHEN c_acctbal > 8000 THEN 'https://new.example.com' WHEN c_acctbal > 7000 THEN 'https://www.old.example.org/x' END AS landed, 'https://old.example.org' AS stated, c_acctbal > 3000 AS own FROM orders JOIN customer ON c_custkey = o_custkey),
    y AS (SELECT *, list_max(list_filter(list_transform(regexp_extract_all(page, '(^|[^0-9.])(19[5-9][0-9]|20[0-4][0-9])', 2), lambda v: CAST(v AS INTEGER)), lambda v: v <= 2002)) AS newest, array_to_string(string_split(regexp_replace(regexp_extract(landed, '://([^/]*)', 1), '^www\.', ''), '.')[-2:], '.') AS dom,
     len(list_filter(string_split(page, '.'), lambda s: regexp_matches(s, '{DEFUNCT}') AND regexp_matches(lower(s), '(^|[^a-z0-9])' || regexp_extract(lower(c_name), '[0-9]+') || '([^a-z0-9]|$)|customer'))) > 0 AS gone FROM d)
    SELECT o_orderkey, CASE WHEN landed IS NOT NULL AND dom <> 'example.org' THEN 'merged_or_renamed' WHEN gone THEN 'defunct' WHEN 2002 - newest >= 4 THEN CASE WHEN own THEN 'stale_own_site' ELSE 'outdated_source' END END AS code FROM y""",
)
def _(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    said = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("News of the year. "), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" was acquired by Acme in spring"))).when(F.col("c_mktsegment") == "MACHINERY", "Our client was acquired by Acme. All is well").when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("customer "), F.col("c_nationkey").cast("string"), F.lit(" has ceased operations"))).otherwise("We met in")
    page = F.concat(said, F.lit(". Copyright "), F.year("o_orderdate").cast("string"), F.lit(", next 2031."))
    landed = F.when(F.col("c_acctbal") > 8000, "https://new.example.com").when(F.col("c_acctbal") > 7000, "https://www.old.example.org/x")
    return rows.select("o_orderkey", S.currency(F.col("c_name"), page, F.lit("https://old.example.org"), landed, F.col("c_acctbal") > 3000, 2002).alias("code"))


# facts: readings of parts of one name, one after the other

READING = "p_name || ' of ' || p_brand || CASE WHEN p_size > 25 THEN ' in ' || lower(p_type) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' sold 1,200 units' ELSE '' END"
STOPPED = quoted(FA.FACT_STOP)
FIGURES = "list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[0-9][0-9,.]*'), lambda n: regexp_replace(replace(n, ',', ''), '[.]+$', ''))))"
SAID = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9&]+'), lambda w: length(w) > 2 AND NOT list_contains({STOPPED}, w) AND NOT regexp_matches(w, '^[0-9]+$')))"
READ = f"""r AS (SELECT p_partkey, p_type, {READING} AS new, lag({READING}) OVER (PARTITION BY p_name ORDER BY p_partkey) AS old FROM part),
q AS (SELECT *, {FIGURES.format('old')} AS na, {FIGURES.format('new')} AS nb, {SAID.format('old')} AS wa, {SAID.format('new')} AS wb FROM r WHERE old IS NOT NULL),
j AS (SELECT *, len(list_intersect(wa, wb)) AS i, len(list_filter(na, lambda n: NOT list_contains(nb, n))) = 0 AS a_in_b, len(list_filter(nb, lambda n: NOT list_contains(na, n))) = 0 AS b_in_a FROM q),
f AS (SELECT *, na = nb AND CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN len(na) > 0 OR (len(wa) = 0 AND len(wb) = 0) ELSE i / least(len(wa), len(wb)) >= 0.7 END AS same, a_in_b AND (len(na) > 0 OR len(wa) > 0) AND i >= 0.7 * len(wa) AS new_covers, b_in_a AND (len(nb) > 0 OR len(wb) > 0) AND i >= 0.7 * len(wb) AS old_covers, b_in_a AND (len(nb) > 0 OR len(wb) > 0) AND i >= 0.6 * len(wb) AS old_knows FROM j)"""


def readings(t):
    new = F.expr(READING)
    rows = t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_brand", new.alias("new"))
    return rows.withColumn("old", F.lag("new").over(Window.partitionBy("p_name").orderBy("p_partkey"))).where("old IS NOT NULL")


@plan("fa04_same_text", f"WITH {READ} SELECT p_partkey, same, old_covers, new_covers FROM f")
def _(t):
    old, new = F.col("old"), F.col("new")
    return readings(t).select("p_partkey", FA.same_text(old, new).alias("same"), FA.covers(old, new).alias("old_covers"), FA.covers(new, old).alias("new_covers"))


@plan(
    "fa05_compared",
    f"""WITH {READ}, o AS (SELECT *, (p_type IN ('SMALL', 'LARGE') AND ((na = nb AND len(wa) > 0 AND len(wb) > 0 AND i >= 0.5 * least(len(wa), len(wb))) OR old_knows)) OR same OR old_covers AS known FROM f)
    SELECT p_partkey, CASE WHEN known THEN 'corroborated' WHEN new_covers THEN 'additional' ELSE 'changed' END AS outcome, CASE WHEN known THEN old ELSE new END AS merged FROM o""",
)
def _(t):
    rows = readings(t).select("p_partkey", FA.compared_text(F.col("old"), F.col("new"), F.col("p_type").isin("SMALL", "LARGE")).alias("c"))
    return rows.select("p_partkey", "c.outcome", "c.merged")


@plan(
    "fa05_compared_lists",
    """WITH l AS (SELECT p_name, array_agg(p_brand || ' ' || lower(p_type) ORDER BY p_partkey) FILTER (WHERE p_size < 12) AS old, array_agg(p_brand || ' ' || lower(p_type) ORDER BY p_partkey) FILTER (WHERE p_size > 38) AS new FROM part GROUP BY 1),
    a AS (SELECT p_name, coalesce(old, []) AS old, list_filter(coalesce(new, []), lambda x: NOT list_contains(coalesce(old, []), x)) AS added FROM l)
    SELECT p_name, CASE WHEN len(added) > 0 THEN 'additional' ELSE 'corroborated' END AS outcome, len(added) AS n_added, len(old) + len(added) AS n_merged FROM a""",
)
def _(t):
    # items of two words and a figure: the same text only where brand figure and type agree
    item = F.concat_ws(" ", F.regexp_replace("p_brand", "Brand", ""), F.concat(F.lit("brand"), F.lower("p_type")))
    grouped = t.part.groupBy("p_name").agg(F.collect_list(F.when(F.col("p_size") < 12, item)).alias("old"), F.collect_list(F.when(F.col("p_size") > 38, item)).alias("new"))
    rows = grouped.select("p_name", FA.compared_lists(F.col("old"), F.col("new")).alias("c"))
    return rows.select("p_name", "c.outcome", F.size("c.added").cast("bigint").alias("n_added"), F.size("c.merged").cast("bigint").alias("n_merged"))


@plan(
    "fa05_compared_parts",
    f"""WITH r AS (SELECT p_partkey, p_type, nullif(p_brand || CASE WHEN p_size > 25 THEN ' works' ELSE '' END, '') AS b1, CASE WHEN p_size % 4 > 0 THEN lower(p_type) || ' ' || (p_size % 3) END AS b2, lag(p_brand || CASE WHEN p_size > 25 THEN ' works' ELSE '' END) OVER w AS a1, lag(CASE WHEN p_size % 4 > 0 THEN lower(p_type) || ' ' || (p_size % 3) END) OVER w AS a2, row_number() OVER w AS n FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)),
    x AS (SELECT p_partkey, p_type, 'brand' AS part, a1 AS old, b1 AS new FROM r WHERE n > 1 UNION ALL SELECT p_partkey, p_type, 'kind', a2, b2 FROM r WHERE n > 1),
    q AS (SELECT *, coalesce(trim(old), '') = '' AS no_old, coalesce(trim(new), '') = '' AS no_new, {FIGURES.format('old')} AS na, {FIGURES.format('new')} AS nb, {SAID.format('old')} AS wa, {SAID.format('new')} AS wb FROM x),
    j AS (SELECT *, len(list_intersect(wa, wb)) AS i, len(list_filter(na, lambda n: NOT list_contains(nb, n))) = 0 AS a_in_b, len(list_filter(nb, lambda n: NOT list_contains(na, n))) = 0 AS b_in_a FROM q),
    f AS (SELECT *, na = nb AND CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN len(na) > 0 OR (len(wa) = 0 AND len(wb) = 0) ELSE i / least(len(wa), len(wb)) >= 0.7 END AS same, a_in_b AND (len(na) > 0 OR len(wa) > 0) AND i >= 0.7 * len(wa) AS new_covers, b_in_a AND (len(nb) > 0 OR len(wb) > 0) AND i >= 0.7 * len(wb) AS old_covers FROM j),
    o AS (SELECT *, CASE WHEN no_old AND no_new THEN NULL WHEN no_new THEN 'not_restated' WHEN no_old OR (same AND new_covers AND len(wb) > len(wa)) THEN 'additional' WHEN same OR old_covers THEN 'confirmed' WHEN new_covers THEN 'additional' ELSE 'changed' END AS outcome FROM f),
    g AS (SELECT p_partkey, any_value(p_type) AS p_type, max(outcome) FILTER (WHERE part = 'brand') AS brand, max(outcome) FILTER (WHERE part = 'kind') AS kind, bool_or(coalesce(outcome = 'changed', false)) AS changed, bool_or(coalesce(outcome = 'additional', false)) AS added, max(old) FILTER (WHERE part = 'kind') AS old_kind, max(new) FILTER (WHERE part = 'kind') AS new_kind FROM o GROUP BY 1)
    SELECT p_partkey, CASE WHEN changed THEN 'changed' WHEN added THEN 'additional' ELSE 'corroborated' END AS outcome, brand, kind, CASE WHEN NOT changed AND NOT added THEN old_kind WHEN changed AND p_type NOT IN ('SMALL', 'LARGE') THEN new_kind WHEN kind IN ('confirmed', 'not_restated') THEN old_kind ELSE coalesce(new_kind, old_kind) END AS merged_kind FROM g""",
)
def _(t):
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    brand, kind = F.concat("p_brand", F.when(F.col("p_size") > 25, " works").otherwise("")), F.when(F.col("p_size") % 4 > 0, F.concat_ws(" ", F.lower("p_type"), (F.col("p_size") % 3).cast("string")))
    rows = t.part.select("p_partkey", "p_type", brand.alias("b1"), kind.alias("b2"), F.lag(brand).over(w).alias("a1"), F.lag(kind).over(w).alias("a2"), F.row_number().over(w).alias("n")).where("n > 1")
    told = rows.select("p_partkey", FA.compared_parts({"brand": F.col("a1"), "kind": F.col("a2")}, {"brand": F.col("b1"), "kind": F.col("b2")}, F.col("p_type").isin("SMALL", "LARGE")).alias("c"))
    of = lambda part: F.get(F.transform(F.filter("c.parts", lambda p: p["part"] == part), lambda p: p["outcome"]), F.lit(0))
    return told.select("p_partkey", "c.outcome", of("brand").alias("brand"), of("kind").alias("kind"), F.col("c.merged.kind").alias("merged_kind"))


@plan(
    "fa06_supported",
    f"""WITH {READ} SELECT p_partkey, b_in_a AND CASE WHEN len(wb) = 0 THEN len(nb) > 0 ELSE i >= 0.6 * len(wb) END AS supported FROM f""",
)
def _(t):
    return readings(t).select("p_partkey", FA.supported(F.col("new"), F.col("old")).alias("supported"))


ON_PAGE = "(({0} <> '' AND contains(page, {0})) OR (len(list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 2))) >= 4 AND len(list_intersect(list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 2)), string_split(page, ' '))) >= 0.8 * len(list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 2)))))"
LATIN = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@plan(
    "fa08_verified",
    f"""WITH d AS (SELECT a.doc_id, coalesce(a.text, '') AS text, string_split_regex(coalesce(a.text, ''), '[ \n]+') AS w, string_split_regex(coalesce(o.text, ''), '[ \n]+') AS v FROM documents a LEFT JOIN documents o ON o.doc_id = a.doc_id + 1),
    k AS (SELECT doc_id, {PLAIN.format('text')} AS page, array_to_string(w[2:7], ' ') AS quote, [array_to_string(w[3:5], ' '), array_to_string(v[1:3], ' '), array_to_string(w[4:6], ' ') || ', ' || array_to_string(v[2:9], ' '), concat_ws(' ', w[7], w[3]), 'zzqx 99'] AS said FROM d),
    q AS (SELECT *, CASE WHEN trim(quote) <> '' AND {ON_PAGE.format(PLAIN.format('quote'))} THEN quote ELSE '' END AS backed FROM k),
    i AS (SELECT doc_id, page, backed, unnest(list_filter(list_transform(said, lambda x: trim(x)), lambda x: x <> '')) AS item FROM q),
    p AS (SELECT doc_id, page, {PLAIN.format('item')} AS whole, {PLAIN.format("split_part(item, ',', 1)")} AS head, list_filter({LATIN.format('item')}, lambda w: length(w) > 3) AS iw, {LATIN.format('backed')} AS bw FROM i)
    SELECT doc_id, count(*) FILTER (WHERE {ON_PAGE.format('whole')} OR {ON_PAGE.format('head')} OR (len(iw) > 0 AND len(list_intersect(iw, bw)) = len(iw))) AS kept, count(*) AS said FROM p GROUP BY 1""",
)
def _(t):
    # the items take the first seven words of a text and nine of the next, so only these are cut off; a page is its whole text
    following = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.slice(F.split(F.coalesce("text", F.lit("")), "[ \\n]+", 10), 1, 9).alias("v"))
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(following, "doc_id", "left").withColumn("w", F.slice(F.split("text", "[ \\n]+", 8), 1, 7)).withColumn("v", F.coalesce("v", F.array(F.lit(""))))
    run = lambda c, at, n: F.array_join(F.slice(c, at, n), " ")
    items = F.array(run("w", 3, 3), run("v", 1, 3), F.concat(run("w", 4, 3), F.lit(", "), run("v", 2, 8)), F.concat_ws(" ", F.get("w", F.lit(6)), F.get("w", F.lit(2))), F.lit("zzqx 99"))
    v = FA.verified_items(items, run("w", 2, 6), F.col("text"))
    return rows.select("doc_id", v.alias("v")).select("doc_id", F.size("v.kept").cast("bigint").alias("kept"), (F.size("v.kept") + F.size("v.dropped")).cast("bigint").alias("said"))
