"""Plans of hubs, uploads, schedules, sheets and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators import evaluation as V
from ..operators import identity as I
from ..operators import ledger as L
from ..operators import places as P
from ..operators import schedule as SM
from ..operators import screening as X
from ..sources.pages import listing_cards
from .domain import SCORED, scored
from .identities import W, named_pairs, organizations, quoted
from .registry import plan
from .scalars import LAT, LON, MILES, lat, lon

# hubs: nations as hubs of a sector, suppliers as actors of two sectors


def actors(t):
    place = lambda c: F.when(F.col("s_suppkey") % 11 != 5, c)
    return t.supplier.select(F.col("s_suppkey").alias("actor"), F.array((F.col("s_nationkey") % 5), (F.col("s_suppkey") % 3).cast("int")).alias("sectors"), place(lat("s_suppkey")).alias("lat"), place(lon("s_suppkey")).alias("lon"))


def hubs(t):
    return t.nation.select(F.col("n_nationkey").alias("hub"), (F.col("n_nationkey") % 5).alias("hub_sector"), lat("n_nationkey").alias("lat2"), lon("n_nationkey").alias("lon2"), (F.lit(200.0) + F.col("n_regionkey") * 100).alias("radius"))


def members(t):
    return t.supplier.select(F.col("s_suppkey").alias("actor"), F.col("s_nationkey").alias("hub"), F.when(F.col("s_acctbal") > 5000, "member").otherwise("assigned").alias("kind"))


A_SQL = f"""a AS (SELECT s_suppkey AS actor, [s_nationkey % 5, CAST(s_suppkey % 3 AS INTEGER)] AS sectors, CASE WHEN s_suppkey % 11 <> 5 THEN {LAT.format('s_suppkey')} END AS lat, CASE WHEN s_suppkey % 11 <> 5 THEN {LON.format('s_suppkey')} END AS lon, s_nationkey AS member_of, s_acctbal FROM supplier),
h AS (SELECT n_nationkey AS hub, n_nationkey % 5 AS hub_sector, {LAT.format('n_nationkey')} AS lat2, {LON.format('n_nationkey')} AS lon2, 200.0 + n_regionkey * 100 AS radius FROM nation)"""
D_SQL = MILES.format("lat", "lon", "lat2", "lon2")


@plan(
    "cl07_hub_outcome",
    f"""WITH {A_SQL}, e AS (SELECT actor, hub, list_contains(sectors, hub_sector) AS m, CASE WHEN list_contains(sectors, hub_sector) AND lat IS NOT NULL THEN {D_SQL} END AS d, radius FROM a JOIN nation x ON x.n_nationkey = member_of JOIN nation y ON y.n_regionkey = x.n_regionkey JOIN h ON hub = y.n_nationkey)
    SELECT actor, hub, CASE WHEN NOT m THEN 'needs_review_sector' WHEN d IS NULL OR d > radius THEN 'needs_review_location' ELSE 'assigned' END AS outcome, CASE WHEN m THEN 'normal' ELSE 'low' END AS priority, coalesce(d > radius, false) AS outside FROM e""",
)
def _(t):
    # the pairs that are asked for: a supplier and the hubs of its region
    region = t.nation.select(F.col("n_nationkey").alias("hub"), F.col("n_regionkey").alias("r"))
    own = actors(t).join(members(t).select("actor", "hub").join(region, "hub").drop("hub"), "actor")
    pairs = own.join(hubs(t).join(region, "hub"), "r")
    return P.evaluations(pairs).select("actor", "hub", "outcome", "priority", "outside")


@plan(
    "cl11_membership_fit",
    f"""WITH {A_SQL}, e AS (SELECT actor, hub, s_acctbal, list_contains(sectors, hub_sector) AS m, CASE WHEN lat IS NOT NULL THEN {D_SQL} END AS d, radius FROM a JOIN h ON hub = member_of)
    SELECT actor, hub, CASE WHEN NOT m THEN 'sector_no_longer_matches' WHEN d IS NULL THEN 'location_unknown' WHEN d > radius THEN 'outside_radius' ELSE 'fits' END AS fit, s_acctbal > 5000 AS preserved FROM e""",
)
def _(t):
    return P.reassessed(actors(t), hubs(t), members(t))[0]


@plan(
    "cl11_reassessment",
    f"""WITH {A_SQL}, w AS (SELECT DISTINCT actor, unnest(sectors) AS sector, lat, lon, member_of % 5 AS held FROM a), e AS (SELECT actor, sector, hub, round({D_SQL}, 6) AS miles FROM w JOIN h ON hub_sector = sector AND sector <> held WHERE lat IS NOT NULL AND {D_SQL} <= radius)
    SELECT actor, sector, arg_min(hub, (miles, hub)) AS hub FROM e GROUP BY 1, 2""",
)
def _(t):
    return P.reassessed(actors(t), hubs(t), members(t))[1].select("actor", "sector", "hub")


@plan(
    "cl03_exclusions",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'status_not_enabled' WHEN c_nationkey % 5 = c_custkey % 5 AND c_custkey % 2 = 0 THEN 'already_assigned_same_sector' WHEN c_acctbal > 9500 THEN 'merged' WHEN c_mktsegment = 'MACHINERY' THEN 'aggregate'
    WHEN c_nationkey = 7 OR c_nationkey = 8 THEN 'missing_deterministic_geography' WHEN c_acctbal < 500 THEN 'missing_classification' END AS reason FROM customer""",
)
def _(t):
    own = (F.col("c_nationkey") % 5).cast("string")
    actor = {
        "status": F.when(F.col("c_acctbal") < 0, "draft").otherwise("Verified"), "assigned": F.when(F.col("c_custkey") % 2 == 0, F.array(own)), "merged": F.col("c_acctbal") > 9500,
        "category": F.when(F.col("c_mktsegment") == "MACHINERY", "Aggregate").otherwise(F.col("c_mktsegment")), "kind": F.when(F.col("c_acctbal") >= 500, "lab"),
        "lat": F.when(F.col("c_nationkey") != 7, lat("c_nationkey")), "lon": lon("c_nationkey"), "city": F.lit("X"), "state": F.when(F.col("c_nationkey") == 8, " ").otherwise("ST"),
    }
    return t.customer.select("c_custkey", P.exclusion(actor, (F.col("c_custkey") % 5).cast("string"), ["verified", "needs_review"]).alias("reason"))


STATES = {"TX": "Texas", "NV": "Nevada", "OH": "Ohio", "CA": "California"}


@plan("ge06_place_statements")
def _(t):
    # a page for each supplier, made of sentences that its lines and its nation give
    c, s = (F.concat(F.lit("Town "), F.chr(65 + F.col("s_nationkey") % 26)), F.element_at(F.array(*map(F.lit, [*STATES, "Texas"])), F.col("s_suppkey").cast("int") % 5 + 1))
    page = F.concat(F.lit("We make rods. "), F.when(F.col("s_acctbal") > 4000, F.concat(F.lit("It is headquartered in "), c, F.lit(", "), s, F.lit(". "))).otherwise(""), F.when(F.col("s_nationkey") % 3 == 0, "Visit us at 12 Main St, Reno, NV 89501. ").when(F.col("s_nationkey") % 3 == 1, "An office located in Austin, Texas helps. ").otherwise("They like Ohio. "))
    return t.supplier.select("s_suppkey", P.checked_location(F.lit("TX"), page, STATES).alias("c")).select("s_suppkey", "c.action", "c.state", "c.headquarters", F.array_join("c.operates_in", ",").alias("operates_in"))


# uploads and curation


FIELDS = [
    {"key": "name", "header": "Name", "kind": "text", "required": True, "most": 9}, {"key": "site", "header": "Website", "kind": "url"}, {"key": "start", "header": "Start date", "kind": "date", "required": True},
    {"key": "priority", "header": "Priority", "kind": "enum", "allowed": ["1-Urgent", "2 HIGH", "3_medium"]}, {"key": "note", "header": "Notes", "kind": "text"},
]


@plan(
    "cu01_row_checks",
    r"""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN '  ' ELSE 'Order ' || o_custkey || ' ' END AS name, CASE o_orderstatus WHEN 'P' THEN 'not a site' WHEN 'F' THEN 'www.o' || o_custkey || '.example.org/x' END AS site,
     CASE WHEN o_totalprice < 50000 THEN NULL WHEN o_totalprice < 150000 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_totalprice < 300000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:30' END AS start, o_orderpriority AS priority, CASE WHEN o_custkey % 9 = 0 THEN '=SUM(A1)' ELSE 'fine' END AS note FROM orders),
    t AS (SELECT *, trim(name) AS n FROM o)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN length(n) > 9 THEN 'Name is longer than 9 characters.' END, CASE WHEN n = '' THEN 'Name is required.' END, CASE WHEN start IS NULL THEN 'Start date is required.' END, CASE WHEN note = '=SUM(A1)' THEN 'Notes starts like a formula (''=SUM(A1)...''). Type the value itself.' END,
     CASE WHEN site = 'not a site' THEN 'Website is not a web address.' END, CASE WHEN ends_with(start, ' 10:30') THEN 'Start date ''' || start || ''' is not a date: use MM/DD/YYYY.' END,
     CASE WHEN regexp_replace(lower(priority), '[\s_-]+', '', 'g') NOT IN ('1urgent', '2high', '3medium') THEN 'Priority ''' || priority || ''' is not an allowed value.' END], lambda x: x IS NOT NULL), ' ') AS errors FROM t""",
)
def _(t):
    d = F.col("o_orderdate")
    values = {
        "name": F.when(F.col("o_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit("Order "), F.col("o_custkey").cast("string"), F.lit(" "))),
        "site": F.when(F.col("o_orderstatus") == "P", "not a site").when(F.col("o_orderstatus") == "F", F.concat(F.lit("www.o"), F.col("o_custkey").cast("string"), F.lit(".example.org/x"))),
        "start": F.when(F.col("o_totalprice") < 50000, None).when(F.col("o_totalprice") < 150000, F.date_format(d, "MM/dd/yyyy")).when(F.col("o_totalprice") < 300000, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd' 10:30'")),
        "priority": F.col("o_orderpriority"), "note": F.when(F.col("o_custkey") % 9 == 0, "=SUM(A1)").otherwise("fine"),
    }
    return C.field_errors(t.orders, values, FIELDS).select("o_orderkey", F.array_join("errors", " ").alias("errors"))


@plan(
    "cu01_cross_rules",
    r"""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_brand END AS website, CASE WHEN p_size % 5 > 0 THEN p_type END AS source, CASE WHEN p_size % 3 > 0 THEN p_name END AS parent, CASE WHEN p_size % 4 > 0 THEN 'part of' END AS relation, CASE WHEN p_size % 2 = 0 THEN 'seed' ELSE ' ' END AS stage, lower(p_type) AS kind, CASE WHEN p_size > 10 THEN p_brand END AS region, CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'Brand#' || (11 + p_size % 5) END AS derived, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 8 = 0 THEN 'One. Two! Three? Four.' ELSE p_name || '. It sells.' END AS about FROM part)
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN website IS NULL AND source IS NULL THEN 'a website or a source is required' END, CASE WHEN (parent IS NULL) <> (relation IS NULL) THEN 'parent and relationship go together' END, CASE WHEN trim(stage) <> '' AND kind NOT IN ('small', 'promo') THEN 'a stage is for startups' END,
     CASE WHEN region IS NULL AND kind IN ('large') THEN 'a lab needs its designation' END, CASE WHEN region IS NOT NULL AND NOT ((kind = 'small' AND region = 'Brand#11') OR (kind = 'large' AND region = 'Brand#12')) THEN 'no such category and type' END, CASE WHEN region IS NOT NULL AND derived IS NOT NULL AND region <> derived THEN 'the region is not that of the state' END,
     CASE WHEN about IS NOT NULL AND len(string_split_regex(about, '[.!?] ')) NOT BETWEEN 1 AND 3 THEN 'a description has one to three sentences' END], lambda x: x IS NOT NULL).list_transform(lambda m: 'Row ' || p_partkey || ': ' || m), ' | ') AS errors FROM r""",
)
def _(t):
    when = lambda c, v: F.when(F.expr(c), F.col(v) if v.startswith("p_") else F.lit(v))
    about = F.when(F.expr("p_size % 9 = 0"), None).when(F.expr("p_size % 8 = 0"), "One. Two! Three? Four.").otherwise(F.concat("p_name", F.lit(". It sells.")))
    rows = t.part.select("p_partkey", when("p_size % 7 > 0", "p_brand").alias("website"), when("p_size % 5 > 0", "p_type").alias("source"), when("p_size % 3 > 0", "p_name").alias("parent"), when("p_size % 4 > 0", "part of").alias("relation"), when("p_size % 2 = 0", "seed").otherwise(" ").alias("stage"), F.lower("p_type").alias("kind"), when("p_size > 10", "p_brand").alias("region"), about.alias("about"), F.when(F.expr("p_size % 6 > 0"), F.concat(F.lit("Brand#"), (11 + F.col("p_size") % 5).cast("string"))).alias("derived"))
    rules = [
        ("one of", ("website", "source"), "a website or a source is required"), ("both", ("parent", "relation"), "parent and relationship go together"), ("only for", ("stage", "kind"), "a stage is for startups", ("small", "promo")), ("needed for", ("region", "kind"), "a lab needs its designation", ("large",)),
        ("pair", ("kind", "region"), "no such category and type", (("small", "Brand#11"), ("large", "Brand#12"))), ("derived", ("region",), "the region is not that of the state", F.col("derived")), ("sentences", ("about",), "a description has one to three sentences", (1, 3)),
    ]
    return C.cross_errors(rows, rules, "p_partkey").select("p_partkey", F.array_join("errors", " | ").alias("errors"))


@plan(
    "cu05_review_export",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, c_name, s_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 JOIN supplier ON s_suppkey = o_custkey % 100 AND s_acctbal > 0 WHERE o_orderstatus = 'P' ORDER BY place LIMIT 500",
)
def _(t):
    rows = t.orders.where("o_orderstatus = 'P'").join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).join(t.supplier.where("s_acctbal > 0"), F.col("s_suppkey") == F.col("o_custkey") % 100)
    best = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)  # an export that a person reads
    return best.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"), "c_name", "s_name")


@plan(
    "cu07_operations",
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p, CASE WHEN o_orderpriority = '1-URGENT' THEN 'actor_update' ELSE 'discovery' END AS job FROM orders),
    e AS (SELECT event_id, user_id, event_type, value FROM events), ck AS (SELECT event_id, user_id, value FROM e WHERE event_type = 'signup'), pr AS (SELECT event_id, user_id FROM e WHERE event_type = 'click'),
    runs AS (SELECT 'collection_run' AS source, r.k AS reference, coalesce(CASE WHEN job = 'actor_update' THEN ck.user_id ELSE coalesce(pr.user_id, CASE WHEN c_acctbal > 0 THEN c_custkey END) END, -1) AS person,
      CASE WHEN job = 'actor_update' THEN CASE WHEN ck.user_id IS NOT NULL THEN 'ran the check' END WHEN pr.user_id IS NOT NULL THEN 'pressed Run now' WHEN c_acctbal > 0 THEN 'owns the request' END AS because, CASE s WHEN 'O' THEN 'in progress' WHEN 'P' THEN 'partial run' ELSE 'final' END AS basis, round(p, 2) AS cost
      FROM r LEFT JOIN ck ON job = 'actor_update' AND ck.event_id = r.k LEFT JOIN pr ON job <> 'actor_update' AND pr.event_id = r.k LEFT JOIN customer ON job <> 'actor_update' AND c_custkey = r.c),
    loose AS (SELECT 'check_result', event_id, user_id, 'ran the check', CASE WHEN value IS NOT NULL THEN 'recorded by the check' ELSE 'unknown' END, round(coalesce(value, 0), 2) FROM ck WHERE event_id NOT IN (SELECT k FROM r WHERE job = 'actor_update')),
    asks AS (SELECT 'ask_usage', event_id, user_id, 'asked', CASE WHEN value > 10 THEN 'priced from tokens' ELSE 'unknown (no price)' END, round(value, 2) FROM e WHERE event_type = 'view')
    SELECT * FROM runs UNION ALL SELECT * FROM loose UNION ALL SELECT * FROM asks""",
)
def _(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderpriority") == "1-URGENT", "actor_update").otherwise("discovery").alias("job"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("check"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("request"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost"))
    of = lambda kind: t.events.where(F.col("event_type") == kind)
    checks = of("signup").select(F.col("event_id").alias("check"), F.col("user_id").alias("person"), F.col("value").alias("cost"))
    presses = of("click").select(F.col("event_id").alias("run"), F.col("user_id").alias("person"))  # already matched to runs
    owners = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("request"), F.col("c_custkey").alias("person"))
    asks = of("view").select(F.col("event_id").alias("ask"), F.col("user_id").alias("person"), F.col("value").alias("cost"), (F.col("value") > 10).alias("priced"))
    return L.operations(runs, checks, presses, owners, asks)


@plan(
    "cu07_imports",
    """WITH d AS (SELECT event_id AS k, user_id AS p FROM events WHERE event_type = 'signup'), o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 4000)
    SELECT 'scrape_run' AS source, o_orderkey AS reference, coalesce(d.p, c_custkey, -1) AS person, CASE WHEN d.p IS NOT NULL THEN 'started the completion' WHEN c_custkey IS NOT NULL THEN 'owns the import' END AS because, CASE o_orderstatus WHEN 'O' THEN 'in progress' WHEN 'P' THEN 'partial run' ELSE 'final' END AS basis, round(o_totalprice, 2) AS cost
    FROM orders LEFT JOIN d ON d.k = o_orderkey LEFT JOIN o ON c_custkey = o_custkey""",
)
def _(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost"))
    started = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("run"), F.col("user_id").alias("person"))
    owners = t.orders.join(t.customer.where("c_acctbal > 4000"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("run"), F.col("c_custkey").alias("person"))
    return L.import_operations(runs, started, owners)


@plan(
    "cu07_map_calls",
    """WITH c AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(floor(l_quantity * 1000) AS BIGINT) END) AS cost, sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_linenumber * 1000 ELSE 0 END) AS held FROM lineitem GROUP BY 1),
    s AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase')
    SELECT 'map_calls' AS source, o_orderkey AS reference, coalesce(CASE WHEN o_orderpriority = '2-HIGH' THEN s.user_id ELSE c_custkey END, -1) AS person,
    CASE WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN s.user_id IS NOT NULL THEN 'started the search' END WHEN c_custkey IS NOT NULL THEN 'owns the map' END AS because,
    CASE WHEN held > 0 THEN 'estimate (calls still running)' WHEN o_orderstatus = 'O' THEN 'in progress' WHEN o_orderstatus = 'P' THEN 'partial run' ELSE 'final' END AS basis, round((cost + held) / 1e6, 6) AS cost
    FROM orders JOIN c ON k = o_orderkey LEFT JOIN s ON event_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
)
def _(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") == "2-HIGH").alias("search"))
    calls = t.lineitem.select(F.col("l_orderkey").alias("run"), F.when(F.col("l_returnflag") != "R", F.floor(F.col("l_quantity") * 1000)).alias("cost"), (F.col("l_linenumber") * 1000).cast("bigint").alias("reserved"), (F.col("l_linestatus") == "F").alias("finished"))
    searches = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("run"), F.col("user_id").alias("person"))
    owners = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("run"), F.col("c_custkey").alias("person"))
    return L.map_operations(runs, calls, searches, owners)


@plan(
    "cu08_run_labels",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'datafeed:' || user_id WHEN 'click' THEN 'actor-update:' || user_id WHEN 'signup' THEN 'v2-review:topic' || user_id % 3 ELSE CAST(event_id AS VARCHAR) END AS run, CASE WHEN event_type = 'error' THEN 'Open-web event discovery weekly' WHEN value > 40 THEN 'Explore and Map: water · team.xlsx' ELSE 'Discovery request: pumps · 3 hubs' END AS said, ts, value FROM events)
    SELECT event_id, CASE WHEN starts_with(run, 'actor-update:') THEN 'actor_updates' WHEN starts_with(run, 'datafeed:') AND NOT contains(said, 'Explore and Map: ') THEN 'data_feed' WHEN starts_with(run, 'v2-review:') THEN 'map_checks' WHEN value > 30 THEN 'discovery_actors' WHEN value > 15 THEN 'discovery_events' ELSE 'discovery_people' END AS kind,
    CASE WHEN contains(lower(said || ' ' || run), 'migration') THEN 'migration' WHEN contains(lower(said || ' ' || run), 'subscription') THEN 'subscription' WHEN regexp_matches(lower(said || ' ' || run), 'schedule|weekly|monthly') THEN 'scheduled_event' ELSE 'manual' END AS trigger,
    CASE WHEN starts_with(run, 'v2-review:') THEN 'map-checks' ELSE run END AS run_group,
    CASE WHEN starts_with(run, 'v2-review:') THEN 'Map checks' WHEN starts_with(run, 'datafeed:') THEN regexp_replace(said, ' · (manual entry|[^·]+\\.(xlsx|xlsm|xls|csv))$', '') WHEN regexp_matches(said, '^Discovery request: ') THEN trim(regexp_extract(said, '^Discovery request:\\s*(.+?)\\s*(·|$)', 1)) ELSE said END || ' · ' || strftime(ts, '%m/%d/%Y') AS label FROM r""",
)
def _(t):
    u = F.col("user_id").cast("string")
    run = F.when(F.col("event_type") == "view", F.concat(F.lit("datafeed:"), u)).when(F.col("event_type") == "click", F.concat(F.lit("actor-update:"), u)).when(F.col("event_type") == "signup", F.concat(F.lit("v2-review:topic"), (F.col("user_id") % 3).cast("string"))).otherwise(F.col("event_id").cast("string"))
    said = F.when(F.col("event_type") == "error", "Open-web event discovery weekly").when(F.col("value") > 40, "Explore and Map: water · team.xlsx").otherwise("Discovery request: pumps · 3 hubs")
    entity = F.when(F.col("value") > 30, "actor").when(F.col("value") > 15, "event").otherwise("person")
    return t.events.select("event_id", L.run_label(run, said, entity, F.col("ts")).alias("l")).select("event_id", "l.kind", "l.trigger", "l.run_group", "l.label")


@plan(
    "jn15_first_unused",
    """WITH RECURSIVE r AS (SELECT user_id, event_id AS run, ts AS ran, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view'),
    p AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(ts ORDER BY ts, event_id) AS pressed FROM events WHERE event_type = 'click' GROUP BY 1),
    w AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS run, CAST(NULL AS BIGINT) AS press, CAST([] AS BIGINT[]) AS used FROM p
     UNION ALL SELECT w.user_id, r.rn, r.run, l.pick, CASE WHEN l.pick IS NULL THEN w.used ELSE list_append(w.used, l.pick) END FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1 JOIN p ON p.user_id = w.user_id,
      LATERAL (SELECT list_filter(p.ids, lambda x, i: NOT list_contains(w.used, x) AND r.ran >= p.pressed[i] - INTERVAL 60 SECOND AND r.ran <= p.pressed[i] + INTERVAL 30 MINUTE)[1] AS pick) l)
    SELECT run, press FROM w WHERE press IS NOT NULL""",
)
def _(t):
    runs = t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("run"), F.col("ts").alias("ran"))
    presses = t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("press"), F.col("ts").alias("pressed"))
    return L.matched_presses(runs, presses, "user_id", "run", "ran", "press", "pressed")


# schedules

REASON = "CASE WHEN o_orderstatus = 'P' THEN 'not active' WHEN CAST(o_orderdate AS DATE) > DATE '1998-01-01' THEN 'not started' WHEN CAST(o_orderdate AS DATE) + 400 < DATE '1998-01-01' THEN 'ended' WHEN CAST(o_orderdate AS DATE) + 97 > DATE '1998-01-01' THEN 'not due yet' END"


@plan("sm02_due_split", f"WITH r AS (SELECT o_orderkey, {REASON} AS reason FROM orders) SELECT o_orderkey, reason IS NULL AS due, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY o_orderkey) END AS place FROM r")
def _(t):
    d = F.to_date("o_orderdate")
    reason = SM.due(F.when(F.col("o_orderstatus") == "P", "paused").otherwise("active"), d, F.date_add(d, 400), F.lit("quarterly"), F.date_add(d, 6), F.lit("1998-01-01").cast("date"))
    return SM.split_due(t.orders, "o_orderkey", reason)


@plan("sm06_unchanged_skip", "WITH p AS (SELECT page_id, split_part(url, '?', 1) AS u, CASE WHEN page_id % 3 = 0 THEN substr(html, 1, 500) ELSE html END AS h FROM pages), held AS (SELECT split_part(url, '?', 1) AS u, html AS h FROM pages WHERE contains(url, '/en/')) SELECT page_id, EXISTS (SELECT 1 FROM held WHERE held.u = p.u AND sha256(held.h) = sha256(p.h)) AS skip FROM p")
def _(t):
    address = F.split_part("url", F.lit("?"), F.lit(1)).alias("u")
    now = t.pages.select("page_id", address, F.when(F.col("page_id") % 3 == 0, F.substring("html", 1, 500)).otherwise(F.col("html")).alias("html"))
    return SM.fresh_pages(now, t.pages.where(F.contains("url", F.lit("/en/"))).select(address, "html"), "u", "html").select("page_id", "skip")


@plan(
    "sm07_exclusive_runs",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, ts + INTERVAL 1 HOUR * (1 + event_id % 50) AS until, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT user_id, event_id, rn, until, true AS holds FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ts >= w.until THEN e.until ELSE w.until END, e.ts >= w.until FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT event_id AS key, holds FROM w""",
)
def _(t):
    rows = t.events.select("user_id", "event_id", "ts", F.expr("ts + make_interval(0, 0, 0, 0, CAST(1 + event_id % 50 AS INT), 0, 0)").alias("until"))
    return SM.exclusive_runs(rows, "user_id", "event_id", "ts", "until")


# sheets


@plan(
    "et01_hub_names",
    rf"""WITH h AS (SELECT DISTINCT {W} AS name FROM part), k AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM h),
    q AS (SELECT DISTINCT CASE WHEN p_size % 4 = 0 THEN upper(p_name) WHEN p_size % 4 = 1 THEN {W} || ' Valley' WHEN p_size % 4 = 2 THEN substr(p_name, 1, CAST(4 + p_size % 6 AS INTEGER)) ELSE 'the ' || split_part(p_name, ' ', 2) || CASE WHEN p_size > 25 THEN '' ELSE ' hub' END END AS typed FROM part),
    s AS (SELECT typed, trim(regexp_replace(lower(typed), '[^a-z0-9]+', '-', 'g'), '-') AS ts FROM q),
    a AS (SELECT typed, min(name) AS x FROM s JOIN k ON ts = slug GROUP BY 1), b AS (SELECT typed, min(name) AS x FROM s JOIN k ON starts_with(slug, ts) OR starts_with(ts, slug) GROUP BY 1 HAVING count(DISTINCT name) = 1),
    c AS (SELECT typed, min(name) AS x FROM s JOIN k ON contains('-' || slug || '-', '-' || ts || '-') OR contains('-' || ts || '-', '-' || slug || '-') GROUP BY 1 HAVING count(DISTINCT name) = 1)
    SELECT s.typed, coalesce(a.x, b.x, c.x) AS resolved FROM s LEFT JOIN a USING (typed) LEFT JOIN b ON b.typed = s.typed LEFT JOIN c ON c.typed = s.typed""",
)
def _(t):
    typed = F.when(F.col("p_size") % 4 == 0, F.upper("p_name")).when(F.col("p_size") % 4 == 1, F.concat(F.expr(W), F.lit(" Valley"))).when(F.col("p_size") % 4 == 2, F.expr("substr(p_name, 1, CAST(4 + p_size % 6 AS INT))")).otherwise(F.concat(F.lit("the "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(F.col("p_size") > 25, "").otherwise(" hub")))
    return C.resolved_hub(t.part.select(typed.alias("typed")).distinct(), t.part.select(F.expr(W).alias("name")).distinct(), "typed", "name").select("typed", "resolved")


@plan(
    "et04_synthetic_parents",
    """WITH m AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size = 50 THEN 1 WHEN p_size IN (48, 49) THEN 2 END AS lv FROM part),
    w AS (SELECT *, max(CASE WHEN lv = 1 THEN p_partkey END) OVER o AS tk, last_value(CASE WHEN lv = 1 THEN p_name END IGNORE NULLS) OVER o AS tt, max(CASE WHEN lv = 2 THEN p_partkey END) OVER o AS sk, last_value(CASE WHEN lv = 2 THEN p_name END IGNORE NULLS) OVER o AS st FROM m WINDOW o AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT p_partkey, nullif(concat_ws(' / ', tt, CASE WHEN tk IS NULL OR sk > tk THEN st END), '') AS parent FROM w WHERE lv IS NULL)
    SELECT p_partkey, parent, parent IS NOT NULL AS synthetic FROM r""",
)
def _(t):
    level = F.when(F.col("p_size") == 50, 1).when(F.col("p_size").isin(48, 49), 2)
    return C.section_tree(t.part, ["p_brand"], "p_partkey", level, F.col("p_name")).select("p_partkey", "parent", "synthetic")


@plan(
    "et07_narrative_actors",
    r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    n AS (SELECT doc_id, source, i, trim(regexp_replace(raw, '^[ \t\r\f\v•*–-]+', '')) AS name FROM l),
    p AS (SELECT * FROM n WHERE length(name) BETWEEN 3 AND 60 AND regexp_matches(name, '[A-Z]') AND NOT list_contains(['n/a', 'none', 'tbd', 'unknown', 'various', 'other', 'others', 'see above'], regexp_replace(lower(name), '^[.:\- ]+|[.:\- ]+$', '', 'g')))
    SELECT source, name, count(DISTINCT doc_id) AS links, CASE WHEN regexp_matches(lower(name), '(^|[^a-z])(der|die|das|und)([^a-z]|$)') THEN 'german' WHEN regexp_matches(lower(name), '(^|[^a-z])(the|of|and)([^a-z]|$)') THEN 'english' END AS hint FROM p GROUP BY 1, 2""",
)
def _(t):
    items = C.narrative_lines(t.documents, "doc_id", "source", "text")
    kept = items.where(X.looks_like_organization(F.col("name")) & (F.length("name") <= 60))
    hint = F.when(F.lower("name").rlike(X.one_of(["der", "die", "das", "und"])), "german").when(F.lower("name").rlike(X.one_of(["the", "of", "and"])), "english")
    return kept.groupBy("source", "name").agg(F.count_distinct("doc_id").alias("links")).withColumn("hint", hint)


# sources and sinks


@plan(
    "sc12_listing_completeness",
    r"""WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>')) AS cards, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) % 10 AS displayed FROM pages) SELECT page_id, cards, displayed, CASE WHEN displayed IS NULL THEN 'unknown' WHEN cards >= displayed THEN 'complete' ELSE 'partial' END AS state FROM c""",
)
def _(t):
    from ..sources.pages import completeness

    pages = t.pages.withColumn("displayed", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint") % 10)
    cards = listing_cards(pages, r"<li><a [^>]*>[^<]*</a></li>", {"title": r">([^<]*)</a>"}, keep=["page_id"])
    return completeness(pages, cards, "page_id", "displayed").select("page_id", "cards", "displayed", "state")


@plan(
    "sc16_search_cache",
    "WITH q AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \\n]+', ' ', 'g'))) AS query, CASE WHEN length(text) > 200 THEN 20 ELSE 10 END AS n, CASE WHEN role = 'user' THEN 'b.org,a.org' ELSE '' END AS domains FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY query, n, domains ORDER BY conv_id, turn) > 1 AS hit FROM q",
)
def _(t):
    from ..sources.pages import cache_hits

    asked = t.conversations.select("conv_id", "turn", F.col("text").alias("query"), F.when(F.length("text") > 200, 20).otherwise(10).alias("n"), F.when(F.col("role") == "user", F.array(F.lit("b.org"), F.lit("a.org"))).otherwise(F.array().cast("array<string>")).alias("domains"))
    return cache_hits(asked, "query", "n", "domains", ["conv_id", "turn"]).select("conv_id", "turn", "hit")


@plan(
    "sk07_keep_delete_split",
    "SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'delete' WHEN n > 1 THEN 'delete' ELSE 'keep' END AS part, CASE WHEN s_acctbal <= 0 THEN 'not live' WHEN n > 1 THEN 'second of its nation' END AS reason FROM (SELECT s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey, s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier)",
)
def _(t):
    from ..sources.sinks import keep_delete

    live = F.col("s_acctbal") > 0
    ranked = t.supplier.withColumn("n", F.row_number().over(Window.partitionBy("s_nationkey", live).orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return keep_delete(ranked, [("not live", ~live), ("second of its nation", F.col("n") > 1)]).select("s_suppkey", "part", "reason")


# evaluation


@plan(
    "ev01_recall_at",
    """WITH f AS (SELECT conv_id, turn, lower(text) AS x, list_filter(string_split(split_part(text, chr(10), 1), ' '), lambda w: length(w) >= 5)[1:3] AS names, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
    q AS (SELECT conv_id, names FROM f WHERE turn = 0), a AS (SELECT conv_id, list(x) AS xs FROM f WHERE turn > 0 AND r <= 10 GROUP BY 1)
    SELECT q.conv_id, CAST(len(list_filter(names, lambda n: len(list_filter(coalesce(xs, []), lambda x: contains(x, lower(n)))) > 0)) AS INTEGER) AS hits, CAST(len(names) AS INTEGER) AS expected FROM q LEFT JOIN a USING (conv_id) WHERE len(names) > 0""",
)
def _(t):
    # what is expected: longer words of a conversation's first line; what was found: its last ten other turns
    names = F.slice(F.filter(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " "), lambda w: F.length(w) >= 5), 1, 3)
    asked = t.conversations.where("turn = 0").select("conv_id", names.alias("names")).where(F.size("names") > 0)
    last = t.conversations.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 10 AND turn > 0")
    return V.recall_at(asked, last.groupBy("conv_id").agg(F.collect_list("text").alias("texts")), "conv_id", "names", "texts").select("conv_id", "hits", "expected")


@plan(
    "ev08_folds",
    """WITH r AS (SELECT doc_id, quality AS label, unnest([0, 1, 2]) AS repeat FROM labels JOIN documents USING (doc_id)),
    d AS (SELECT *, CAST((row_number() OVER (PARTITION BY repeat, label ORDER BY md5(doc_id || ':' || repeat), doc_id) - 1) % 5 AS INTEGER) AS fold FROM r) SELECT doc_id, label, repeat, fold FROM d""",
)
def _(t):
    return V.stratified_folds(scored(t).select("doc_id", "label"), "doc_id", "label", 5, 3)


def pair_features(t):
    """Gold pairs: names that share a word; the same where they lead to the same site, which no feature sees."""
    pairs = named_pairs(t)
    features = {"containment": T.containment(F.col("_words_a"), F.col("_words_b")), "jaccard": T.jaccard(F.col("_words_a"), F.col("_words_b"))} | {k: c.cast("double") for k, c in I.mismatches().items()}
    host = organizations(t).groupBy("name").agg(F.min("website").alias("site")).select("name", F.regexp_extract("site", "//([^/]*)", 1).alias("host"))
    rows = pairs.select("a", "b", *[c.alias(k) for k, c in features.items()])
    rows = rows.join(host.select(F.col("name").alias("a"), F.col("host").alias("ha")), "a").join(host.select(F.col("name").alias("b"), F.col("host").alias("hb")), "b")
    return rows.select(F.concat_ws(" | ", "a", "b").alias("pair"), *features, F.coalesce(F.col("ha") == F.col("hb"), F.lit(False)).cast("int").alias("label")), list(features)


@plan("er08_combiner")
def _(t):
    rows, features = pair_features(t)
    return V.out_of_fold(rows, "pair", "label", features, folds=3, repeats=1)


@plan(
    "ev09_sweep",
    f"""WITH s AS (SELECT score, label FROM {SCORED}), g AS (SELECT t AS threshold, count(*) FILTER (WHERE score >= t AND label = 1) AS tp, count(*) FILTER (WHERE score >= t AND label = 0) AS fp, count(*) FILTER (WHERE score < t AND label = 1) AS fn FROM s, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS t) GROUP BY 1)
    SELECT threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1 FROM g""",
)
def _(t):
    return V.sweep(scored(t), "label", "score", [0.1, 0.25, 0.5, 0.75, 0.9])


@plan("ev09_false_merges", f"SELECT doc_id, score, label, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM {SCORED} WHERE score >= 0.5 AND label = 0")
def _(t):
    return V.false_merges(scored(t), "label", "score", 0.5)


# descriptions, reviews, rubrics, quotes, sheets and reports


ABOUT = "CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'Makes ' || p_name || ' of ' || lower(p_type) || ' kind in ' || CASE WHEN p_size > 30 THEN 'austin texas' WHEN p_size > 20 THEN 'reno nevada' ELSE 'ohio' END END"
CITIES, REGIONS = ("austin", "reno"), ("texas", "nevada", "ohio")


@plan(
    "er07_description_features",
    f"""WITH p AS (SELECT p_brand, p_partkey, {ABOUT} AS d FROM part), m AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, d) AS r FROM p), k AS (SELECT DISTINCT p_brand, d, r FROM m),
    q AS (SELECT x.r AS a, y.r AS b, x.d AS da, y.d AS db, 0 AS copy FROM k x JOIN k y ON x.p_brand IS NOT DISTINCT FROM y.p_brand AND x.r < y.r UNION ALL SELECT r, p_partkey, d, d, 1 FROM m WHERE p_partkey > r),
    n AS (SELECT DISTINCT d FROM p WHERE d IS NOT NULL), tok AS (SELECT d, unnest(string_split(lower(d), ' ')) AS term FROM n), tf AS (SELECT d, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    raw AS (SELECT d, term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM n)) / (1 + df))) AS w FROM tf JOIN df USING (term)), ln AS (SELECT d, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1), wt AS (SELECT d, term, w / l AS w FROM raw JOIN ln USING (d)),
    cs AS (SELECT x.d AS da, y.d AS db, sum(x.w * y.w) AS c FROM (SELECT DISTINCT da, db FROM q) k JOIN wt x ON x.d = k.da JOIN wt y ON y.d = k.db AND y.term = x.term GROUP BY 1, 2),
    t AS (SELECT q.a, q.b, copy, c, q.da IS NOT NULL AND q.db IS NOT NULL AS both_present, list_distinct(list_filter(string_split(lower(coalesce(q.da, '')), ' '), lambda w: length(w) > 2 AND NOT list_contains({quoted(T.STOP_WORDS)}, w))) AS ta, list_distinct(list_filter(string_split(lower(coalesce(q.db, '')), ' '), lambda w: length(w) > 2 AND NOT list_contains({quoted(T.STOP_WORDS)}, w))) AS tb FROM q LEFT JOIN cs ON cs.da = q.da AND cs.db = q.db),
    z AS (SELECT *, list_intersect(ta, {quoted(CITIES)}) AS ca, list_intersect(tb, {quoted(CITIES)}) AS cb, list_intersect(ta, {quoted(REGIONS)}) AS sa, list_intersect(tb, {quoted(REGIONS)}) AS sb FROM t)
    SELECT a, b, CAST(floor(CASE WHEN both_present THEN coalesce(c, 0) ELSE 0 END * 1e5 + 0.5) AS BIGINT) AS tfidf_e5, CASE WHEN both_present THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) ELSE 0 END AS overlap,
    CAST(CASE WHEN NOT both_present THEN 0 WHEN len(ca) > 0 AND len(cb) > 0 THEN CAST(len(list_intersect(ca, cb)) = 0 AS INT) WHEN len(sa) > 0 AND len(sb) > 0 THEN CAST(len(list_intersect(sa, sb)) = 0 AS INT) ELSE 0 END AS DOUBLE) AS place_conflict, CAST(both_present AS INTEGER) AS both_present, CAST(copy AS INTEGER) AS copy FROM z""",
)
def _(t):
    from ..operators import entity as E
    from ..operators import search as Q

    rows = t.part.select("p_brand", "p_partkey", F.expr(ABOUT).alias("d"))
    weights = Q.tfidf(rows.select(F.col("d").alias("key")).where("d IS NOT NULL").distinct(), "key", F.split(F.lower("key"), " "))
    out = E.description_pairs(rows, "p_brand", "p_partkey", "d", weights, CITIES, REGIONS)  # all pairs of parts of a brand
    return out.select("a", "b", F.floor(F.col("tfidf") * 1e5 + 0.5).alias("tfidf_e5"), "overlap", "place_conflict", "both_present", "copy")


@plan(
    "er29_waiting_in_review",
    """WITH r AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name FROM pages), k AS (SELECT *, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(www\\.)?', ''), '/+$', '') AS u, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')) AS n FROM r),
    p AS (SELECT * FROM k WHERE contains(url, '/es/') OR contains(url, 'utm_')) SELECT page_id, CASE WHEN u IN (SELECT u FROM p) THEN 'page' WHEN n IN (SELECT n FROM p WHERE n <> '') THEN 'name' END AS waits FROM k""",
)
def _(t):
    from ..operators import entity as E

    rows = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    pending = rows.where(F.contains("url", F.lit("/es/")) | F.contains("url", F.lit("utm_")))
    return E.waiting(rows, pending, "url", "name").select("page_id", "waits")


@plan(
    "ru05_weight_errors",
    """WITH w AS (SELECT user_id AS rubric, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'other' ELSE event_type END AS item, CASE WHEN user_id % 7 = 0 THEN -0.2 ELSE 0.2 END AS weight FROM (SELECT DISTINCT user_id, event_type FROM events)),
    g AS (SELECT rubric, list_sort(list(DISTINCT item)) AS items, min(weight) AS low, sum(weight) AS total FROM w GROUP BY 1)
    SELECT rubric, concat_ws('; ', CASE WHEN NOT list_has_all(items, ['click', 'error', 'purchase', 'signup', 'view']) THEN 'missing: ' || array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(items, x)), ', ') END,
    CASE WHEN list_contains(items, 'other') THEN 'unknown: other' END, CASE WHEN low < 0 THEN 'negative' END, CASE WHEN abs(total - 1) > 1e-9 THEN 'does not add to one' END) AS errors FROM g""",
)
def _(t):
    from ..operators import scoring as S

    for weights in (S.RELEVANCE_WEIGHTS, S.PRIORITY_WEIGHTS, S.COMBINED_WEIGHTS, S.EVENT_WEIGHTS, S.PERSON_WEIGHTS):
        S.check_weights(weights, list(weights))
    rows = t.events.select("user_id", "event_type").distinct()
    item = F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "other").otherwise(F.col("event_type"))
    table = rows.select(F.col("user_id").alias("rubric"), item.alias("item"), F.when(F.col("user_id") % 7 == 0, -0.2).otherwise(0.2).alias("weight"))
    return S.weight_errors(table, ["click", "error", "purchase", "signup", "view"])


QUOTES = (
    "We received {} from the agency.", "Apply now for grants of {}", "Our foundation awards {} to local startups", "@ was awarded {}", "{} on behalf of the state", "A budget of {}", "It funded 34 projects with {}", "Received a grant of {}",
    "@, of Tau, was selected for {} of aid", "{} for eligible schools", "Made possible in part by the state with {}", "The institute raised {}", "The agency awarded @ {}", "A grant for @ of {}", "Our team closed a {} seed round", "The fund gave {} to us", "Acme Electric d/b/a @ received {}", "The district, with {}, opens", "Thanks to a gift of {}, and an award",
)
QUOTE = f"replace(replace(CASE o_orderkey % {len(QUOTES)} " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(QUOTES)) + " END, '{}', '$' || CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING)), '@', c_name)"


def ru12_sql() -> str:
    from ..operators import scoring as S

    has = lambda p: f"regexp_matches(low, '{p}')"
    near = lambda before, after: f"regexp_matches(low, '(^|[^a-z0-9]){before}' || who || '{after}')"
    end = "([^a-z0-9]|$)"
    return f"""WITH q AS (SELECT o_orderkey, lower({QUOTE}) AS low, array_to_string(list_filter(string_split_regex(lower(c_name), '[^a-z0-9]+'), lambda w: w <> ''), '[^a-z0-9]+') AS who, c_acctbal > 0 AS own FROM orders JOIN customer ON c_custkey = o_custkey),
    r AS (SELECT *, {near('', end)} AS says, {has(S.WE_GOT)} OR {near('', '[^a-z0-9][^.]{0,60}' + S.GOT + '([^a-z]|$)')} OR {has(S.SOURCE)} OR {near(S.FOR_NAME[0], end)} OR {near(S.TO_NAME[0], end)} OR {has(S.TO_US)} OR (own AND {has(S.OPENS)}) AS got FROM q)
    SELECT o_orderkey, CASE WHEN {near(S.TRADES_AS, end)} THEN 'went to a company that trades under the name' WHEN {has(S.GIVES)} OR {has(S.PASSES)} OR ({has(S.TO_OTHERS)} AND NOT got) THEN 'gives it to others' WHEN {has(S.OFFERS)} AND NOT got THEN 'advertises an opportunity' WHEN {has(S.ADMINISTERS)} AND NOT got THEN 'runs a programme for a funder'
    WHEN got AND (own OR says) THEN NULL WHEN NOT own THEN 'another''s page does not say who received it' ELSE 'names the money only' END AS reason FROM r"""


@plan("ru12_funding_receipt", ru12_sql())
def _(t):
    from ..operators import scoring as S

    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", S.receipt(F.expr(QUOTE), F.col("c_name"), F.col("c_acctbal") > 0).alias("reason"))


@plan(
    "et02_upsert_by_name",
    f"""WITH h AS (SELECT DISTINCT lower({W}) AS key, {W} AS name FROM part WHERE p_size < 25), hv AS (SELECT key, name, 'old' AS brand, CAST(NULL AS VARCHAR) AS kind FROM h),
    r AS (SELECT lower(p_name) AS key, p_name AS name, p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_type END AS kind FROM part WHERE p_size > 20),
    n AS (SELECT key, arg_max(name, k) AS name, arg_max(brand, k) FILTER (WHERE brand IS NOT NULL) AS brand, arg_max(kind, k) FILTER (WHERE trim(kind) <> '') AS kind FROM r GROUP BY 1)
    SELECT coalesce(hv.key, n.key) AS key, coalesce(hv.name, n.name) AS name, coalesce(n.brand, hv.brand) AS brand, coalesce(n.kind, hv.kind) AS kind, CASE WHEN hv.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'kept' ELSE 'updated' END AS state FROM hv FULL JOIN n ON n.key = hv.key""",
)
def _(t):
    held = t.part.where("p_size < 25").select(F.expr(W).alias("name")).distinct().select("name", F.lit("old").alias("brand"), F.lit(None).cast("string").alias("kind"))
    rows = t.part.where("p_size > 20").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_type")).alias("kind"))
    return C.upsert_by_name(held, rows, "name", "k", ["brand", "kind"])


@plan(
    "et03_quarantine",
    """SELECT p_partkey, 'trl' AS field, CAST(p_size AS VARCHAR) AS raw_value, 'not a whole number from 1 to 9' AS reason FROM part WHERE p_size > 9 OR p_size < 1 UNION ALL SELECT p_partkey, 'stage', p_type, 'not an allowed value' FROM part WHERE p_type NOT IN ('SMALL', 'LARGE', 'ECONOMY')""",
)
def _(t):
    rows = t.part.select("p_partkey", F.col("p_size").cast("string").alias("trl"), F.col("p_type").alias("stage"))
    return C.validated(rows, "p_partkey", {"trl": (1, 9)}, {"stage": ["small", "large", "economy"]})[1]


@plan(
    "et05_event_rows",
    """WITH e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN lower(replace(n_name, '_', ' ')) WHEN 'F' THEN n_name || ' board' ELSE 'nobody' END AS host, [1 + o_orderkey % 3, 2, 3, 1 + o_custkey % 4, 1, 2] AS raw, CASE WHEN o_totalprice > 200000 THEN 'Tier 1' ELSE 'unrated' END AS tier, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
    SELECT o_orderkey, host, CASE WHEN host <> 'nobody' THEN n_name END AS resolved, CASE WHEN raw[4] <= 3 THEN CAST(list_sum(raw) AS INTEGER) END AS total, CASE WHEN tier = 'Tier 1' THEN 'tier_1' END AS tier FROM e""",
)
def _(t):
    from ..operators import scoring as S

    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    host = F.when(F.col("o_orderstatus") == "P", F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).when(F.col("o_orderstatus") == "F", F.concat("n_name", F.lit(" board"))).otherwise("nobody")
    raw = F.array(*[x.cast("string") for x in (1 + F.col("o_orderkey") % 3, F.lit(2), F.lit(3), 1 + F.col("o_custkey") % 4, F.lit(1), F.lit(2))])
    sheet = S.score_sheet(raw, F.when(F.col("o_totalprice") > 200000, "Tier 1").otherwise("unrated"))
    rows = rows.select("o_orderkey", host.alias("host"), sheet.alias("s"))
    return C.resolved_hub(rows, t.nation.select("n_name"), "host", "n_name").select("o_orderkey", "host", "resolved", "s.total", "s.tier")


@plan(
    "et06_banners",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, last_value(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS section FROM orders)
    SELECT o_orderkey, section, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(o_orderpriority), '-'), lambda x: x <> ''), lambda x: CASE WHEN x IN ('urgent', 'high') THEN 'pressing' ELSE trim(x) END))), ',') AS themes FROM b WHERE o_orderstatus <> 'P'""",
)
def _(t):
    rows = C.sectioned(t.orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    return rows.select("o_orderkey", "section", F.array_join(C.folded_themes(F.col("o_orderpriority"), "-", {"urgent": "pressing", "high": "pressing"}), ",").alias("themes"))


@plan(
    "sc09_header_rows",
    """WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, list_distinct(list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)], lambda w: list_contains(['red', 'widget', 'small', 'gear', 'promo'], w))) AS f FROM part),
    b AS (SELECT p_brand, n, list_sort(f) AS f, row_number() OVER (PARTITION BY p_brand ORDER BY len(f) DESC, n) AS k FROM r WHERE n <= 8) SELECT p_brand, CAST(n AS INTEGER) AS header_row, array_to_string(f, ',') AS fields FROM b WHERE k = 1 AND len(f) > 0""",
)
def _(t):
    rows = t.part.select("p_brand", "p_partkey", F.array(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" ")), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.concat(F.lit("-"), "p_type")).alias("cells"))
    return C.best_headers(rows, "p_brand", "p_partkey", "cells", ["Red", "Widget", "Small", "Gear", "Promo"])


@plan(
    "sk06_digest_lines",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) AS k FROM customer)
    SELECT c_mktsegment AS section, 1 AS place, '## ' || c_mktsegment AS line FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 2, count(*) || ' records' FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, CAST(k + 2 AS INTEGER), '- ' || c_name FROM r WHERE k <= 3""",
)
def _(t):
    from ..sources.sinks import digest_lines

    return digest_lines(t.customer, "c_mktsegment", "c_name", "c_acctbal")
