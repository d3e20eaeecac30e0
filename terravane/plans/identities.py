"""Plans of identity: mismatch features, edge classes, routing, import matching, map duplicates, editions, events and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identity as I
from ..operators.similarity import set_pairs
from .registry import plan

#: Organizations as sheets name them, made from the parts table: wholes, parts of them, places, numbers, short forms.
W = "(upper(substr(p_name, 1, 1)) || substr(p_name, 2))"
ORG = (
    f"CASE p_type WHEN 'ECONOMY' THEN {W} || ' Company' WHEN 'SMALL' THEN 'University of ' || {W} WHEN 'LARGE' THEN 'University of ' || {W} || ' Department of Chemistry'"
    f" WHEN 'PROMO' THEN {W} || CASE WHEN p_size % 2 = 0 THEN ' (Texas)' ELSE ' State (Ohio)' END WHEN 'MEDIUM' THEN {W} || ' Site ' || CAST(p_size % 3 AS STRING) ELSE upper('u' || substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) END"
)
OTHER = f"CASE WHEN p_size BETWEEN 20 AND 24 THEN 'The ' || {W} || ' of ' || p_brand END"
SITE = "CASE WHEN p_size >= 5 THEN 'https://www.' || replace(p_name, ' ', '-') || '-' || lower(p_type) || '.example.org' || CASE WHEN p_size > 46 THEN '/lab/water' WHEN p_size > 38 THEN '/about' ELSE '' END END"


def organizations(t):
    return t.part.select("p_partkey", F.expr(ORG).alias("name"), F.when(F.expr(OTHER).isNotNull(), F.array(F.expr(OTHER))).alias("others"), F.expr(SITE).alias("website"))


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def cases(word: str, table: dict) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {word} END"


STEM = "CASE WHEN length(w) > 3 AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 3 AND ends_with(w, 'es') AND NOT ends_with(w, 'ses') THEN substr(w, 1, length(w) - 2) WHEN length(w) > 3 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END"
DESCRIBED = rf"""n AS (SELECT DISTINCT {ORG} AS name FROM part),
w1 AS (SELECT name, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9&]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws, trim(regexp_replace(lower(regexp_replace(name, '\([^)]*\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS bare FROM n),
d AS (SELECT name, bare, list_distinct(ws) AS wd, len(ws) AS n,
 list_distinct(list_transform(list_filter(list_transform(ws, lambda w: {cases('w', I.SHORT_FORMS)}), lambda w: NOT list_contains({quoted(I.STRUCTURAL)}, w)), lambda w: {STEM})) AS ct,
 array_to_string(list_transform(list_filter(ws, lambda w: NOT list_contains({quoted(I.INITIAL_STOP)}, w)), lambda w: substr(w, 1, 1)), '') AS ini,
 list_sort(list_distinct(list_transform(list_filter(ws, lambda w: regexp_matches(w, '^[0-9]+$') OR list_contains({quoted(I.NUMBERS)}, w)), lambda w: CAST({cases('w', I.NUMBERS)} AS INTEGER)))) AS nums,
 regexp_matches(bare, '^(university|univ)( |$)') OR regexp_matches(bare, '(^| )(university|clinic|hospital|corporation|corp|company|inc|laboratory)$') AS whole FROM w1),
k AS (SELECT *, list_distinct(list_concat(list_filter(wd, lambda w: length(w) >= 4), [ini], CASE WHEN n = 1 THEN wd ELSE [] END)) AS bl FROM d),
p AS (SELECT a.name AS a, b.name AS b, a.wd AS wa, b.wd AS wb, a.n AS na, b.n AS nb, a.ct AS ca, b.ct AS cb, a.ini AS ia, b.ini AS ib, a.nums AS ma, b.nums AS mb, a.whole AS ha, b.whole AS hb, a.bare AS ba, b.bare AS bb
 FROM k a JOIN k b ON a.name < b.name AND len(list_intersect(a.bl, b.bl)) > 0),
q AS (SELECT *, list_filter(wa, lambda w: NOT list_contains(wb, w)) AS ea, list_filter(wb, lambda w: NOT list_contains(wa, w)) AS eb,
 CASE WHEN na < nb THEN len(wa) = 1 AND (wa[1] = ib OR list_contains(wb, wa[1])) ELSE len(wb) = 1 AND (wb[1] = ia OR list_contains(wa, wb[1])) END AS short FROM p),
z AS (SELECT *, coalesce(CASE WHEN len(ea) = 0 AND len(eb) > 0 THEN CASE WHEN len(list_filter(eb, lambda w: NOT list_contains({quoted(I.ONLY_STRUCTURE)}, w))) = 0 THEN 0 WHEN ha OR (len(list_intersect(eb, {quoted(I.PARTS)})) > 0 AND len(list_intersect(wa, {quoted(I.PARTS)})) = 0) THEN 1 ELSE 0 END END,
 CASE WHEN len(eb) = 0 AND len(ea) > 0 THEN CASE WHEN len(list_filter(ea, lambda w: NOT list_contains({quoted(I.ONLY_STRUCTURE)}, w))) = 0 THEN 0 WHEN hb OR (len(list_intersect(ea, {quoted(I.PARTS)})) > 0 AND len(list_intersect(wb, {quoted(I.PARTS)})) = 0) THEN 1 ELSE 0 END END, 0) AS below FROM q)"""


def named_pairs(t):
    blocks = F.concat(F.filter("_words", lambda w: F.length(w) >= 4), F.array("_initials"), F.when(F.col("_n") == 1, F.col("_words")).otherwise(F.array().cast("array<string>")))
    return I.name_pairs(organizations(t).select("name"), "name", blocks)


of = lambda side, words: f"list_sort(list_intersect(w{side}, {quoted(words)}))"


@plan(
    "er06_mismatch_features",
    f"""WITH {DESCRIBED}, f AS (SELECT a, b, short, CAST({of('a', I.QUALIFIERS)} <> {of('b', I.QUALIFIERS)} AS INTEGER) AS q, len(list_filter(ca, lambda w: NOT list_contains(cb, w))) AS oa, len(list_filter(cb, lambda w: NOT list_contains(ca, w))) AS ob,
    CAST(ma <> mb AS INTEGER) AS nu, CAST(len({of('a', I.PLACES)}) > 0 AND len({of('b', I.PLACES)}) > 0 AND len(list_intersect({of('a', I.PLACES)}, {of('b', I.PLACES)})) = 0 AS INTEGER) AS pl, below FROM z)
    SELECT a, b, CASE WHEN short THEN 0 ELSE q END AS qualifier, CASE WHEN short THEN 0 ELSE CAST(oa > 0 AND ob > 0 AS INTEGER) END AS unique_both, CAST(CASE WHEN short THEN 0 ELSE least(oa + ob, 5) END AS INTEGER) AS unique_count,
    CASE WHEN short THEN 0 ELSE nu END AS numeric, CASE WHEN short THEN 0 ELSE pl END AS place, CASE WHEN short THEN 0 ELSE below END AS hierarchy FROM f""",
)
def _(t):
    return named_pairs(t).select("a", "b", *[c.alias(k) for k, c in I.mismatches().items()])


@plan(
    "er21_edge_class",
    f"""WITH {DESCRIBED}, s AS (SELECT *, CASE WHEN na < nb THEN a ELSE b END AS sn, CASE WHEN na < nb THEN wa ELSE wb END AS sw, CASE WHEN na < nb THEN ib ELSE ia END AS li FROM z)
    SELECT a, b, CASE WHEN short AND ((regexp_matches(sn, '^[^a-z]*[A-Z][^a-z]*$') AND length(sw[1]) BETWEEN 2 AND 8) OR sw[1] = li) THEN 'merge' WHEN ba = bb AND ba <> '' THEN 'merge'
    WHEN (len(ea) = 0 OR len(eb) = 0) AND len(ea) + len(eb) > 0 AND len(list_filter(list_concat(ea, eb), lambda w: NOT list_contains({quoted(I.ONLY_STRUCTURE)}, w))) = 0 THEN 'merge'
    WHEN below = 1 THEN 'hierarchy' WHEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) >= 0.6 THEN 'merge' ELSE 'review' END AS class FROM s""",
)
def _(t):
    return named_pairs(t).select("a", "b", I.edge_class(F.col("a"), F.col("b")).alias("class"))


@plan(
    "er05_hub_overlap",
    """WITH h AS (SELECT l_suppkey AS a, list(DISTINCT CAST(l_orderkey AS VARCHAR)) AS hubs FROM lineitem GROUP BY 1)
    SELECT x.s_suppkey AS a, y.s_suppkey AS b, coalesce(len(list_intersect(hx.hubs, hy.hubs)) > 0, false)::INTEGER AS hub_overlap FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey LEFT JOIN h hx ON hx.a = x.s_suppkey LEFT JOIN h hy ON hy.a = y.s_suppkey""",
)
def _(t):
    # hubs of a supplier: the orders that it has items in; pairs to tell apart are suppliers of one nation
    rows = t.supplier.select("s_suppkey", "s_nationkey")
    return I.shared_hubs(rows, "s_suppkey", "s_nationkey", t.lineitem.select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey")


PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
ROUTE_HELD = f"SELECT min(p_partkey) AS target, {ORG} AS name, min({SITE}) AS website, min({OTHER}) AS other FROM part WHERE p_partkey % 2 = 0 GROUP BY 2"


def held_organizations(t):
    rows = organizations(t).where("p_partkey % 2 = 0")
    return rows.groupBy("name").agg(F.min("p_partkey").alias("target"), F.min("website").alias("website"), F.min(F.get("others", F.lit(0))).alias("other")).select("target", "name", F.when(F.col("other").isNotNull(), F.array("other")).alias("others"), "website")


@plan(
    "er10_actor_routing",
    rf"""WITH r AS (SELECT p_partkey AS id, {ORG} AS name, {SITE} AS website, {OTHER} AS other FROM part WHERE p_partkey % 2 = 1), h AS ({ROUTE_HELD}),
    r2 AS (SELECT *, regexp_replace(regexp_extract(website, '://([^/]*)', 1), '^www\.', '') AS host, trim(regexp_extract(website, '://[^/]*(.*)', 1), '/') AS path, list_filter([{PLAIN.format('name')}, {PLAIN.format('other')}], lambda x: x IS NOT NULL AND x <> '') AS names FROM r),
    h2 AS (SELECT *, regexp_replace(regexp_extract(website, '://([^/]*)', 1), '^www\.', '') AS host, trim(regexp_extract(website, '://[^/]*(.*)', 1), '/') AS path, list_filter([{PLAIN.format('name')}, {PLAIN.format('other')}], lambda x: x IS NOT NULL AND x <> '') AS names FROM h),
    m AS (SELECT r2.id, h2.target, coalesce(r2.host = h2.host, false) AS site, len(list_intersect(r2.names, h2.names)) > 0 AS same, r2.path <> h2.path AND (regexp_matches(r2.path, '{I.UNIT_PATH}') OR regexp_matches(h2.path, '{I.UNIT_PATH}')) AS unit FROM r2 JOIN h2 ON r2.host = h2.host OR len(list_intersect(r2.names, h2.names)) > 0),
    e AS (SELECT id, min(target) AS target, count(*) AS n, min(CASE WHEN site THEN CASE WHEN NOT same AND unit THEN 'same_site_other_unit' ELSE 'website_domain' END ELSE 'name_or_alternate_name' END) AS rule FROM m GROUP BY 1),
    ac AS (SELECT *, list_filter(string_split({PLAIN.format("regexp_replace(name, '[(][^)]*[)]', ' ', 'g')")}, ' '), lambda w: NOT list_contains({quoted(T.STOP_WORDS)}, w)) AS ws, {PLAIN.format('name')} AS word FROM (SELECT id AS k, name, true AS mine FROM r UNION ALL SELECT target, name, false FROM h)),
    ai AS (SELECT k, mine, word, CASE WHEN len(ws) >= 2 THEN array_to_string(list_transform(ws, lambda w: substr(w, 1, 1)), '') ELSE '' END AS ini FROM ac),
    s AS (SELECT a.k AS id, min(b.k) AS target FROM ai a JOIN ai b ON a.mine AND NOT b.mine AND ((a.ini <> '' AND a.ini = b.word) OR (b.ini <> '' AND b.ini = a.word)) GROUP BY 1),
    sc AS (SELECT r.id, h.target, length(r.name) / 40.0 AS score FROM r JOIN h ON h.target = r.id + 1),
    o AS (SELECT r.id, e.n, e.rule, e.target, s.target AS st, sc.target AS ct, coalesce(sc.score, 0) AS score FROM r LEFT JOIN e USING (id) LEFT JOIN s USING (id) LEFT JOIN sc USING (id))
    SELECT id, CASE WHEN n = 1 THEN CASE WHEN rule = 'same_site_other_unit' THEN 'review' ELSE 'absorb' END WHEN n > 1 OR st IS NOT NULL OR score >= 0.35 THEN 'review' ELSE 'create' END AS decision,
    CASE WHEN n = 1 THEN rule WHEN n > 1 THEN 'conflicting_exact_identity' WHEN st IS NOT NULL THEN 'acronym' WHEN score >= 0.35 THEN 'score' END AS rule, coalesce(target, st, CASE WHEN score >= 0.35 THEN ct END) AS target FROM o""",
)
def _(t):
    rows = organizations(t).where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "id")
    held = held_organizations(t)
    # scores of close candidates come from a model; here the next held row, by the length of the name
    scores = rows.select("id", (F.col("id") + 1).alias("target"), (F.length("name") / 40.0).alias("score")).join(held.select("target"), "target", "left_semi")
    return I.route_actors(rows, held, scores).select("id", "decision", "rule", "target")


INSTITUTION = "(?i)(university|company|site|institute)"
PERSON = "CASE WHEN c_custkey % 50 = 0 THEN repeat('long name ', 30) ELSE 'Person ' || CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 3 ELSE c_custkey END AS STRING) END"
ROLE = "CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal > 9000 THEN repeat('very ', 30) || 'senior' ELSE lower(c_mktsegment) END"


def persons(t):
    orgs = organizations(t).select(F.col("p_partkey").alias("_k"), F.col("name").alias("affiliation"))
    n = F.when(F.col("c_custkey") % 50 == 0, F.expr("repeat('long name ', 30)")).otherwise(F.concat(F.lit("Person "), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_custkey div 3 ELSE c_custkey END").cast("string")))
    rows = t.customer.select("c_custkey", n.alias("name"), F.expr(ROLE).alias("role"), F.concat(F.lit("in/"), F.expr("c_custkey div 3").cast("string")).alias("profile"), (F.col("c_nationkey") * 7).cast("bigint").alias("_k"), (F.col("c_nationkey") > 3).alias("authorized"))
    return rows.join(orgs, "_k", "left").drop("_k")


@plan(
    "er12_person_routing",
    f"""WITH p AS (SELECT c_custkey, {PERSON} AS name, {ROLE} AS role, c_custkey // 3 AS prof, c_nationkey > 3 AS authorized, o.name AS affiliation FROM customer LEFT JOIN (SELECT p_partkey, {ORG} AS name FROM part) o ON o.p_partkey = c_nationkey * 7),
    k AS (SELECT *, {PLAIN.format('name')} AS nk, {PLAIN.format("coalesce(affiliation, '')")} AS ak FROM p), r AS (SELECT * FROM k WHERE c_custkey % 3 = 0), h AS (SELECT * FROM k WHERE c_custkey % 3 <> 0),
    hn AS (SELECT nk, min(c_custkey) AS t, count(DISTINCT c_custkey) AS n FROM h GROUP BY 1), hb AS (SELECT nk, ak, min(c_custkey) AS t, arg_min(role, c_custkey) AS role2, arg_min(prof, c_custkey) AS prof2, count(DISTINCT c_custkey) AS n FROM h GROUP BY 1, 2),
    ha AS (SELECT ak, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, {PLAIN.format(ORG)} AS ak FROM part WHERE p_size > 25) GROUP BY 1),
    o AS (SELECT r.c_custkey AS id, CASE WHEN length(trim(name)) > 255 THEN 'invalid_name_length' WHEN r.ak = '' THEN 'missing_affiliation' WHEN hb.n > 1 THEN 'ambiguous_identity' WHEN hb.n = 1 THEN CASE WHEN (role <> '' AND role2 <> '' AND role <> role2) OR prof <> prof2 THEN 'conflicting_details' ELSE 'already_held' END
     WHEN hn.n >= 1 THEN 'different_affiliation' WHEN NOT authorized THEN 'create_not_authorized' WHEN NOT regexp_matches(affiliation, '{INSTITUTION}') THEN 'invalid_affiliation' WHEN ha.n > 1 THEN 'ambiguous_affiliation' WHEN trim(role) = '' THEN 'missing_role' WHEN length(trim(role)) > 120 THEN 'invalid_role_length' ELSE 'create' END AS outcome,
     hb.t AS bt, hn.t AS nt, hn.n AS nn FROM r LEFT JOIN hn ON hn.nk = r.nk LEFT JOIN hb ON hb.nk = r.nk AND hb.ak = r.ak LEFT JOIN ha ON ha.ak = r.ak)
    SELECT id, outcome, CASE outcome WHEN 'already_held' THEN 'skip' WHEN 'create' THEN 'create' ELSE 'review' END AS zone, CASE WHEN outcome IN ('conflicting_details', 'already_held') THEN bt WHEN outcome = 'different_affiliation' OR (outcome = 'missing_affiliation' AND nn = 1) THEN nt END AS target FROM o""",
)
def _(t):
    rows = persons(t)
    held = rows.where("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "target")
    actors = organizations(t).join(t.part.where("p_size > 25").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("actor"), "name")
    return I.route_people(rows.where("c_custkey % 3 = 0").withColumnRenamed("c_custkey", "id"), held, actors, INSTITUTION)


def summits(t, *keep):
    """Events by order: a title from the first item's part and the year, the order's day, a natural key of both, and columns of the order."""
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
    titled = t.orders.join(first, "o_orderkey").join(t.part.select("p_partkey", F.expr(W).alias("w"), "p_brand"), "p_partkey")
    title = F.concat(F.col("w"), F.when(F.col("o_orderkey") % 5 == 0, " Summits").otherwise(" Summit"))
    return titled.select("o_orderkey", title.alias("title"), F.to_date("o_orderdate").alias("day"), F.concat_ws("|", T.plain(title), F.to_date("o_orderdate").cast("string")).alias("key"), *keep)


@plan("er11_event_routing")
def _(t):
    events = summits(t)
    held = events.where("o_orderkey % 4 = 0").withColumnRenamed("o_orderkey", "target")
    return I.route_events(events.where("o_orderkey % 4 <> 0").withColumnRenamed("o_orderkey", "id"), held)


@plan("er14_import_match")
def _(t):
    return I.import_actors(organizations(t).withColumnRenamed("p_partkey", "id"), held_organizations(t))


def listed_once(t):
    """Organizations by name: k, name, others, website."""
    rows = organizations(t).groupBy("name").agg(F.min("p_partkey").alias("k"), F.min(F.get("others", F.lit(0))).alias("o"), F.min("website").alias("website"))
    return rows.select("k", "name", F.when(F.col("o").isNotNull(), F.array("o")).alias("others"), "website")


@plan("er15_actor_duplicates")
def _(t):
    return I.actor_duplicates(listed_once(t))


@plan("er16_event_duplicates")
def _(t):
    return I.event_duplicates(listed_once(t))


@plan("er17_person_duplicates")
def _(t):
    return I.person_duplicates(listed_once(t))


@plan(
    "er19_edition_merge",
    """WITH e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS f, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS extra FROM orders),
    g AS (SELECT *, CASE WHEN f IS NOT NULL THEN f + 3 END AS l FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN f IS NULL THEN 2 WHEN l < DATE '1998-01-01' THEN 1 ELSE 0 END, CASE WHEN l < DATE '1998-01-01' THEN DATE '1998-01-01' - l ELSE f - DATE '1998-01-01' END NULLS FIRST, o_orderkey) AS rn FROM g),
    b AS (SELECT o_custkey, max(f) FILTER (WHERE rn = 1) AS begin_day FROM r GROUP BY 1)
    SELECT r.o_custkey, max(o_orderkey) FILTER (WHERE rn = 1) AS kept, max(f) FILTER (WHERE rn = 1) AS day, max(f) FILTER (WHERE l < begin_day) AS previous, arg_min(extra, rn) FILTER (WHERE extra IS NOT NULL) AS extra FROM r JOIN b ON b.o_custkey = r.o_custkey GROUP BY 1""",
)
def _(t):
    day = F.when(F.col("o_orderpriority") != "5-LOW", F.to_date("o_orderdate"))
    rows = t.orders.select("o_custkey", "o_orderkey", day.alias("f"), F.date_add(day, 3).alias("l"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("extra"))
    return I.merged_editions(rows, "o_custkey", "o_orderkey", "f", "l", F.lit("1998-01-01").cast("date"), ["extra"])


@plan("er25_same_event_collapse")
def _(t):
    rows = summits(t, "o_custkey", "o_orderstatus", "o_totalprice")
    rows = rows.withColumn("own", F.col("o_orderstatus") == "P").withColumn("band", F.when(F.col("o_totalprice") > 250000, "auto_high").otherwise("review")).withColumn("run", F.col("o_custkey") % 10)
    return I.collapsed_events(rows, "run", "o_orderkey", "title", "day", "own", "band", "o_totalprice")


@plan(
    "er26_held_event",
    f"""WITH s AS (SELECT o_orderkey, {W} || CASE WHEN o_orderkey % 5 = 0 THEN ' Forum ' ELSE ' Meeting ' END || p_brand || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' || year(o_orderdate) END AS title, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day
     FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
    y AS (SELECT *, list_distinct(list_filter(string_split({PLAIN.format('title')}, ' '), lambda w: w <> '')) AS ws, list_distinct(regexp_extract_all(title, '\\b((?:19|20)[0-9]{{2}})\\b', 1)) AS ty FROM s),
    h AS (SELECT o_orderkey AS held, list_filter(ws, lambda w: NOT list_contains(['the', 'and', 'for', 'conference', 'summit', 'annual', 'edition'], w) AND NOT regexp_matches(w, '^[0-9]+$')) AS hw, list_distinct(list_concat(ty, CASE WHEN day IS NULL THEN [] ELSE [CAST(year(day) AS VARCHAR)] END)) AS hy FROM y WHERE o_orderkey % 4 = 0)
    SELECT o_orderkey AS key, min(held) AS held FROM y JOIN h ON len(hw) >= 3 AND list_has_all(ws, hw) AND NOT (len(hy) > 0 AND len(ty) > 0 AND len(list_intersect(hy, ty)) = 0) AND NOT (len(ty) > 0 AND len(hy) = 0) WHERE o_orderkey % 4 <> 0 GROUP BY 1""",
)
def _(t):
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
    rows = t.orders.join(first, "o_orderkey").join(t.part.select("p_partkey", F.expr(W).alias("w"), "p_brand"), "p_partkey")
    title = F.concat(F.col("w"), F.when(F.col("o_orderkey") % 5 == 0, " Forum ").otherwise(" Meeting "), F.col("p_brand"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.year("o_orderdate").cast("string"))))
    rows = rows.select("o_orderkey", title.alias("title"), F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("day"))
    return I.held_events(rows.where("o_orderkey % 4 <> 0"), "o_orderkey", "title", rows.where("o_orderkey % 4 = 0"), "o_orderkey", "title", "day")


@plan("er28_people_links")
def _(t):
    rows = persons(t).select(F.col("c_custkey").alias("person"), F.col("affiliation").alias("organization"), F.concat(F.lit("head of "), F.col("role"), F.lit(" at "), F.coalesce("affiliation", F.lit("home"))).alias("title"))
    actors = held_organizations(t).select(F.col("target").alias("actor"), "name")
    return I.linked_people(rows.withColumn("organization", F.when(F.col("person") % 2 == 0, F.col("organization"))), actors)


@plan("jn13_upper_triangle", f"WITH {DESCRIBED.split(', p AS' if ', p AS' in DESCRIBED else ',' + chr(10) + 'p AS')[0]} SELECT a.name AS a, b.name AS b FROM d a JOIN d b ON a.name < b.name AND len(a.wd) > 0 AND len(b.wd) > 0 AND len(list_intersect(a.wd, b.wd)) / len(list_distinct(list_concat(a.wd, b.wd))) >= 0.6")
def _(t):
    rows = I.described(organizations(t).select("name").distinct(), "name")
    return set_pairs(rows, "name", "_words", 0.6).select("a", "b")


REGISTERED = f"CASE WHEN p_size % 2 = 0 THEN {ORG} ELSE regexp_replace({ORG}, ' [(].*', '') || CASE WHEN p_size > 40 THEN ' (UX)' ELSE '' END END"
PROVIDER = "CASE WHEN p_size < 15 THEN 'openalex' WHEN p_size < 30 THEN 'ror' WHEN p_size < 40 THEN 'sec' ELSE 'wikidata' END"
BARE = "trim(regexp_replace(lower(regexp_replace({}, '[(][^)]*[)]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@plan(
    "er30_official_candidates",
    rf"""WITH a AS (SELECT p_partkey AS actor, {ORG} AS an FROM part WHERE p_partkey % 5 = 0), c AS (SELECT p_partkey AS candidate, {REGISTERED} AS cn, {PROVIDER} AS provider, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(replace(p_name, ' ', '-')) || '.example.org' END AS url FROM part WHERE p_partkey % 5 <> 0),
    a2 AS (SELECT *, {BARE.format('an')} AS base, {PLAIN.format('an')} AS ap, list_filter(list_transform(regexp_extract_all(an, '[(]([^)]*)[)]', 1), lambda x: {PLAIN.format('x')}), lambda x: x <> '') AS notes FROM a), c2 AS (SELECT *, {BARE.format('cn')} AS base, {PLAIN.format('cn')} AS cp, contains(cn, '(') AS bracketed FROM c WHERE provider IN ('ror', 'openalex', 'wikidata')),
    w AS (SELECT *, list_filter(string_split(base, ' '), lambda x: NOT list_contains({quoted(T.STOP_WORDS)}, x)) AS bw FROM a2 WHERE base <> ''), i AS (SELECT *, CASE WHEN len(bw) >= 2 THEN array_to_string(list_transform(bw, lambda x: substr(x, 1, 1)), '') ELSE '' END AS ini FROM w),
    j AS (SELECT actor, candidate, provider, url, an, cn, list_filter(list_distinct(string_split(ap, ' ')), lambda x: length(x) >= 4 AND NOT list_contains({quoted(T.STOP_WORDS)}, x)) AS da, list_filter(list_distinct(string_split(cp, ' ')), lambda x: length(x) >= 4 AND NOT list_contains({quoted(T.STOP_WORDS)}, x)) AS dc
     FROM i JOIN c2 ON c2.base = i.base WHERE ap = cp OR len(notes) = 0 OR (NOT bracketed AND len(list_filter(notes, lambda n: replace(n, ' ', '') <> ini)) = 0)),
    s AS (SELECT *, CASE WHEN least(len(da), len(dc)) > 0 THEN len(list_intersect(da, dc)) / least(len(da), len(dc)) ELSE 0.0 END AS sim, list_position(['ror', 'openalex', 'wikidata'], provider) AS o FROM j),
    g AS (SELECT actor, arg_min(candidate, (o, -sim, candidate)) AS candidate, arg_min(provider, (o, -sim, candidate)) AS provider, count(DISTINCT nullif(url, '')) AS n FROM s GROUP BY 1)
    SELECT actor, CASE WHEN n <= 1 THEN 'matched' ELSE 'conflict' END AS outcome, CASE WHEN n <= 1 THEN candidate END AS candidate, CASE WHEN n <= 1 THEN provider END AS provider, CASE WHEN n <= 1 THEN 0.88::DOUBLE END AS confidence FROM g""",
)
def _(t):
    actors = organizations(t).where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("actor"), "name")
    site = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("https://www."), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(".example.org/")))
    held = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("candidate"), F.expr(REGISTERED).alias("name"), F.expr(PROVIDER).alias("provider"), site.alias("website"))
    return I.official_matches(actors, held, ["ror", "openalex", "wikidata"])
