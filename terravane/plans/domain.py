"""Plans of retrieval, entity resolution, clusters, scoring, facts, curation, schedules, sheets and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators import entity as E
from ..operators import evaluation as V
from ..operators import facts as FA
from ..operators import graph as G
from ..operators import index as X
from ..operators import ledger as L
from ..operators import places as P
from ..operators import relational as R
from ..operators import schedule as SM
from ..operators import scoring as S
from ..operators import search as Q
from ..sources.shared import fresh_path
from .registry import plan
from .scalars import LAT, LON, MILES, lat, lon

QUERY = ["the", "cher", "sch", "thing"]
QUERY_SQL = "['the', 'cher', 'sch', 'thing']"

# retrieval

KEYWORD_SQL = f"""tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2)) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'cher', 'sch', 'thing') GROUP BY 1, 2),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY 1),
kw AS (SELECT doc_id, round(sum((1 + ln(tf)) * idf), 6) AS score FROM tf JOIN idf USING (term) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50)"""
VECTOR_SQL = "vec AS (SELECT vec_id AS doc_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 50)"


def vectors(t, k=50, most=None):
    asked = t.embeddings.where("vec_id = 0").first().embedding  # the query's own vector
    return Q.vector_top(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", asked, k, most)


@plan("tk01_vector_top", f"WITH {VECTOR_SQL} SELECT doc_id, CAST(floor(distance * 1e5 + 0.5) AS BIGINT) AS e5 FROM vec WHERE distance <= 0.9")
def _(t):
    return vectors(t, 50, 0.9).select("doc_id", F.floor(F.col("distance") * 1e5 + 0.5).alias("e5"))


@plan("tk02_keyword_top", f"WITH {KEYWORD_SQL} SELECT doc_id, score FROM kw")
def _(t):
    return Q.keyword_top(R.spread(t.documents.select("doc_id", "text"), "doc_id"), "doc_id", "text", QUERY, 50)


@plan("tk01_vector_index")
def _(t):
    rows = t.embeddings.select("vec_id", "embedding")
    centroids, probes = X.fitted_centroids(rows, "vec_id", "embedding")
    index = X.write_vector_index(rows, "vec_id", "embedding", centroids, fresh_path(rows.sparkSession, "vectors"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return X.vector_index_top(index, asked, "vec_id", "embedding", centroids, probes, 10)


@plan("tk02_block_max", f"WITH {KEYWORD_SQL} SELECT doc_id, score FROM kw")
def _(t):
    docs = R.spread(t.documents.select("doc_id", "text"), "doc_id")
    index = X.write_postings(docs, "doc_id", "text", fresh_path(docs.sparkSession, "postings"))
    return X.block_max_top(index, QUERY, docs.count(), 50, "doc_id")


@plan(
    "tk03_hybrid_rrf",
    f"""WITH {KEYWORD_SQL}, {VECTOR_SQL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rank, 1 AS list FROM vec UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id), 2 FROM kw)
    SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(max(rank) FILTER (WHERE list = 1) AS INTEGER) AS rank_1, CAST(max(rank) FILTER (WHERE list = 2) AS INTEGER) AS rank_2 FROM r GROUP BY 1 ORDER BY score DESC, rank_1 NULLS LAST, rank_2 NULLS LAST, doc_id LIMIT 20""",
)
def tk03(t):
    words = Q.keyword_top(R.spread(t.documents.select("doc_id", "text"), "doc_id"), "doc_id", "text", QUERY, 50)
    return Q.fused([vectors(t), words], "doc_id", [[F.col("distance"), F.col("doc_id")], [F.desc("score"), F.col("doc_id")]], 20)


@plan(
    "tk06_excerpt",
    f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, unnest(range(0, greatest(length(coalesce(text, '')), 1), 700)) AS k FROM documents),
    h AS (SELECT doc_id, k, length(t) <= 700 AS whole, substring(t, k + 1, 700) AS s, len(list_intersect(list_distinct(string_split_regex(lower(substring(t, k + 1, 700)), '[^\\p{{L}}\\p{{N}}]+')), {QUERY_SQL})) AS hits FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k > 0, hits DESC, k) AS rn FROM h WHERE k = 0 OR hits > 0)
    SELECT doc_id, string_agg(s, ' … ' ORDER BY k) AS excerpt, any_value(whole) AS whole FROM r WHERE rn <= 4 GROUP BY 1""",
)
def _(t):
    docs = t.documents.select("doc_id", "text", F.coalesce(F.length("text") <= 700, F.lit(True)).alias("whole"))
    return Q.excerpt(docs, "doc_id", "text", QUERY, keep=["whole"])


def name_weights(t):
    names = t.part.select("p_name").distinct()
    return Q.tfidf(names, "p_name", F.split("p_name", " "))


TFIDF_SQL = """n AS (SELECT DISTINCT p_name FROM part), tok AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS term FROM n), tf AS (SELECT p_name, term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT p_name, term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM n)) / (1 + df))) AS w FROM tf JOIN df USING (term)),
len AS (SELECT p_name, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1), wt AS (SELECT p_name, term, w / l AS weight FROM raw JOIN len USING (p_name))"""


@plan("ma05_tfidf", f"WITH {TFIDF_SQL} SELECT p_name, term, CAST(floor(weight * 1e6 + 0.5) AS BIGINT) AS micros FROM wt")
def _(t):
    return name_weights(t).select("p_name", "term", F.floor(F.col("weight") * 1e6 + 0.5).alias("micros"))


@plan("er01_shortlist", f"WITH {TFIDF_SQL}, m AS (SELECT a.p_name AS a, b.p_name AS b, round(sum(a.weight * b.weight), 6) AS cosine FROM wt a JOIN wt b USING (term) WHERE a.p_name <> b.p_name GROUP BY 1, 2) SELECT a, b, cosine FROM m WHERE cosine > 0.3")
def _(t):
    w = name_weights(t)
    pairs = Q.shortlist(w.withColumnRenamed("p_name", "a"), w.select(F.col("p_name").alias("b"), "term", F.col("weight").alias("weight2")), "a", "b", 1_000_000, 0.3)
    return pairs.where("a <> b").select("a", "b", "cosine")


# entity resolution


NAMES = "(SELECT DISTINCT p_name AS name FROM part)"


def names(t):
    return t.part.select(F.col("p_name").alias("name")).distinct()


def name_pairs(t):
    """Pairs of distinct names that share a word."""
    own = names(t)
    return E.blocked_pairs(own, "name", F.split("name", " "))


PAIRS_SQL = f"(SELECT DISTINCT a.name AS a, b.name AS b FROM {NAMES} a JOIN {NAMES} b ON a.name < b.name AND len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) > 0)"
JACCARD_SQL = "len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))"


@plan("jn12_blocked_pairs", f"SELECT a, b FROM {PAIRS_SQL}")
def _(t):
    return name_pairs(t)


@plan("jn14_domain_suffix_join", "WITH h AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), d AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM h WHERE page_id % 7 = 0) SELECT DISTINCT page_id FROM h JOIN d ON host = domain OR ends_with(host, '.' || domain)")
def _(t):
    hosts = t.pages.select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    labels = F.split("host", r"\.")
    held = hosts.where("page_id % 7 = 0").select(F.array_join(F.when(F.size(labels) > 3, F.slice(labels, -3, 3)).otherwise(labels), ".").alias("domain"))
    return R.on_domains(hosts, "host", held, "domain").select("page_id")


@plan(
    "er02_duplicate_names",
    f"""SELECT a, b, CASE WHEN least(length(replace(a, ' ', '')), length(replace(b, ' ', ''))) >= 5 AND (contains(replace(a, ' ', ''), replace(b, ' ', '')) OR contains(replace(b, ' ', ''), replace(a, ' ', ''))) THEN 'containment' WHEN {JACCARD_SQL} >= 0.3 THEN 'words' END AS reason
    FROM (SELECT a.name AS a, b.name AS b FROM {NAMES} a JOIN {NAMES} b ON a.name < b.name) WHERE reason IS NOT NULL""",
)
def _(t):
    return E.duplicate_names(names(t), "name", 0.3)


@plan("er03_ranked_candidates", f"SELECT a, b, CAST(row_number() OVER (ORDER BY j DESC, a, b) AS INTEGER) AS position FROM (SELECT a, b, {JACCARD_SQL} AS j FROM {PAIRS_SQL}) ORDER BY position LIMIT 150")
def _(t):
    scored = name_pairs(t).withColumn("j", T.jaccard(F.split("a", " "), F.split("b", " "))).orderBy(F.desc("j"), "a", "b").limit(150)
    return scored.select("a", "b", F.row_number().over(Window.orderBy(F.desc("j"), "a", "b")).alias("position"))


@plan("er04_lexical_features", f"SELECT a, b, 0.0::DOUBLE AS acronym_match, CAST(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' ')))) AS DOUBLE) AS containment, {JACCARD_SQL} AS jaccard, least(length(a), length(b)) / greatest(length(a), length(b)) AS length_ratio FROM {PAIRS_SQL}")
def _(t):
    return name_pairs(t).select("a", "b", *[c.alias(k) for k, c in E.lexical_features(F.col("a"), F.col("b")).items()])


@plan("er09_zones", "SELECT event_id, CASE WHEN k / 100.0 >= 0.96 THEN 'high' WHEN k / 100.0 >= 0.35 THEN 'review' ELSE 'create' END AS zone FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def _(t):
    return t.events.select("event_id", E.zone(F.get_json_object("props", "$.k").cast("bigint") / 100).alias("zone"))


@plan("er13_natural_keys", "SELECT event_id, event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR).replace('-', ' ') AS key FROM events")
def _(t):
    return t.events.select("event_id", E.natural_key(F.col("event_type"), F.to_date("ts").cast("string")).alias("key"))


@plan("er18_merge_policy", "SELECT p_name, arg_max(p_brand, (length(p_brand), p_brand)) AS p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS all_p_type FROM part GROUP BY 1")
def _(t):
    return E.merged(t.part, "p_name", ["p_brand"], ["p_type"])


@plan("er20_greedy_groups")
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand")
    return E.spelled_groups(rows, ["p_brand"], ["p_partkey"], "p_partkey", "p_name", 85)


@plan("er22_components")
def _(t):
    edges = t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b")).distinct()
    return G.components(edges, "a", "b")


@plan("er23_winner", "SELECT p_name, arg_min(p_partkey, (-p_size, length(p_brand), p_partkey)) AS winner, count(*) AS size FROM part GROUP BY 1")
def _(t):
    return E.winners(t.part, "p_name", "p_partkey", [F.desc("p_size"), F.length("p_brand"), F.col("p_partkey")])


SIDES = ("p_name || CASE p_size % 4 WHEN 0 THEN ' ' || lower(p_type) WHEN 1 THEN '' ELSE ' of ' || p_brand END", "CASE WHEN p_size % 3 = 0 THEN p_brand || ' ' ELSE '' END || p_name || CASE WHEN p_size % 5 = 0 THEN ', ' || p_type ELSE '' END")


@plan("er24_direction", "SELECT p_partkey, CASE WHEN len(less) = 0 AND len(more) > 0 THEN 'child_first' WHEN len(more) = 0 AND len(less) > 0 THEN 'parent_first' END AS direction FROM (SELECT p_partkey, list_filter(x, lambda w: NOT list_contains(y, w)) AS more, list_filter(y, lambda w: NOT list_contains(x, w)) AS less FROM (SELECT p_partkey, " + ", ".join(f"list_filter(string_split(trim(regexp_replace(lower({side}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS {n}" for side, n in zip(SIDES, "xy")) + " FROM part))")
def _(t):
    return t.part.select("p_partkey", E.direction(*map(F.expr, SIDES)).alias("direction"))


def _(t):
    more, k = F.concat("p_name", F.lit(" extra")), F.col("p_partkey") % 3
    return t.part.select("p_partkey", E.direction(F.when(k == 0, more).otherwise(F.col("p_name")), F.when(k == 1, more).otherwise(F.col("p_name"))).alias("direction"))


@plan("er27_person_key", "SELECT c_custkey, lower(replace(replace(c_name, '#', ' '), '  ', ' ')) || '|' || lower(c_mktsegment) AS key FROM customer")
def _(t):
    return t.customer.select("c_custkey", E.natural_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@plan("cl00_families", "WITH RECURSIVE w AS (SELECT s_suppkey AS node, s_suppkey AS now, 0 AS depth FROM supplier UNION ALL SELECT node, CASE now WHEN 20 THEN 21 WHEN 21 THEN 20 ELSE now // 2 END, depth + 1 FROM w WHERE now > 0 AND depth < 40) SELECT node, CAST(CASE WHEN min(now) = 0 THEN 0 END AS BIGINT) AS root, min(now) = 0 AS resolved FROM w GROUP BY 1")
def _(t):
    nodes = t.supplier.select("s_suppkey")
    parent = F.when(F.col("s_suppkey") == 20, 21).when(F.col("s_suppkey") == 21, 20).otherwise(F.expr("s_suppkey div 2")).cast("bigint")  # one cycle planted
    edges = nodes.where("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), parent.alias("parent"))
    return G.families(nodes, edges, "s_suppkey", "child", "parent")


@plan("cl00b_descendants", "WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 0), w AS (SELECT parent AS ancestor, child AS descendant, parent || '/' || child AS path, 1 AS depth FROM e UNION ALL SELECT ancestor, e.child, path || '/' || e.child, depth + 1 FROM w JOIN e ON e.parent = w.descendant) SELECT ancestor, descendant, path, CAST(depth AS BIGINT) AS depth FROM w")
def _(t):
    edges = t.supplier.where("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 2").alias("parent"))
    return G.descendants(edges, "child", "parent")


def actors(t, most=None):
    rows = t.supplier if most is None else t.supplier.where(F.col("s_suppkey") < most)
    return rows.select(F.col("s_suppkey").alias("actor"), (F.col("s_nationkey") % 5).alias("sector"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))


def hubs(t):
    return t.nation.select(F.col("n_nationkey").alias("hub"), (F.col("n_nationkey") % 5).alias("sector"), lat("n_nationkey").alias("lat2"), lon("n_nationkey").alias("lon2"))


AT = MILES.format(LAT.format("s_suppkey"), LON.format("s_suppkey"), LAT.format("n_nationkey"), LON.format("n_nationkey"))
REACH_SQL = f"(SELECT s_suppkey AS actor, n_nationkey AS hub, round({AT}, 6) AS miles FROM supplier JOIN nation ON s_nationkey % 5 = n_nationkey % 5 WHERE {AT} <= 400)"


@plan("jn11_radius_join", f"SELECT s_suppkey AS actor, n_nationkey AS hub FROM supplier, nation WHERE {AT} <= 200")
def _(t):
    return P.radius_join(actors(t).drop("sector"), hubs(t).drop("sector"), 200.0).select("actor", "hub")


@plan("jn21_hub_suggestions", f"SELECT actor, hub FROM {REACH_SQL} WHERE hub <> (actor % 25)")
def _(t):
    return P.radius_join(actors(t), hubs(t), 400.0, ["sector"]).where("hub <> actor % 25").select("actor", "hub")


SPOT = "(SELECT c_nationkey % 5 AS cluster, c_nationkey, " + LAT.format("c_nationkey") + " AS lat, " + LON.format("c_nationkey") + " AS lon, 'city ' || c_nationkey AS city, count(*) AS n FROM customer GROUP BY ALL)"
CENTER_SQL = f"""near AS (SELECT a.cluster, a.city, a.lat, a.lon, b.n, {MILES.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM {SPOT} a JOIN {SPOT} b ON a.cluster = b.cluster),
ranked AS (SELECT cluster, city, lat, lon, sum(CASE WHEN d <= 50 THEN n ELSE 0 END) AS core, row_number() OVER (PARTITION BY cluster ORDER BY sum(CASE WHEN d <= 50 THEN n ELSE 0 END) DESC, round(sum(d * n) / sum(n), 6), city, lat, lon) AS k FROM near WHERE d <= 200 GROUP BY 1, 2, 3, 4)"""


def spots(t):
    return t.customer.select((F.col("c_nationkey") % 5).alias("cluster"), lat("c_nationkey").alias("lat"), lon("c_nationkey").alias("lon"), F.lit("ST").alias("state"), F.concat(F.lit("city "), F.col("c_nationkey").cast("string")).alias("city"), "c_custkey", "c_acctbal", "c_mktsegment")


@plan("cl01_density_center", f"WITH {CENTER_SQL} SELECT cluster, city, CAST(core AS BIGINT) AS core FROM ranked WHERE k = 1")
def _(t):
    return P.density_center(spots(t), "cluster").select("cluster", "city", "core")


@plan(
    "cl12_topic_proposal",
    f"""WITH {CENTER_SQL}, m AS (SELECT c_nationkey % 5 AS cluster, {LAT.format('c_nationkey')} AS lat2, {LON.format('c_nationkey')} AS lon2, c_acctbal, c_mktsegment FROM customer),
    g AS (SELECT cluster, list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal > 9990) AS tags, count(*) AS members, count(*) FILTER (WHERE c_acctbal > 0) AS located FROM m GROUP BY 1),
    o AS (SELECT m.cluster, count(*) FILTER (WHERE {MILES.format('lat', 'lon', 'lat2', 'lon2')} > 200 AND c_acctbal > 0) AS outside FROM m JOIN ranked r ON r.cluster = m.cluster AND k = 1 GROUP BY 1)
    SELECT g.cluster AS hub, CASE WHEN len(tags) = 1 THEN tags[1] WHEN g.cluster = 3 THEN 'WATER' END AS topic, CASE WHEN len(tags) = 1 THEN 'single primary tag' WHEN g.cluster = 3 THEN 'hub name only' ELSE 'no deterministic basis' END AS basis, coalesce(len(tags), 0) <> 1 AS needs_review, members, located, outside FROM g JOIN o ON o.cluster = g.cluster""",
)
def _(t):
    rows = spots(t)
    tags = rows.groupBy(F.col("cluster").alias("hub")).agg(F.collect_set(F.when(F.col("c_acctbal") > 9990, F.col("c_mktsegment"))).alias("tags"))
    hubs = tags.withColumn("name", F.concat(F.lit("Hub "), F.col("hub").cast("string")))
    center = P.density_center(rows, "cluster")  # all members give the center; those of a positive balance have a place of their own
    own = rows.select(F.col("cluster").alias("hub"), F.when(F.col("c_acctbal") > 0, F.col("lat")).alias("lat"), F.when(F.col("c_acctbal") > 0, F.col("lon")).alias("lon"))
    return P.topic_proposals(hubs, own, center.select(F.col("cluster").alias("hub"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon")), {"Hub 3": "WATER"})


@plan("cl02_new_clusters")
def _(t):
    rows = t.customer.select((F.col("c_nationkey") % 5).alias("sector"), (F.col("c_custkey") % 40).cast("string").alias("family"), F.col("c_mktsegment").alias("category"), F.concat(F.lit("city "), F.col("c_nationkey").cast("string")).alias("city"), F.lit("ST").alias("state"), lat("c_nationkey").alias("lat"), lon("c_nationkey").alias("lon"))
    return P.detect_clusters(rows, "sector")


@plan("cl05_family_fingerprint", "SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS fingerprint FROM nation GROUP BY 1")
def _(t):
    from ..functions.collections import set_fingerprint

    return t.nation.groupBy("n_regionkey").agg(F.collect_set("n_name").alias("s")).select("n_regionkey", set_fingerprint(F.col("s")).alias("fingerprint"))


@plan("cl06_covering_hub", f"SELECT actor, min(hub) AS hub FROM {REACH_SQL} GROUP BY 1")
def _(t):
    return P.radius_join(actors(t), hubs(t), 400.0, ["sector"]).groupBy("actor").agg(F.min("hub").alias("hub"))


@plan("cl08_assignment", f"SELECT actor, arg_min(hub, (miles, hub)) AS hub, count(*) AS overlaps FROM {REACH_SQL} GROUP BY 1")
def _(t):
    return P.assignments(actors(t), hubs(t), 400.0).select("actor", "hub", "overlaps")


@plan("cl09_legacy_membership", f"SELECT s_suppkey AS actor, CASE WHEN {AT} <= 200 THEN 'confirmed' ELSE 'kept outside radius' END AS assessment FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    from ..functions.numbers import haversine_miles

    rows = actors(t).join(t.supplier.select(F.col("s_suppkey").alias("actor"), F.col("s_nationkey").alias("hub")), "actor").join(hubs(t).drop("sector"), "hub")
    return rows.select("actor", F.when(haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 200, "confirmed").otherwise("kept outside radius").alias("assessment"))


@plan("cl10_drift", f"SELECT s_suppkey AS actor, s_suppkey % 2 = 0 AND {AT} > 25 AS drifted FROM supplier JOIN nation ON n_nationkey = s_suppkey % 25")
def _(t):
    rows = actors(t).drop("sector").join(hubs(t).drop("sector"), F.col("actor") % 25 == F.col("hub"))
    return rows.select("actor", P.drifted(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), F.col("actor") % 2 == 0).alias("drifted"))


@plan("cl13_single_primary", "SELECT l_orderkey, count(DISTINCT p_brand) AS links, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS primary_brand FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    one = rows.groupBy("l_orderkey").agg(F.count_distinct("p_brand").alias("links"), F.min("p_brand").alias("b"))
    return one.select("l_orderkey", "links", F.when(F.col("links") == 1, F.col("b")).alias("primary_brand"))


# scoring


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def k():
    return F.get_json_object("props", "$.k").cast("bigint")


def rubric_plan(name, weights, items):
    terms = " + ".join(f"round(CASE WHEN ({K} >> {i % 6}) & 1 = 1 THEN {weights[w]} ELSE 0 END * 1e6)" for i, w in enumerate(items))

    @plan(name, f"SELECT event_id, CAST({terms} AS BIGINT) AS micros FROM events")
    def _(t):
        flags = F.create_map(*[x for i, w in enumerate(items) for x in (F.lit(w), F.shiftright(k(), i % 6).bitwiseAND(F.lit(1)) == 1)])
        return t.events.select("event_id", F.round(S.rubric(flags, weights) * 1e6).cast("bigint").alias("micros"))


rubric_plan("ru01_relevance", S.RELEVANCE_WEIGHTS, list(S.RELEVANCE_WEIGHTS))
rubric_plan("ru01_priority", S.PRIORITY_WEIGHTS, list(S.PRIORITY_WEIGHTS))
rubric_plan("ru02_combined", S.COMBINED_WEIGHTS, list(S.COMBINED_WEIGHTS))
rubric_plan("ru03_event", S.EVENT_WEIGHTS, list(S.EVENT_WEIGHTS))
rubric_plan("ru03_person", S.PERSON_WEIGHTS, list(S.PERSON_WEIGHTS))


@plan("ru04_bands", f"SELECT event_id, CASE WHEN {K} / 100.0 < 0.45 THEN 'auto_low' WHEN {K} / 100.0 >= 0.8 THEN 'auto_high' ELSE 'review' END AS band FROM events")
def _(t):
    return t.events.select("event_id", S.band(k() / 100, *S.BANDS["actor"]).alias("band"))


@plan("ru06_capped_band", f"SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'auto_low' WHEN event_type = 'click' AND {K} >= 80 THEN 'review' WHEN {K} < 45 THEN 'auto_low' WHEN {K} >= 80 THEN 'auto_high' ELSE 'review' END AS band FROM events")
def _(t):
    decision = F.when(F.col("event_type") == "error", "exclude").when(F.col("event_type") == "signup", "research").when(F.col("event_type") == "click", "review").otherwise("accept")
    return t.events.select("event_id", S.capped_band(S.band(k() / 100, 0.45, 0.8), decision, F.array(F.lit("expertise"))).alias("band"))


@plan("fi12_source_kind", "SELECT page_id, CASE WHEN ends_with(host, 'example.net') THEN 'social' WHEN ends_with(host, 'example.org') THEN 'listing' ELSE 'web' END AS kind FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)")
def _(t):
    from ..functions import urls as U

    return t.pages.select("page_id", S.source_kind(U.host(F.col("url")), U.path(F.col("url")), ["example.net"], [], ["example.org"], []).alias("kind"))


@plan("wi06_list_ranks", "SELECT event_id, 1.0 / (60 + row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)) AS gain FROM events WHERE event_type = 'purchase'".replace("1.0 /", "CAST(1 AS DOUBLE) /"))
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.where("event_type = 'purchase'").select("event_id", (1.0 / (60 + F.row_number().over(w))).alias("gain"))


@plan(
    "wi11_fetch_plan",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), f AS (SELECT *, min(place) OVER (PARTITION BY user_id, event_type) AS seen FROM p), d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY seen) AS dom FROM f)
    SELECT event_id, dom <= 3 AND sum(CASE WHEN dom <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING) <= 10 AS planned FROM d""",
)
def _(t):
    return S.fetch_plan(t.events, ["user_id"], "event_type", ["ts", "event_id"], 10, 3).select("event_id", "planned")


# facts


def ledger(t):
    return t.events.select("user_id", "event_type", F.col("event_id").alias("id"), F.sha2(F.col("value").cast("string"), 256).alias("hash"), (k() % 3).alias("confidence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("read_at"), (k() % 10 == 0).alias("human"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrived"))


FOLD_SQL = f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id, event_type, sha256(CAST(value AS VARCHAR)) AS hash, {K} % 3 AS conf, ts, {K} % 10 = 0 AS human, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT id, user_id, event_type, rn, 'accepted' AS outcome, id AS current_id, hash AS h, conf AS c, ts AS r, human AS m FROM e WHERE rn = 1
 UNION ALL SELECT e.id, e.user_id, e.event_type, e.rn, o.outcome, CASE WHEN o.outcome = 'superseded' THEN e.id ELSE w.current_id END, CASE WHEN o.outcome = 'superseded' THEN e.hash ELSE h END, CASE WHEN o.outcome = 'superseded' THEN e.conf ELSE c END, CASE WHEN o.outcome = 'superseded' THEN e.ts ELSE r END, CASE WHEN o.outcome = 'superseded' THEN e.human ELSE m END
 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.rn = w.rn + 1, LATERAL (SELECT CASE WHEN e.hash = h THEN 'corroborated' WHEN m THEN 'pending_update' WHEN e.conf >= c AND e.ts > r THEN 'superseded' ELSE 'conflict_flagged' END AS outcome) o)"""


@plan("fa01_fold", f"{FOLD_SQL} SELECT id, outcome, current_id FROM w")
def _(t):
    return FA.fold(ledger(t), ["user_id", "event_type"])


@plan("fa02_current_facts", f"SELECT user_id, event_type, event_id FROM events WHERE {K} % 3 < 2 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    rows = t.events.withColumn("state", F.when(k() % 3 < 2, "accepted").otherwise("rejected"))
    return FA.current(rows, ["user_id", "event_type"], ["ts", "event_id"], ["accepted"], "state").select("user_id", "event_type", "event_id")


@plan("fa03_entries", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10 GROUP BY 1")
def _(t):
    rows = FA.entries(t.events.withColumn("v", F.col("event_id")), ["user_id"], "ts", "v", F.lit("2024-02-01").cast("date"))
    return rows.select("user_id", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"))


@plan("fa07_planned_fields", "SELECT s_suppkey AS entity, f.field, CASE WHEN d IS NULL THEN 'missing' ELSE 'outdated' END AS reason FROM supplier CROSS JOIN (SELECT DISTINCT event_type AS field FROM events) f LEFT JOIN (SELECT user_id, event_type, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1, 2) h ON h.user_id = s_suppkey AND h.event_type = f.field WHERE d IS NULL OR date_diff('day', d, DATE '2025-01-20') > 365")
def _(t):
    held = t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("field"), F.to_date("ts").alias("read_on"))
    return FA.planned(t.events.select(F.col("event_type").alias("field")), t.supplier.select(F.col("s_suppkey").alias("entity")), held, F.lit("2025-01-20").cast("date"))


@plan("fa09_details_row", "SELECT user_id, max(value) FILTER (WHERE event_type = 'purchase') AS purchase, max(value) FILTER (WHERE event_type = 'signup') AS signup FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def _(t):
    now = R.latest_value(t.events, ["user_id", "event_type"], ["value"], ["ts", "event_id"])
    return R.pivoted(now, ["user_id"], "event_type", "value", ["purchase", "signup"])


# curation and ledgers


@plan("cu02_file_duplicates", "SELECT p_partkey AS row, CASE WHEN rn > 1 THEN first END AS duplicate_of FROM (SELECT p_partkey, row_number() OVER w AS rn, first_value(p_partkey) OVER w AS first FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey))")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("file"), "p_partkey", F.array("p_name").alias("keys"), F.lit(True).alias("valid"))
    return C.file_duplicates(rows, "file", "p_partkey", "keys", "valid")


@plan("cu03_batch_state", "SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey < 30) THEN 'already imported' ELSE 'new' END AS state FROM part")
def _(t):
    return C.batch_state(t.part.select("p_partkey", "p_name"), t.part.where("p_partkey < 30"), "p_name").select("p_partkey", "state")


@plan("cu04_valid_pairs", "SELECT p_partkey, (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part WHERE p_partkey < 60) AS valid_pair FROM part")
def _(t):
    return C.valid_pairs(t.part.select("p_partkey", "p_brand", "p_type"), t.part.where("p_partkey < 60"), ["p_brand", "p_type"]).select("p_partkey", "valid_pair")


@plan("cu06_activity_feed", "SELECT id, kind, c_name FROM (SELECT event_id AS id, 'event' AS kind, user_id AS who, ts AS happened FROM events WHERE ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT o_orderkey, 'order', o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01') LEFT JOIN customer ON c_custkey = who ORDER BY happened DESC, kind, id LIMIT 100")
def _(t):
    events = t.events.where("ts >= timestamp_ntz '2024-01-20'").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("user_id").alias("who"), F.col("ts").alias("happened"))
    orders = t.orders.where("o_orderdate >= timestamp_ntz '1998-07-01'").select("o_orderkey", F.lit("order"), "o_custkey", "o_orderdate")
    feed = events.unionAll(orders).orderBy(F.desc("happened"), "kind", "id").limit(100)  # cut first: names are looked up for the page alone
    return feed.join(t.customer, F.col("c_custkey") == F.col("who"), "left").select("id", "kind", "c_name")


@plan("cu07_basis", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'in progress' WHEN 'P' THEN 'partial run' ELSE 'final' END AS basis FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.basis(F.col("o_orderstatus")).alias("basis"))


@plan(
    "cu09_exact_duplicates",
    """WITH r AS (SELECT p_partkey AS key, CASE WHEN p_size > 2 THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END END AS name, CASE WHEN p_size % 3 > 0 THEN 'https://' || lower(p_brand) || '.example.org/' || p_size || '/' || p_type END AS site FROM part)
    SELECT key, lower(name) AS name, CASE WHEN name IS NOT NULL THEN min(key) OVER (PARTITION BY lower(name)) END AS by_name, CASE WHEN site IS NOT NULL THEN min(key) OVER (PARTITION BY site) END AS by_site FROM r QUALIFY by_name < key OR by_site < key""",
)
def _(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    site = F.concat(F.lit("https://"), F.lower("p_brand"), F.lit(".example.org/"), F.col("p_size"), F.lit("/"), "p_type")
    rows = t.part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 2, name).alias("name"), F.when(F.col("p_size") % 3 > 0, site).alias("site"))
    found = C.exact_duplicates(rows, "key", "name", "site")
    return found.where("by_name < key OR by_site < key").select("key", F.lower("name").alias("name"), "by_name", "by_site")


# schedules


@plan("sm01_due", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not active' WHEN CAST(o_orderdate AS DATE) > DATE '1998-01-01' THEN 'not started' WHEN CAST(o_orderdate AS DATE) + 400 < DATE '1998-01-01' THEN 'ended' WHEN CAST(o_orderdate AS DATE) + 37 > DATE '1998-01-01' THEN 'not due yet' ELSE '' END AS reason FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    reason = SM.due(F.when(F.col("o_orderstatus") == "P", "paused").otherwise("active"), d, F.date_add(d, 400), F.lit("monthly"), F.date_add(d, 7), F.lit("1998-01-01").cast("date"))
    return t.orders.select("o_orderkey", reason.alias("reason"))


@plan("sm03_refreshed", "SELECT user_id, bool_or(ts >= TIMESTAMP '2024-01-25') AS by_change, bool_or(event_type = 'error') AS by_flag FROM events WHERE ts >= TIMESTAMP '2024-01-25' OR event_type = 'error' GROUP BY 1")
def _(t):
    return SM.refreshed(t.events.where("ts >= timestamp_ntz '2024-01-25'"), t.events.where("event_type = 'error'"), "user_id")


@plan("sm04_next_run", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + 7 <= DATE '1998-01-01' THEN CAST(o_orderdate AS DATE) + 7 END AS next_run FROM orders")
def _(t):
    return t.orders.select("o_orderkey", SM.next_run(F.lit("weekly"), F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("next_run"))


@plan("sm08_purge", "SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') > 365")
def _(t):
    return t.orders.where(SM.purgeable(F.to_date("o_orderdate"), F.lit("1998-08-01").cast("date"), 365)).select("o_orderkey")


# sheets


@plan("et01_sections", "SELECT p_partkey, last_value(CASE WHEN p_size = 50 THEN p_name END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS section FROM part QUALIFY p_size <> 50")
def _(t):
    return C.sectioned(t.part, ["p_brand"], "p_partkey", F.col("p_size") == 50, F.col("p_name")).select("p_partkey", "section")


@plan("et07_narrative_items", "SELECT conv_id, turn, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[ \\t\\n\\r\\f\\v•*–-]+', ''))), lambda x: regexp_matches(x, '[A-Za-z].* .*[A-Za-z]'))) AS INTEGER) AS n FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.size(C.narrative_items(F.col("text"))).alias("n"))


# evaluation


def scored(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("score"), F.col("quality").alias("label"))


SCORED = "(SELECT doc_id, (n_chars % 97) / 97.0 AS score, quality AS label FROM labels JOIN documents USING (doc_id))"
CURVE = f"""s AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM {SCORED} GROUP BY 1), c AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS total FROM s WINDOW w AS (ORDER BY threshold DESC)),
r AS (SELECT threshold, tp, fp, tp / (tp + fp) AS precision, CASE WHEN total > 0 THEN tp / total ELSE 0 END AS recall FROM c)"""


@plan("ev02_accuracy", f"SELECT label AS class, count(*) AS n, CAST(count(*) FILTER (WHERE (score >= 0.5)::INT = label) AS BIGINT) AS right_n, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy FROM {SCORED} GROUP BY ROLLUP (1)")
def _(t):
    rows = scored(t).withColumn("said", (F.col("score") >= 0.5).cast("int"))
    return V.accuracy(rows, "said", "label").withColumnRenamed("right", "right_n")


@plan("ev03_gate_metrics", f"SELECT count(*) FILTER (WHERE d = 'review') AS workload, round(count(*) FILTER (WHERE d = e) / count(*), 6) AS exact, round(count(*) FILTER (WHERE d = 'accept' AND e = 'accept') / count(*) FILTER (WHERE d = 'accept'), 6) AS accept_precision, round(count(*) FILTER (WHERE d IN ('accept', 'review') AND e IN ('accept', 'review')) / count(*) FILTER (WHERE e IN ('accept', 'review')), 6) AS useful_recall, round(count(*) FILTER (WHERE d = 'exclude' AND e = 'exclude') / count(*) FILTER (WHERE e = 'exclude'), 6) AS junk_filtered FROM (SELECT CASE WHEN score >= 0.7 THEN 'accept' WHEN score >= 0.3 THEN 'review' ELSE 'exclude' END AS d, CASE WHEN label = 1 THEN 'accept' ELSE 'exclude' END AS e FROM {SCORED})")
def _(t):
    rows = scored(t).select(F.when(F.col("score") >= 0.7, "accept").when(F.col("score") >= 0.3, "review").otherwise("exclude").alias("d"), F.when(F.col("label") == 1, "accept").otherwise("exclude").alias("e"))
    return V.gate_metrics(rows, "d", "e")


@plan("ev04_thresholds", f"WITH {CURVE} SELECT max(threshold) FILTER (WHERE round(recall, 9) >= 0.98) AS low, count(*) AS points FROM r")
def _(t):
    points = V.curve(scored(t), "score", "label")
    return V.chosen_thresholds(points).select("low").join(F.broadcast(points.agg(F.count(F.lit(1)).alias("points"))), F.lit(True))


@plan("ev05_curve", f"WITH {CURVE} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM r")
def _(t):
    return V.curve(scored(t), "score", "label").drop("f1")


@plan("ev06_average_precision", f"WITH {CURVE} SELECT round(sum((round(recall, 9) - coalesce(lag, 0)) * round(precision, 9)), 6) AS average_precision FROM (SELECT *, lag(round(recall, 9)) OVER (ORDER BY threshold DESC) AS lag FROM r)")
def _(t):
    return V.average_precision(V.curve(scored(t), "score", "label"))


@plan("ev06_confusion", f"SELECT (score >= 0.5)::INT AS said, label, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def _(t):
    return V.confusion(scored(t).withColumn("said", (F.col("score") >= 0.5).cast("int")), "said", "label")


@plan("ev07_bootstrap")
def _(t):
    return V.bootstrap(scored(t).select("doc_id", "label"), "label", 200)
