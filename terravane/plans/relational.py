"""Plans of scans, shaping, filters, joins, aggregates, windows, ordering and set operations.

"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import relational as R
from ..operators import screening as X
from .registry import plan

LIVE = "s_acctbal > 0"


# scans


@plan("sc01_capped_read", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 200")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(200)


@plan(
    "sc02_live_actors",
    """SELECT s_suppkey, s_name, n_name, r_name, coalesce(brands, '') AS brands FROM supplier
    LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN (SELECT l_suppkey, string_agg(p_brand, ', ' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45) GROUP BY 1) ON l_suppkey = s_suppkey
    WHERE s_acctbal > 0""",
)
def _(t):
    links = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.where("p_size > 45").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = R.grouped_text(links, ["l_suppkey"], "p_brand", name="brands")
    return (
        t.supplier.where(LIVE)
        .join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .join(brands, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select("s_suppkey", "s_name", "n_name", "r_name", F.coalesce("brands", F.lit("")).alias("brands"))
    )


@plan(
    "sc03_removed_records",
    """SELECT s_suppkey, s_name, ts, event_type FROM supplier LEFT JOIN (SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ON user_id = s_suppkey WHERE s_acctbal <= 0""",
)
def _(t):
    last = R.latest_value(t.events, ["user_id"], ["ts", "event_type"], ["ts", "event_id"])
    return t.supplier.where(f"NOT ({LIVE})").join(last, F.col("user_id") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", "ts", "event_type")


@plan(
    "sc04_hubs_with_members",
    """SELECT n_nationkey, n_name, coalesce(members, 0) AS members FROM nation LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS members FROM supplier WHERE s_acctbal > 0 GROUP BY 1) ON s_nationkey = n_nationkey""",
)
def _(t):
    members = t.supplier.where(LIVE).groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("members"))
    return t.nation.join(members, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("members", F.lit(0)).alias("members"))


@plan(
    "sc05_event_and_person_scan",
    """SELECT c_custkey, c_name, c_mktsegment, coalesce(n_events, 0) AS n_events, first_day, last_day FROM customer LEFT JOIN (SELECT user_id, count(*) AS n_events, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events WHERE event_type <> 'error' GROUP BY 1) ON user_id = c_custkey""",
)
def _(t):
    seen = t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))
    return t.customer.join(seen, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "c_mktsegment", F.coalesce("n_events", F.lit(0)).alias("n_events"), "first_day", "last_day")


@plan("sc06_csv_fields", """SELECT s_suppkey AS row_number, s_name || ', "' || s_nationkey || '"' AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""")
def _(t):
    quoted = F.concat(F.lit('"'), F.col("s_name"), F.lit(', ""'), F.col("s_nationkey").cast("string"), F.lit('"""'))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), quoted, F.col("s_nationkey").cast("string"))
    cells = F.from_csv(line, "row_number bigint, name string, nation string", {"escape": '"', "mode": "FAILFAST"})
    return t.supplier.select(cells.alias("r")).select("r.*")


@plan(
    "sc08_upload_rows",
    """WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS row_number, trim(coalesce(text, '')) = '' AS blank FROM conversations),
    r AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM n),
    s AS (SELECT conv_id, arg_min(CASE WHEN record > 4 THEN 'The file has more than 4 records. Split it into several files.' ELSE 'Row ' || row_number || ': a value in ''text'' is longer than 1500 characters.' END, row_number) AS refused
          FROM r WHERE NOT blank AND (record > 4 OR length(trim(text)) > 1500) GROUP BY 1)
    SELECT r.conv_id, CAST(row_number AS INTEGER) AS row_number, turn, blank, refused, sha256(text) AS digest FROM r LEFT JOIN s ON s.conv_id = r.conv_id""",
)
def _(t):
    from ..sources.uploads import upload_rows

    # a conversation stands for a file; its limits are lower here, so that some files are refused for either of them
    rows = upload_rows(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], "turn", ["text"], most_rows=4, most_cell=1500)
    return rows.select("conv_id", "row_number", "turn", "blank", "refused", F.sha2("text", 256).alias("digest"))


SCRIPT = r"(?is)<(script|style|noscript|svg)\b.*?</(script|style|noscript|svg)>"


@plan(
    "sc11_visible_text",
    rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '{SCRIPT}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages""",
)
def _(t):
    from ..sources.pages import visible_text

    return t.pages.select("page_id", visible_text(F.col("html")).alias("body"))


@plan(
    "sc12_listing_cards",
    r"""SELECT page_id, url, i - 1 AS position, regexp_extract(card, 'href="([^"]*)"', 1) AS link, regexp_extract(card, '>([^<]*)</a>', 1) AS title FROM (SELECT page_id, url, unnest(c) AS card, unnest(range(1, len(c) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>') AS c FROM pages))""",
)
def _(t):
    from ..sources.pages import listing_cards

    return listing_cards(t.pages, r"<li><a [^>]*>[^<]*</a></li>", {"link": r'href="([^"]*)"', "title": r">([^<]*)</a>"}, keep=["page_id", "url"])


@plan("sc13_pipe_dimension", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey < 3")
def _(t):
    line = F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    cells = F.from_csv(line, "n_name string, n_nationkey int, n_regionkey int", {"sep": "|"})
    return t.nation.select(cells.alias("r")).select("r.*").where("n_regionkey < 3").select("n_name", "n_nationkey")


@plan("sc14_json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@plan("sc15_unseen_pages", "SELECT page_id, sha256(html) AS digest FROM pages WHERE page_id % 2 = 1 AND sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0)")
def _(t):
    hashed = t.pages.select("page_id", F.sha2("html", 256).alias("digest"))
    return hashed.where("page_id % 2 = 1").join(hashed.where("page_id % 2 = 0").select("digest"), "digest", "left_anti").select("page_id", "digest")


@plan("sc17_ledger_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(t):
    owners = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    return t.orders.join(owners, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "o_orderstatus", "o_totalprice", "c_name")


@plan("sc18_drift_tolerant", "SELECT p_partkey, p_brand, CAST(NULL AS VARCHAR) AS p_colour FROM part")
def _(t):
    return t.part.select("p_partkey", R.optional(t.part, "p_brand").alias("p_brand"), R.optional(t.part, "p_colour").alias("p_colour"))


# sinks as table states


@plan("sk01_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def _(t):
    base = t.supplier.select("s_suppkey", "s_acctbal")
    return R.upsert(base.where("s_suppkey % 2 = 0"), base.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


@plan("sk02_prune_index", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def _(t):
    return t.documents.select("doc_id").join(t.embeddings.where("label < 5").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")


@plan("sk03_append_new", "SELECT DISTINCT o_custkey FROM orders")
def _(t):
    keys = t.orders.select("o_custkey")
    return R.append_new(keys.where("o_orderkey % 2 = 0" if "o_orderkey" in keys.columns else "true").distinct(), keys, ["o_custkey"])


@plan("sk04_sorted_rows", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", "s_name").orderBy("s_name")


@plan("pr01_first_filled", "SELECT s_suppkey, coalesce(nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 1 THEN NULL ELSE ' a ' END), ''), s_name) AS label FROM supplier")
def _(t):
    odd = F.when(F.col("s_suppkey") % 3 == 0, "  ").when(F.col("s_suppkey") % 3 == 1, F.lit(None)).otherwise(" a ")
    return t.supplier.select("s_suppkey", R.first_filled(odd, F.col("s_name")).alias("label"))


@plan("pr02_safe_number", "SELECT p_partkey, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(v AS BIGINT) END AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS v FROM part)")
def _(t):
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", R.number_or_null(v).alias("n"))


@plan("pr03_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Running' WHEN 'F' THEN 'Final' ELSE 'Unknown' END AS label FROM orders")
def _(t):
    return t.orders.select("o_orderkey", R.labelled(F.col("o_orderstatus"), {"O": "Running", "F": "Final"}, "Unknown").alias("label"))


@plan("pr04_documents", "SELECT s_suppkey, concat_ws(chr(10), 'Name: ' || s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Nation: ' || n_name END, 'Region: ' || r_name) AS doc FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(t):
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    nation = F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise("  ")
    return rows.select("s_suppkey", R.assembled(("Name", F.col("s_name")), ("Nation", nation), ("Region", F.col("r_name"))).alias("doc"))


@plan("pr05_match_documents", "SELECT s_suppkey, concat_ws(' ', s_name, n_name, r_name) AS doc FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(t):
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("s_suppkey", F.concat_ws(" ", "s_name", "n_name", "r_name").alias("doc"))


EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]


@plan("pr06_pivot_facts", "SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in EVENT_TYPES) + " FROM events GROUP BY 1")
def _(t):
    return R.pivoted(t.events, ["user_id"], "event_type", "value", EVENT_TYPES)


@plan("pr07_object_aggregate", "SELECT user_id, string_agg(event_type || '=' || printf('%.2f', value), ';' ORDER BY event_type) AS facts FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def _(t):
    now = R.latest_value(t.events, ["user_id", "event_type"], ["value"], ["ts", "event_id"])
    facts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "value"))))
    return now.groupBy("user_id").agg(facts.alias("m")).select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ";").alias("facts"))


@plan("pr08_newest_edit", "SELECT s_suppkey, coalesce(e.event_type, s_name) AS s_name FROM supplier LEFT JOIN (SELECT user_id, event_type FROM events WHERE event_type IN ('signup', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON user_id = s_suppkey")
def _(t):
    edits = t.events.where(F.col("event_type").isin("signup", "purchase")).select(F.col("user_id").alias("s_suppkey"), F.lit("s_name").alias("field"), F.col("event_type").alias("value"), "ts", "event_id")
    return R.overlay(t.supplier.select("s_suppkey", "s_name"), edits, "s_suppkey", "field", "value", ["ts", "event_id"], ["s_name"])


@plan("pr09_payload_merge", "SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(t):
    rows = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", R.first_filled("s_name", "c_name").alias("name"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("none")).alias("segment"))


@plan("pr10_split_join", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ; ' || p_brand, ';'), lambda x: trim(x)), '|') AS parts FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.transform(F.split(F.concat_ws(" ; ", "p_name", "p_brand"), ";"), lambda x: F.trim(x)), "|").alias("parts"))


@plan("pr11_code_or_label", "SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN nation ON lower(replace(n_name, ' ', '')) = lower(replace(CASE WHEN s_suppkey % 2 = 0 THEN ' nation_' || s_nationkey ELSE 'Nation _x' END, ' ', ''))")
def _(t):
    typed = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" nation_"), F.col("s_nationkey").cast("string"))).otherwise("Nation _x")
    key = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    return t.supplier.withColumn("k", key(typed)).join(t.nation.withColumn("k", key(F.col("n_name"))), "k", "left").select("s_suppkey", "n_nationkey")


@plan("pr12_numbered_context", "SELECT conv_id, string_agg('[' || n || '] ' || role || ': ' || text, chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("n", F.row_number().over(w))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("s")))).alias("l")).select("conv_id", F.array_join("l.s", "\n").alias("context"))


# filters


@plan("fi01_actor_facets", "SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 2) AND s_acctbal >= 1000 AND (contains(lower(s_name), '9') OR contains(lower(n_name), '9'))")
def _(t):
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return R.facet_filter(rows, one_of={"n_regionkey": [1, 2], "n_name": []}, at_least={"s_acctbal": 1000}, text=(["s_name", "n_name"], "9")).select("s_suppkey")


@plan("fi02_event_filter", "SELECT event_id FROM events WHERE event_type LIKE '%ur%' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(t):
    return R.facet_filter(t.events, holds={"event_type": "UR"}).where("ts >= timestamp_ntz '2024-01-10' AND ts < timestamp_ntz '2024-01-20'").select("event_id")


@plan("fi03_people_filter", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'house'))")
def _(t):
    rows = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return rows.where(F.contains(F.lower("c_name"), F.lit("7")) | F.contains(F.lower("c_mktsegment"), F.lit("house"))).select("c_custkey")


@plan("fi04_live_or_other", "SELECT doc_id FROM documents WHERE lang <> 'en' OR EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def _(t):
    live = t.labels.where("quality = 1").select("doc_id").distinct().withColumn("live", F.lit(True))
    return t.documents.select("doc_id", "lang").join(live, "doc_id", "left").where("lang <> 'en' OR live").select("doc_id")


@plan("fi05_safe_select", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment LIMIT 200")
def _(t):
    from ..operators.guard import safe_select

    for name in ("orders", "customer"):
        getattr(t, name).createOrReplaceTempView(name)
    return safe_select(t.spark, "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", cap=200)


@plan("fi06_any_name_search", "SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%') AND p_size > 10 ORDER BY p_name, p_partkey LIMIT 50")
def _(t):
    rows = t.part.where(F.col("p_name").ilike("%ring%") | F.col("p_brand").ilike("%ring%") | F.col("p_type").ilike("%ring%")).where("p_size > 10").select("p_partkey", "p_name")
    return R.with_total(rows, [F.col("p_name"), F.col("p_partkey")], 50)


HOST_SQL = "split_part(split_part(url, '://', 2), '/', 1)"


@plan("fi11_domain_suffix", f"WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), d AS (SELECT DISTINCT host AS domain FROM h WHERE page_id < 40) SELECT DISTINCT page_id FROM h, d WHERE host = domain OR ends_with(host, '.' || domain)")
def _(t):
    hosts = t.pages.withColumn("host", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))).select("page_id", "host")
    return R.on_domains(hosts, "host", hosts.where("page_id < 40").withColumnRenamed("host", "domain"), "domain").select("page_id")


@plan(
    "fi13_request_scope",
    """SELECT o_orderkey, CASE WHEN d < DATE '1993-06-01' THEN 'before' WHEN d > DATE '1997-06-30' THEN 'after' WHEN trim(state) <> '' AND upper(trim(state)) NOT IN ('TX', 'NY') AND form IS DISTINCT FROM 'online' THEN 'elsewhere' END AS outside FROM (
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d, ['tx', ' NY ', 'CA', '', NULL][c_nationkey % 5 + 1] AS state, CASE c_mktsegment WHEN 'BUILDING' THEN 'online' WHEN 'MACHINERY' THEN NULL ELSE 'on site' END AS form FROM orders JOIN customer ON c_custkey = o_custkey)""",
)
def _(t):
    state = F.element_at(F.array(*map(F.lit, ["tx", " NY ", "CA", "", None])), (F.col("c_nationkey") % 5 + 1).cast("int"))
    form = F.when(F.col("c_mktsegment") == "BUILDING", "online").when(F.col("c_mktsegment") != "MACHINERY", "on site")
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    day = lambda d: F.lit(d).cast("date")
    return rows.select("o_orderkey", X.event_scope(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")), state, form, day("1993-06-01"), day("1997-06-30"), ["TX", "NY"]).alias("outside"))


@plan(
    "fi13_person_scope",
    """WITH p AS (SELECT p_partkey, 'University of ' || p_name AS asked, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' State University' WHEN 2 THEN 'The university of ' || p_name || ', ' || p_type WHEN 3 THEN 'University of ' || p_type WHEN 4 THEN upper(p_name) || ' University' ELSE ' ' END AS stated FROM part),
    w AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'inc', 'llc', 'ltd'))) AS a, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(stated, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'inc', 'llc', 'ltd'))) AS s FROM p)
    SELECT p_partkey, coalesce(trim(stated), '') <> '' AND (NOT list_has_all(s, a) OR len(list_filter(s, lambda x: NOT list_contains(a, x) AND x IN ('state', 'tech', 'technology', 'institute', 'college', 'medical'))) > 0) AS outside FROM w""",
)
def _(t):
    k, university = F.col("p_size") % 6, lambda *c: F.concat(*[F.lit(x) if x[:2] != "p_" else F.col(x) for x in c])
    stated = F.when(k == 1, university("p_name", " State University")).when(k == 2, university("The university of ", "p_name", ", ", "p_type")).when(k == 3, university("University of ", "p_type")).when(k == 4, F.concat(F.upper("p_name"), F.lit(" University"))).when(k == 5, " ")
    return t.part.select("p_partkey", X.person_scope(stated, university("University of ", "p_name")).alias("outside"))


@plan("fi14_relevance_floor", "SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL ELSE k < 30 END AS below FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    score = F.when(k % 5 != 0, k)
    return t.events.select("event_id", F.when(score.isNotNull(), score < 30).alias("below"))


@plan("fi15_sector_match", "SELECT l_suppkey, array_to_string(list_sort(list_filter(list_distinct(list(p_brand)), lambda b: b IN ('Brand#1', 'Brand#2'))), ',') AS codes, count(*) FILTER (WHERE p_brand IN ('Brand#1', 'Brand#2')) > 0 AS in_sector FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    codes = F.array_sort(F.array_intersect(F.collect_set("p_brand"), F.array(F.lit("Brand#1"), F.lit("Brand#2"))))
    return rows.groupBy("l_suppkey").agg(codes.alias("c")).select("l_suppkey", F.array_join("c", ",").alias("codes"), (F.size("c") > 0).alias("in_sector"))


CELL = "CASE WHEN o_totalprice < 50000 THEN ' =' || o_orderpriority WHEN o_totalprice < 80000 THEN '@' || o_orderstatus WHEN o_totalprice < 90000 THEN '-' || o_custkey WHEN o_totalprice < 100000 THEN NULL ELSE o_orderpriority || '=' END"


@plan("fi17_formula_cells", f"SELECT o_orderkey, c AS cell FROM (SELECT o_orderkey, {CELL} AS c FROM orders) WHERE regexp_matches(ltrim(c), '^[=+@-]')")
def _(t):
    from ..functions.text import formula_like

    cells = t.orders.select("o_orderkey", F.expr(CELL.replace("o_custkey", "CAST(o_custkey AS STRING)")).alias("cell"))
    return cells.where(formula_like(F.col("cell")))


@plan("fi18_review_list", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup') AND CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20 AND CAST(user_id AS VARCHAR) LIKE '1%'")
def _(t):
    return t.events.where(F.col("event_type").isin("error", "signup") & F.get_json_object("props", "$.k").cast("bigint").between(10, 20) & F.col("user_id").cast("string").startswith("1")).select("event_id")


@plan("fi19_month_window", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-15' AND DATE '1997-06-15' + INTERVAL 6 MONTH")
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.where(day.between(F.lit("1997-06-15").cast("date"), F.add_months(F.lit("1997-06-15").cast("date"), 6))).select("o_orderkey")


@plan("fi21_sparse_records", "SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR trim(c_mktsegment) = '') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    done = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    linked = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_acctbal < 0 OR trim(c_mktsegment) = ''").select("c_custkey").join(done, "c_custkey", "left_anti").join(linked, "c_custkey", "left_semi")


# joins


@plan("jn01_star", "SELECT l_orderkey, l_linenumber, p_brand, s_name, n_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey WHERE l_shipdate >= TIMESTAMP '2001-06-01'")
def _(t):
    facts = t.lineitem.where("l_shipdate >= timestamp_ntz '2001-06-01'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (
        facts.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name")
    )


@plan("jn02_bridge_text", "SELECT l_partkey, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS sellers FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def _(t):
    links = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    return R.grouped_text(links, ["l_partkey"], "s_name", name="sellers")


@plan("jn03_lateral_latest", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def _(t):
    last = R.latest_value(t.orders, ["o_custkey"], ["o_orderkey", "o_totalprice"], ["o_orderdate", "o_orderkey"])
    return t.customer.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@plan("jn04_correlated_scalar", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS members, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS richest FROM nation")
def _(t):
    t.nation.createOrReplaceTempView("nation")
    t.supplier.createOrReplaceTempView("supplier")
    return t.spark.sql("SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS members, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS richest FROM nation")


@plan("jn05_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    wanted = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")).unionAll(t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))
    return t.customer.select("c_custkey").join(wanted, "c_custkey", "left_semi")


@plan("jn06_anti", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = e.event_type AND n.ts > e.ts)")
def _(t):
    newest = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return t.events.join(newest, ["user_id", "event_type", "ts"], "left_semi").select("event_id")


@plan("jn07_polymorphic", "SELECT event_id, coalesce(c_name, s_name, p_name) AS subject FROM events LEFT JOIN customer ON event_type IN ('view', 'click') AND c_custkey = user_id LEFT JOIN supplier ON event_type = 'signup' AND s_suppkey = user_id LEFT JOIN part ON event_type IN ('purchase', 'error') AND p_partkey = user_id")
def _(t):
    tag = F.col("event_type")
    rows = t.events.withColumn("ck", F.when(tag.isin("view", "click"), F.col("user_id"))).withColumn("sk", F.when(tag == "signup", F.col("user_id"))).withColumn("pk", F.when(tag.isin("purchase", "error"), F.col("user_id")))
    rows = rows.join(t.customer, F.col("ck") == F.col("c_custkey"), "left").join(t.supplier, F.col("sk") == F.col("s_suppkey"), "left").join(t.part, F.col("pk") == F.col("p_partkey"), "left")
    return rows.select("event_id", F.coalesce("c_name", "s_name", "p_name").alias("subject"))


EDGES = "(SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 0)"


def edges(t):
    return t.supplier.where("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 2").alias("parent"))


@plan("jn08_both_ends", f"SELECT child AS node, parent AS other, true AS outgoing FROM {EDGES} UNION ALL SELECT parent, child, false FROM {EDGES}")
def _(t):
    return R.neighbours(edges(t), "child", "parent")


@plan("jn09_either_role", "SELECT DISTINCT c_custkey, event_id FROM customer JOIN events ON event_id = c_custkey OR user_id = c_custkey")
def _(t):
    return R.either_match(t.customer.select("c_custkey"), t.events.select("event_id", "user_id"), [("c_custkey", "event_id"), ("c_custkey", "user_id")]).select("c_custkey", "event_id").distinct()


@plan("jn10_grid_counts", "SELECT n_name, seg AS segment, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = seg GROUP BY 1, 2")
def _(t):
    # the grid is filled from the sets of both edges, each a small dimension; facts are counted before they meet it
    counted = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("n"))
    segments = t.customer.agg(F.collect_set("c_mktsegment").alias("segments"))
    grid = t.nation.join(F.broadcast(segments), F.lit(True)).select("n_nationkey", "n_name", F.explode("segments").alias("segment"))
    return grid.join(counted, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_mktsegment") == F.col("segment")), "left").select("n_name", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@plan("jn15_interval_pairs", "SELECT a.event_id AS press, b.event_id AS run FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 30 MINUTE")
def _(t):
    press = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("pressed"), F.col("event_id").alias("press"))
    run = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("ran"), F.col("event_id").alias("run"))
    return R.proximity_join(press, run, ["user_id"], "pressed", "ran", "60 seconds", "30 minutes").select("press", "run")


@plan("jn16_forward_asof", "SELECT a.event_id, (SELECT min(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts) AS started FROM events a WHERE a.event_type = 'signup'")
def _(t):
    asked = t.events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    runs = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("started"))
    return R.asof_forward(asked, runs, ["user_id"], "ts", "started", []).select("event_id", "started")


@plan("jn17_date_proximity", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'signup' AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 7")
def _(t):
    day = t.events.withColumn("day", F.to_date("ts").cast("timestamp_ntz"))
    a = day.where("event_type = 'purchase'").select("user_id", F.col("day").alias("da"), F.col("event_id").alias("a"))
    b = day.where("event_type = 'signup'").select("user_id", F.col("day").alias("db"), F.col("event_id").alias("b"))
    return R.proximity_join(a, b, ["user_id"], "da", "db", "7 days", "7 days").select("a", "b")


@plan("jn18_json_contains", "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 7}')")
def _(t):
    return t.events.where(F.exists(F.array(F.from_json("props", "k bigint")), lambda x: x.k == 7)).select("event_id")


@plan("jn19_fallback_join", "SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, a.s_suppkey IS NOT NULL AS by_id FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN supplier b ON b.s_name = replace(c_name, 'Customer', 'Supplier')")
def _(t):
    by_id = t.supplier.select(F.col("s_suppkey").alias("a"))
    by_name = t.supplier.select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("n"))
    rows = t.customer.join(by_id, F.col("a") == F.col("c_custkey"), "left").join(by_name, F.col("n") == F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), "left")
    return rows.select("c_custkey", F.coalesce("a", "b").alias("s_suppkey"), F.col("a").isNotNull().alias("by_id"))


@plan(
    "jn20_survivor_chain",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 7 = 3 THEN s_suppkey ELSE s_suppkey // 2 END AS target FROM supplier),
    w AS (SELECT node, node AS place, 0 AS n FROM e UNION ALL SELECT w.node, e.target, n + 1 FROM w JOIN e ON e.node = w.place WHERE e.target IS NOT NULL AND n <= 10)
    SELECT w.node, max(CASE WHEN e.target IS NULL THEN w.place END) AS survivor FROM w JOIN e ON e.node = w.place WHERE w.n <= 10 GROUP BY w.node""",
)
def _(t):
    target = F.when(F.col("s_suppkey") == 0, F.lit(None)).when(F.col("s_suppkey") % 7 == 3, F.col("s_suppkey")).otherwise(F.expr("s_suppkey div 2"))
    return R.follow(t.supplier.select(F.col("s_suppkey").alias("node"), target.cast("bigint").alias("target")), "node", "target")


# aggregates


@plan("ag01_spend_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS initiator, count(*) AS runs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def ag01(t):
    rows = t.orders.where("o_orderstatus <> 'P'").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_mktsegment").alias("initiator")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@plan(
    "ag02_multi_summary",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS feature, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus <> 'F'), 0) AS BIGINT) AS open_cents FROM orders GROUP BY GROUPING SETS ((), (1), (2), (1, 2))",
)
def _(t):
    t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("feature"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), (F.col("o_orderstatus") != "F").alias("open")).createOrReplaceTempView("spend")
    return t.spark.sql("SELECT month, feature, count(*) AS n, sum(cents) AS cents, coalesce(sum(cents) FILTER (WHERE open), 0L) AS open_cents FROM spend GROUP BY GROUPING SETS ((), (month), (feature), (month, feature))")


@plan("ag03_reconcile", "SELECT CAST(sum(c) AS BIGINT) AS total, CAST(sum(c) FILTER (WHERE k) AS BIGINT) AS attributed, CAST(sum(c) FILTER (WHERE NOT k) AS BIGINT) AS unattributed, CAST(sum(c) - sum(c) FILTER (WHERE k) - sum(c) FILTER (WHERE NOT k) AS BIGINT) AS difference FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS c, c_custkey IS NOT NULL AS k FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)")
def _(t):
    from ..operators.ledger import reconcile

    owners = t.customer.where("c_acctbal > 0").select("c_custkey")
    rows = t.orders.join(owners, F.col("c_custkey") == F.col("o_custkey"), "left")
    return reconcile(rows.select(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cost"), F.col("c_custkey").alias("owner")), "cost", "owner")


@plan("ag04_group_projection", "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE event_type = 'error') AS pending, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("pending"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@plan("ag05_facet_counts", "SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events WHERE user_id < 20 GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events WHERE event_type = 'error' GROUP BY 2")
def _(t):
    return R.facet_counts(t.events, {"type": F.col("event_type"), "user": F.col("user_id")}, {"type": F.col("event_type") == "error", "user": F.col("user_id") < 20})


@plan("ag06_filter_options", "SELECT p_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS position FROM part GROUP BY 1")
def _(t):
    counted = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "p_type")))


@plan("ag07_date_bounds", "SELECT min(ts) AS low, max(ts) AS high FROM events")
def _(t):
    return t.events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))


@plan("ag08_evidence_by_source", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS keys, max(ts) AS newest, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 12")
def _(t):
    rows = t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("keys"), F.max("ts").alias("newest"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "user_id").limit(12)


@plan("ag09_conditional_distinct", "SELECT l_returnflag, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_suppkey END) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("n"))


@plan("ag10_boolean", "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_final, bool_or(o_orderstatus = 'P') AS any_partial FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_final"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_partial"))


@plan("ag11_distributions_equal", "SELECT count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) = 0 AS same, count(*) AS keys FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").agg((F.count_if(~F.col("a").eqNullSafe(F.col("b"))) == 0).alias("same"), F.count(F.lit(1)).alias("keys"))


@plan("ag12_loss_audit", "SELECT 'orders with customer' AS check_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) AS destination_rows UNION ALL SELECT 'lines with part', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem JOIN part ON p_partkey = l_partkey)")
def _(t):
    def check(name, left, right, key, other):
        rows = left.join(right.select(other), F.col(key) == F.col(other), "left")
        return rows.agg(F.count(F.lit(1)).alias("source_rows"), F.count(other).alias("destination_rows")).select(F.lit(name).alias("check_name"), "source_rows", "destination_rows")

    return check("orders with customer", t.orders, t.customer, "o_custkey", "c_custkey").unionAll(check("lines with part", t.lineitem, t.part, "l_partkey", "p_partkey"))


@plan("ag13_duplicate_keys", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@plan("ag14_outcome_counts", "SELECT CAST(ts AS DATE) AS run, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(F.to_date("ts").alias("run"), F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@plan("ag15_run_metrics", "SELECT o_orderpriority AS mode, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'P') AS useful, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS BIGINT) AS cents_per_useful FROM orders GROUP BY 1")
def _(t):
    useful = F.count_if(F.col("o_orderstatus") == "P")
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("mode")).agg(F.count(F.lit(1)).alias("runs"), useful.alias("useful"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c"))
    return rows.select("mode", "runs", "useful", F.expr("c div nullif(useful, 0)").alias("cents_per_useful"))


@plan("ag16_dominant_value", "SELECT n_name, c_mktsegment AS dominant, n FROM (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY n DESC, c_mktsegment) = 1")
def _(t):
    mix = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return R.latest(mix, ["n_name"], [F.desc("n"), F.col("c_mktsegment")]).select("n_name", F.col("c_mktsegment").alias("dominant"), "n")


@plan("ag17_additive_counters", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(t):
    count = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return count(t.events.where("event_id % 2 = 0")).unionAll(count(t.events.where("event_id % 2 = 1"))).groupBy("user_id").agg(F.sum("n").alias("n"))


@plan("ag18_score_summary", "SELECT event_type, count(*) AS n, CAST(round(avg(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS mean_cents, median(CAST(round(value * 100) AS BIGINT)) AS median_cents, count(*) FILTER (WHERE value > 50) AS above FROM events GROUP BY 1")
def _(t):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cents)).cast("bigint").alias("mean_cents"), F.median(cents).alias("median_cents"), F.count_if(F.col("value") > 50).alias("above"))


@plan("ag19_reserved_or_actual", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 500 ELSE CAST(round(o_totalprice) AS BIGINT) END) AS BIGINT) AS spent FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus").isin("O", "P"), F.lit(500)).otherwise(F.round("o_totalprice").cast("bigint"))).cast("bigint").alias("spent"))


@plan("ag20_completeness", "SELECT c_custkey, CAST((c_acctbal > 0)::INT + (c_mktsegment = 'BUILDING')::INT + 1 AS INTEGER) AS filled FROM customer")
def _(t):
    from ..operators.entity import completeness

    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).alias("b"))
    return rows.select("c_custkey", completeness(["c_name", "a", "b"]).alias("filled"))


@plan("ag21_reference_counts", "SELECT key, count(*) AS n FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT user_id FROM events UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1")
def _(t):
    children = t.orders.select(F.col("o_custkey").alias("key")).unionAll(t.events.select("user_id")).unionAll(t.lineitem.select("l_suppkey"))
    return children.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@plan("ag22_group_concat", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"))


# windows


@plan("wi01_latest_fact", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return R.latest_value(t.events, ["user_id", "event_type"], ["event_id", "value"], ["ts", "event_id"])


@plan("wi02_top_n", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 25")
def _(t):
    return R.top_n(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 25).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@plan("wi03_top_runs_of_union", "SELECT key, id, kind FROM (SELECT o_custkey AS key, o_orderkey AS id, 'order' AS kind, o_orderdate AS happened FROM orders UNION ALL SELECT user_id, event_id, 'event', ts FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY happened DESC, kind, id) <= 3")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at")).unionAll(t.events.select("user_id", "event_id", F.lit("event"), "ts"))
    return R.top_n(rows, ["key"], [F.desc("at"), F.col("kind"), F.col("id")], 3).select("key", "id", "kind")


@plan("wi04_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, ts FROM events WHERE event_type <> 'error' ORDER BY user_id, ts DESC, event_id DESC")
def _(t):
    return R.latest_value(t.events.where("event_type <> 'error'"), ["user_id"], ["event_id", "ts"], ["ts", "event_id"])


@plan("wi05_page_with_total", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def _(t):
    return R.with_total(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), [F.col("o_orderkey")], 20, 10)


@plan("wi07_renumbered", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS position FROM events WHERE event_type = 'purchase'")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.where("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(w).alias("position"))


@plan("wi08_first_occurrence", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS repeated FROM documents")
def _(t):
    keyed = t.documents.select("doc_id", F.md5("text").alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("first_id"))
    return keyed.join(first, "k").select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("repeated"))


@plan("wi09_latest_earlier", "SELECT o_orderkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).over(w).alias("earlier"))


@plan("wi10_running_ceiling", "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) OVER w AS BIGINT) AS running, sum(CAST(round(o_totalprice) AS BIGINT)) OVER w > 1000000 AS stopped FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.round("o_totalprice").cast("bigint")).over(w)
    return t.orders.select("o_orderkey", running.alias("running")).withColumn("stopped", F.col("running") > 1000000)


# order and limits


@plan("tk04_prefix_first", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' ORDER BY (p_name ILIKE 're%') DESC, length(p_name), p_name, p_partkey LIMIT 40")
def _(t):
    return t.part.where(F.col("p_name").ilike("%re%")).select("p_partkey", "p_name").orderBy(F.col("p_name").ilike("re%").desc(), F.length("p_name"), "p_name", "p_partkey").limit(40)


@plan("tk05_capped_per_run", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, event_id) > 5 THEN 'capped' ELSE event_type END AS state FROM events")
def _(t):
    from ..operators.scoring import capped

    return capped(t.events, ["user_id"], [(F.col("event_type") == "purchase").desc(), F.desc("value"), F.col("event_id")], 5, "event_type").select("event_id", F.col("event_type").alias("state"))


@plan("tk07_rerank_groups", "SELECT user_id, event_id, (rn - 1) // 10 AS batch FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 40")
def _(t):
    return R.top_n(t.events, ["user_id"], [F.desc("value"), F.col("event_id")], 40, "rn").select("user_id", "event_id", F.expr("(cast(rn as bigint) - 1) div 10").alias("batch"))


@plan("tk08_listing_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN epoch_us(o_orderdate) ELSE -epoch_us(o_orderdate) END, o_orderkey) AS INTEGER) AS position FROM orders")
def _(t):
    coming = F.col("o_orderdate") >= F.expr("timestamp_ntz '1998-01-01'")
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    w = Window.partitionBy("o_custkey").orderBy(F.when(coming, 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2), F.when(coming, micros).otherwise(-micros), "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("position"))


@plan("tk09_limit_labels", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN rn > 8 THEN 'beyond limit' ELSE 'kept' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY value DESC, event_id) AS rn FROM events)")
def _(t):
    w = Window.partitionBy("user_id", F.col("event_type") == "error").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("rn", F.row_number().over(w)).select("event_id", F.when(F.col("event_type") == "error", "error").when(F.col("rn") > 8, "beyond limit").otherwise("kept").alias("label"))


@plan("tk10_gap_first", "SELECT c_custkey FROM customer LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1) ON user_id = c_custkey ORDER BY c_acctbal < 0, coalesce(k, 0), c_name LIMIT 100")
def _(t):
    held = t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("k"))
    rows = t.customer.join(held, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.orderBy(F.col("c_acctbal") < 0, F.coalesce("k", F.lit(0)), "c_name").limit(100).select("c_custkey")


@plan("tk11_best_per_domain", "SELECT page_id, first_value(page_id) OVER w AS kept_id FROM (SELECT page_id, array_to_string(string_split(split_part(split_part(url, '://', 2), '/', 1), '.')[-3:], '.') AS domain, length(html) AS score FROM pages) WINDOW w AS (PARTITION BY domain ORDER BY score DESC, page_id)")
def _(t):
    labels = F.split(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)), r"\.")
    domain = F.array_join(F.when(F.size(labels) > 3, F.slice(labels, -3, 3)).otherwise(labels), ".")
    rows = t.pages.select("page_id", domain.alias("domain"), F.length("html").alias("score"))
    best = rows.groupBy("domain").agg(F.max(F.struct("score", (-F.col("page_id")).alias("m"), "page_id")).alias("b"))
    return rows.join(best, "domain").select("page_id", F.col("b.page_id").alias("kept_id"))


@plan(
    "tk12_accepted_domains",
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN page_id % 4 END AS fit, page_id % 5 > 0 AS accepted, string_split(split_part(split_part(url, '://', 2), '/', 1), '.') AS l FROM pages),
    d AS (SELECT *, CASE WHEN NOT accepted THEN NULL WHEN len(l) > 2 AND length(l[-1]) = 2 AND list_contains(['ac', 'co', 'com', 'edu', 'gov', 'net', 'org'], l[-2]) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM p)
    SELECT page_id, CASE WHEN NOT accepted THEN 'rejected' WHEN domain IS NULL OR first_value(page_id) OVER w = page_id THEN 'accepted' ELSE 'duplicate' END AS state, CASE WHEN domain IS NOT NULL AND first_value(page_id) OVER w <> page_id THEN first_value(page_id) OVER w END AS duplicate_of
    FROM d WINDOW w AS (PARTITION BY domain ORDER BY coalesce(fit, -1) DESC, page_id)""",
)
def _(t):
    rows = t.pages.select("page_id", "url", F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 4).alias("fit"), F.when(F.col("page_id") % 5 > 0, "accepted").otherwise("rejected").alias("state"))
    return R.one_per_domain(rows, "page_id", U.registrable(F.col("url")), "fit", "state").select("page_id", "state", "duplicate_of")


@plan("tk13_first_seen_cap", "SELECT url, first_id, CASE WHEN rn <= 200 THEN 'kept' ELSE 'capped' END AS state FROM (SELECT url, min(page_id) AS first_id, row_number() OVER (ORDER BY min(page_id)) AS rn FROM pages GROUP BY 1)")
def _(t):
    seen = t.pages.groupBy("url").agg(F.min("page_id").alias("first_id"))
    top = seen.orderBy("first_id").limit(200).select("url", F.lit(True).alias("in"))
    return seen.join(F.broadcast(top), "url", "left").select("url", "first_id", F.when(F.col("in"), "kept").otherwise("capped").alias("state"))


# sets


@plan("se01_union_all", "SELECT event_id AS id, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, 'order' FROM orders")
def _(t):
    return t.events.select(F.col("event_id").alias("id"), F.lit("event").alias("kind")).unionByName(t.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind")))


@plan("se02_union_distinct", "SELECT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT s_suppkey, 'Brand#' || s_nationkey FROM supplier")
def _(t):
    direct = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand")
    return direct.union(t.supplier.select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")))).distinct()


@plan("se03_to_discover", "SELECT DISTINCT lower(trim(c_name)) AS key FROM customer WHERE lower(trim(c_name)) NOT IN (SELECT lower(trim(replace(s_name, 'Supplier', 'Customer'))) FROM supplier)")
def _(t):
    held = t.supplier.select(F.lower(F.trim(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))).alias("key"))
    return t.customer.select(F.lower(F.trim("c_name")).alias("key")).distinct().join(held, "key", "left_anti")


@plan("se04_array_sets", "SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'ring', 'small'] AS b FROM part)")
def _(t):
    a, b = F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("small"))
    return t.part.select("p_partkey", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))


@plan("se05_dedup_by_url", "SELECT split_part(split_part(url, '?', 1), '#', 1) AS key, min(page_id) AS page_id, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS queries FROM pages GROUP BY 1")
def _(t):
    key = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return t.pages.groupBy(key.alias("key")).agg(F.min("page_id").alias("page_id"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("queries"))


@plan("se06_without_repeats", "SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, line, row_number() OVER (PARTITION BY source, lower(line) ORDER BY doc_id, i) AS rn FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE rn = 1 GROUP BY 1")
def _(t):
    lines = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    # the first place of a line is a minimum, summed up before the shuffle, so a line on every page is no hot group
    first = lines.groupBy("source", F.md5(F.lower("line")).alias("k")).agg(F.min(F.struct("doc_id", "i")).alias("at"))
    kept = lines.join(first.select("at.doc_id", "at.i"), ["doc_id", "i"], "left_semi")
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l")).select("doc_id", F.array_join("l.line", "\n").alias("text"))


@plan("se07_difference_with_reason", "SELECT c_custkey, 'no urgent order' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.difference(t.customer.select("c_custkey"), urgent, ["c_custkey"], "no urgent order")


