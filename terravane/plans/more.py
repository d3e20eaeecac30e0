"""Plans of the remaining operators: locations, learned matching, evidence rules, cached lookups."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import entity as E
from ..operators import facts as FA
from ..operators import places as P
from ..operators import scoring as S
from ..sources.packages import write_packages
from ..sources.shared import fresh_path
from ..sources.sheets import read_xlsx
from .domain import FOLD_SQL, JACCARD_SQL, PAIRS_SQL, K, ledger, name_pairs, scored
from .registry import plan
from .scalars import CITY_RULE


def workbooks(t):
    """Parts as workbooks of 500 keys each, one sheet a type, best first, with an address for some."""
    site = F.when(F.col("p_size") > 10, F.concat(F.lit("https://www.example.org/"), F.col("p_partkey")))
    rows = t.part.select(F.concat(F.lit("parts-"), F.floor(F.col("p_partkey") / 500)).alias("book"), F.col("p_type").alias("sheet"), "p_partkey", "p_name", "p_retailprice", site.alias("site"))
    path = fresh_path(rows.sparkSession, "workbooks")
    write_packages(rows, "workbook", path, "book", "sheet", [F.desc("p_retailprice"), "p_partkey"])
    return read_xlsx(rows.sparkSession, path)


BOOKS_SQL = "SELECT 'parts-' || (p_partkey // 500) AS book, p_type AS sheet, p_partkey, 1 + row_number() OVER (PARTITION BY p_partkey // 500, p_type ORDER BY p_retailprice DESC, p_partkey) AS line, p_name, CASE WHEN p_size > 10 THEN 'https://www.example.org/' || p_partkey END AS site FROM part"


@plan("sk05_sheets_best_first", f"SELECT book, sheet, p_partkey, CAST(line - 1 AS INTEGER) AS line FROM ({BOOKS_SQL})")
def _(t):
    book = F.regexp_extract("path", "([^/]*)[.]xlsx$", 1)
    return workbooks(t).select(book.alias("book"), "sheet", F.col("values.p_partkey").cast("bigint").alias("p_partkey"), (F.col("row_number") - 1).cast("int").alias("line"))


@plan("sc07_workbook_rows", f"SELECT sheet, line AS row_number, p_name AS name, site, site AS link FROM ({BOOKS_SQL})")
def _(t):
    return workbooks(t).select("sheet", "row_number", F.col("values.p_name").alias("name"), F.col("values.site").alias("site"), F.col("links.site").alias("link"))


@plan("sc13_zipped_gazetteer", "SELECT n_nationkey || '.txt' AS member, 1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_number, c_custkey AS place, c_name AS name, c_acctbal AS latitude FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    rows = t.customer.select(F.concat(F.lit("places-"), F.col("c_nationkey") % 5).alias("book"), F.concat(F.col("c_nationkey"), F.lit(".txt")).alias("sheet"), "c_custkey", "c_name", "c_acctbal")
    path = fresh_path(rows.sparkSession, "gazetteer")
    write_packages(rows, "zipped_lines", path, "book", "sheet", ["c_custkey"])  # an archive for five nations or so, one member each
    lines = rows.sparkSession.read.format("zipped_lines").load(path).where("line_number > 1")
    cells = F.from_csv("line", "place bigint, name string, latitude double", {"sep": "|"})
    return lines.select("member", "line_number", cells.alias("r")).select("member", "line_number", "r.*")


LOCATED = "CASE WHEN s_suppkey % 4 = 0 THEN ' ;' ELSE '' END || 'St. ' || s_name || ';' || CASE WHEN s_nationkey % 3 = 0 THEN '(!)' WHEN s_nationkey % 3 = 1 THEN 'Ft ' || CAST(s_nationkey AS STRING) || ' city' ELSE 'Town ' || CAST(s_nationkey AS STRING) END"


@plan(
    "ge04_locations",
    f"""WITH r AS (SELECT s_suppkey, string_split({LOCATED}, ';') AS l FROM supplier), u AS (SELECT s_suppkey, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS position FROM r),
    c AS (SELECT *, {CITY_RULE} AS city FROM u)
    SELECT s_suppkey, CAST(position AS INTEGER) AS position, nullif(city, '') AS city, coalesce(city <> '' AND position = min(position) FILTER (WHERE city <> '') OVER (PARTITION BY s_suppkey), false) AS is_primary, CASE WHEN city = '' THEN 'no city' END AS failure FROM c""",
)
def _(t):
    return P.prepared_locations(t.supplier.select("s_suppkey", F.split(F.expr(LOCATED), ";").alias("places")), "s_suppkey", "places")


def _(t):
    places = F.array(F.lit("St. Paul"), F.concat(F.lit("Town "), F.col("s_nationkey").cast("string")))
    rows = t.supplier.select("s_suppkey", F.posexplode(places).alias("position", "raw"))
    return rows.select("s_suppkey", "position", P.normalized_city(F.col("raw")).alias("city"), (F.col("position") == 0).alias("is_primary"))


@plan("ge05_derived_state", "SELECT s_suppkey, CASE WHEN n = 1 THEN region END AS state FROM supplier LEFT JOIN (SELECT n_nationkey % 17 AS city, count(DISTINCT n_regionkey) AS n, min(n_regionkey) AS region FROM nation GROUP BY 1) ON city = s_suppkey % 20")
def _(t):
    only = t.nation.groupBy((F.col("n_nationkey") % 17).alias("city")).agg(F.count_distinct("n_regionkey").alias("n"), F.min("n_regionkey").alias("region"))
    return t.supplier.join(only, F.col("s_suppkey") % 20 == F.col("city"), "left").select("s_suppkey", F.when(F.col("n") == 1, F.col("region")).alias("state"))


@plan(
    "cl04_matching",
    """WITH p AS (SELECT DISTINCT c_nationkey AS hub, c_custkey % 7 AS f, c_mktsegment AS m FROM customer), s AS (SELECT hub, mask, count(DISTINCT f) - count(DISTINCT m) AS lack FROM p, (SELECT unnest(range(1, 128)) AS mask) WHERE (mask >> f) & 1 = 1 GROUP BY 1, 2)
    SELECT p.hub, count(DISTINCT f) - greatest(0, max(lack)) AS matched FROM p JOIN (SELECT hub, max(lack) AS lack FROM s GROUP BY 1) d ON d.hub = p.hub GROUP BY 1""",  # families less the greatest lack of categories of any set of them
)
def _(t):
    import pandas as pd

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(frame["c_nationkey"].iloc[0]), P.maximum_matching(frame.groupby("family")["c_mktsegment"].apply(list).to_dict()))], columns=["hub", "matched"])

    pairs = t.customer.select("c_nationkey", (F.col("c_custkey") % 7).cast("string").alias("family"), "c_mktsegment").distinct()
    return pairs.groupBy("c_nationkey").applyInPandas(match, "hub bigint, matched bigint")


@plan("sm05_fold_counts", f"{FOLD_SQL} SELECT outcome, count(*) AS n FROM w GROUP BY 1")
def _(t):
    return FA.fold(ledger(t), ["user_id", "event_type"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


