"""Line dedup: site-relative frequency.

For each host, the pages that hold a line are divided by the pages of the host, and lines above the boilerplate ratio are
dropped. A line of one page alone repeats nowhere and stays, however few pages its host has. Lines are counted by digest with map-side combine, so a hot host or a line on every page is summed before the
shuffle. A line above the ratio r is on a share r of its host's pages at least, so a host with L lines a page has at most L / r
such lines: the digests of a host fit one row. Those rows are joined back to the pages, by broadcast if their measured
size is small and else by a join salted so that a hot host is spread; no page text is ever shuffled by host.

Defined cases: null text stays null, and counts as a page without lines; a null host is a host of its own, apart from the empty one; blank lines are neither counted nor dropped; a line
repeated within a page counts once; lines compare without the white space around them; a page whose every line goes keeps
an empty text; an empty table gives an empty result; columns of the input are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .common import table, written

#: A line on more than this share of its host's pages is boilerplate.
MAX_RATIO = 0.05
#: Boilerplate digests are broadcast up to this number in all (32 characters each), and joined by salted shuffle beyond.
BROADCAST_LINES = 1_000_000
SALTS = 32
_SPACE = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def _digest(key: Column) -> Column:
    """The first 16 bytes of SHA-1 in hex: strings, which the array functions put into hash sets."""
    return F.substring(F.sha1(key), 1, 32)


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO) -> DataFrame:
    """host, lines (array of digests): the lines of each host above the ratio."""
    pages = docs.select(host.alias("host"), text.alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "_of")
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _key), lambda k: k != ""))
    lines = pages.select("host", F.explode(keys).alias("key")).select("host", F.unhex(_digest(F.col("key"))).alias("line"))  # half the bytes to shuffle
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        often.join(totals, F.col("host").eqNullSafe(F.col("_of")))
        .where(F.col("n") > max_ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list(F.lower(F.hex("line"))).alias("lines"))
    )


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with the boilerplate lines taken out of text_col; two more columns, _lines_in and _lines_out, count lines, in place of columns of these names."""
    found = written(boilerplate(docs, F.col(host_col), F.col(text_col), max_ratio), "boilerplate")
    n = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # names of the input stand inside and meet none of this operator's
    host, text = F.col("row").getField(host_col), F.col("row").getField(text_col)
    same = host.eqNullSafe(F.col("of_host"))
    found = found.select(F.col("host").alias("of_host"), F.col("lines").alias("known"))
    if n <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(found), same, "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, same & (F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int") == F.col("salt")), "left")
    lines = F.split(text, "\n")
    digests = F.transform(lines, lambda x: _digest(_key(x)))
    # the page's own boilerplate first, by hash set: a page costs its lines and its host's list, not their product
    known = joined.select("row", F.when(F.col("known").isNotNull() & text.isNotNull(), F.array_intersect(digests, "known")).alias("hits"))
    cut = F.coalesce(F.size("hits"), F.lit(0)) > 0
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("hits"), _digest(_key(x))))
    told = known.select("row", F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("lines_in"), F.when(cut, kept).alias("kept"))
    out = [F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_lines_in", "_lines_out")]
    return told.select(*out, F.col("lines_in").alias("_lines_in"), F.when(F.col("kept").isNotNull(), F.size("kept")).otherwise(F.col("lines_in")).cast("bigint").alias("_lines_out"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spread(table(spark, sf_dir, "documents"), "doc_id")).select(
        "doc_id", "text", F.col("_lines_in").alias("n_lines"), (F.col("_lines_in") - F.col("_lines_out")).alias("n_dropped")
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, source AS host, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
h AS (SELECT source AS host, count(*) AS pages FROM documents GROUP BY 1),
b AS (
  SELECT x.host, x.key FROM (SELECT host, key, count(DISTINCT doc_id) AS n FROM l WHERE key <> '' GROUP BY 1, 2) x JOIN h ON h.host IS NOT DISTINCT FROM x.host
  WHERE n > 1 AND n > 0.05 * pages
),
k AS (SELECT l.doc_id, i, line, b.key IS NULL AS stays FROM l LEFT JOIN b ON b.host IS NOT DISTINCT FROM l.host AND b.key = l.key)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
