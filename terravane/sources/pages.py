"""Raw pages: visible text and listing cards by expressions, so that they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles, noscript and drawings, tags as spaces, white space as one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</(script|style|noscript|svg)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def listing_cards(pages: DataFrame, card: str, fields: dict[str, str], keep: Sequence[str], html: str = "html") -> DataFrame:
    """One row for each match of the card pattern, in page order, with a captured group for each field."""
    cards = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(f"({card})"), F.lit(1))).alias("position", "card"))
    return cards.select(*keep, F.col("position").cast("bigint").alias("position"), *[F.regexp_extract("card", p, 1).alias(f) for f, p in fields.items()])


def completeness(pages: DataFrame, cards: DataFrame, key: str, displayed: str) -> DataFrame:
    """key, cards, displayed, state: complete where a listing gave as many cards as it says it has, partial where fewer, unknown where it says nothing."""
    counted = cards.groupBy(key).agg(F.count(F.lit(1)).alias("cards"))
    joined = pages.select(key, F.col(displayed).alias("displayed")).join(counted, key, "left").withColumn("cards", F.coalesce("cards", F.lit(0)))
    return joined.withColumn("state", F.when(F.col("displayed").isNull(), "unknown").when(F.col("cards") >= F.col("displayed"), "complete").otherwise("partial"))


def cache_hits(searches: DataFrame, query: str, count: str, domains: str, order: Sequence[str]) -> DataFrame:
    """searches with hit: whether the same search was made before, in the order given; the same query in lower case with single spaces, count and set of domains."""
    key = F.lower(F.trim(F.regexp_replace(query, r"[ \n]+", " ")))
    names = F.array_join(F.array_sort(F.array_distinct(F.col(domains))), ",")
    keyed = searches.withColumn("_q", key).withColumn("_d", names)
    first = keyed.groupBy("_q", count, "_d").agg(F.min(F.struct(*order)).alias("_first"))
    joined = keyed.join(first, ["_q", count, "_d"])
    return joined.withColumn("hit", F.struct(*order) != F.col("_first")).drop("_q", "_d", "_first")
