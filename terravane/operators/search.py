"""Retrieval: postings, TF-IDF cosine, vector top-k, reciprocal rank fusion, excerpts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def terms(value: Column, least: int = 2) -> Column:
    """Lower-case words of letters and digits of at least so many characters."""
    return F.filter(F.split(F.lower(value), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= least)


def postings(docs: DataFrame, key: str, value: str) -> DataFrame:
    """key, term, tf: summed on the map side within a document."""
    return docs.select(key, F.explode(terms(F.col(value))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def keyword_top(docs: DataFrame, key: str, value: str, query: Sequence[str], k: int, total: str = "score") -> DataFrame:
    """The k documents with the greatest sum of (1 + ln tf) * ln(1 + N / df) over the query's terms, ties by key.

    Only rows of the query's terms leave a task: terms are tested inside the document before anything is exploded.
    """
    asked = F.array(*map(F.lit, query))
    own = docs.select(key, F.filter(terms(F.col(value)), lambda w: F.array_contains(asked, w)).alias("ts"))
    found = own.where(F.size("ts") > 0).select(key, F.explode("ts").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    scored = found.join(F.broadcast(weights), "term").groupBy(key).agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf")), 6).alias(total))  # one row a query term
    return scored.orderBy(F.desc(total), key).limit(k)


def vector_top(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int, most: float | None = None, distance: str = "distance") -> DataFrame:
    """The k nearest vectors by cosine distance, ties by key: a scan and a bounded sort, no shuffle of vectors."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(key, F.round(1 - numbers.cosine(F.col(vector), asked), 6).alias(distance))
    return (out if most is None else out.where(F.col(distance) <= most)).orderBy(distance, key).limit(k)


def fused(lists: Sequence[DataFrame], key: str, orders: Sequence[Sequence[Column]], k: int, constant: int = RRF_K) -> DataFrame:
    """key, score, rank_1 ... : reciprocal rank fusion of ranked lists of bounded length; ties by the first list's rank, then the others', then key."""
    out = None
    for i, (own, order) in enumerate(zip(lists, orders), 1):
        ranked = own.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank")).withColumn("list", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked)
    ranks = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(1, len(lists) + 1)]
    scored = out.groupBy(key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), *ranks)
    return scored.orderBy(F.desc("score"), *[F.asc_nulls_last(f"rank_{i}") for i in range(1, len(lists) + 1)], key).limit(k)


def char_grams(value: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word with a space at either end, as an array with repeats."""
    padded = F.transform(T.words(T.plain(value)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[grams(w, n) for n in range(low, high + 1)]))))


def tfidf(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), each document of length one."""
    tf = docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(df, "term").join(F.broadcast(n), F.lit(True)).select(key, "term", ((1 + F.log("tf")) * (1 + F.log((1 + F.col("n")) / (1 + F.col("df"))))).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("l")).alias("weight"))


def shortlist(left: DataFrame, right: DataFrame, key: str, other: str, k: int = 40, least: float = 0.15) -> DataFrame:
    """key, other, cosine, rank: for each left document the k most similar right ones above the bound, from two weight tables."""
    met = left.join(right, "term").groupBy(key, other).agg(F.round(F.sum(F.col("weight") * F.col("weight2")), 6).alias("cosine")).where(F.col("cosine") > least)
    w = Window.partitionBy(key).orderBy(F.desc("cosine"), other)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def excerpt(docs: DataFrame, key: str, value: str, query: Sequence[str], size: int = 700, best: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """The first block of each document and its best blocks by distinct query words, in order; a null text is empty."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(value) / size) - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.col(value), i * size + 1, F.lit(size)))
    asked = F.array(*map(F.lit, query))
    scored = F.transform(blocks, lambda b, i: F.struct((-F.size(F.array_intersect(terms(b), asked))).alias("m"), i.alias("i"), b.alias("b")))
    rest = F.filter(scored, lambda x: (x["i"] > 0) & (x["m"] < 0))
    kept = F.array_sort(F.transform(F.concat(F.slice(scored, 1, 1), F.slice(F.array_sort(rest), 1, best)), lambda x: F.struct(x["i"].alias("i"), x["b"].alias("b"))))
    return docs.select(key, F.array_join(F.transform(kept, lambda x: x["b"]), " … ").alias("excerpt"), *keep)
