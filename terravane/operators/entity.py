"""Entity resolution: blocking, pair features, routing, duplicate rules, merging, thresholds.

Pairs come from equi-joins on blocking keys (tokens, n-grams, domains, dates), never from a cross join. Names are made
distinct before they are compared, and only distinct names are paired, so repeated names cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import components
from .similarity import containment_pairs, edit_pairs, set_pairs

#: Words that describe a part of an organization, and words that add structure only.
SUB_UNIT_WORDS = ("department", "school", "college", "center", "centre", "lab", "laboratory", "division", "office", "institute")
STRUCTURAL_WORDS = (*T.LEGAL_WORDS, "group", "holdings", "international")
HIGH, LOW = 0.96, 0.35


def completeness(fields: Sequence[str]) -> Column:
    """Filled fields of a list."""
    out = F.lit(0)
    for f in fields:
        out = out + F.col(f).isNotNull().cast("int")
    return out


#: Members of a block that meet in one task; a larger block is split into so many parts, and its pairs into tiles of two parts.
BLOCK_PART = 2000


def blocked_pairs(df: DataFrame, key: str, blocks: Column, part: int = BLOCK_PART) -> DataFrame:
    """a, b with a < b: distinct pairs of rows that share a block, all of them.

    Blocks are meant to be rare tokens. The rows of a common one are dealt into parts on one side and met by every part on the other, so its pairs are made in many
    tasks instead of one; none is dropped.
    """
    exploded = df.select(F.col(key).alias("_id"), F.explode(F.array_distinct(blocks)).alias("_block"))
    sizes = exploded.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    keyed = exploded.join(sizes, "_block")
    left = keyed.select(F.col("_id").alias("a"), "_block", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int").alias("_part"))
    right = keyed.select(F.col("_id").alias("b"), "_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, ["_block", "_part"]).where("a < b").select("a", "b").distinct()


def duplicate_names(names: DataFrame, name: str, least: float) -> DataFrame:
    """a, b, reason with a < b: distinct names of which one, without spaces and of 5 letters or more, stands inside the other, or whose words have a Jaccard similarity of `least`."""
    rows = names.select(F.col(name).alias("a")).distinct().select("a", F.replace("a", F.lit(" "), F.lit("")).alias("c"))
    within = containment_pairs(rows, "c").unionByName(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND length(c) >= 5").select(F.col("c").alias("inner"), F.col("c").alias("outer")))
    other = rows.select(F.col("a").alias("b"), F.col("c").alias("outer"))
    inside = rows.withColumnRenamed("c", "inner").join(within, "inner").join(other, "outer").where("a <> b")
    told = inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("containment").alias("reason"))
    words = set_pairs(rows.select("a", F.split("a", " ").alias("w")).withColumnRenamed("a", "k"), "k", "w", least).select("a", "b", F.lit("words").alias("reason"))
    return told.union(words).groupBy("a", "b").agg(F.min("reason").alias("reason"))


def lexical_features(a: Column, b: Column) -> dict[str, Column]:
    """acronym_match, containment, jaccard, length_ratio of two names."""
    x, y = F.array_distinct(T.words(T.normalize_name(a))), F.array_distinct(T.words(T.normalize_name(b)))
    la, lb = F.length(T.normalize_name(a)), F.length(T.normalize_name(b))
    return {
        "acronym_match": T.acronym_pair(a, b).cast("double"),
        "containment": T.containment(x, y),
        "jaccard": T.jaccard(x, y),
        "length_ratio": F.when(F.greatest(la, lb) > 0, F.least(la, lb) / F.greatest(la, lb)).otherwise(0.0),
    }


def zone(score: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(score >= high, "high").when(score >= low, "review").otherwise("create")


def direction(a: Column, b: Column) -> Column:
    """child_first where the first name's words are a strict superset of the other's, parent_first the other way round, else null."""
    x, y = F.array_distinct(T.words(T.plain(a))), F.array_distinct(T.words(T.plain(b)))
    more, less = F.size(F.array_except(x, y)), F.size(F.array_except(y, x))
    return F.when((less == 0) & (more > 0), "child_first").when((more == 0) & (less > 0), "parent_first")


def winners(members: DataFrame, cluster: str, key: str, order: Sequence[Column]) -> DataFrame:
    """cluster, winner, size: the first member of each cluster in the order."""
    w = Window.partitionBy(cluster).orderBy(*order)
    ranked = members.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(cluster).agg(F.max(F.when(F.col("_rank") == 1, F.col(key))).alias("winner"), F.count(F.lit(1)).alias("size"))


def merged(members: DataFrame, cluster: str, longest: Sequence[str], joined: Sequence[str]) -> DataFrame:
    """One record a cluster: the longest value of some fields (the first in order on a tie), all distinct values of others."""
    longer = [F.max(F.struct(F.length(c).alias("n"), F.col(c).alias("v"))).getField("v").alias(c) for c in longest]
    every = [F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(f"all_{c}") for c in joined]
    return members.groupBy(cluster).agg(*longer, *every)


def greedy_groups(df: DataFrame, block: Sequence[str], order: Sequence[str], key: str, name: str, same) -> DataFrame:
    """key, group: in order, each record joins the first group whose merged record it duplicates, else opens one.

    `same(record name, group's longest name)` decides. The scan order is the meaning of this operator, so a block is one
    task; blocks must be closed under `same`.
    """

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), kind="stable")
        groups: list[list] = []
        out = []
        for k, n in zip(frame[key], frame[name]):
            for g in groups:
                if same(n, g[1]):
                    if len(n) > len(g[1]):
                        g[1] = n
                    out.append((k, g[0]))
                    break
            else:
                groups.append([k, n])
                out.append((k, k))
        return pd.DataFrame(out, columns=["key", "group"])

    return df.select(*dict.fromkeys([*block, *order, key, name])).groupBy(*block).applyInPandas(scan, "key bigint, group bigint")


def spelled_groups(df: DataFrame, block: Sequence[str], order: Sequence[str], key: str, name: str, least: int) -> DataFrame:
    """key, group: greedy_groups() with names the same at a ratio of sorted words of `least`, each scan over records that spelling can connect instead of a whole block.

    A group's merged name is the name of one of its records, so a record can only join a group in which it has a close name: records of a block that no chain of close names connects never meet, and
    the components of that graph are scanned apart, with the result of one scan.
    """
    in_order = F.array_join(F.array_sort(T.words(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\s+", " ")))), " ")
    rows = df.select(*dict.fromkeys([*block, *order, key, name])).withColumn("_words", in_order).withColumn("_node", F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in block], "_words"))
    nodes = rows.select(*block, "_words", "_node").distinct()
    close = edit_pairs(nodes, "_words", least)
    one = nodes.join(close, nodes["_words"] == close["a"])
    other = nodes.select(*[F.col(c).alias(f"_o_{c}") for c in block], F.col("_words").alias("b"), F.col("_node").alias("_other"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in block], F.lit(True))
    joined = components(one.join(other, (one["b"] == other["b"]) & same).select("_node", "_other"), "_node", "_other")
    placed = rows.join(joined, F.col("_node") == F.col("node"), "left").withColumn("_part", F.coalesce("root", "_node"))
    return greedy_groups(placed, ["_part"], order, key, name, lambda a, b: T.token_sort(a, b) >= least)


def natural_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(T.plain(p), F.lit("")) for p in parts])


def described(rows: DataFrame, desc: str, weights: DataFrame, cities: Sequence[str], states: Sequence[str]) -> DataFrame:
    """rows with _about: what compared() reads of a description, made once a row and not once a pair. weights as in description_features()."""
    terms = weights.groupBy(F.col("key").alias(desc)).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_terms"))
    text = F.coalesce(F.trim(desc), F.lit(""))
    tokens = F.array_distinct(F.filter(T.words(T.plain(text)), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS)))
    named = lambda names: F.array_intersect("_tokens", F.array(*map(F.lit, names)))
    told = rows.join(terms, desc, "left").withColumn("_tokens", tokens)
    about = F.struct((text != "").alias("filled"), F.col("_tokens").alias("tokens"), named(cities).alias("cities"), named(states).alias("states"), F.col("_terms").alias("terms"))
    return told.withColumn("_about", about).drop("_tokens", "_terms")


def compared(x: Column, y: Column) -> dict[str, Column]:
    """tfidf, overlap, place_conflict and both_present of two descriptions as described() tells them, all nought where either is missing."""
    both = F.coalesce(x["filled"] & y["filled"], F.lit(False))
    cosine = F.aggregate(F.map_entries(x["terms"]), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(y["terms"], e["key"]), F.lit(0.0)))
    differ = lambda names: (F.size(x[names]) > 0) & (F.size(y[names]) > 0)
    conflict = F.when(differ("cities"), ~F.arrays_overlap(x["cities"], y["cities"])).when(differ("states"), ~F.arrays_overlap(x["states"], y["states"])).otherwise(False)
    zero = lambda c: F.when(both, c).otherwise(0.0)
    return {"tfidf": zero(F.coalesce(cosine, F.lit(0.0))), "overlap": zero(T.jaccard(x["tokens"], y["tokens"])), "place_conflict": zero(conflict.cast("double")), "both_present": both.cast("int")}


def description_features(pairs: DataFrame, weights: DataFrame, cities: Sequence[str], states: Sequence[str], dense: str | None = None) -> DataFrame:
    """pairs (a, b, desc_a, desc_b) with tfidf, dense, overlap, place_conflict and both_present: how alike two descriptions are, all nought where either is missing.

    weights: key, term, weight of every distinct description (search.tfidf() with the description as key); dense: a column of a model's similarity, where there is one. A city that both name differently is a conflict; states decide only where no city is
    named by both.
    """
    side = lambda s: described(pairs.select(f"desc_{s}").distinct(), f"desc_{s}", weights, cities, states).withColumnRenamed("_about", f"_{s}")
    out = compared(F.col("_a"), F.col("_b"))
    own = F.lit(0.0) if dense is None else F.when(out["both_present"] == 1, F.col(dense)).otherwise(0.0)
    joined = pairs.join(side("a"), "desc_a", "left").join(side("b"), "desc_b", "left")
    return joined.select("a", "b", out["tfidf"].alias("tfidf"), own.alias("dense"), *[out[c].alias(c) for c in ("overlap", "place_conflict", "both_present")])


def description_pairs(rows: DataFrame, block: str, key: str, desc: str, weights: DataFrame, cities: Sequence[str], states: Sequence[str], part: int = 100) -> DataFrame:
    """a, b, tfidf, overlap, place_conflict, both_present, copy: the features of all pairs of rows of a block, by classes of rows with the same description.

    The least key of a class, of a missing description too, stands for it. Each pair of these is a row with a < b and copy 0, and each other member of a class is a row b of copy 1 with a that
    stands for it. So two rows of different classes compare as those that stand for them, and two of one class as either of its rows of copy 1; no pair is left out, and copies are not
    expanded. The classes of a block are dealt into parts, so its pairs are made in many tasks.
    """
    least = rows.where(F.col(key).isNotNull()).groupBy(block, desc).agg(F.min(key).alias("a"))
    classes = described(least, desc, weights, cities, states).select(F.col(block).alias("_of"), F.col(desc).alias("_same"), "a", "_about")
    sizes = least.groupBy(F.col(block).alias("_block")).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    dealt = classes.join(sizes, F.col("_of").eqNullSafe(F.col("_block")))
    tile = lambda i: F.concat_ws("=", i.cast("string"), "_of").alias("_tile")
    left = dealt.select("a", F.col("_about").alias("_x"), tile(F.pmod(F.xxhash64("a"), "_parts")))
    right = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(F.col("a").alias("b"), F.col("_about").alias("_y"), tile(F.col("_i")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since few rows make many pairs and would be put into few tasks
    met = left.repartition(tasks, "_tile").join(right.repartition(tasks, "_tile"), "_tile").where("a < b")
    features = lambda x, y: [c.alias(n) for n, c in compared(F.col(x), F.col(y)).items()]
    own = classes.select("_of", "_same", "a", *features("_about", "_about"))
    copies = rows.join(own, F.col(block).eqNullSafe(F.col("_of")) & F.col(desc).eqNullSafe(F.col("_same"))).where(F.col(key) > F.col("a"))
    names = list(compared(F.col("_x"), F.col("_y")))
    return met.select("a", "b", *features("_x", "_y"), F.lit(0).alias("copy")).union(copies.select("a", F.col(key).alias("b"), *names, F.lit(1).alias("copy")))


def waiting(rows: DataFrame, pending: DataFrame, page: str, name: str) -> DataFrame:
    """rows with waits: "page" where a pending item has the same address, else "name" where one has the same name, else null; addresses and names as keys."""
    from ..functions import urls as U

    pages = pending.select(U.key(F.col(page)).alias("_p")).where("_p <> ''").distinct().withColumn("_by_page", F.lit(True))
    names = pending.select(T.plain(F.col(name)).alias("_n")).where("_n <> ''").distinct().withColumn("_by_name", F.lit(True))
    joined = rows.withColumn("_p", U.key(F.coalesce(page, F.lit("")))).withColumn("_n", T.plain(F.coalesce(name, F.lit("")))).join(pages, "_p", "left").join(names, "_n", "left")
    return joined.withColumn("waits", F.when(F.col("_by_page"), "page").when(F.col("_by_name"), "name")).drop("_p", "_n", "_by_page", "_by_name")
