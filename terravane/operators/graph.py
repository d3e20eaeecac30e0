"""Hierarchies: family roots with failing cycles, descendants with paths, survivors of merges, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def families(nodes: DataFrame, edges: DataFrame, node: str, child: str, parent: str, depth: int = 32) -> DataFrame:
    """node, root, resolved: the one root that all paths upward reach; cycles, several roots and paths over `depth` fail closed.

    Ancestors are doubled each round, so depth costs its logarithm in joins; a node that is its own ancestor is on a cycle.
    """
    up = edges.select(F.col(child).alias("n"), F.col(parent).alias("p")).distinct()
    _checkpoint_dir(edges.sparkSession)
    up = up.checkpoint()
    reach, span = up, 1
    while span < depth:
        further = reach.join(reach.select(F.col("n").alias("_n"), F.col("p").alias("_p")), F.col("p") == F.col("_n")).select("n", F.col("_p").alias("p"))
        reach, span = reach.unionAll(further).distinct().checkpoint(), span * 2
    own = reach.groupBy("n").agg(F.max((F.col("n") == F.col("p")).cast("int")).alias("on_cycle"))
    bad = own.where("on_cycle = 1").select("n")
    roots = reach.join(up.select(F.col("n").alias("p")).distinct(), "p", "left_anti").groupBy("n").agg(F.count_distinct("p").alias("roots"), F.min("p").alias("root"))
    through = reach.join(bad.select(F.col("n").alias("p")), "p", "left_semi").select("n").unionAll(bad).distinct().withColumn("failed", F.lit(True))
    rows = nodes.select(F.col(node).alias("n")).join(up.select("n").distinct().withColumn("has", F.lit(True)), "n", "left").join(roots, "n", "left").join(through, "n", "left")
    resolved = F.col("has").isNull() | (F.col("failed").isNull() & (F.col("roots") == 1))
    return rows.select(F.col("n").alias("node"), F.when(resolved, F.when(F.col("has").isNull(), F.col("n")).otherwise(F.col("root"))).alias("root"), F.coalesce(resolved, F.lit(False)).alias("resolved"))


def descendants(edges: DataFrame, child: str, parent: str, view: str = "terravane_edges") -> DataFrame:
    """ancestor, descendant, path (ids joined by /), depth: by recursion in SQL, which stops at a node already on the path."""
    edges.select(F.col(child).cast("bigint").alias("child"), F.col(parent).cast("bigint").alias("parent")).createOrReplaceTempView(view)
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE walk AS (
          SELECT parent AS ancestor, child AS descendant, array(parent, child) AS path FROM {view}
          UNION ALL
          SELECT w.ancestor, e.child, array_append(w.path, e.child) FROM walk w JOIN {view} e ON e.parent = w.descendant WHERE NOT array_contains(w.path, e.child)
        ) SELECT ancestor, descendant, array_join(transform(path, x -> cast(x AS string)), '/') AS path, cast(size(path) - 1 AS bigint) AS depth FROM walk"""
    )


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """node, root: least node of each component, by hooking and contraction; lineage is cut by checkpoints.

    A round hooks every node to its least neighbour, follows those pointers to their ends by doubling, and replaces the ends of all edges by what they lead to. Edges inside what has met
    fall away, so a round works on the edges that are left; a component's local minima, at most half of its nodes, are what the next round sees. Only counts come to the driver.
    """
    _checkpoint_dir(edges.sparkSession)
    left = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint()
    known = None
    for _ in range(most_rounds):
        if not left.limit(1).count():
            break
        hooked = _followed(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).checkpoint(), most_rounds)
        end = lambda side: hooked.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
        moved = left.join(end("lo"), "lo", "left").join(end("hi"), "hi", "left").select(F.coalesce("_lo", "lo").alias("x"), F.coalesce("_hi", "hi").alias("y"))
        left = moved.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct().checkpoint()
        if known is None:
            known = hooked
        else:
            after = hooked.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            known = known.join(after, "root", "left").select("node", F.coalesce("_to", "root").alias("root")).unionByName(hooked).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    if known is None:  # no edges: no nodes
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return known.unionByName(known.select(F.col("root").alias("node"), "root").distinct())


def strongest_first(spots: DataFrame, near: DataFrame, alike: float, most_rounds: int = 200) -> DataFrame:
    """class, start, winner (the key in a rank): in order of rank a spot joins the strongest winner that it meets, or wins itself.

    spots: class, start, rank, a row for each class and start, from a stored table; near: a, b, share of classes. Spots meet in one class, in classes whose share is `alike`, or, in other near classes, at the same start.
    A round lets every open spot win that is the strongest open one among all that it meets, so it settles all local cases together, and a class is done once one of its spots wins.
    """
    _checkpoint_dir(spots.sparkSession)
    near = near.checkpoint()
    both = near.select("a", "b", "share").union(near.select("b", "a", "share")).toDF("class", "other", "share")
    same = spots.select("class").distinct().withColumn("other", F.col("class"))
    wide = both.where(F.col("share") + 1e-12 >= alike).select("class", "other").union(same)
    close = both.where(F.col("share") + 1e-12 < alike).select("class", "other")

    def met(heads: DataFrame, tails: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The least rank that each class meets among the heads (class, rank), and that each spot meets at its start in close classes among the tails."""
        named = lambda rs: rs.withColumnRenamed("class", "other")
        by_class = wide.join(named(heads), "other").groupBy("class").agg(F.min("rank").alias("wide"))
        return by_class, close.join(named(tails), "other").groupBy("class", "start").agg(F.min("rank").alias("close"))

    open_, won = spots, None
    for _ in range(most_rounds):
        if not open_.limit(1).count():
            break
        fronts = open_.groupBy("class").agg(F.min(F.struct("rank", "start")).alias("f")).select("class", "f.rank", "f.start")
        by_class, by_spot = met(fronts.select("class", "rank"), open_)
        first = fronts.join(by_class, "class").where("rank = wide").join(by_spot, ["class", "start"], "left").where("close IS NULL OR rank < close").select("class", "start", "rank").checkpoint()
        by_class, by_spot = met(first.select("class", "rank"), first)
        open_ = open_.join(by_class, "class", "left_anti").join(by_spot, ["class", "start"], "left_anti").checkpoint()
        won = first if won is None else won.unionByName(first)
    else:
        raise RuntimeError("the order did not settle")
    won = spots.limit(0) if won is None else won
    by_class, by_spot = met(won.groupBy("class").agg(F.min("rank").alias("rank")), won)
    told = spots.join(by_class, "class", "left").join(by_spot, ["class", "start"], "left")
    return told.select("class", "start", F.least("wide", "close")["key"].alias("winner"))


def _followed(pointers: DataFrame, most_rounds: int) -> DataFrame:
    """node, root with every pointer replaced by the end of its chain; chains lead to lesser nodes, so there are no circles."""
    for _ in range(most_rounds):
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        stepped = pointers.join(ahead, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")).checkpoint()
        pointers = stepped.select("node", "root")
        if not stepped.where("_moved").limit(1).count():
            return pointers
    raise RuntimeError("pointers did not settle")


def _checkpoint_dir(spark) -> None:
    """The shared folder becomes the checkpoint folder, unless one is set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = shared_folder(spark)
        spark.sparkContext.setCheckpointDir(folder)
