"""Connected components of an edge table, by label passing with pointer jumping.

Each round sends labels along edges and then jumps every node to its label's label, so the rounds grow with the logarithm
of a component's diameter. A round is three shuffled equi-joins or aggregations with map-side combine; hot nodes and hot labels
stand on the side of a join that adaptive execution splits. Labels are written after every round, and only the count of changes
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Rounds after which something must be wrong: label passing with jumps needs about the logarithm of the longest path.
MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the edges (a, b); root is the least node of its component. Null ends are ignored."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(MOST_ROUNDS):
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        passed = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        jumped = passed.join(up, F.col("root") == F.col("up_node"), "left").select("node", "old", F.least("root", "up_root").alias("root"))
        new = written(jumped, "labels")
        changed = new.where(F.col("old") != F.col("root")).limit(1).count()
        dropped(labels)
        labels = new.select("node", "root")
        labels._terravane_path = new._terravane_path
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError("components did not settle")
