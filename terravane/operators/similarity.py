"""Exact similarity joins: pairs of close spelling and pairs of word sets that overlap, without a cross join and without lossy blocks.

Both joins are equi-joins on signatures that every result pair must share, a condition in generated code that rules most other pairs out before anything is
written, and an exact check of the distinct pairs that are left. Adaptive execution splits a frequent signature; none is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Groups of letters whose counts are compared before a pair is checked; two spellings differ by at least as many edits as their counts differ.
LETTERS = ("e", "t", "a", "o", "i", "n", "s", "r", "hb", "lv", "dk", "cj", "ux", "mq", "pz", "fgwy")


def _counts(value: Column, groups: tuple[str, ...]) -> Column:
    """The counts of eight groups of letters, one byte each, packed into a bigint."""
    out = F.lit(0).cast("bigint")
    for i, group in enumerate(groups):
        n = F.least(F.length(value) - F.length(F.translate(value, group, "")), F.lit(255))
        out = out.bitwiseOR(F.shiftleft(n.cast("bigint"), 8 * i))
    return out


def _apart(a: Column, b: Column) -> Column:
    """The sum of the differences of two packed rows of counts."""
    byte = lambda x, i: F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))
    return sum((F.abs(byte(a, i) - byte(b, i)) for i in range(8)), F.lit(0).cast("bigint"))


def _told(names: DataFrame, name: str) -> DataFrame:
    """Distinct filled names as s, with their length n and letter counts c0 and c1."""
    rows = names.select(F.col(name).alias("s")).where("s <> ''").distinct()
    return rows.select("s", F.length("s").alias("n"), _counts(F.col("s"), LETTERS[:8]).alias("c0"), _counts(F.col("s"), LETTERS[8:]).alias("c1"))


def _segments(rows: DataFrame, least: int) -> DataFrame:
    """rows with sig: a hash of (length, place, text) of each segment. The longer of two names is cut into one segment more than a pair can have edits."""
    cut = rows.withColumn("m", F.expr(f"cast({100 - least} * 2 * n div 100 as int) + 1")).withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
    cut = cut.withColumns({"p": F.expr("cast(i * n div m as int)"), "q": F.expr("cast((i + 1) * n div m as int)")})
    return cut.select(F.xxhash64("n", "i", F.expr("substring(s, p + 1, q - p)")).alias("sig"), "s", "n", "c0", "c1")


def _probes(rows: DataFrame, least: int) -> DataFrame:
    """rows with sig: hashes of the runs of a name that can be a segment of a name as long or longer.

    Of the segments of the longer name that no edit touches, take the first with as many edits before it as segments before it. It stands in the shorter
    name shifted by x, where x is i insertions and deletions in all, and what is left of the edits must make up for the rest of the difference in length.
    """
    each = rows.withColumn("t", F.explode(F.expr(f"sequence(n, cast(n * {200 - least} div {least} as int))")))
    each = each.withColumns({"tau": F.expr(f"cast({100 - least} * (n + t) div 100 as int)"), "m": F.expr(f"cast({100 - least} * 2 * t div 100 as int) + 1"), "d": F.expr("n - t")})
    each = each.where("tau >= -d").withColumn("i", F.explode(F.expr("sequence(0, least(tau, m - 1))")))
    each = each.withColumns({"p": F.expr("cast(i * t div m as int)"), "w": F.expr("cast((i + 1) * t div m as int) - cast(i * t div m as int)")})
    each = each.withColumns({"lo": F.expr("greatest(-i, d - (tau - i), -p)"), "hi": F.expr("least(i, d + (tau - i), n - w - p)")})
    each = each.withColumn("lo", F.expr("lo + pmod(lo - i, 2)")).where("lo <= hi").withColumn("x", F.explode(F.expr("sequence(lo, hi, 2)")))
    return each.select(F.xxhash64("t", "i", F.expr("substring(s, p + x + 1, w)")).alias("sig"), "s", "n", "c0", "c1")


def _rated(short: DataFrame, long: DataFrame, least: int) -> DataFrame:
    """short, long: distinct pairs that share a signature and whose letters allow the ratio."""
    x, y = _probes(short, least).alias("x"), _segments(long, least).alias("y")
    edits = F.expr(f"{100 - least} * (x.n + y.n) div 100")
    near = (_apart(F.col("x.c0"), F.col("y.c0")) + _apart(F.col("x.c1"), F.col("y.c1"))) <= edits
    return x.join(y, F.expr("x.sig = y.sig AND x.n <= y.n") & near).select(F.col("x.s").alias("short"), F.col("y.s").alias("long")).distinct()


def edit_pairs(names: DataFrame, name: str, least: int) -> DataFrame:
    """a, b, ratio with a < b: all pairs of distinct filled names whose indel ratio is at least `least` (a whole number up to 100)."""
    rows = _told(names, name)
    met = _rated(rows, rows, least).where("short <> long").select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    return met.withColumn("ratio", T.ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


def edit_join(left: DataFrame, right: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """a, b, ratio: all pairs of a distinct filled name of left's column and one of right's whose indel ratio is at least `least`, equal ones too."""
    x, y = _told(left, a), _told(right, b)
    met = _rated(x, y, least).toDF("a", "b").union(_rated(y, x, least).select("long", "short")).distinct()
    return met.withColumn("ratio", T.ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least).select(F.col("a").alias(a), F.col("b").alias(b) if b != a else F.col("b"), "ratio")


def set_candidates(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """a, b, x, y: pairs of distinct keys with their sets, by prefixes in the order of rare items first; every pair of Jaccard similarity `least` is among them.

    Two such sets share an item among the first of either: as many as a set can miss, and one. They are joined on those, within the lengths that the similarity
    allows, and only where the items after the shared place could still make it up.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_distinct(items).alias("v")).where(F.size("v") > 0)
    counts = rows.select(F.explode("v").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = rows.select("k", F.explode("v").alias("w")).join(counts, "w").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda s: s.w).alias("v"))
    first = F.size("v") - F.ceil(F.size("v") * F.lit(float(least)) - 1e-9).cast("int") + 1
    cut = ordered.select("k", "v", F.size("v").alias("n"), F.posexplode(F.slice("v", F.lit(1), first)).alias("at", "w"))
    x, y = cut.alias("x"), cut.alias("y")
    most = F.expr("1 + least(x.n - x.at - 1, y.n - y.at - 1)")  # of common items, if the shared one is the first that both have
    enough = most + F.lit(0) >= F.ceil(F.expr(f"{least} / (1 + {least}) * (x.n + y.n)") - 1e-9)
    alike = F.expr(f"least(x.n, y.n) + 1e-9 >= {least} * greatest(x.n, y.n)")
    first_shared = F.expr("size(array_intersect(slice(x.v, 1, x.at), slice(y.v, 1, y.at))) = 0")
    return x.join(y, F.expr("x.w = y.w AND x.k < y.k") & alike & enough & first_shared).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.v").alias("x"), F.col("y.v").alias("y"))


def set_pairs(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """a, b, similarity with a < b: all pairs of keys whose sets of items have a Jaccard similarity of at least `least`; empty sets pair with nothing."""
    return set_candidates(sets, key, items, least).select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") + 1e-12 >= least)


def overlap_pairs(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """a, b, share with a < b: all pairs of keys whose sets have at least the share `least` of the smaller one in common; empty sets pair with nothing.

    As many of the smaller set's rarest items as it can miss, and one, are looked up among all items of the others.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_distinct(items).alias("v")).where(F.size("v") > 0)
    each = rows.select("k", "v", F.explode("v").alias("w"))
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.select("k", "w").join(counts, "w").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda s: s.w).alias("v"))
    first = F.size("v") - F.ceil(F.size("v") * F.lit(float(least)) - 1e-9).cast("int") + 1
    cut = ordered.select(F.col("k").alias("x"), F.col("v").alias("xv"), F.explode(F.slice("v", F.lit(1), first)).alias("w"))
    met = cut.join(each.select(F.col("k").alias("y"), F.col("v").alias("yv"), "w"), "w").where("x <> y AND size(xv) <= size(yv)")
    told = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.size(F.array_intersect("xv", "yv")) / F.size("xv")).alias("share")).where(F.col("share") + 1e-12 >= least)
    return told.distinct()


def subset_pairs(sets: DataFrame, key: str, items: str) -> DataFrame:
    """small, big: all pairs of distinct keys where the first's set lies within the second's (equal sets both ways); empty sets pair with nothing.

    A set finds the ones around it by its rarest item alone.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_distinct(items).alias("v")).where(F.size("v") > 0)
    each = rows.select("k", "v", F.explode("v").alias("w"))
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(counts, "w").groupBy("k").agg(F.min(F.struct("df", "w", "v")).alias("r")).select(F.col("k").alias("small"), F.col("r.w").alias("w"), F.col("r.v").alias("x"))
    return rarest.join(each, "w").where(F.expr("small <> k AND size(array_except(x, v)) = 0")).select("small", F.col("k").alias("big"))


def containment_pairs(names: DataFrame, name: str, least: int = 5) -> DataFrame:
    """inner, outer: all pairs of distinct names where the first, of `least` characters or more, stands inside the other.

    A name finds the ones around it by its rarest run of `least` characters alone.
    """
    rows = names.select(F.col(name).alias("s")).where(F.length("s") >= least).distinct()
    runs = F.transform(F.expr(f"sequence(1, length(s) - {least - 1})"), lambda i: F.substring("s", i, F.lit(least)))
    each = rows.select("s", F.explode(F.array_distinct(runs)).alias("w"))
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(counts, "w").groupBy("s").agg(F.min(F.struct("df", "w"))["w"].alias("w")).select(F.col("s").alias("inner"), "w")
    return rarest.join(each, "w").where(F.expr("inner <> s AND contains(s, inner)")).select("inner", F.col("s").alias("outer"))
