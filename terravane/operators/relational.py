"""Relational operators: facets, latest and top per group, attachment joins, set difference with reasons.

Each takes DataFrames and column names and returns a DataFrame. Aggregations combine on the map side; joins are plain
equi-joins, so that the optimizer broadcasts a side that its statistics prove small and splits skewed keys otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, stored


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by the keys over all cores where its plan has fewer tasks than there are cores; give a plain scan.

    A small table of one file would otherwise run on one core, whatever is computed from its rows. A table of many files is left as it is, so
    a corpus is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if tasks >= cores else df.repartition(cores, *keys)


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that readers may lack: null of the kind where the table has no such column."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def blank_as_null(value: Column | str) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[blank_as_null(v) for v in values])


def number_or_null(value: Column | str) -> Column:
    """A whole number from text of digits only; null otherwise."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint"))


def labelled(value: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """Display label of a code, from a mapping given as a parameter."""
    out = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), labels.items(), F.when(F.lit(False), F.lit(None)))
    return out.otherwise(F.lit(default) if default is not None else value)


def assembled(*fields: tuple[str, Column], separator: str = "\n") -> Column:
    """Lines "Label: value" of the filled fields."""
    return F.concat_ws(separator, *[F.when(blank_as_null(v.cast("string")).isNotNull(), F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in fields])


def conjunction(conditions: Sequence[Column | None]) -> Column:
    """All given conditions; None is a facet that was not asked for."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def facet_filter(df: DataFrame, *, contains: dict[str, str] | None = None, one_of: dict[str, Sequence] | None = None, at_least: dict[str, float] | None = None, holds: dict[str, str] | None = None, text: tuple[Sequence[str], str] | None = None) -> DataFrame:
    """Rows that pass every facet given: array membership, value lists, lower bounds, substring, text in any of some columns."""
    conditions: list[Column | None] = []
    conditions += [F.array_contains(c, v) for c, v in (contains or {}).items() if v]
    conditions += [F.col(c).isin(*v) for c, v in (one_of or {}).items() if v]
    conditions += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    conditions += [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (holds or {}).items() if v]
    if text and text[1]:
        conditions.append(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text[1].lower())), F.lit(False)) for c in text[0]]))
    return df.where(conjunction(conditions))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order: one shuffle, and a map-side limit of one row a key before it."""
    return top_n(df, keys, order, 1).drop("rank")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark prunes groups to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "place", within: Sequence[str] = ()) -> DataFrame:
    """df with each row's place, from 1, in the order within the groups: as row_number(), but a group of any size is spread over many tasks.

    Rows are dealt into ranges of the order and written once with their range; a place is the place within the range after the rows of the ranges before it, of which there is one count for each range and group.
    """
    keys = [*map(F.col, within), *order]
    ranged = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), fresh_path(df.sparkSession, "ranges"))
    counts = ranged.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_range").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in within], F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in within], F.col("_range") == F.col("_of"))
    placed = ranged.withColumn("_here", here).join(F.broadcast(offsets), same)  # a row for each range and group that meet: ranges and groups together, since groups are ranges' first keys
    return placed.select(*df.columns, (F.col("_before") + F.col("_here")).alias(name))


def latest_value(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Values of the row of each key that is greatest by the order columns, by one aggregation without a sort."""
    best = F.max(F.struct(*order, *[c for c in values if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in values])


def one_per_domain(rows: DataFrame, key: str, domain: Column, fit: str, state: str, accepted: str = "accepted") -> DataFrame:
    """rows with duplicate_of: of the accepted rows of a domain the fittest stays (no fit counts -1, the least key wins a tie), the others are in state "duplicate" of it.

    The winners are one aggregate with map-side combine, joined back, so a domain of any size is never sorted in one task.
    """
    placed = rows.withColumn("_domain", F.when(F.col(state) == accepted, F.nullif(domain, F.lit(""))))
    best = placed.where("_domain IS NOT NULL").groupBy("_domain").agg(F.max_by(key, F.struct(F.coalesce(F.col(fit), F.lit(-1)), -F.col(key))).alias("_best"))
    loses = F.col("_best").isNotNull() & (F.col("_best") != F.col(key))
    return placed.join(best, "_domain", "left").withColumns({state: F.when(loses, "duplicate").otherwise(F.col(state)), "duplicate_of": F.when(loses, F.col("_best"))}).drop("_domain", "_best")


def with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, total: str = "total") -> DataFrame:
    """A page of rows with the count of all rows beside each; the count is an aggregate, not a window over one partition."""
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))), F.lit(True))


def facet_counts(df: DataFrame, facets: dict[str, Column], conditions: dict[str, Column]) -> DataFrame:
    """facet, value, n: counts of each facet's values under the conditions of all other facets, in one pass over df."""
    rows = []
    for name, value in facets.items():
        others = conjunction([c for k, c in conditions.items() if k != name])
        rows.append(F.when(others, F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))))
    exploded = df.select(F.explode(F.array_compact(F.array(*rows))).alias("f"))
    return exploded.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def grouped_text(df: DataFrame, keys: Sequence[str], value: str, separator: str = ", ", name: str = "values") -> DataFrame:
    """Distinct values of each key, sorted and joined."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(name))


def neighbours(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, other, outgoing: each edge seen from both ends, as a union instead of a join on either end."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), F.lit(True).alias("outgoing"))
    return out.unionAll(edges.select(F.col(target).alias("node"), F.col(source).alias("other"), F.lit(False).alias("outgoing")))


def either_match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs of rows equal in any of the column pairs, each once: a union of equi-joins instead of an OR join."""
    parts = [left.join(right, left[a] == right[b]) for a, b in pairs]
    return reduce(DataFrame.unionAll, parts).distinct()


def domain_suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def on_domains(df: DataFrame, host: str, domains: DataFrame, domain: str) -> DataFrame:
    """Rows whose host is one of the domains or below one, by an equi-join on exploded suffixes."""
    suffixed = df.withColumn("_suffix", F.explode(domain_suffixes(F.col(host))))
    return suffixed.join(domains.select(F.col(domain).alias("_suffix")).distinct(), "_suffix", "left_semi").drop("_suffix").distinct()


def proximity_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, before: str, after: str) -> DataFrame:
    """Pairs of equal keys whose right time lies within [left - before, left + after]; times are matched by bucket first.

    A bucket is as wide as the whole interval, so a left row meets two buckets at most and a hot key is spread over time.
    """
    width = f"(unix_micros(cast({{}} as timestamp)) div (({_micros(before)}) + ({_micros(after)}) + 1))"
    l = left.withColumn("_from", F.expr(width.format(f"{left_time} - interval {before}"))).withColumn("_to", F.expr(width.format(f"{left_time} + interval {after}")))
    l = l.withColumn("_bucket", F.explode(F.array_distinct(F.array("_from", "_to")))).drop("_from", "_to")
    r = right.withColumn("_bucket", F.expr(width.format(right_time)))
    joined = l.join(r, [*on, "_bucket"]).drop("_bucket")
    return joined.where(F.expr(f"{right_time} BETWEEN {left_time} - interval {before} AND {left_time} + interval {after}"))


def _micros(interval: str) -> str:
    n, unit = interval.split()
    return f"{n}L * " + {"second": "1000000L", "minute": "60000000L", "hour": "3600000000L", "day": "86400000000L"}[unit.rstrip("s")]


def asof_forward(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the first right row of its key at or after its time: one union, one window, no pairs."""
    payload = F.struct(F.col(right_time).alias("_t"), *[F.col(v) for v in values])
    marks = right.select(*on, F.col(right_time).alias("_time"), F.lit(1).alias("_side"), payload.alias("_right"), F.lit(None).cast(left.schema.simpleString()).alias("_left"))
    rows = left.select(*on, F.col(left_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(marks.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    w = Window.partitionBy(*on).orderBy("_time", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = rows.unionByName(marks).withColumn("_next", F.first("_right", ignorenulls=True).over(w)).where("_side = 0")
    return found.select("_left.*", F.col("_next._t").alias(right_time), *[F.col(f"_next.{v}").alias(v) for v in values])


def difference(left: DataFrame, right: DataFrame, on: Sequence[str], reason: str) -> DataFrame:
    """Rows of left without a match, with the reason they are reported for."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti").withColumn("reason", F.lit(reason))


def append_new(held: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An append-only insert: held rows, and those of rows whose key is not held, the first of each key."""
    fresh = rows.dropDuplicates(list(keys)).join(held.select(*keys), list(keys), "left_anti")
    return held.unionByName(fresh)


def upsert(held: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Held rows replaced by rows of the same key, and new ones added."""
    return held.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def follow(links: DataFrame, node: str, target: str, hops: int = 10) -> DataFrame:
    """node, survivor: the end of each chain of pointers; null where a chain is longer than `hops` or runs in a circle.

    Pointers are doubled every round, so `hops` costs its logarithm in joins.
    """
    at = links.select(F.col(node).alias("node"), F.col(target).alias("to"))
    at = at.withColumn("n", F.when(F.col("to").isNull(), 0).otherwise(1)).withColumn("to", F.coalesce("to", "node"))
    span = 1
    while span <= hops:
        ahead = at.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("n").alias("_k"))
        at = at.join(ahead, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_k", F.lit(0))).alias("n"))
        span *= 2
    return at.select("node", F.when(F.col("n") <= hops, F.col("to")).alias("survivor"))


def pivoted(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row a key with the greatest value of each name as a column; the names are given, so there is no pass to find them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def overlay(base: DataFrame, edits: DataFrame, key: str, field: str, value: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """base with the newest edit of each field in place of its value."""
    newest = latest_value(edits, [key, field], [value], order)
    wide = pivoted(newest, [key], field, value, fields).select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(wide, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_new_{f}").cast(base.schema[f].dataType), F.col(f)) for f in fields}).drop(*[f"_new_{f}" for f in fields])
