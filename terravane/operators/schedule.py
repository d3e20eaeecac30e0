"""Requests with a cadence: what is due, why others are skipped, what expires and when the next run is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered

#: Days between runs of each cadence; once runs a single time.
CADENCE_DAYS = {"daily": 1, "weekly": 7, "biweekly": 14, "monthly": 30, "quarterly": 91}


def period(cadence: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, days in CADENCE_DAYS.items():
        out = out.when(cadence == name, F.lit(days))
    return out


def due(status: Column, starts: Column, ends: Column, cadence: Column, last_run: Column, today: Column) -> Column:
    """Empty where a run is due, else the reason for skipping: status, then period, then cadence."""
    return (
        F.when(status != "active", "not active")
        .when(starts > today, "not started")
        .when(ends < today, "ended")
        .when((cadence == "once") & last_run.isNotNull(), "already run")
        .when((cadence != "once") & (F.date_add(last_run, period(cadence)) > today), "not due yet")
        .otherwise("")
    )


def next_run(cadence: Column, last_run: Column, ends: Column) -> Column:
    following = F.date_add(last_run, period(cadence))
    return F.when(following <= ends, following)


def refreshed(changed: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """key, by_change, by_flag: rows to index again, each once."""
    both = changed.select(key, F.lit(True).alias("c")).unionAll(dirty.select(key, F.lit(False)))
    return both.groupBy(key).agg(F.bool_or("c").alias("by_change"), F.bool_or(~F.col("c")).alias("by_flag"))


def purgeable(deleted_at: Column, now: Column, days: int) -> Column:
    return F.datediff(now, deleted_at) > days


def split_due(requests: DataFrame, key: str, reason: Column) -> DataFrame:
    """key, due, reason, place: requests that run and those skipped with their reason; place counts the due ones in order of the key."""
    told = requests.withColumn("_reason", F.nullif(reason, F.lit(""))).withColumn("_due", F.col("_reason").isNull())
    placed = numbered(told.where("_due").select(key), [key])
    return told.select(key, F.col("_due").alias("due"), F.col("_reason").alias("reason")).join(placed, key, "left")


def exclusive_runs(runs: DataFrame, lock: str, key: str, started: str, ended: str) -> DataFrame:
    """runs with holds: whether a run got the lock of its group. Runs in order of start: one starts while another holds the lock is turned away and never holds it.

    The decision depends on the runs that held before, so a lock's runs stream through one task in order, keeping the end of the holder alone.
    """
    import pandas as pd

    names = (lock, key, started, ended)
    rows = runs.select(*names).repartition(lock).sortWithinPartitions(lock, started, key)

    def decide(frames):
        at, until = None, None
        for frame in frames:
            out = []
            for group, k, a, b in frame.itertuples(index=False):
                if group != at:
                    at, until = group, None
                holds = until is None or a >= until
                if holds:
                    until = b
                out.append((k, holds))
            yield pd.DataFrame(out, columns=["key", "holds"])

    kind = runs.schema[key].dataType.simpleString()
    return rows.mapInPandas(decide, f"key {kind}, holds boolean")


def fresh_pages(pages: DataFrame, held: DataFrame, url: str, content: str) -> DataFrame:
    """pages with skip: whether the same address was read before with the same content, by its hash; a held page is compared, not the page itself."""
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    seen = held.select(F.col(url).alias("_u"), digest.alias("_h")).distinct().withColumn("_seen", F.lit(True))
    joined = pages.withColumn("_d", digest).join(seen, (F.col(url) == F.col("_u")) & (F.col("_d") == F.col("_h")), "left")
    return joined.withColumn("skip", F.col("_seen").isNotNull()).drop("_u", "_h", "_seen", "_d")
