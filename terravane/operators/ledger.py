"""Ledgers: reconciliation, attribution of runs to those who asked, spend by month."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds between a press and the run it explains, in seconds.
BEFORE, AFTER = 60, 1800


def reconcile(rows: DataFrame, cost: str, owner: str) -> DataFrame:
    """total, attributed, unattributed, difference: one row of sums."""
    attributed = F.coalesce(F.sum(F.when(F.col(owner).isNotNull(), F.col(cost))), F.lit(0))
    loose = F.coalesce(F.sum(F.when(F.col(owner).isNull(), F.col(cost))), F.lit(0))
    total = F.coalesce(F.sum(cost), F.lit(0))
    return rows.agg(total.alias("total"), attributed.alias("attributed"), loose.alias("unattributed"), (total - attributed - loose).alias("difference"))


def basis(status: Column) -> Column:
    return F.when(status == "O", "in progress").when(status == "P", "partial run").otherwise("final")


def matched_presses(runs: DataFrame, presses: DataFrame, key: str, run: str, ran: str, press: str, pressed: str) -> DataFrame:
    """run, press: each run in start order takes the first unused press of its key within the bounds; a press explains one run.

    The greedy order matters inside a key only, and a key's rows stream to one task in batches with their times alone.
    """
    both = runs.select(key, F.col(run).alias("id"), F.unix_micros(F.col(ran).cast("timestamp")).alias("at"), F.lit(True).alias("is_run"))
    both = both.unionAll(presses.select(key, F.col(press), F.unix_micros(F.col(pressed).cast("timestamp")), F.lit(False)))

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        free = sorted(zip(frame.loc[~frame.is_run, "at"], frame.loc[~frame.is_run, "id"]))
        used, out, low = set(), [], 0
        for at, i in sorted(zip(frame.loc[frame.is_run, "at"], frame.loc[frame.is_run, "id"])):
            while low < len(free) and (low in used or at - free[low][0] > AFTER * 10**6):
                low += 1
            k = low
            while k < len(free) and at - free[k][0] >= -BEFORE * 10**6:
                if k not in used and at - free[k][0] <= AFTER * 10**6:
                    used.add(k)
                    out.append((i, free[k][1]))
                    break
                k += 1
        return pd.DataFrame(out, columns=["run", "press"])

    return both.groupBy(key).applyInPandas(assign, "run bigint, press bigint")


def operations(runs: DataFrame, checks: DataFrame, presses: DataFrame, owners: DataFrame, asks: DataFrame) -> DataFrame:
    """source, reference, person, because, basis, cost: every paid operation of the ledgers, with who it is put down to and why; person -1 where it is not recorded.

    runs: run, job, check, request, status, cost; checks: check, person, cost; presses: run, person (one run each, from matched_presses()); owners: request, person; asks: ask, person, cost, priced. An update belongs to who
    ran its check, another run to who pressed for it, else to the owner of its request. A check that no run applied stands for itself.
    """
    by_check = checks.select("check", F.col("person").alias("_checker"))
    by_press = presses.select("run", F.col("person").alias("_presser"))
    by_owner = owners.select("request", F.col("person").alias("_owner"))
    joined = runs.join(by_check, "check", "left").join(by_press, "run", "left").join(by_owner, "request", "left")
    update = F.col("job") == "actor_update"
    person = F.when(update, F.col("_checker")).otherwise(F.coalesce("_presser", "_owner"))
    because = F.when(update, F.when(F.col("_checker").isNotNull(), "ran the check")).when(F.col("_presser").isNotNull(), "pressed Run now").when(F.col("_owner").isNotNull(), "owns the request")
    line = lambda source, reference, who, why, how, cost: [F.lit(source).alias("source"), reference.alias("reference"), F.coalesce(who.cast("bigint"), F.lit(-1)).alias("person"), why.alias("because"), how.alias("basis"), F.round(F.coalesce(cost, F.lit(0.0)), 2).alias("cost")]
    run_lines = joined.select(*line("collection_run", F.col("run"), person, because, basis(F.col("status")), F.col("cost")))
    loose = checks.join(runs.where("check IS NOT NULL").select("check"), "check", "left_anti")
    check_lines = loose.select(*line("check_result", F.col("check"), F.col("person"), F.lit("ran the check"), F.when(F.col("cost").isNotNull(), "recorded by the check").otherwise("unknown"), F.col("cost")))
    ask_lines = asks.select(*line("ask_usage", F.col("ask"), F.col("person"), F.lit("asked"), F.when(F.col("priced"), "priced from tokens").otherwise("unknown (no price)"), F.col("cost")))
    return run_lines.unionByName(check_lines).unionByName(ask_lines)


def run_label(run: Column, said: Column, entity: Column, at: Column) -> Column:
    """struct(kind, trigger, run_group, label) of a run, from its key and description alone: what is not recorded is not guessed."""
    map_import = F.contains(said, F.lit("Explore and Map: "))
    checks = run.startswith("v2-review:")
    kind = (
        F.when(run.startswith("actor-update:"), "actor_updates")
        .when(run.startswith("datafeed:") & ~map_import, "data_feed")
        .when(checks, "map_checks")
        .otherwise(F.concat(F.lit("discovery_"), F.when(entity == "actor", "actors").when(entity == "event", "events").otherwise("people")))
    )
    both = F.lower(F.concat_ws(" ", said, run))
    trigger = F.when(F.contains(both, F.lit("migration")) | F.contains(both, F.lit("existing_canonical")), "migration").when(F.contains(both, F.lit("subscription")), "subscription").when(both.rlike("schedule|weekly|monthly"), "scheduled_event").otherwise("manual")
    asked = F.trim(F.regexp_extract(said, r"^Discovery request:\s*(.+?)\s*(·|$)", 1))
    name = F.when(checks, "Map checks").when(run.startswith("datafeed:"), F.regexp_replace(said, r" · (manual entry|[^·]+\.(xlsx|xlsm|xls|csv))$", "")).when(asked != "", asked).otherwise(said)
    return F.struct(kind.alias("kind"), trigger.alias("trigger"), F.when(checks, "map-checks").otherwise(run).alias("run_group"), F.concat_ws(" · ", name, F.date_format(at, "MM/dd/yyyy")).alias("label"))


def import_operations(runs: DataFrame, completions: DataFrame, owners: DataFrame) -> DataFrame:
    """source, reference, person, because, basis, cost of imports: runs (run, status, cost) go to who started the completion (run, person), else to who owns the import (run, person)."""
    j = runs.join(completions.select("run", F.col("person").alias("_started")), "run", "left").join(owners.select("run", F.col("person").alias("_owner")), "run", "left")
    because = F.when(F.col("_started").isNotNull(), "started the completion").when(F.col("_owner").isNotNull(), "owns the import")
    return j.select(F.lit("scrape_run").alias("source"), F.col("run").alias("reference"), F.coalesce("_started", "_owner", F.lit(-1)).cast("bigint").alias("person"), because.alias("because"), basis(F.col("status")).alias("basis"), F.round("cost", 2).alias("cost"))


def map_operations(runs: DataFrame, calls: DataFrame, searches: DataFrame, owners: DataFrame) -> DataFrame:
    """source, reference, person, because, basis, cost of maps and people searches: what their calls cost and what open calls hold in reserve, in millionths.

    runs: run, status, search (whether it is a people search); calls: run, cost, reserved (millionths), finished; searches: run, person; owners: run, person. A run without calls has no line. Open reserves make an estimate.
    """
    held = F.sum(F.when(F.col("cost").isNull() & ~F.col("finished"), F.col("reserved")).otherwise(0))
    spent = calls.groupBy("run").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("_cost"), held.alias("_held"))
    j = runs.join(spent, "run").join(searches.select("run", F.col("person").alias("_searcher")), "run", "left").join(owners.select("run", F.col("person").alias("_owner")), "run", "left")
    person = F.when(F.col("search"), F.col("_searcher")).otherwise(F.col("_owner"))
    because = F.when(person.isNotNull(), F.when(F.col("search"), "started the search").otherwise("owns the map"))
    how = F.when(F.col("_held") > 0, "estimate (calls still running)").otherwise(basis(F.col("status")))
    return j.select(F.lit("map_calls").alias("source"), F.col("run").alias("reference"), F.coalesce(person, F.lit(-1)).cast("bigint").alias("person"), because.alias("because"), how.alias("basis"), F.round((F.col("_cost") + F.col("_held")) / 1e6, 6).alias("cost"))
