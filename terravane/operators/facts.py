"""The fact ledger: folding appended facts, current values, comparing and verifying values, planning what to collect."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HUMAN_PREFIXES = ("human", "reviewer", "editor")
FOLDED = "id bigint, outcome string, current_id bigint"


def creator_class(origin: Column, name: Column) -> Column:
    named = F.lit(False)
    for p in HUMAN_PREFIXES:
        named = named | F.lower(name).startswith(p)
    return F.when((origin == "manual") | named, "human").otherwise("agent")


def fold_step(current: dict | None, fact: dict) -> str:
    """Outcome of one fact against the current one of its key: the rules in order."""
    if current is None:
        return "accepted"
    if fact["hash"] == current["hash"]:
        return "corroborated"
    if current["human"]:
        return "pending_update"
    if fact["confidence"] >= current["confidence"] and fact["read_at"] > current["read_at"]:
        return "superseded"
    return "conflict_flagged"


def fold(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """id, outcome, current_id for every fact in order of arrival; ties by id.

    facts: keys, id, hash, confidence, read_at, human, arrived. The fold is sequential within a key by meaning; keys of
    any number of facts stream through in Arrow batches sorted by the shuffle, and only the current fact is held.
    """
    kept = facts.select(*keys, "id", "hash", "confidence", "read_at", "human", "arrived")
    ordered = kept.repartition(*keys).sortWithinPartitions(*keys, "arrived", "id")
    n = len(keys)

    def run(frames):
        at, current = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if at != row[:n]:
                    at, current = row[:n], None
                fact = {"id": row[n], "hash": row[n + 1], "confidence": row[n + 2], "read_at": row[n + 3], "human": row[n + 4]}
                outcome = fold_step(current, fact)
                if outcome in ("accepted", "superseded"):
                    current = fact
                out.append((fact["id"], outcome, current["id"]))
            yield pd.DataFrame(out, columns=["id", "outcome", "current_id"])

    return ordered.mapInPandas(run, FOLDED)


def current(facts: DataFrame, keys: Sequence[str], order: Sequence[str], states: Sequence[str], state: str) -> DataFrame:
    """The newest fact of each key in one of the states."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return facts.where(F.col(state).isin(*states)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def entries(facts: DataFrame, keys: Sequence[str], at: str, value: str, today: Column, most: int = 10, days: int = 730) -> DataFrame:
    """keys, entries: newest values first, at most `most`, none older than `days` unless all are."""
    rows = facts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))), asc=False).alias("e"))
    fresh = F.filter("e", lambda x: F.datediff(today, x["at"]) <= days)
    return rows.select(*keys, F.transform(F.slice(F.when(F.size(fresh) > 0, fresh).otherwise(F.col("e")), 1, most), lambda x: x["value"]).alias("entries"))


#: Words that say nothing of a value.
FACT_STOP = ("the", "and", "for", "with", "from", "that", "this", "its", "are", "was", "has", "have")


def numbers_of(value: Column) -> Column:
    """Distinct figures of a text, without thousands separators or a closing mark."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"([0-9][0-9,.]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), "[.]+$", ""))))


def fact_words(value: Column) -> Column:
    """Distinct words of three letters or more that are no figures."""
    found = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9&]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*FACT_STOP) & ~w.rlike("^[0-9]+$")))


def same_text(a: Column, b: Column, share: float = 0.7) -> Column:
    """Equal figures, and the share of the shorter text's words is in the other; texts without words are the same by their figures."""
    x, y, n = fact_words(a), fact_words(b), numbers_of(a)
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return (n == numbers_of(b)) & F.when(none, (F.size(n) > 0) | ((F.size(x) == 0) & (F.size(y) == 0))).otherwise(T.containment(x, y) >= share)


def covers(wide: Column, narrow: Column, share: float = 0.7) -> Column:
    """Every figure of the second text and the share of its words is in the first; an empty text is covered by none."""
    n, w = numbers_of(narrow), fact_words(narrow)
    within = F.size(F.array_intersect(w, fact_words(wide))) >= share * F.size(w)
    return (F.size(F.array_except(n, numbers_of(wide))) == 0) & ((F.size(n) > 0) | (F.size(w) > 0)) & within


def part_outcome(old: Column, new: Column) -> Column:
    """What a new reading says of one part: additional, confirmed, changed, not_restated, or null for two empty values."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fuller = same_text(old, new) & covers(new, old) & (F.size(fact_words(new)) > F.size(fact_words(old)))
    return (
        F.when(empty(old) & empty(new), F.lit(None))
        .when(empty(new), "not_restated")
        .when(empty(old) | fuller, "additional")
        .when(same_text(old, new) | covers(old, new), "confirmed")
        .when(covers(new, old), "additional")
        .otherwise("changed")
    )


def compared_text(old: Column, new: Column, descriptive: Column) -> Column:
    """struct(outcome, merged) of two plain values: corroborated keeps the recorded one; additional and changed take the new one.

    A descriptive value with equal figures and half of the shorter wording in common, or 0.6 of whose new wording is recorded, is corroborated.
    """
    x, y = fact_words(old), fact_words(new)
    alike = (numbers_of(old) == numbers_of(new)) & (F.size(x) > 0) & (F.size(y) > 0) & (T.containment(x, y) >= 0.5)
    known = (descriptive & (alike | covers(old, new, 0.6))) | same_text(old, new) | covers(old, new)
    outcome = F.when(known, "corroborated").when(covers(new, old), "additional").otherwise("changed")
    return F.struct(outcome.alias("outcome"), F.when(known, old).otherwise(new).alias("merged"))


def compared_lists(old: Column, new: Column) -> Column:
    """struct(outcome, added, merged): items of a new list that no recorded item states are added; nothing recorded goes."""
    old, new = F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))
    added = F.filter(new, lambda i: ~F.exists(old, lambda o: same_text(i, o)))
    return F.struct(F.when(F.size(added) > 0, "additional").otherwise("corroborated").alias("outcome"), added.alias("added"), F.concat(old, added).alias("merged"))


def compared_parts(old: dict[str, Column], new: dict[str, Column], profile: Column) -> Column:
    """struct(outcome, parts, merged): part by part; in a profile what a reading does not restate is kept, elsewhere a changed part replaces the value whole."""
    parts = {k: part_outcome(old[k], new[k]) for k in old}
    outcomes = F.array(*[F.struct(F.lit(k).alias("part"), o.alias("outcome")) for k, o in parts.items()])
    said = F.filter(outcomes, lambda p: p["outcome"].isNotNull())
    some = lambda o: F.exists(said, lambda p: p["outcome"] == o)
    changed, added = some("changed"), some("additional")
    keep = lambda k: F.when(parts[k].isin("confirmed", "not_restated"), old[k]).otherwise(F.coalesce(new[k], old[k]))
    whole = changed & ~profile
    merged = F.struct(*[F.when(~changed & ~added, old[k]).when(whole, new[k]).otherwise(keep(k)).alias(k) for k in old])
    return F.struct(F.when(changed, "changed").when(added, "additional").otherwise("corroborated").alias("outcome"), said.alias("parts"), merged.alias("merged"))


def supported(value: Column, quote: Column, share: float = 0.6) -> Column:
    """All figures of the value are in the quote, and the share of its words; a value without words is held by its figures alone."""
    n, w = numbers_of(value), fact_words(value)
    return (F.size(F.array_except(n, numbers_of(quote))) == 0) & F.when(F.size(w) == 0, F.size(n) > 0).otherwise(F.size(F.array_intersect(w, fact_words(quote))) >= share * F.size(w))


def supported_items(items: Column, quote: Column) -> Column:
    """struct(kept, dropped): the items of a list that the quote backs, and the others."""
    return F.struct(F.filter(items, lambda i: supported(i, quote)).alias("kept"), F.filter(items, lambda i: ~supported(i, quote)).alias("dropped"))


def planned(schema: DataFrame, entities: DataFrame, held: DataFrame, today: Column, days: int = 365) -> DataFrame:
    """entity, field, reason for every field that is missing or outdated: fields of the schema times entities, less what is fresh.

    schema: field (a short list, gathered into one row); held: entity, field, read_on.
    """
    fields = schema.agg(F.array_sort(F.collect_set("field")).alias("fields"))
    grid = entities.select("entity").join(F.broadcast(fields), F.lit(True)).select("entity", F.explode("fields").alias("field"))
    joined = grid.join(held.groupBy("entity", "field").agg(F.max("read_on").alias("read_on")), ["entity", "field"], "left")
    reason = F.when(F.col("read_on").isNull(), "missing").when(F.datediff(today, F.col("read_on")) > days, "outdated")
    return joined.select("entity", "field", reason.alias("reason")).where("reason IS NOT NULL")


def verified(value: Column, quote: Column, page: Column) -> Column:
    """The value if its quote is on the page, else null."""
    return F.when((F.coalesce(F.trim(quote), F.lit("")) != "") & T.quote_on_page(quote, page), value)


def verified_items(items: Column, quote: Column, page: Column, least: int = 4) -> Column:
    """struct(kept, dropped): list items that the page states, whole or up to their first comma, or all of whose words of `least` letters a quote on the page says."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    longer = lambda i: F.filter(words(i), lambda w: F.length(w) >= least)

    def told(g: Column) -> Column:
        """The items with whether each holds, given the page (plain, and its words) once."""
        on_page = lambda c: T.quote_on_plain(c, g["page"], g["words"])
        backed = F.when((F.coalesce(F.trim(quote), F.lit("")) != "") & on_page(quote), quote).otherwise("")
        said = F.filter(F.transform(items, lambda i: F.trim(i)), lambda i: i != "")

        def held(own: Column) -> Column:
            said_all = lambda i: (F.size(longer(i)) > 0) & (F.size(F.array_except(longer(i), own)) == 0)
            holds = lambda i: F.coalesce(on_page(i) | on_page(F.split_part(i, F.lit(","), F.lit(1))) | said_all(i), F.lit(False))
            return F.transform(said, lambda i: F.struct(i.alias("item"), holds(i).alias("holds")))

        return _given(words(backed), held)

    def parted(every: Column) -> Column:
        of = lambda kept: F.transform(F.filter(every, lambda x: x["holds"] == F.lit(kept)), lambda x: x["item"])
        return F.struct(of(True).alias("kept"), of(False).alias("dropped"))

    pages = _given(T.plain(page), lambda p: F.struct(p.alias("page"), T.words(p).alias("words")))
    return _given(_given(pages, told), parted)


def _given(value: Column, then) -> Column:
    """then(value), where the value is computed once for a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def grounded(value: Column, page: Column) -> Column:
    """The sentences of the value that the page states, joined; empty if none."""
    return F.array_join(F.filter(T.sentences(T.collapsed(value)), lambda s: T.quote_on_page(s, page)), " ")
