"""Curation: row checks, duplicates inside a file, batches already imported, taxonomies, sheets with sections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(df: DataFrame, rules: Sequence[tuple[str, Column]], row: str = "row_number", name: str = "errors") -> DataFrame:
    """df with an array of messages "Row n: ..." of the rules that fail; a rule's column is true where the row is wrong."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit("Row "), F.col(row).cast("string"), F.lit(f": {message}"))) for message, bad in rules]
    return df.withColumn(name, F.array_compact(F.array(*found)))


def required(column: str) -> tuple[str, Column]:
    return f"{column} is required", F.coalesce(F.trim(column), F.lit("")) == ""


def longer(column: str, most: int) -> tuple[str, Column]:
    return f"{column} is longer than {most} characters", F.length(column) > most


def not_one_of(column: str, allowed: Sequence[str]) -> tuple[str, Column]:
    return f"{column} is not one of the allowed values", F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def file_duplicates(rows: DataFrame, file: str, row: str, keys: str, valid: str) -> DataFrame:
    """row, duplicate_of: in file order, a valid row whose keys one before it owns; a duplicate owns none of its keys.

    The scan is sequential in a file by meaning, and files are capped on upload, so a file is one task.
    """

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        owner, out = {}, []
        for n, own, ok in sorted(zip(frame[row], frame[keys], frame[valid]), key=lambda x: x[0]):
            hit = next((owner[k] for k in own if k in owner), None) if ok else None
            if ok and hit is None:
                owner.update((k, n) for k in own)
            out.append((n, hit))
        return pd.DataFrame(out, columns=["row", "duplicate_of"]).astype({"duplicate_of": "Int64"})

    return rows.select(file, row, keys, valid).groupBy(file).applyInPandas(scan, "row bigint, duplicate_of bigint")


def exact_duplicates(rows: DataFrame, key: str, name: str, site: str) -> DataFrame:
    """rows with by_name and by_site: the least key of a row of the same name in lower case, and of the same address; null where the row has none.

    A duplicate is a row with a lesser one. Two aggregates joined back: each row tells its group's least key, so a group of any size costs its rows, not its pairs.
    """
    by_name = rows.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_n")).agg(F.min(key).alias("by_name"))
    by_site = rows.where(F.col(site).isNotNull()).groupBy(F.col(site).alias("_s")).agg(F.min(key).alias("by_site"))
    return rows.withColumn("_n", F.lower(name)).withColumn("_s", F.col(site)).join(by_name, "_n", "left").join(by_site, "_s", "left").drop("_n", "_s")


def batch_state(rows: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """rows with state new or already imported, by the digest of the key."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    held = imported.select(digest.alias("_digest")).distinct().withColumn("_held", F.lit(True))
    joined = rows.withColumn("_digest", digest).join(held, "_digest", "left")
    return joined.withColumn("state", F.when(F.col("_held"), "already imported").otherwise("new")).drop("_digest", "_held")


def valid_pairs(rows: DataFrame, pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with valid_pair: whether the values of the columns occur together in the taxonomy."""
    known = pairs.select(*columns).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, list(columns), "left").withColumn("valid_pair", F.col("_known").isNotNull()).drop("_known")


def sectioned(rows: DataFrame, sheet: Sequence[str], order: str, is_header: Column, title: Column) -> DataFrame:
    """Rows that are no headers, with the title of the last header above them."""
    w = Window.partitionBy(*sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_header", is_header).withColumn("section", F.last(F.when(is_header, title), ignorenulls=True).over(w))
    return marked.where("NOT _header").drop("_header")


def quarantined(rows: DataFrame, field: str, allowed: Sequence[str], row: str) -> tuple[DataFrame, DataFrame]:
    """(rows with other values nulled, the log of what was nulled: row, field, raw_value, reason)."""
    bad = F.col(field).isNotNull() & ~F.col(field).isin(*allowed)
    log = rows.where(bad).select(row, F.lit(field).alias("field"), F.col(field).alias("raw_value"), F.lit("not an allowed value").alias("reason"))
    return rows.withColumn(field, F.when(~bad, F.col(field))), log


def narrative_items(text: Column) -> Column:
    """Lines of a narrative without bullets, those with letters and at least two words."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s•*–-]+", "")))
    return F.filter(lines, lambda x: x.rlike("[A-Za-z].* .*[A-Za-z]"))


def resolved_name(df: DataFrame, names: DataFrame, typed: str, known: str) -> DataFrame:
    """df with resolved: the known name of the same slug, else the only one that begins with it."""
    from ..functions.text import slugify

    own = names.select(F.col(known).alias("_name"), slugify(F.col(known)).alias("_slug")).distinct()
    keyed = df.withColumn("_typed", slugify(F.col(typed)))
    exact = own.groupBy("_slug").agg(F.min("_name").alias("_exact"))
    prefixes = own.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("_slug")), lambda i: F.substring("_slug", 1, i))).alias("_typed"))
    only = prefixes.groupBy("_typed").agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("_prefix")).where("_n = 1").drop("_n")
    out = keyed.join(exact, F.col("_typed") == F.col("_slug"), "left").join(only, "_typed", "left")
    return out.withColumn("resolved", F.coalesce("_exact", "_prefix")).drop("_typed", "_slug", "_exact", "_prefix")


def field_errors(rows: DataFrame, values: dict[str, Column], fields: Sequence[dict], name: str = "errors") -> DataFrame:
    """rows with the messages of their cells against a contract of fields, in order: formulas, lengths and required cells first, then addresses, dates and lists of values.

    A field: key, header, kind (text, url, date, enum), required, most (length), allowed. A cell that starts like a formula is treated as empty. Cells are
    cleaned in a projection of their own, so each is cleaned once however many rules read it.
    """
    from ..functions import dates as D
    from ..functions import text as T
    from ..functions import urls as U

    cleaned = rows.select("*", *[F.trim(F.regexp_replace(F.coalesce(values[f["key"]], F.lit("")), r"\s+", " ")).alias(f"_c_{f['key']}") for f in fields])
    first, second = [], []
    for f in fields:
        cell, head = F.col(f"_c_{f['key']}"), f["header"]
        formula = T.formula_like(cell)
        sound = ~formula & (cell != "")
        first.append(F.when(formula, F.concat(F.lit(f"{head} starts like a formula ('"), F.substring(cell, 1, 12), F.lit("...'). Type the value itself."))))
        if f.get("most"):
            first.append(F.when(~formula & (F.length(cell) > f["most"]), F.lit(f"{head} is longer than {f['most']} characters.")))
        if f.get("required"):
            first.append(F.when(cell == "", F.lit(f"{head} is required.")))
        if f["kind"] == "url":
            second.append(F.when(sound & U.typed(cell).isNull(), F.lit(f"{head} is not a web address.")))
        elif f["kind"] == "date":
            second.append(F.when(sound & D.us_date(cell).isNull(), F.concat(F.lit(f"{head} '"), cell, F.lit("' is not a date: use MM/DD/YYYY."))))
        elif f["kind"] == "enum":
            known = [a.lower().replace(" ", "").replace("_", "").replace("-", "") for a in f["allowed"]]
            second.append(F.when(sound & ~F.regexp_replace(F.lower(cell), r"[\s_-]+", "").isin(*known), F.concat(F.lit(f"{head} '"), cell, F.lit("' is not an allowed value."))))
    return cleaned.withColumn(name, F.array_compact(F.array(*first, *second))).drop(*[f"_c_{f['key']}" for f in fields])


def cross_errors(rows: DataFrame, rules: Sequence[tuple], row: str, name: str = "errors") -> DataFrame:
    """rows with the messages "Row n: ..." of the rules that cells break together, in order; blank cells are empty.

    A rule is (kind, columns, message) with further values: ("one of", columns, message): one at least is filled; ("both", (a, b), message): both or neither; ("only for", (a, b), message, values): a only where b is one of the
    values; ("needed for", (a, b), message, values): a wherever b is one; ("pair", (a, b), message, pairs): a pair of the list, where both are filled; ("derived", (a,), message, column): a is what the column derives, where it
    derives something; ("sentences", (a,), message, (low, high)): so many sentences, where filled.
    """
    from ..functions import text as T

    said = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    filled = lambda c: said(c) != ""
    found = []
    for kind, columns, message, *more in rules:
        a, b = columns[0], columns[1] if len(columns) > 1 else None
        wrong = {
            "one of": lambda: ~reduce(lambda x, y: x | y, map(filled, columns)),
            "both": lambda: filled(a) != filled(b),
            "only for": lambda: filled(a) & ~said(b).isin(*more[0]),
            "needed for": lambda: ~filled(a) & said(b).isin(*more[0]),
            "pair": lambda: filled(a) & filled(b) & ~F.concat(said(a), F.lit("\n"), said(b)).isin(*["\n".join(p) for p in more[0]]),
            "derived": lambda: filled(a) & (F.trim(more[0]) != "") & (said(a) != F.trim(more[0])),
            "sentences": lambda: filled(a) & ~F.size(T.sentences(said(a))).between(*more[0]),
        }[kind]()
        found.append((message, wrong))
    return checked(rows, found, row, name)


def resolved_hub(rows: DataFrame, hubs: DataFrame, typed: str, name: str) -> DataFrame:
    """rows with resolved: the hub of the same slug, else the only one whose slug begins the other's either way, else the only one whose name is inside the other's either way.

    Distinct typed names meet hubs by equi-joins: prefixes of slugs for the first two rules, runs of words for the last, so a name inside another is met at word borders.
    """
    from ..functions.text import plain, slugify, words

    own = hubs.select(F.col(name).alias("_hub"), slugify(F.col(name)).alias("_slug"), plain(F.col(name)).alias("_plain")).distinct()
    asked = rows.select(F.col(typed).alias("_typed")).where("trim(_typed) <> ''").distinct().select("_typed", slugify(F.col("_typed")).alias("_tslug"), plain(F.col("_typed")).alias("_tplain"))
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))
    exact = asked.join(own, F.col("_tslug") == F.col("_slug")).groupBy("_typed").agg(F.min("_hub").alias("_exact"))
    short = asked.join(own.withColumn("_p", F.explode(starts(F.col("_slug")))), F.col("_tslug") == F.col("_p")).select("_typed", "_hub")
    long = asked.withColumn("_p", F.explode(starts(F.col("_tslug")))).join(own, F.col("_p") == F.col("_slug")).select("_typed", "_hub")
    only = lambda pairs, out: pairs.distinct().groupBy("_typed").agg(F.count(F.lit(1)).alias("_n"), F.min("_hub").alias(out)).where("_n = 1").drop("_n")

    def runs(c):
        ws = words(c)
        n = F.size(ws)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i, F.lit(1))), lambda k: F.array_join(F.slice(ws, i + 1, k), " ")))))

    inside = asked.join(own.withColumn("_r", F.explode(runs(F.col("_plain")))), F.col("_tplain") == F.col("_r")).select("_typed", "_hub")
    around = asked.withColumn("_r", F.explode(runs(F.col("_tplain")))).join(own, F.col("_r") == F.col("_plain")).select("_typed", "_hub")
    found = asked.select("_typed").join(exact, "_typed", "left").join(only(short.union(long), "_prefix"), "_typed", "left").join(only(inside.union(around), "_inner"), "_typed", "left")
    found = found.select("_typed", F.coalesce("_exact", "_prefix", "_inner").alias("resolved"))
    return rows.join(found, rows[typed] == F.col("_typed"), "left").drop("_typed")


def section_tree(rows: DataFrame, sheet: Sequence[str], order: str, level: Column, title: Column) -> DataFrame:
    """Rows that are no markers, with parent: the path of the last marker of every level above them, "Top / Sub", and synthetic, whether a marker gave it.

    level: 1 or 2 on a marker row, null on others; a marker of level 1 ends the section of level 2.
    """
    w = Window.partitionBy(*sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_level", level).withColumn("_title", title)
    marked = marked.withColumn("_top", F.last(F.when(F.col("_level") == 1, F.struct(F.col(order).alias("o"), "_title")), ignorenulls=True).over(w)).withColumn("_sub", F.last(F.when(F.col("_level") == 2, F.struct(F.col(order).alias("o"), "_title")), ignorenulls=True).over(w))
    live = F.when(F.col("_top").isNull() | (F.col("_sub.o") > F.col("_top.o")), F.col("_sub._title"))
    out = marked.where("_level IS NULL").withColumn("parent", F.nullif(F.concat_ws(" / ", F.col("_top._title"), live), F.lit("")))
    return out.withColumn("synthetic", F.col("parent").isNotNull()).drop("_level", "_title", "_top", "_sub")


def narrative_lines(rows: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """key, group, line, name: the lines of a narrative without bullets, blank ones left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t\r\f\x0B•*–-]+", "")))
    return rows.select(key, group, F.posexplode(lines).alias("line", "name")).where("name <> ''")


def upsert_by_name(held: DataFrame, rows: DataFrame, name: str, order: str, fields: Sequence[str]) -> DataFrame:
    """key, name, fields, state: held records with the filled fields of rows of the same name over theirs, the last filled one in order; new names are added."""
    from ..functions.text import plain

    key = plain(F.col(name))
    at = lambda c: F.max(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.struct(order, F.col(c).alias("v"))))["v"].alias(c)
    newest = rows.withColumn("_key", key).where("_key <> ''").groupBy("_key").agg(at(name).alias("_name"), *[at(c).alias(f"_{c}") for c in fields])
    base = held.select(key.alias("_key"), F.col(name), *fields, F.lit(True).alias("_held"))
    joined = base.join(newest, "_key", "full")
    state = F.when(F.col("_held").isNull(), "inserted").when(F.col("_name").isNull(), "kept").otherwise("updated")
    return joined.select(F.col("_key").alias("key"), F.coalesce(name, "_name").alias(name), *[F.coalesce(f"_{c}", c).alias(c) for c in fields], state.alias("state"))


def validated(rows: DataFrame, row: str, ranges: dict[str, tuple[int, int]], lists: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows with values outside their range or list nulled, the log: row, field, raw_value, reason), both from one pass over the fields."""
    good = {c: F.trim(F.col(c).cast("string")).try_cast("int").between(*b) for c, b in ranges.items()} | {c: F.lower(F.trim(c)).isin(*[v.lower() for v in vs]) for c, vs in lists.items()}
    why = {c: f"not a whole number from {b[0]} to {b[1]}" for c, b in ranges.items()} | {c: "not an allowed value" for c in lists}
    bad = {c: F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False)) for c, ok in good.items()}
    entry = lambda c: F.when(bad[c], F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw_value"), F.lit(why[c]).alias("reason")))
    log = rows.select(row, F.explode(F.array_compact(F.array(*map(entry, good)))).alias("e")).select(row, "e.*")
    return rows.withColumns({c: F.when(~bad[c], F.col(c)) for c in good}), log


def best_headers(rows: DataFrame, sheet: str, order: str, cells: str, known: Sequence[str], first: int = 8) -> DataFrame:
    """sheet, header_row, fields: of a sheet's first rows the one that names the most known headers, the first of equals; headers compare by letters and digits."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    wanted = F.array(*[F.lit("".join(x for x in k.lower() if x.isalnum())) for k in known])
    place = Window.partitionBy(sheet).orderBy(order)
    top = rows.select(sheet, cells, F.row_number().over(place).alias("n")).where(F.col("n") <= first)
    found = F.array_intersect(F.transform(F.col(cells), lambda c: key(F.coalesce(c, F.lit("")))), wanted)
    best = top.withColumn("found", found).groupBy(sheet).agg(F.max(F.struct(F.size("found").alias("k"), (-F.col("n")).alias("n"), F.array_sort("found").alias("fields"))).alias("b"))
    return best.where("b.k > 0").select(sheet, (-F.col("b.n")).alias("header_row"), F.array_join("b.fields", ",").alias("fields"))


def folded_themes(value: Column, separator: str, names: dict[str, str]) -> Column:
    """Sorted distinct themes of a cell, in lower case, each under the name it folds to."""
    def folded(w):
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for k, v in names.items():
            out = out.when(w == k, F.lit(v))
        return out.otherwise(w)

    parts = F.filter(F.transform(F.split(F.lower(value), separator), lambda w: F.trim(w)), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(parts, folded)))
