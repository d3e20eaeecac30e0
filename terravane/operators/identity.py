"""Identity rules: what two names tell, what routes a record to a held one, what two records of a map are to each other.

Each record is turned into columns of its own once (names, words, initials, hosts), and rules are expressions over a pair of them. Pairs come
from equi-joins on keys that a rule needs equal (a host, a name, a word, a date); edit ratios run last, on pairs that earlier
rules left open.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.shared import fresh_path, stored
from .graph import strongest_first
from .similarity import edit_join, edit_pairs, overlap_pairs, subset_pairs

#: Words without identity, words that tell institutions apart, states and regions, parts of an organization, words that only
#: add structure, short forms, and numbers in words.
STRUCTURAL = (
    "university", "univ", "of", "the", "at", "in", "and", "for", "a", "an", "department", "dept", "school", "college", "center", "centre",
    "institute", "laboratory", "laboratories", "lab", "labs", "program", "programs", "division", "office", "group", "inc", "llc", "ltd",
    "corporation", "corp", "company", "co",
)
QUALIFIERS = (
    "state", "tech", "technical", "technological", "technology", "polytechnic", "poly", "community", "southern", "northern", "eastern", "western",
    "central", "north", "south", "east", "west", "upper", "lower", "greater", "national", "international", "american", "royal", "federal",
)
PLACES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "ohio", "oklahoma", "oregon", "pennsylvania", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "wisconsin", "wyoming", "midwest", "midwestern", "northeast", "southeast", "southwest", "northwest", "pacific", "atlantic", "gulf",
    "appalachian", "rockies",
)
PARTS = (
    "department", "dept", "school", "college", "center", "centre", "institute", "lab", "labs", "laboratory", "laboratories", "program", "programs",
    "division", "faculty", "erg", "chemistry", "engineering", "physics", "biology", "medicine", "campus", "branch", "office", "initiative",
    "initiatives", "group", "unit", "facility", "facilities", "complex", "project", "projects", "health", "hospital", "clinic",
)
ONLY_STRUCTURE = ("department", "dept", "of", "the", "at", "and", "for", "in")
SHORT_FORMS = {
    "r&d": "research", "rd": "research", "dept": "department", "sci": "science", "tech": "technology", "eng": "engineering", "natl": "national",
    "intl": "international", "univ": "university", "inst": "institute", "med": "medical", "ctr": "center", "lab": "laboratory",
}
NUMBERS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5}
INITIAL_STOP = ("of", "the", "and", "for", "at", "in", "&")
UNIT_PATH = r"(?i)(^|/)(centers?|centres?|institutes?|labs?|laborator(y|ies)|departments?|schools?|colleges?|programs?|initiatives?)(/|$)"
CLOSE_NAME, REORDERED, POSSIBLE, LEAST_ALIAS, NEAR_DAYS = 85, 95, 90, 4, 7
SAME_DAY_TITLE, SAME_YEAR_TITLE, LOW = 0.88, 0.9, 0.35
WHOLE = r"(university|clinic|hospital|corporation|corp|company|inc|laboratory)$"


def listed(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def mapped(word: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(word == k, F.lit(v))
    return out.otherwise(word)


def folded_plural(word: Column) -> Column:
    long = F.length(word) > 3
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(long & word.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(long & word.endswith("es") & ~word.endswith("ses"), cut(2)).when(long & word.endswith("s"), cut(1)).otherwise(word)


def described(names: DataFrame, name: str) -> DataFrame:
    """names with what the pair rules read: _norm, _words (distinct), _n, _content, _initials, _numbers, _whole."""
    norm = T.norm_with_ampersand(F.col(name))
    words = T.words(F.col("_norm"))
    content = F.filter(F.transform(words, lambda w: mapped(w, SHORT_FORMS)), lambda w: ~w.isin(*STRUCTURAL))
    initials = F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(*INITIAL_STOP)), lambda w: F.substring(w, 1, 1)), "")
    numbers = F.transform(F.filter(words, lambda w: w.rlike("^[0-9]+$") | w.isin(*NUMBERS)), lambda w: mapped(w, {k: str(v) for k, v in NUMBERS.items()}).cast("int"))
    bare = T.plain(F.regexp_replace(F.col(name), r"\([^)]*\)", " "))
    return (
        names.withColumn("_norm", norm)
        .withColumn("_words", F.array_distinct(words))
        .withColumn("_n", F.size(words))
        .withColumn("_content", F.array_distinct(F.transform(content, folded_plural)))
        .withColumn("_initials", initials)
        .withColumn("_numbers", F.array_sort(F.array_distinct(numbers)))
        .withColumn("_whole", bare.rlike("^(university|univ)( |$)") | bare.rlike("(^| )" + WHOLE))
    )


DESCRIBED = ("_norm", "_words", "_n", "_content", "_initials", "_numbers", "_whole")


def name_pairs(names: DataFrame, name: str, blocks: Column) -> DataFrame:
    """a, b and for both sides the described columns with _a and _b: distinct names that share a block, each pair once, a before b."""
    rows = described(names.select(name).distinct(), name)
    keyed = rows.withColumn("_block", F.explode(F.array_distinct(blocks)))
    side = lambda s: keyed.select("_block", F.col(name).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in DESCRIBED])
    return side("a").join(side("b"), "_block").where("a < b").drop("_block").dropDuplicates(["a", "b"])


def short_of(words: str) -> Column:
    """One side is a single word that is the other's initials or one of its words."""
    a, b = (F.col(f"{words}_{s}") for s in "ab")
    one = lambda short, ws, long: F.when(F.size(ws) == 1, (F.get(ws, F.lit(0)) == F.col(f"_initials_{long}")) | F.array_contains(F.col(f"{words}_{long}"), F.get(ws, F.lit(0)))).otherwise(False)
    return F.when(F.col("_n_a") < F.col("_n_b"), one("a", a, "b")).otherwise(one("b", b, "a"))


def hierarchy() -> Column:
    """1 where one name is a part of the other's organization: its words go beyond the other's by more than structure, and the other is a whole, or a part word is new."""

    def side(small, big):
        x, y = F.col(f"_words_{small}"), F.col(f"_words_{big}")
        added = F.array_except(y, x)
        strict = (F.size(F.array_except(x, y)) == 0) & (F.size(added) > 0)
        structure = F.size(F.array_except(added, listed(ONLY_STRUCTURE))) == 0
        part = F.arrays_overlap(added, listed(PARTS)) & ~F.arrays_overlap(x, listed(PARTS))
        return F.when(strict, F.when(structure, 0).when(F.col(f"_whole_{small}") | part, 1).otherwise(0))

    empty = (F.size("_words_a") == 0) | (F.size("_words_b") == 0)
    return F.when(empty, 0).otherwise(F.coalesce(side("a", "b"), side("b", "a"), F.lit(0)))


def mismatches() -> dict[str, Column]:
    """The six mismatch features of a pair of name_pairs(); all nought for a short form of the other."""
    of = lambda words: [F.array_sort(F.array_intersect(F.col(f"_words_{s}"), listed(words))) for s in "ab"]
    (qa, qb), (pa, pb) = of(QUALIFIERS), of(PLACES)
    only_a, only_b = F.array_except("_content_a", "_content_b"), F.array_except("_content_b", "_content_a")
    features = {
        "qualifier": qa != qb,
        "unique_both": (F.size(only_a) > 0) & (F.size(only_b) > 0),
        "unique_count": F.least(F.size(only_a) + F.size(only_b), F.lit(5)),
        "numeric": F.col("_numbers_a") != F.col("_numbers_b"),
        "place": (F.size(pa) > 0) & (F.size(pb) > 0) & ~F.arrays_overlap(pa, pb),
        "hierarchy": hierarchy(),
    }
    return {k: F.when(short_of("_words"), 0).otherwise(c.cast("int")) for k, c in features.items()}


def edge_class(a: Column, b: Column, share: float = 0.6) -> Column:
    """merge, hierarchy or review for a confirmed pair of name_pairs().

    A short form in capitals (or equal initials) merges; so do names that differ in brackets alone and names that add structure only. A
    name that adds more to a whole organization, or a part word, is below it. Else the share of common words decides.
    """
    caps = lambda n, w: n.rlike("^[^a-z]*[A-Z][^a-z]*$") & F.length(F.get(w, F.lit(0))).between(2, 8)
    first = F.col("_n_a") < F.col("_n_b")
    short, ws, long = F.when(first, a).otherwise(b), F.when(first, F.col("_words_a")).otherwise(F.col("_words_b")), F.when(first, F.col("_initials_b")).otherwise(F.col("_initials_a"))
    acronym = short_of("_words") & (caps(short, ws) | (F.get(ws, F.lit(0)) == long))
    bare = lambda n: T.plain(F.regexp_replace(n, r"\([^)]*\)", " "))
    brackets = (bare(a) == bare(b)) & (bare(a) != "")
    added = F.concat(F.array_except("_words_a", "_words_b"), F.array_except("_words_b", "_words_a"))
    subset = (F.size(F.array_except("_words_a", "_words_b")) == 0) | (F.size(F.array_except("_words_b", "_words_a")) == 0)
    structure = F.size(F.array_except(added, listed(ONLY_STRUCTURE))) == 0
    empty = (F.size("_words_a") == 0) | (F.size("_words_b") == 0)
    return (
        F.when(empty, "review")
        .when(acronym | brackets | (subset & structure & (F.size(added) > 0)), "merge")
        .when(hierarchy() == 1, "hierarchy")
        .when(T.jaccard(F.col("_words_a"), F.col("_words_b")) >= share, "merge")
        .otherwise("review")
    )


#: Records of a block that meet the others in one task.
HUB_PART = 500


def shared_hubs(rows: DataFrame, key: str, block: str, hubs: DataFrame, of: str, hub: str, part: int = HUB_PART) -> DataFrame:
    """a, b, hub_overlap with a < b: all pairs of records of a block, and 1 where both have a hub in common.

    The partners of a record come from the hubs of a block that several of its records have, and stand with it as one list. The records of a block are dealt into parts,
    each of which meets the block in a task, so its pairs are made in many tasks and no pair carries hubs.
    """
    own = rows.select(F.col(key).alias("k"), F.col(block).alias("_block")).where("k IS NOT NULL AND _block IS NOT NULL")
    each = hubs.select(F.col(of).alias("k"), F.col(hub).alias("_hub")).where("_hub IS NOT NULL").join(own, "k")
    several = each.groupBy("_block", "_hub").agg(F.collect_set("k").alias("_ks")).where(F.size("_ks") > 1).select("_block", F.explode("_ks").alias("a"), "_ks")
    partners = several.select("_block", "a", F.explode(F.filter("_ks", lambda k: k > F.col("a"))).alias("b")).groupBy("_block", "a").agg(F.collect_set("b").alias("_with"))
    sizes = own.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    dealt = own.join(sizes, "_block")
    tile = lambda i: F.concat_ws("=", i.cast("string"), "_block").alias("_tile")
    left = dealt.withColumnRenamed("k", "a").join(partners, ["_block", "a"], "left").select("a", "_with", tile(F.pmod(F.xxhash64("a"), "_parts")))
    right = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(F.col("k").alias("b"), tile(F.col("_i")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since few rows make many pairs and would be put into few tasks
    met = left.repartition(tasks, "_tile").join(right.repartition(tasks, "_tile"), "_tile").where("a < b")
    return met.select("a", "b", F.coalesce(F.array_contains("_with", F.col("b")), F.lit(False)).cast("int").alias("hub_overlap"))


# routing


def named(rows: DataFrame, key: str, name: str, others: str, form) -> DataFrame:
    """key, _name: every name of a record, its own and its alternates, in the form that names are compared in; blanks go."""
    every = F.concat(F.array(F.col(name)), F.coalesce(F.col(others), F.array().cast("array<string>")))
    return rows.select(key, F.explode(F.array_distinct(F.transform(every, form))).alias("_name")).where("_name <> ''")


def route_actors(rows: DataFrame, held: DataFrame, scores: DataFrame, low: float = LOW) -> DataFrame:
    """id, decision, rule, target, score for every record.

    rows: id, name, others (array), website; held: target, name, others, website; scores: id, target, score of close candidates. The
    same host is one match, "same_site_other_unit" where names and paths differ and a path is a unit's; else a shared name or alternate
    name is one. One match absorbs (another unit: review), several are a conflict for review. Else initials in common are for review, and
    else the best score is reviewed from `low` on; without one the record is new. A score alone never merges.
    """
    host, path = U.host(F.col("website")), F.regexp_replace(U.path(F.col("website")), "^/+|/+$", "")
    mine = rows.select("id", "name", "others", host.alias("_host"), path.alias("_path"))
    theirs = held.select("target", "name", "others", host.alias("_host"), path.alias("_path2"))
    by_name = named(mine, "id", "name", "others", T.plain).join(named(theirs, "target", "name", "others", T.plain), "_name").select("id", "target").distinct().withColumn("_same", F.lit(True))
    by_site = mine.where("_host <> ''").select("id", "_host", "_path").join(theirs.where("_host <> ''").select("target", "_host", "_path2"), "_host").select("id", "target", "_path", "_path2")
    unit = (F.col("_path") != F.col("_path2")) & (F.col("_path").rlike(UNIT_PATH) | F.col("_path2").rlike(UNIT_PATH))
    both = by_site.withColumn("_site", F.lit(True)).join(by_name, ["id", "target"], "full")
    rule = F.when(F.col("_site"), F.when(F.col("_same").isNull() & unit, "same_site_other_unit").otherwise("website_domain")).otherwise("name_or_alternate_name")
    exact = both.groupBy("id").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n"), F.min(rule).alias("rule"))
    words = lambda rs, k: rs.select(k, T.plain(F.col("name")).alias("_key"))
    initials = lambda rs, k: rs.select(k, T.acronym(F.col("name")).alias("_key")).where("_key <> ''")
    short = initials(mine, "id").join(words(theirs, "target"), "_key").union(words(mine, "id").join(initials(theirs, "target"), "_key"))
    short = short.groupBy("id").agg(F.min("target").alias("_short_target"))
    best = scores.groupBy("id").agg(F.max(F.struct("score", (-F.col("target")).alias("_t"))).alias("_best"))
    out = rows.select("id").join(exact, "id", "left").join(short, "id", "left").join(best, "id", "left")
    score = F.coalesce(F.col("_best.score"), F.lit(0.0))
    close = score >= low
    unit_only = (F.col("n") == 1) & (F.col("rule") == "same_site_other_unit")
    return out.select(
        "id",
        F.when(F.col("n") == 1, F.when(unit_only, "review").otherwise("absorb")).when(F.col("n") > 1, "review").when(F.col("_short_target").isNotNull(), "review").when(close, "review").otherwise("create").alias("decision"),
        F.when(F.col("n") == 1, F.col("rule")).when(F.col("n") > 1, "conflicting_exact_identity").when(F.col("_short_target").isNotNull(), "acronym").when(close, "score").alias("rule"),
        F.coalesce("target", "_short_target", F.when(close, -F.col("_best._t"))).alias("target"),
        F.when(F.col("n") == 1, F.when(unit_only, 0.9).otherwise(1.0)).when(F.col("n") > 1, 1.0).when(F.col("_short_target").isNotNull(), 0.9).otherwise(score).alias("score"),
    )


def route_events(rows: DataFrame, held: DataFrame) -> DataFrame:
    """id, decision, target, score: the natural key absorbs; a close title on the same day, or a closer one in the same year, is reviewed; else new.

    rows: id, key, title, day; held: target, key, title, day. Distinct titles are joined by spelling, and
    the pairs that are close enough meet by title and day or year. A title without letters or digits is close to none.
    Records of the same key, title and day are decided once, and held ones of the same title and day or year count as their least target, so copies never meet copies.
    """
    kinds = rows.select("key", "title", "day").distinct()
    known = held.groupBy("key", "title", "day").agg(F.min("target").alias("target"))
    same = known.groupBy("key").agg(F.min("target").alias("_same"))
    titles = lambda rs, n: rs.select(F.col("title").alias(n), T.plain(F.col("title")).alias(f"_p{n}")).distinct()
    mine, theirs = titles(kinds, "title"), titles(known, "_title2")
    met = edit_join(mine, theirs, "_ptitle", "_p_title2", int(100 * min(SAME_DAY_TITLE, SAME_YEAR_TITLE)))  # a sequence ratio is no greater than the indel ratio
    rated = met.withColumn("sim", T.sequence_ratio(F.col("_ptitle"), F.col("_p_title2"))).where(F.col("sim") >= min(SAME_DAY_TITLE, SAME_YEAR_TITLE))
    close = mine.join(rated, "_ptitle").join(theirs, "_p_title2").select("title", "_title2", "sim")
    when = {"day": F.col("day"), "_year": F.year("day")}

    def nearest(on: str, least: float) -> DataFrame:
        """title, on, and the best (sim, -target) of the held titles that are close to it at that time."""
        own = kinds.where("day IS NOT NULL").select("title", when[on].alias(on)).distinct().join(close.where(F.col("sim") >= least), "title")
        theirs = known.where("day IS NOT NULL").groupBy(F.col("title").alias("_title2"), when[on].alias(on)).agg(F.min("target").alias("target"))
        return own.join(theirs, ["_title2", on]).groupBy("title", on).agg(F.max(F.struct("sim", (-F.col("target")).alias("_t"))).alias(f"_best{on}"))

    dated = kinds.withColumn("_year", when["_year"]).join(same, "key", "left").join(nearest("day", SAME_DAY_TITLE), ["title", "day"], "left").join(nearest("_year", SAME_YEAR_TITLE), ["title", "_year"], "left")
    best = F.greatest(F.struct(F.coalesce("_bestday.sim", F.lit(-1.0)).alias("sim"), F.col("_bestday._t").alias("_t")), F.struct(F.coalesce("_best_year.sim", F.lit(-1.0)).alias("sim"), F.col("_best_year._t").alias("_t")))
    told = dated.select(F.col("key").alias("_key"), F.col("title").alias("_title"), F.col("day").alias("_day"), "_same", best.alias("_best"))
    out = rows.join(told, F.col("key").eqNullSafe(F.col("_key")) & F.col("title").eqNullSafe(F.col("_title")) & F.col("day").eqNullSafe(F.col("_day")))
    close = F.col("_best.sim") >= 0
    return out.select(
        "id",
        F.when(F.col("_same").isNotNull(), "absorb").when(close, "review").otherwise("create").alias("decision"),
        F.coalesce("_same", F.when(close, -F.col("_best._t"))).alias("target"),
        F.when(F.col("_same").isNotNull(), 1.0).otherwise(F.when(close, F.col("_best.sim")).otherwise(0.0)).alias("score"),
    )


def route_people(rows: DataFrame, held: DataFrame, actors: DataFrame, institution: str, most_name: int = 255, most_role: int = 120) -> DataFrame:
    """id, zone, outcome, target for every person: ten outcomes in order.

    rows: id, name, affiliation, role, profile, authorized; held: target, name, affiliation, role, profile; actors: actor, name.
    institution: a pattern that an affiliation's name must meet. The order: a name too long; no affiliation; name and affiliation held by several
    people, by one with other details, by one; the name held elsewhere; not authorized; no institution; several actors of that name; no role, or
    one too long; else a new person.
    """
    key = lambda c: T.plain(F.coalesce(F.col(c), F.lit("")))
    flat = lambda c: F.lower(T.collapsed(F.coalesce(F.col(c), F.lit(""))))
    mine = rows.withColumn("_name", key("name")).withColumn("_aff", key("affiliation"))
    theirs = held.select("target", key("name").alias("_name"), key("affiliation").alias("_aff"), flat("role").alias("_role2"), flat("profile").alias("_profile2"))
    by_name = theirs.groupBy("_name").agg(F.min("target").alias("_named"), F.count_distinct("target").alias("_n_named"))
    by_both = theirs.groupBy("_name", "_aff").agg(F.min(F.struct("target", "_role2", "_profile2")).alias("_held"), F.count_distinct("target").alias("_n_held"))
    by_actor = actors.select("actor", key("name").alias("_aff")).groupBy("_aff").agg(F.count_distinct("actor").alias("_n_actors"))
    j = mine.join(by_name, "_name", "left").join(by_both, ["_name", "_aff"], "left").join(by_actor, "_aff", "left")
    differs = lambda own, other: (flat(own) != "") & (F.col(other) != "") & (flat(own) != F.col(other))
    conflict = differs("role", "_held._role2") | differs("profile", "_held._profile2")
    role = F.trim(F.coalesce("role", F.lit("")))
    outcome = (
        F.when(F.length(F.trim("name")) > most_name, "invalid_name_length")
        .when(F.col("_aff") == "", "missing_affiliation")
        .when(F.col("_n_held") > 1, "ambiguous_identity")
        .when(F.col("_n_held") == 1, F.when(conflict, "conflicting_details").otherwise("already_held"))
        .when(F.col("_n_named") >= 1, "different_affiliation")
        .when(~F.col("authorized"), "create_not_authorized")
        .when(~F.col("affiliation").rlike(institution), "invalid_affiliation")
        .when(F.col("_n_actors") > 1, "ambiguous_affiliation")
        .when(role == "", "missing_role")
        .when(F.length(role) > most_role, "invalid_role_length")
        .otherwise("create")
    )
    zone = F.when(F.col("outcome") == "already_held", "skip").when(F.col("outcome") == "create", "create").otherwise("review")
    target = F.when(F.col("outcome").isin("conflicting_details", "already_held"), F.col("_held.target")).when(
        (F.col("outcome") == "different_affiliation") | ((F.col("outcome") == "missing_affiliation") & (F.col("_n_named") == 1)), F.col("_named")
    )
    return j.withColumn("outcome", outcome).select("id", zone.alias("zone"), "outcome", target.alias("target"))


def import_actors(rows: DataFrame, held: DataFrame) -> DataFrame:
    """id, kind, target, reason: an uploaded organization against held ones by site, then core name or alternate name, then close core names.

    rows: id, name, others, website; held: target, name, others, website. Close names (a ratio of sorted words of POSSIBLE) are
    looked for among held names with the record's first word; the least target wins a tie.
    """
    site = U.import_domain(F.col("website"))
    by_site = rows.select("id", site.alias("_s")).where("_s <> ''").join(held.select("target", U.host(F.col("website")).alias("_h")).withColumn("_s", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_h", r"\."))), lambda i: F.array_join(F.slice(F.split("_h", r"\."), i, 99), ".")))), "_s")
    by_site = by_site.groupBy("id").agg(F.min("target").alias("_site"))
    core = lambda n: T.core_name(n)
    cores = named(held, "target", "name", "others", core)
    by_name = named(rows, "id", "name", "others", core).join(cores, "_name").groupBy("id").agg(F.min("target").alias("_same"))
    own = rows.select("id", T.core_name(F.col("name")).alias("_own"))
    first = own.withColumn("_w", F.get(F.filter(T.words(F.col("_own")), lambda w: F.length(w) > 2), F.lit(0))).where("_w IS NOT NULL")
    first, cores = first.withColumn("_sorted", in_order(F.col("_own"))), cores.withColumn("_sorted2", in_order(F.col("_name")))
    met = edit_join(first, cores, "_sorted", "_sorted2", POSSIBLE).select("_sorted", "_sorted2", F.col("ratio").alias("r"))
    near = first.join(met, "_sorted").join(cores, "_sorted2").where(F.array_contains(T.words(F.col("_name")), F.col("_w"))).select("id", "target", "r")
    near = near.join(by_site, "id", "left_anti").join(by_name, "id", "left_anti")
    close = near.groupBy("id").agg(F.max(F.struct("r", (-F.col("target")).alias("_t"))).alias("_near"))
    j = rows.select("id").join(by_site, "id", "left").join(by_name, "id", "left").join(close, "id", "left")
    return j.select(
        "id",
        F.when(F.col("_site").isNotNull() | F.col("_same").isNotNull(), "existing").when(F.col("_near").isNotNull(), "possible").otherwise("new").alias("kind"),
        F.coalesce("_site", "_same", -F.col("_near._t")).alias("target"),
        F.when(F.col("_site").isNotNull(), "same website").when(F.col("_same").isNotNull(), "same name").when(F.col("_near").isNotNull(), "similar name").alias("reason"),
    )


# duplicates on a map


def in_order(value: Column) -> Column:
    """The words of a plain name in alphabetical order."""
    return F.array_join(F.array_sort(T.words(value)), " ")


def meeting(rows: DataFrame, left: Column, right: Column | None = None) -> DataFrame:
    """k, k2 with k < k2: records with a filled value in common among two arrays of strings, the second's of the other record."""
    x = rows.select(F.col("k").alias("x"), F.explode(F.array_distinct(left)).alias("v")).where("v <> ''")
    y = rows.select(F.col("k").alias("y"), F.explode(F.array_distinct(left if right is None else right)).alias("v")).where("v <> ''")
    return x.join(y, "v").where("x <> y").select(F.least("x", "y").alias("k"), F.greatest("x", "y").alias("k2"))


def spelled(rows: DataFrame, value: Column, least: int) -> DataFrame:
    """k, k2 with k < k2: records whose values are equal or of an indel ratio of `least`."""
    own = rows.select("k", value.alias("v")).where("v <> ''")
    met = edit_pairs(own, "v", least)
    near = own.withColumnRenamed("v", "a").join(met, "a").join(own.select(F.col("k").alias("o"), F.col("v").alias("b")), "b").select(F.least("k", "o").alias("k"), F.greatest("k", "o").alias("k2"))
    return meeting(rows, F.array(value)).union(near)


def paired(rows: DataFrame, pairs: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """k, k2 of all the pairs, each once, with the columns of both records with _a and _b."""
    every = reduce(DataFrame.union, pairs).distinct()
    side = lambda s, k: rows.select(F.col("k").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return every.join(side("a", "k"), "k").join(side("b", "k2"), "k2")


def actor_duplicates(rows: DataFrame) -> DataFrame:
    """k, k2, decision: all pairs of organizations (k, name, others, website) that actor_match() merges or flags, each from a join on what its rule needs."""
    plain, alternates = T.plain(F.col("name")), F.transform(F.coalesce("others", F.array().cast("array<string>")), T.plain)
    long = F.filter(alternates, lambda n: F.length(n) >= LEAST_ALIAS)
    pairs = [
        spelled(rows, plain, CLOSE_NAME),
        spelled(rows, in_order(plain), REORDERED),
        meeting(rows, long),
        meeting(rows, F.concat(T.bracketed(F.col("name")), F.array(plain)), long),
        meeting(rows, F.array(T.normalize_name(F.col("name")))),
        meeting(rows, F.array(F.coalesce(U.homepage(F.col("website")), F.lit("")))),
    ]
    bare = rows.where(T.normalize_name(F.col("name")) == "")  # names that are brackets alone have the same bare name, none
    return actor_match(paired(rows, [*pairs, meeting(bare, F.array(F.lit("none")))], ["name", "others", "website"])).where("decision IS NOT NULL").select("k", "k2", "decision")


def event_duplicates(rows: DataFrame) -> DataFrame:
    """k, k2, decision: all pairs of events (k, name, website) that event_match() merges or flags."""
    core, bare = T.series_key(F.col("name")), T.series_key(F.regexp_replace(F.col("name"), r"\([^)]*\)", " "))
    own = rows.select("k", core.alias("c"))
    within = subset_pairs(own.select("c").distinct().select("c", T.words(F.col("c")).alias("w")), "c", "w")
    inside = own.join(within.withColumnRenamed("small", "c"), "c").select("k", "big").join(own.select(F.col("k").alias("o"), F.col("c").alias("big")), "big").where("k <> o").select(F.least("k", "o").alias("k"), F.greatest("k", "o").alias("k2"))
    pairs = [spelled(rows, core, CLOSE_NAME), inside, meeting(rows, F.array(bare)), meeting(rows, F.array(U.key(F.coalesce(F.col("website"), F.lit("")))))]
    return event_match(paired(rows, pairs, ["name", "website"])).where("decision IS NOT NULL").select("k", "k2", "decision")


def person_duplicates(rows: DataFrame) -> DataFrame:
    """k, k2: all pairs of people (k, name, website) that person_match() finds the same."""
    pairs = [spelled(rows, T.plain(F.col("name")), CLOSE_NAME), meeting(rows, F.array(U.key(F.coalesce(F.col("website"), F.lit("")))))]
    return person_match(paired(rows, pairs, ["name", "website"])).where("same").select("k", "k2")


def actor_match(pairs: DataFrame) -> DataFrame:
    """pairs with decision: MERGE, FLAG or null for two organizations, columns name, others (array), website of each side with _a and _b.

    The same name, a shared alternate name, or a bracket that is the other's alternate name merges. So do names equal but for brackets, where the brackets are
    equal or one side has none and the other short ones; else these are flagged. Names of the same words in another order merge; close names merge on the same homepage.
    """
    side = lambda s: (T.plain(F.col(f"name_{s}")), F.filter(F.transform(F.coalesce(F.col(f"others_{s}"), F.array().cast("array<string>")), T.plain), lambda n: F.length(n) >= LEAST_ALIAS), T.bracketed(F.col(f"name_{s}")), T.normalize_name(F.col(f"name_{s}")), U.homepage(F.col(f"website_{s}")))
    (na, alt_a, br_a, core_a, home_a), (nb, alt_b, br_b, core_b, home_b) = side("a"), side("b")
    long = lambda ns: F.filter(ns, lambda n: F.length(n) >= LEAST_ALIAS)
    short = lambda ns: F.forall(ns, lambda n: F.size(T.words(n)) <= 4)
    home = F.coalesce((home_a != "") & (home_a == home_b), F.lit(False))
    sure = (na == nb) | F.arrays_overlap(alt_a, alt_b) | F.arrays_overlap(long(br_a), alt_b) | F.arrays_overlap(long(br_b), alt_a)
    brackets = (F.array_sort(br_a) == F.array_sort(br_b)) | ((F.size(br_a) == 0) & short(br_b)) | ((F.size(br_b) == 0) & short(br_a))
    decision = (
        F.when((na == "") | (nb == ""), None)
        .when(sure, "MERGE")
        .when(core_a == core_b, F.when(brackets, "MERGE").otherwise("FLAG"))
        .when(F.col("_sorted") >= REORDERED, "MERGE")
        .when(F.col("_ratio") >= CLOSE_NAME, F.when(home, "MERGE").otherwise("FLAG"))
        .when(F.array_contains(alt_a, nb) | F.array_contains(alt_b, na) | home, "FLAG")
    )
    rated = pairs.withColumn("_sorted", T.token_sort_ratio(na, nb)).withColumn("_ratio", T.ratio(na, nb))
    return rated.withColumn("decision", decision).drop("_sorted", "_ratio")


def event_match(pairs: DataFrame) -> DataFrame:
    """pairs with decision: MERGE, FLAG or null for two events, columns name, website of each side with _a and _b.

    The same series name merges, and a close one on the same homepage; a close one elsewhere, the same name without brackets, one name's words inside the other's, or the same address is flagged.
    """
    core = [T.series_key(F.col(f"name_{s}")) for s in "ab"]
    bare = [T.series_key(F.regexp_replace(F.col(f"name_{s}"), r"\([^)]*\)", " ")) for s in "ab"]
    words = [F.array_distinct(T.words(c)) for c in core]
    home, site = [U.homepage(F.col(f"website_{s}")) for s in "ab"], [U.key(F.coalesce(F.col(f"website_{s}"), F.lit(""))) for s in "ab"]
    same = lambda x: F.coalesce((x[0] != "") & (x[0] == x[1]), F.lit(False))
    inside = (F.size(F.array_except(words[0], words[1])) == 0) | (F.size(F.array_except(words[1], words[0])) == 0)
    decision = (
        F.when((core[0] == "") | (core[1] == ""), None)
        .when(core[0] == core[1], "MERGE")
        .when(F.col("_ratio") >= CLOSE_NAME, F.when(same(home), "MERGE").otherwise("FLAG"))
        .when(same(bare) | inside | same(site), "FLAG")
    )
    return pairs.withColumn("_ratio", T.ratio(core[0], core[1])).withColumn("decision", decision).drop("_ratio")


def person_match(pairs: DataFrame) -> DataFrame:
    """pairs with same: close names, or the same address, columns name, website of each side with _a and _b."""
    key, site = [T.plain(F.col(f"name_{s}")) for s in "ab"], [U.key(F.coalesce(F.col(f"website_{s}"), F.lit(""))) for s in "ab"]
    rated = pairs.withColumn("_ratio", T.ratio(key[0], key[1]))
    filled = (key[0] != "") & (key[1] != "")
    return rated.withColumn("same", filled & ((F.col("_ratio") >= CLOSE_NAME) | ((site[0] != "") & (site[0] == site[1])))).drop("_ratio")


def merged_editions(events: DataFrame, series: str, key: str, first: str, last: str, today: Column, carried: Sequence[str]) -> DataFrame:
    """series, kept (key of the edition that stays whole), day, previous and the carried columns.

    The nearest coming edition stays, else the latest past one, else one without dates; ties by key. previous: the latest day of another edition that ended before the one kept begins.
    Carried columns do not belong to an edition: the kept one's value, else that of the next in the order that has one.
    """
    end = F.coalesce(F.col(last), F.col(first))
    past = end < today
    order = [F.when(F.col(first).isNull(), 2).when(past, 1).otherwise(0), F.when(past, F.datediff(today, end)).otherwise(F.datediff(F.col(first), today)), F.col(key)]
    rank = Window.partitionBy(series).orderBy(*order)
    ranked = events.withColumn("_rank", F.row_number().over(rank)).withColumn("_end", end)
    ranked = ranked.withColumn("_begin", F.first(F.col(first)).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    one = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c)))
    keep = [F.min(F.when(F.col(c).isNotNull(), F.struct("_rank", F.col(c).alias("v"))))["v"].alias(c) for c in carried]
    return ranked.groupBy(series).agg(one(key).alias("kept"), one(first).alias("day"), F.max(F.when(F.col("_end") < F.col("_begin"), F.col(first))).alias("previous"), *keep)


def collapsed_events(events: DataFrame, run: str, key: str, title: str, start: str, own: str, band: str, score: str) -> DataFrame:
    """key, winner: kept candidates in order of strength join the first stronger winner that is the same event; others win themselves.

    Strength: read on its own site, the top band, the score, then the key. The same event: the same start and 0.7 of the smaller set of words,
    or the same year and 0.85. Candidates of the same run, words and start have the same neighbours, so the strongest of them stands for all. Those of the same run, words and year
    are all the same event, so at most one of them wins; overlaps are joined between such classes, not between candidates, and who wins is settled in rounds, as one scan in order would.
    """
    stop = ("the", "and", "for", "conference", "summit", "annual")
    words = F.array_sort(F.array_distinct(F.filter(T.words(T.plain(F.col(title))), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$") & ~w.isin(*stop))))
    strength = F.struct((~F.col(own)).alias("own"), (F.col(band) != "auto_high").alias("band"), (-F.col(score).cast("double")).alias("score"), F.col(key).alias("key"))
    rows = events.select(F.col(run).alias("run"), F.col(key).alias("key"), F.col(start).cast("string").alias("start"), words.alias("words"), strength.alias("rank"))
    rows = rows.withColumn("class", F.when((F.col("start") != "") & F.col("run").isNotNull() & (F.size("words") > 0), F.concat_ws("|", F.col("run").cast("string"), F.substring("start", 1, 4), F.array_join("words", " "))))
    spots = stored(rows.where("class IS NOT NULL").groupBy("class", "start").agg(F.min("rank").alias("rank")), fresh_path(events.sparkSession, "spots"))
    own_words = F.substring_index("class", "|", -1)
    place = F.substring("class", F.lit(1), F.length("class") - F.length(own_words))
    near = overlap_pairs(spots.select("class").distinct().select("class", F.transform(F.split(own_words, " "), lambda w: F.concat(place, w)).alias("words")), "class", "words", 0.7)
    winners = strongest_first(spots, near, 0.85)
    return rows.select("key", "class", "start").join(winners, ["class", "start"], "left").select("key", F.coalesce("winner", "key").alias("winner"))


def held_events(titles: DataFrame, key: str, title: str, held: DataFrame, held_key: str, name: str, day: str, stop: Sequence[str] = ("the", "and", "for", "conference", "summit", "annual", "edition"), least: int = 3) -> DataFrame:
    """key, held: the least held event that a title names: all distinctive words of the event's name, `least` at least, in the same year.

    A title and an event without a common year among those they state are different editions; a dated title never matches an undated event.
    """
    tokens = lambda c: F.array_distinct(T.words(T.plain(F.col(c))))
    years = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))
    distinctive = F.array_sort(F.filter(tokens(name), lambda w: ~w.isin(*stop) & ~w.rlike("^[0-9]+$")))
    # titles of the same words and years are told once, and events of the same words and years count as the least of them
    events = held.select(F.col(held_key).alias("_held"), distinctive.alias("_ws"), F.array_sort(F.array_union(years(F.col(name)), years(F.col(day)))).alias("_hy")).where(F.size("_ws") >= least).groupBy("_ws", "_hy").agg(F.min("_held").alias("_held"))
    told = titles.select(F.col(key).alias("key"), F.array_sort(years(F.col(title))).alias("_ty"), F.array_sort(tokens(title)).alias("_said"))
    kinds = told.select("_said", "_ty").distinct()
    # an event's rarest word finds the titles that can name it; a word of every title is never joined on
    said = kinds.select("_said").distinct()
    counts = said.select(F.explode("_said").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("n"))
    names = events.select("_ws").distinct()
    anchors = names.select("_ws", F.explode("_ws").alias("_w")).join(counts, "_w").groupBy("_ws").agg(F.min(F.struct("n", "_w"))["_w"].alias("_w"))
    met = said.withColumn("_w", F.explode("_said")).join(anchors, "_w").where(F.size(F.array_except("_ws", "_said")) == 0).select("_said", "_ws")
    other = (F.size("_hy") > 0) & (F.size("_ty") > 0) & ~F.arrays_overlap("_hy", "_ty")
    undated = (F.size("_ty") > 0) & (F.size("_hy") == 0)
    found = kinds.join(met, "_said").join(events, "_ws").where(~other & ~undated).groupBy("_said", "_ty").agg(F.min("_held").alias("held"))
    return told.join(found, ["_said", "_ty"]).groupBy("key").agg(F.min("held").alias("held"))


def linked_people(people: DataFrame, actors: DataFrame, least: float = 85) -> DataFrame:
    """person, actor, score: each person's organization, the best of a set ratio of names and 100 where the title names it; none below `least`.

    people: person, organization, title; actors: actor, name. Names of `least` share a word, or one is the other, so pairs come from words; the least actor wins a tie.
    """
    names = actors.select("actor", T.plain(F.col("name")).alias("_name")).where("_name <> ''")
    own = people.select("person", T.plain(F.coalesce("organization", F.lit(""))).alias("_org"), T.plain(F.coalesce("title", F.lit(""))).alias("_title"))
    distinct = names.select("_name").distinct().withColumn("_w", F.explode(F.array_distinct(T.words(F.col("_name")))))
    orgs = own.select("_org").where("_org <> ''").distinct().withColumn("_w", F.explode(F.array_distinct(T.words(F.col("_org")))))
    close = orgs.join(distinct, "_w").select("_org", "_name").distinct().withColumn("score", T.token_set_ratio(F.col("_org"), F.col("_name"))).where(F.col("score") >= least)
    by_name = own.join(close, "_org").join(names, "_name").select("person", "actor", "score")
    # a name inside a title begins with one of the title's words and is as long as some run of them
    runs = own.where("_title <> ''").select("person", "_title", F.explode(F.array_distinct(T.words(F.col("_title")))).alias("_w"))
    starts = names.withColumn("_w", F.split_part("_name", F.lit(" "), F.lit(1)))
    by_title = runs.join(starts, "_w").where(F.contains("_title", F.col("_name"))).select("person", "actor", F.lit(100.0).alias("score"))
    best = by_name.union(by_title).groupBy("person").agg(F.max(F.struct("score", (-F.col("actor")).alias("_t"))).alias("_b"))
    return best.select("person", (-F.col("_b._t")).alias("actor"), F.col("_b.score").alias("score"))


def official_matches(actors: DataFrame, candidates: DataFrame, providers: Sequence[str], confidence: float = 0.88) -> DataFrame:
    """actor, outcome, candidate, provider, confidence: what registers say of an actor, by strict matches alone.

    actors: actor, name; candidates: candidate, name, provider, website. A candidate matches by the same name, by the same name without brackets where the actor has none, or where the actor's
    brackets are its own initials and the candidate has none. Matches that lead to different addresses are a conflict; else the first provider in order wins, then the closer name, then the candidate.
    """
    base = lambda c: T.plain(F.regexp_replace(c, r"\([^)]*\)", " "))
    a = actors.select(F.col("name").alias("_an")).distinct().withColumn("_base", base(F.col("_an")))
    # candidates of one name and register differ in key and address only: the least key, and the least and greatest address tell whether there are two
    told = candidates.where(F.col("provider").isin(*providers)).withColumn("_url", F.nullif(U.key(F.coalesce("website", F.lit(""))), F.lit("")))
    c = told.groupBy("provider", F.col("name").alias("_cn")).agg(F.min("candidate").alias("candidate"), F.min("_url").alias("_low"), F.max("_url").alias("_high")).withColumn("_base", base(F.col("_cn")))
    j = a.where("_base <> ''").join(c, "_base")
    notes, other = T.bracketed(F.col("_an")), T.bracketed(F.col("_cn"))
    own_initials = F.forall(notes, lambda n: F.regexp_replace(n, "[^a-z0-9]", "") == T.acronym(F.col("_base")))
    strict = (T.plain(F.col("_an")) == T.plain(F.col("_cn"))) | (F.size(notes) == 0) | ((F.size(other) == 0) & own_initials)
    order = F.array_position(listed(providers), F.col("provider"))
    found = j.where(strict).withColumn("_rank", F.struct(order.alias("o"), (-T.name_similarity(F.col("_an"), F.col("_cn"))).alias("s"), "candidate", "provider"))
    one = found.groupBy("_an").agg(F.min("_rank").alias("b"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    each = actors.select("actor", F.col("name").alias("_an")).join(one, "_an").groupBy("actor").agg(F.min("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"))
    clear = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    pick = lambda c, name: F.when(clear, c).alias(name)
    return each.select("actor", F.when(clear, "matched").otherwise("conflict").alias("outcome"), pick(F.col("b.candidate"), "candidate"), pick(F.col("b.provider"), "provider"), pick(F.lit(confidence), "confidence"))
