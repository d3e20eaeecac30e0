"""Similarity joins against all pairs by brute force, with common words, common beginnings and odd names."""

import itertools
import random

from pyspark.sql import functions as F

from terravane.functions import text as T
from terravane.operators import identity as I
from terravane.operators import similarity as S


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def spellings(seed, n=160):
    rng = random.Random(seed)
    words = ["university", "of", "florida", "water", "institute", "national", "lab", "clean", "energy", "centre", "ab", "x", "für", "日本", "🙂"]
    out = ["", "a", "b", "aa", "ab", "aaa", "aab", "abc", "abcd", "university of florida", "university of floridaa"]
    while len(out) < n:
        s = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
        out.append(s)
        for _ in range(rng.randrange(4)):
            t = list(s)
            for _ in range(rng.randrange(1, 2 + len(t) // 4)):
                at = rng.randrange(len(t) + 1)
                if rng.random() < 0.5:
                    t.insert(at, rng.choice("aeiou xyz日"))
                elif at < len(t):
                    del t[at]
            out.append("".join(t))
    return out


def test_edit_pairs(spark):
    for least, seed in ((85, 1), (70, 2), (95, 3), (100, 4)):
        names = spellings(seed)
        want = {(a, b) for a, b in itertools.combinations(sorted({n for n in names if n}), 2) if lcs_ratio(a, b) >= least}
        got = S.edit_pairs(spark.createDataFrame([(n,) for n in [*names, None]], "n string"), "n", least).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want, least
        assert all(abs(r.ratio - lcs_ratio(r.a, r.b)) < 1e-9 for r in got)


def test_edit_join(spark):
    left, right = spellings(5), spellings(5)[::2] + spellings(6)
    frame = lambda names, c: spark.createDataFrame([(n,) for n in [*names, None]], f"{c} string")
    got = {(r.own, r.theirs) for r in S.edit_join(frame(left, "own"), frame(right, "theirs"), "own", "theirs", 85).collect()}
    assert got == {(a, b) for a in left for b in right if a and b and lcs_ratio(a, b) >= 85}
    assert S.edit_pairs(frame([], "n"), "n", 85).count() == 0


def test_set_and_subset_pairs(spark):
    rng = random.Random(9)
    rows = [(k, [w for w in (rng.choice(["the", "of", *(f"w{rng.randrange(12)}" for _ in range(3))]) for _ in range(rng.randrange(7)))]) for k in range(200)]
    frame = spark.createDataFrame(rows, "k bigint, v array<string>")
    sets = {k: set(v) for k, v in rows}
    for least in (0.3, 0.6, 0.8, 1.0):
        got = S.set_pairs(frame, "k", "v", least).collect()
        want = {(a, b) for a, b in itertools.combinations(range(200), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-12}
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want, least
    got = S.subset_pairs(frame, "k", "v").collect()
    want = {(a, b) for a in range(200) for b in range(200) if a != b and sets[a] and sets[a] <= sets[b]}
    assert len(got) == len(want) and {(r.small, r.big) for r in got} == want


def test_candidates_stay_near_the_results(spark):
    """Words of every name alone bring nothing together."""
    names = spark.range(3000).select("id", F.array(F.lit("university"), F.lit("of"), F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("b"), (F.col("id") / 2).cast("int")), F.concat(F.lit("c"), (F.col("id") / 2).cast("int"))).alias("v"))
    tried, found = S.set_candidates(names, "id", "v", 0.6).count(), S.set_pairs(names, "id", "v", 0.6).count()
    assert found == 1500 and tried <= 2 * found


def test_ratio_of_the_library(spark):
    row = spark.createDataFrame([("abcd", "abxd")], "a string, b string").select(T.ratio(F.col("a"), F.col("b")).alias("r")).first()
    assert row.r == 75.0


# duplicates of a map, routed events and imports: the joins against all pairs


def sides(rows, columns):
    side = lambda s, k: rows.select(F.col("k").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side("a", "k").crossJoin(side("b", "k2")).where("k < k2")


def odd_names(spark):
    names = [n for n in spellings(11, 120) if n] + ["(UF)", "(Water Lab)", "University of Florida (UF)", "Water (x y z u v)", "water lab institute", "institute water lab", "", "Summit", "Clean Summit 2024", "12th annual Clean Summit"]
    rows = [(k, n, [names[k - 3], "UF"] if k % 9 == 0 else None, f"https://www.s{k % 40}.org{'/page' if k % 4 == 0 else ''}" if k % 3 else None) for k, n in enumerate(names)]
    return spark.createDataFrame([*rows, (9000, None, None, "https://www.s1.org"), (9001, None, None, "https://www.s1.org")], "k bigint, name string, others array<string>, website string")


def test_duplicates_equal_all_pairs(spark):
    from terravane.plans import identities
    from terravane.plans.registry import Tables

    for rows in (odd_names(spark), identities.listed_once(Tables(spark, "/root/testdata/sf0.001"))):
        rows = rows.cache()
        for joined, rule, keep, columns in (
            (I.actor_duplicates, I.actor_match, "decision", ["name", "others", "website"]),
            (I.event_duplicates, I.event_match, "decision", ["name", "website"]),
            (I.person_duplicates, I.person_match, "same", ["name", "website"]),
        ):
            want = {(r.k, r.k2, r[keep]) for r in rule(sides(rows, columns)).collect() if r[keep]}
            got = joined(rows).collect()
            assert len(got) == len(want) > 0
            assert {tuple(r) for r in got} == ({w[:2] for w in want} if keep == "same" else want)


def test_routed_events_equal_all_pairs(spark):
    rng, titles = random.Random(4), [n for n in spellings(12, 90) if n]
    row = lambda k: (k, f"key{rng.randrange(400)}", rng.choice(titles), rng.choice([None, "2024-05-01", "2024-09-09", "2025-01-01"]))
    mine, held = [row(k) for k in range(150)], [row(k) for k in range(500, 600)]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} bigint, key string, title string, day string").withColumn("day", F.to_date("day"))
    own, theirs = frame(mine, "id"), frame(held, "target").toDF("target", "_k", "_t", "_d")
    every = own.crossJoin(theirs).withColumn("sim", T.sequence_ratio(T.plain(F.col("title")), T.plain(F.col("_t")))).withColumn("p", T.plain(F.col("title"))).collect()
    got = {r.id: (r.decision, r.target, round(r.score, 9)) for r in I.route_events(own, frame(held, "target")).collect()}
    for k, key, _, _ in mine:
        same = [r.target for r in every if r.id == k and r._k == key]
        near = [(-r.sim, r.target) for r in every if r.id == k and r.p and r.day and r._d and ((r.day == r._d and r.sim >= 0.88) or (r.day.year == r._d.year and r.sim >= 0.9))]
        want = ("absorb", min(same), 1.0) if same else ("review", min(near)[1], round(-min(near)[0], 9)) if near else ("create", None, 0.0)
        assert got[k] == want


def test_imports_equal_all_pairs(spark):
    names = [n for n in spellings(13, 120) if n]
    held = spark.createDataFrame([(k, n, None, None) for k, n in enumerate(names)], "target bigint, name string, others array<string>, website string")
    rows = spark.createDataFrame([(1000 + k, n, None, None) for k, n in enumerate(spellings(13, 120)[::3] + spellings(14, 60)) if n], "id bigint, name string, others array<string>, website string")
    cores = lambda f, k: f.select(k, T.core_name(F.col("name")).alias(f"c{k}"))
    every = cores(rows, "id").crossJoin(cores(held, "target")).withColumn("r", T.token_sort_ratio(F.col("cid"), F.col("ctarget"))).collect()
    want = {}
    for r in every:
        first = next((w for w in r.cid.split() if len(w) > 2), None)
        told = want.setdefault(r.id, [[], []])
        if r.cid and r.cid == r.ctarget:
            told[0].append(r.target)
        if first and first in r.ctarget.split() and r.r >= 90:
            told[1].append((-r.r, r.target))
    for r in I.import_actors(rows, held).collect():
        same, near = want[r.id]
        assert (r.kind, r.target) == (("existing", min(same)) if same else ("possible", min(near)[1]) if near else ("new", None))


def test_collapsed_events_equal_one_scan(spark):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(9)] + ["summit", "the", "2024"]
    rows = [(k, k % 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6))), rng.choice(["2024-05-01", "2024-05-02", "2025-05-01", None]), rng.random() < 0.3, rng.choice(["auto_high", "review"]), rng.randrange(4) / 4) for k in range(220)]
    frame = spark.createDataFrame(rows, "k bigint, run bigint, title string, start string, own boolean, band string, score double")
    got = {r.key: r.winner for r in I.collapsed_events(frame, "run", "k", "title", "start", "own", "band", "score").collect()}
    winners, want = [], {}
    for k, run, title, start, own, band, score in sorted(rows, key=lambda r: (not r[4], r[5] != "auto_high", -r[6], r[0])):
        words = {w for w in title.split() if len(w) > 2 and not w.isdigit() and w not in ("the", "summit")}
        hit = None
        for other, r, d, ws in winners:
            if r == run and start and d and start[:4] == d[:4] and words and ws:
                share = len(words & ws) / min(len(words), len(ws))
                if (start == d and share >= 0.7 - 1e-12) or share >= 0.85 - 1e-12:
                    hit = other
                    break
        if hit is None:
            winners.append((k, run, start, words))
        want[k] = k if hit is None else hit
    assert got == want and len(winners) < 200


def test_spelled_groups_equal_one_scan(spark):
    from terravane.operators import entity

    rng = random.Random(31)
    rows = [(rng.choice(["x", "y", None]), k, n) for k, n in enumerate(spellings(32, 140)) if n.strip()]
    frame = spark.createDataFrame(rows, "block string, id bigint, name string")
    for least in (85, 70):
        got = {r.key: r.group for r in entity.spelled_groups(frame, ["block"], ["id"], "id", "name", least).collect()}
        assert got == {r.key: r.group for r in entity.greedy_groups(frame, ["block"], ["id"], "id", "name", lambda a, b, n=least: T.token_sort(a, b) >= n).collect()}
        assert len(set(got.values())) < len(got)
