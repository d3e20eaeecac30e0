"""Plans on small fixtures of their own: every row of the tables counts, against brute force."""

import itertools
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from terravane import plans
from terravane.operators import graph
from terravane.sources.uploads import upload_rows


def ran(spark, folder, name, **tables):
    """The rows of a plan over the given tables."""
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return plans.queries()[name](spark, str(folder)).collect()


def test_components_of_all_edges(spark, tmp_path):
    rows = [(k, k % 37 * (k % 3), k * 7 % 90) for k in range(1, 60)]  # no order key is a multiple of 200
    got = ran(spark, tmp_path, "er22_components", lineitem=spark.createDataFrame(rows, "l_orderkey bigint, l_suppkey bigint, l_partkey bigint"))
    up = {}

    def root(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for _, a, b in rows:
        x, y = sorted((root(a), root(b + 1000000)))
        up[y] = x
    assert {r.node: r.root for r in got} == {n: root(n) for n in list(up)} and len(got) == len(up)
    assert len({r.root for r in got}) > 1


def test_excerpts_of_all_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cher", "sch", "thing", "plain", "other", "Word"]) if rng.random() < p else "filler" for _ in range(n)) for n, p in ((3, 1), (90, 0.5), (400, 0.01), (900, 0.02), (2000, 0.005))]
    rows = list(enumerate([*texts, "x" * 700, "y" * 700 + " the", "", None]))
    got = ran(spark, tmp_path, "tk06_excerpt", documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = {}
    for i, text in rows:
        blocks = [(text or "")[k : k + 700] for k in range(0, len(text or ""), 700)] or [""]
        hits = [len({"the", "cher", "sch", "thing"} & set(re.split(r"[^a-z0-9]+", b.lower()))) for b in blocks]
        best = sorted((k for k in range(1, len(blocks)) if hits[k]), key=lambda k: (-hits[k], k))[:3]
        want[i] = (" … ".join(blocks[k] for k in [0, *sorted(best)]), len(blocks) == 1)
    assert {r.doc_id: (r.excerpt, r.whole) for r in got} == want and len(got) == len(rows)
    assert any(" … " in e for e, _ in want.values())


def above(k):
    """The ancestors of k under `k div 2`, upward."""
    return [] if k == 0 else [k // 2, *above(k // 2)]


def test_families_of_all_suppliers(spark, tmp_path):
    got = ran(spark, tmp_path, "cl00_families", supplier=spark.range(300).withColumnRenamed("id", "s_suppkey"))
    want = {k: (None, False) if {20, 21} & {k, *above(k)} else (0, True) for k in range(300)}
    assert {r.node: (r.root, r.resolved) for r in got} == want and len(got) == 300


def test_descendants_of_all_suppliers(spark, tmp_path):
    got = ran(spark, tmp_path, "cl00b_descendants", supplier=spark.range(300).withColumnRenamed("id", "s_suppkey"))
    want = set()
    for k in range(1, 300):
        chain = [k, *above(k)]
        want |= {(chain[d], k, "/".join(map(str, chain[d::-1])), d) for d in range(1, len(chain))}
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_exact_duplicates_by_name_or_address(spark):
    from terravane.operators import curation

    rows = [(k, ["Red Nut", "red nut", "blue bolt", None][k % 4], [f"https://s{k % 11}.org/", None, f"https://own{k}.org/"][k % 3]) for k in range(150)]
    got = curation.exact_duplicates(spark.createDataFrame(rows, "key bigint, name string, site string"), "key", "name", "site").collect()
    least = lambda i, same: min((r[0] for r in rows if same(r[i])), default=None)
    assert len(got) == len(rows)
    for r in got:
        assert r.by_name == (least(1, lambda n: n is not None and n.lower() == r.name.lower()) if r.name is not None else None)
        assert r.by_site == (least(2, lambda u: u == r.site) if r.site is not None else None)


def test_uploads_are_refused_whole(spark):
    rows = [("ok", k, t) for k, t in enumerate(["a", None, "  ", "b", "y" * 4000])] + [("long", 0, "a"), ("long", 1, " "), ("long", 2, "x" * 4001), ("long", 3, "z" * 5000)]
    rows += [("many", k, f"text {k}" if k % 7 else None) for k in range(1300)]
    frame = spark.createDataFrame(rows, "file string, k int, text string")
    got = upload_rows(frame, ["file"], "k", ["text"]).orderBy("file", "k").collect()
    assert len(got) == len(rows)
    assert [(r.row_number, r.blank) for r in got if r.file == "ok"] == [(2, False), (3, True), (4, True), (5, False), (6, False)]
    assert {r.file: r.refused for r in got} == {
        "ok": None, "long": "Row 4: a value in 'text' is longer than 4000 characters.", "many": "The file has more than 1000 records. Split it into several files."
    }


def test_components_of_chains_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)] + [(5, 5), (None, 1), (900, 901), (902, 901), (901, 900), (1000, 1000)]
    for edges in (chain, [(b, a) for a, b in chain]):
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3), "a", "b").collect()}
        assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900, 902: 900}
    assert graph.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint"), "a", "b").count() == 0
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)]
    up = {}

    def root(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    rows = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.root for r in rows} == {n: root(n) for n in list(up)} and len(rows) == len(up)


def test_numbers_by_ranges_equal_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from terravane.operators import relational

    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 503).alias("v"), F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("g"))
    for within in ([], ["g"]):
        order = [F.desc("v"), "id"]
        got = relational.numbered(rows, order, "n", within)
        want = rows.withColumn("n", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert relational.numbered(rows.limit(0), ["id"]).count() == 0


def descriptions(rows):
    """What er07 makes of parts (key, name, brand, type, size): brand and description of each key."""
    place = lambda size: "austin texas" if size > 30 else "reno nevada" if size > 20 else "ohio"
    return {k: (brand, None if size % 6 == 0 or name is None else f"Makes {name} of {kind.lower()} kind in {place(size)}") for k, name, brand, kind, size in rows}


def description_weights(texts):
    """The weights of the terms of each text, of length one."""
    terms = {d: Counter(d.lower().split(" ")) for d in texts}
    df = Counter(w for t in terms.values() for w in t)
    out = {}
    for d, t in terms.items():
        own = {w: (1 + math.log(n)) * (1 + math.log((1 + len(terms)) / (1 + df[w]))) for w, n in t.items()}
        out[d] = {w: x / math.sqrt(sum(y * y for y in own.values())) for w, x in own.items()}
    return out


def description_pair(x, y, weights):
    """tfidf in 1e-5, overlap, place_conflict and both_present of two descriptions."""
    if x is None or y is None:
        return 0, 0.0, 0.0, 0
    words = lambda d: {w for w in d.lower().split(" ") if len(w) > 2 and w not in ("the", "and", "for")}
    a, b = words(x), words(y)
    conflict = 0.0
    for names in ({"austin", "reno"}, {"texas", "nevada", "ohio"}):
        if a & names and b & names:
            conflict = float(not a & b & names)
            break
    return math.floor(sum(w * weights[y].get(t, 0) for t, w in weights[x].items()) * 1e5 + 0.5), len(a & b) / len(a | b), conflict, 1


def test_description_features_of_all_pairs_of_a_brand(spark, tmp_path):
    rng = random.Random(7)
    keys = rng.sample(range(10**6), 150)  # far apart, in no order
    rows = [(k, rng.choice(["hot ring", "old bolt", "cold nut", None]), rng.choice(["A", "B", "C", None]), rng.choice(["LARGE", "PROMO"]), rng.randint(1, 50)) for k in keys]
    told = descriptions(rows)
    got = ran(spark, tmp_path, "er07_description_features", part=spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"))
    stands = {}
    for k in sorted(keys):
        stands.setdefault(told[k], k)
    met = {(r.a, r.b): r for r in got}
    assert len(met) == len(got)
    assert {p for p, r in met.items() if r.copy} == {(stands[told[k]], k) for k in keys if stands[told[k]] != k}
    assert {p for p, r in met.items() if not r.copy} == {(a, b) for a, b in itertools.combinations(sorted(stands.values()), 2) if told[a][0] == told[b][0]}
    weights = description_weights({d for _, d in told.values() if d})
    pairs = [(a, b) for a, b in itertools.combinations(sorted(keys), 2) if told[a][0] == told[b][0]]
    for a, b in pairs:  # each pair of parts of a brand is told by those that stand for them
        x, y = sorted((stands[told[a]], stands[told[b]]))
        r = met[(x, b) if x == y else (x, y)]
        tfidf, *rest = description_pair(told[a][1], told[b][1], weights)
        assert (r.overlap, r.place_conflict, r.both_present) == tuple(rest) and abs(r.tfidf_e5 - tfidf) <= 1
    assert len(pairs) > 2000 and 0 < len([r for r in got if r.copy]) < 150


def test_description_pairs_in_parts_and_of_given_pairs(spark):
    from terravane.operators import entity, search

    rng = random.Random(8)
    rows = spark.createDataFrame([(k, k % 2, rng.choice(["", None, "Lab of Reno, Nevada", "water in Austin"]) if k % 5 == 0 else f"Works of {k % 40} {rng.choice(['austin', 'reno', 'ohio'])}") for k in range(120)], "k bigint, block int, d string").cache()
    weights = search.tfidf(rows.select(F.col("d").alias("key")).where("d IS NOT NULL").distinct(), "key", F.split(F.lower("key"), " "))
    names = ("tfidf", "overlap", "place_conflict", "both_present")
    of = lambda r: (round(r.tfidf, 9), *[r[n] for n in names[1:]])
    one = {(r.a, r.b, r.copy): of(r) for r in entity.description_pairs(rows, "block", "k", "d", weights, ["austin", "reno"], ["ohio", "nevada"]).collect()}
    many = entity.description_pairs(rows, "block", "k", "d", weights, ["austin", "reno"], ["ohio", "nevada"], part=3).collect()
    assert len(many) == len(one) and {(r.a, r.b, r.copy): of(r) for r in many} == one
    text = {r.k: (r.block, r.d) for r in rows.collect()}
    given = spark.createDataFrame([(a, b, text[a][1], text[b][1]) for a, b, _ in one], "a bigint, b bigint, desc_a string, desc_b string")
    assert {(r.a, r.b): (of(r), r.dense) for r in entity.description_features(given, weights, ["austin", "reno"], ["ohio", "nevada"]).collect()} == {(a, b): (f, 0.0) for (a, b, _), f in one.items()}
    assert {f[3] for f in one.values()} == {0, 1} and {f[2] for f in one.values()} == {0.0, 1.0}
    rows.unpersist()
