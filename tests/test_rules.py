"""Rules that SQL does not state: matchings, places, edit ratios, institutions, fitted scores, bootstraps, facts part by part."""

import difflib
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions import text as T
from terravane.operators import entity, evaluation, facts, places, scoring

LETTERS = st.text("abc ", max_size=9)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(LETTERS, LETTERS)
@settings(max_examples=300, deadline=None)
def test_indel_ratio_matches_the_longest_common_subsequence(a, b):
    want = 100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b))
    assert abs(T.indel_ratio(a, b) - want) < 1e-9
    assert T.token_sort(a, b) == T.indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def test_ratios_as_columns(spark):
    rows = [("red widget", "widget red"), ("a", ""), ("", ""), (None, "x"), ("acme water", "acme water company")]
    got = spark.createDataFrame(rows, "a string, b string").select(*[f(F.col("a"), F.col("b")) for f in (T.ratio, T.token_sort_ratio, T.token_set_ratio, T.sequence_ratio)]).collect()
    for (a, b), r in zip(rows, got):
        if a is None:
            assert all(x is None for x in r)
        else:
            assert tuple(r) == (T.indel_ratio(a, b), T.token_sort(a, b), T.token_set(a, b), difflib.SequenceMatcher(None, a, b).ratio())
    assert got[0][1] == 100 and got[4][2] == 100


@given(st.dictionaries(st.sampled_from("abcdef"), st.lists(st.integers(0, 4).map(str), max_size=4), max_size=6))
@settings(max_examples=200, deadline=None)
def test_matching_is_the_largest(families):
    def best(left, used):
        if not left:
            return 0
        skip = best(left[1:], used)
        return max([skip, *(1 + best(left[1:], used | {c}) for c in set(families[left[0]]) - used)])

    assert places.maximum_matching(families) == best(list(families), frozenset())


def test_matching_of_a_long_chain():
    n = 3000  # every family must move along one path of 3000 steps
    chain = {f"f{i:05}": [f"c{i:05}", f"c{i + 1:05}"] for i in range(n)} | {"z": ["c00000"]}
    assert places.maximum_matching(chain) == n + 1


def test_density_center_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(c, "S", f"city {k}", 30 + rng.random() * 3, -100 + rng.random() * 3) for c in "ab" for k in range(6) for _ in range(rng.randint(1, 4))]
    spots = {}
    for c, state, city, lat, lon in rows:
        spots.setdefault((c, city), (lat, lon))
    rows = [(c, s, city, *spots[c, city]) for c, s, city, *_ in rows]
    out = {r.cluster: (r.city, r.core) for r in places.density_center(spark.createDataFrame(rows, "cluster string, state string, city string, lat double, lon double"), "cluster").collect()}
    for cluster in "ab":
        own = [r for r in rows if r[0] == cluster]
        ranked = []
        for city in {r[2] for r in own}:
            at = spots[cluster, city]
            miles = [places._miles(*at, r[3], r[4]) for r in own]
            near = [m for m in miles if m <= 200]
            ranked.append((-sum(m <= 50 for m in miles), round(sum(near) / len(near), 6), city))
        assert out[cluster] == (min(ranked)[2], -min(ranked)[0])


def test_locations_are_checked(spark):
    states = {"TX": "Texas", "NV": "Nevada", "OH": "Ohio"}
    pages = {
        "We make rods.": ("unconfirmed", "TX", None, []), "It is based in Reno, NV. We like it.": ("correct", "NV", None, []), "Headquartered in Austin, Texas. Visit 12 Main St, Reno, NV 89501.": ("keep", "TX", "TX", ["NV"]),
        "12 Main St, Reno, NV 89501. 7 Oak Avenue, Dayton, OH 45402.": ("withhold", None, None, ["NV", "OH"]), "They like Austin, TX.": ("unconfirmed", "TX", None, []), "Our head office is located in Dayton, Ohio. An office in Austin, TX.": ("keep", "TX", "OH", []),
    }
    frame = spark.createDataFrame([(p,) for p in pages], "page string").select("page", places.checked_location(F.lit("TX"), F.col("page"), states).alias("c"))
    assert {r.page: (r.c.action, r.c.state, r.c.headquarters, r.c.operates_in) for r in frame.collect()} == pages


def test_employing_institution(spark):
    cases = {"Department of Physics, University of Rho": "University of Rho", "Water Lab, Acme": "Acme", "Solar group": "Solar group", " ": None, "School of Law | State College": "State College"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", T.employing_institution("v").alias("x")).collect()
    assert {r.v: r.x for r in got} == cases


def test_chunks_cover_the_text():
    rng = random.Random(1)
    for _ in range(30):
        paragraphs = [" ".join(f"w{rng.randint(0, 99)}" + rng.choice(["", ".", "!"]) for _ in range(rng.randint(1, 400))) for _ in range(rng.randint(1, 4))]
        out = T.chunked("\n\n".join(paragraphs))
        assert all(len(c) <= 1200 for c in out)
        assert set(" ".join(paragraphs).split()) <= set(" ".join(out).split()) | {"".join(x) for x in itertools.chain()}
    assert T.chunked("") == []


def test_scores_are_out_of_fold(spark):
    rng = random.Random(5)
    rows = [(i, int(i % 4 == 0), (i % 4 == 0) + rng.gauss(0, 0.4), rng.random(), float(i)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k bigint, label int, good double, noise double, own double")
    out = evaluation.out_of_fold(frame, "k", "label", ["good", "noise"], folds=4, repeats=2).collect()
    assert len(out) == 800 and {(r.repeat, r.fold) for r in out} == set(itertools.product(range(2), range(4)))
    per = {(r, f): [x.label for x in out if (x.repeat, x.fold) == (r, f)] for r in range(2) for f in range(4)}
    assert all(len(v) == 100 and sum(v) == 25 for v in per.values())
    assert sum((r.score >= 0.5) == bool(r.label) for r in out) > 0.85 * len(out)
    blind = evaluation.out_of_fold(frame, "k", "label", ["noise"], folds=4, repeats=1).collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in blind) < 0.7 * len(blind)  # nothing of a row's own label reaches its score


def test_bootstrap_spans_the_mean(spark):
    rows = spark.createDataFrame([(i, float(i % 10)) for i in range(300)], "k bigint, v double")
    r, again = evaluation.bootstrap(rows, "v", 200).first(), evaluation.bootstrap(rows.repartition(7), "v", 200).first()
    assert r.low < r["mean"] < r.high and r.high - r.low < 1.0 and tuple(r) == tuple(again)


def test_facts_part_by_part(spark):
    rows = [
        (1, "10 staff in Rho", "10 staff in Rho", "pumps", "pumps and valves for farms", None, "x"), (2, "10 staff", "12 staff", "pumps", None, "old", None), (3, "ten people", "ten people", "pumps", "pumps", None, None), (4, None, None, None, "new", "a", "a"),
    ]
    frame = spark.createDataFrame(rows, "k int, a1 string, a2 string, b1 string, b2 string, c1 string, c2 string")
    old, new = {k: F.col(f"{k}1") for k in "abc"}, {k: F.col(f"{k}2") for k in "abc"}
    for profile in (True, False):
        got = {r.k: r.c for r in frame.select("k", facts.compared_parts(old, new, F.lit(profile)).alias("c")).collect()}
        assert {k: v.outcome for k, v in got.items()} == {1: "additional", 2: "changed", 3: "corroborated", 4: "additional"}
        assert tuple(got[1].merged) == ("10 staff in Rho", "pumps and valves for farms", "x") and tuple(got[3].merged) == ("ten people", "pumps", None)
        assert tuple(got[2].merged) == (("12 staff", "pumps", "old") if profile else ("12 staff", None, None))
        assert [tuple(p) for p in got[2].parts] == [("a", "changed"), ("b", "not_restated"), ("c", "not_restated")]


def test_facts_on_a_page(spark):
    page = "The Rho lab runs 12 pumps in the north. It was founded in 1990 by two engineers from Sigma."
    value = F.lit("It runs 12 pumps in the north. It sells 900 boats to the navy every year.")
    r = spark.range(1).select(
        facts.grounded(F.lit("The Rho lab runs 12 pumps in the north. It sells 900 boats to the navy."), F.lit(page)).alias("g"), facts.verified(value, F.lit("founded in 1990"), F.lit(page)).alias("yes"), facts.verified(value, F.lit("founded in 1991 in Tau town"), F.lit(page)).alias("no"),
        facts.supported_items(F.array(F.lit("12 pumps"), F.lit("13 pumps"), F.lit("boats")), F.lit(page)).alias("s"),
    ).first()
    assert r.g == "The Rho lab runs 12 pumps in the north." and r.yes and r.no is None
    assert (list(r.s.kept), list(r.s.dropped)) == (["12 pumps"], ["13 pumps", "boats"])


def test_weights_and_thresholds_are_checked():
    for bad in ({"a": 0.5, "b": 0.4}, {"a": 1.5, "b": -0.5}, {"a": 1.0}):
        try:
            scoring.check_weights(bad, ["a", "b"])
        except ValueError:
            continue
        raise AssertionError(bad)


def test_receipts_of_funding(spark):
    cases = [
        ("We received $2 million from the agency.", True, None), ("Received a grant of $2 million", True, None), ("Received a grant of $2 million", False, "another's page does not say who received it"), ("Rho Lab was awarded $5 million", False, None), ("The Rho-Lab of Tau was selected for $5 million", True, None),
        ("Apply now for grants of $3,000", True, "advertises an opportunity"), ("Our foundation awards $3,000 to local startups", True, "gives it to others"), ("It funded 34 projects with $9 million", True, "gives it to others"), ("$4 million on behalf of the state", True, "runs a programme for a funder"),
        ("A budget of $4 million", True, "names the money only"), ("Acme was awarded $5 million", False, "another's page does not say who received it"), (None, True, "names the money only"),
    ]
    frame = spark.createDataFrame([(i, q, own) for i, (q, own, _) in enumerate(cases)], "i int, quote string, own boolean")
    got = {r.i: r.x for r in frame.select("i", scoring.receipt(F.col("quote"), F.lit("Rho Lab"), F.col("own")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_pairs_of_a_common_block_are_whole(spark):
    rows = [(f"n{i:03}", ["the", f"w{i % 7}"] if i % 3 else [f"w{i % 7}"]) for i in range(90)]
    frame = spark.createDataFrame(rows, "k string, ws array<string>")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(rows), 2) if set(x) & set(y)}
    for part in (3, 2000):
        got = entity.blocked_pairs(frame, "k", F.col("ws"), part).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
