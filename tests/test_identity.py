"""Identity rules that SQL does not state, against the rules written out over pairs of small tables."""

import datetime
import difflib
import itertools

from pyspark.sql import functions as F

from terravane.functions import text as T
from terravane.operators import identity as I

ACTOR = "name string, others array<string>, website string"


def matched(spark, pairs, match, columns):
    rows = [(i, *x, *y) for i, (x, y) in enumerate(pairs)]
    schema = "k int, name_a string, others_a array<string>, website_a string, name_b string, others_b array<string>, website_b string"
    return {r.k: r[columns] for r in match(spark.createDataFrame(rows, schema)).collect()}


def test_actor_match(spark):
    a = lambda name, others=None, site=None: (name, others, site)
    cases = [
        (a("Acme Water"), a("ACME  water"), "MERGE"),
        (a("Acme", ["Big Water"]), a("Other", ["big water", "x"]), "MERGE"),
        (a("Lab (Deep Blue)"), a("Something", ["deep blue"]), "MERGE"),
        (a("University of Rho"), a("University of Rho (UR)"), "MERGE"),
        (a("Institute (North)"), a("Institute (South)"), "FLAG"),
        (a("Institute"), a("Institute (a unit of many more words)"), "FLAG"),
        (a("Water Research Center"), a("Research Center Water"), "MERGE"),
        (a("Water Res Centre", None, "https://w.org"), a("Water Res Center", None, "http://www.w.org/"), "MERGE"),
        (a("Water Res Centre", None, "https://w.org/x"), a("Water Res Center", None, "http://w.org/"), "FLAG"),
        (a("Alpha", ["Beta Works"]), a("Beta Works"), "FLAG"),
        (a("Alpha", None, "https://one.org"), a("Gamma", None, "https://one.org"), "FLAG"),
        (a("Alpha"), a("Gamma"), None),
        (a(""), a(""), None),
    ]
    got = matched(spark, [(x, y) for x, y, _ in cases], I.actor_match, "decision")
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_event_and_person_match(spark):
    e = lambda name, site=None: (name, None, site)
    cases = [
        (e("RE Expo 2026"), e("12th annual RE Expo 2027"), "MERGE"),
        (e("Clean Water Summit", "https://a.org"), e("Clean Waters Summit", "https://a.org"), "MERGE"),
        (e("Clean Water Summit"), e("Clean Waters Summit"), "FLAG"),
        (e("RE+ (Renewable Energy Plus)"), e("RE+"), "FLAG"),
        (e("Cleanpower"), e("Cleanpower Conference Exhibition"), "FLAG"),
        (e("One", "https://x.org/list"), e("Two", "http://www.x.org/list/"), "FLAG"),
        (e("One"), e("Two"), None),
        (e("2026"), e("One"), None),
    ]
    got = matched(spark, [(x, y) for x, y, _ in cases], I.event_match, "decision")
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]
    people = [(e("Ann Lee"), e("ann  lee"), True), (e("Ann Lee", "https://x.org/a"), e("Bo Chi", "x.org/a/"), True), (e("Ann Lee"), e("Bo Chi"), False), (e(""), e("", "x.org"), False)]
    got = matched(spark, [(x, y) for x, y, _ in people], I.person_match, "same")
    assert [got[i] for i in range(len(people))] == [want for *_, want in people]


def test_events_are_routed(spark):
    day = datetime.date
    titles = ["Water Summit", "Water Summits", "Waters Summit", "Solar Expo", "Solar Expos West", "Wind"]
    held = [(100 + i, f"{t}|{d}", t, d) for i, (t, d) in enumerate(itertools.product(titles[:4], [day(2026, 5, 1), day(2026, 9, 9), day(2027, 5, 1)]))]
    rows = [(i, f"{t}|{d}", t, d) for i, (t, d) in enumerate(itertools.product(titles, [day(2026, 5, 1), day(2026, 7, 7), day(2028, 1, 1), None]))]
    schema = "{} bigint, key string, title string, day date"
    got = {r.id: r for r in I.route_events(spark.createDataFrame(rows, schema.format("id")), spark.createDataFrame(held, schema.format("target"))).collect()}
    assert len(got) == len(rows)
    for i, key, title, when in rows:
        exact = [h for h, k, *_ in held if k == key]
        best = None
        for h, _, other, then in held:
            if not when or not set(title.lower().split()) & set(other.lower().split()):
                continue
            sim = difflib.SequenceMatcher(None, title.lower(), other.lower()).ratio()
            if (then == when and sim >= 0.88) or (then.year == when.year and sim >= 0.9):
                best = max(best or (0, 0), (sim, -h))
        want = ("absorb", exact[0]) if exact else ("review", -best[1]) if best else ("create", None)
        assert (got[i].decision, got[i].target) == want, (title, when)


def test_imports_are_matched(spark):
    held = [(1, "Acme Water Company", ["The Blue Lab"], "https://www.acme.org/x"), (2, "Solar Works", None, None), (3, "Solar Worksx", None, None), (4, "University of Rho", None, "https://a.rho.ac.uk")]
    rows = [(1, "Other", None, "http://acme.org"), (2, "ACME water", None, None), (3, "X", ["blue lab"], None), (4, "Solar Work", None, None), (5, "Zeta", None, None), (6, "Y", None, "https://b.rho.ac.uk/z"), (7, None, None, None)]
    out = I.import_actors(spark.createDataFrame(rows, f"id bigint, {ACTOR}"), spark.createDataFrame(held, f"target bigint, {ACTOR}"))
    assert {r.id: (r.kind, r.target, r.reason) for r in out.collect()} == {
        1: ("existing", 1, "same website"), 2: ("existing", 1, "same name"), 3: ("existing", 1, "same name"), 4: ("possible", 2, "similar name"),
        5: ("new", None, None), 6: ("existing", 4, "same website"), 7: ("new", None, None),
    }


def test_same_events_collapse(spark):
    rows = [
        (1, 1, "World Agri Tech Summit", "2026-03-01", False, "auto_high", 0.9), (2, 1, "World Agri Tech Innovation Summit", "2026-03-01", True, "review", 0.4),
        (3, 1, "World Agri Tech Innovation", "2026-08-01", False, "review", 0.4), (4, 1, "World Agri Fair", "2026-03-01", False, "review", 0.5),
        (5, 1, "World Agri Tech Summit", "2027-03-01", False, "review", 0.5), (6, 2, "World Agri Tech Summit", "2026-03-01", False, "review", 0.5), (7, 1, "Undated", None, False, "review", 0.5), (8, 1, "Undated", None, False, "review", 0.6),
    ]
    frame = spark.createDataFrame(rows, "k bigint, run int, title string, start string, own boolean, band string, score double")
    got = {r.key: r.winner for r in I.collapsed_events(frame, "run", "k", "title", "start", "own", "band", "score").collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_people_are_linked(spark):
    actors = spark.createDataFrame([(1, "Acme Water Company"), (2, "Solar Works"), (3, "Rho"), (4, "")], "actor bigint, name string")
    people = [(1, "Acme Water", None), (2, None, "Head of Solar Works, Berlin"), (3, "Solar Workers", "x"), (4, "Rhode", None), (5, "Sun", "rho"), (6, None, None)]
    got = {r.person: (r.actor, r.score) for r in I.linked_people(spark.createDataFrame(people, "person bigint, organization string, title string"), actors).collect()}
    want = {}
    for p, org, title in people:
        best = None
        for a, name in [(1, "acme water company"), (2, "solar works"), (3, "rho")]:
            score = T.token_set((org or "").lower(), name) if org else 0
            if name in (title or "").lower().replace(",", ""):
                score = max(score, 100)
            best = max(best or (0, 0), (score, -a))
        if best[0] >= 85:
            want[p] = (-best[1], best[0])
    assert got == want and set(got) == {1, 2, 3, 5}


def test_mismatches_are_nought_for_short_forms(spark):
    names = spark.createDataFrame([("NREL",), ("National Renewable Energy Laboratory",), ("Rho University Chemistry",), ("Rho University Department of Chemistry",), ("Water Lab (Arizona)",), ("Water Lab (Texas)",), ("Site 1 Works",), ("Site First Works",), ("Michigan State University",), ("University of Michigan",)], "name string")
    pairs = I.name_pairs(names, "name", F.lit(["x"]))
    got = {(r.a, r.b): r for r in pairs.select("a", "b", *[c.alias(k) for k, c in I.mismatches().items()], I.edge_class(F.col("a"), F.col("b")).alias("edge")).collect()}
    assert len(got) == 45
    short = got["NREL", "National Renewable Energy Laboratory"]
    assert tuple(short)[2:] == (0, 0, 0, 0, 0, 0, "merge")
    assert got["Rho University Chemistry", "Rho University Department of Chemistry"].hierarchy == 0 and got["Rho University Chemistry", "Rho University Department of Chemistry"].edge == "merge"
    assert got["Water Lab (Arizona)", "Water Lab (Texas)"].place == 1 and got["Site 1 Works", "Site First Works"].numeric == 0
    assert got["Michigan State University", "University of Michigan"].qualifier == 1
