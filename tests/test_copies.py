"""Records that say the same are decided once: results by the rule written out, and the rows that joins make stay near the distinct records."""

import datetime

from pyspark.sql import functions as F

from terravane.operators import identity as I


def joined_rows(df):
    """The rows of df, and the most rows that a join of its final plan made."""
    rows = df.collect()
    found, seen, todo = [0], set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.id() in seen:
            continue
        seen.add(node.id())
        if "Join" in name or name == "CartesianProduct":
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, max(found)


def test_copies_of_events_are_routed_once(spark):
    n, day = 1500, datetime.date(2026, 5, 1)
    event = lambda k, title, when: (k, f"{title}|{when}", title, when)
    rows = [event(k, "Water Summit" if k % 3 else "Waters Summit", day if k % 2 else datetime.date(2026, 9, 9)) for k in range(n)] + [event(8000, "Water Summit", None), event(8001, "Wind", day), event(8002, None, day)]
    held = [event(10000 + k, "Waters Summits", day if k % 2 else None) for k in range(n)] + [event(9000, "Water Summit", day), event(9001, None, day)]
    frame = lambda x, k: spark.createDataFrame(x, f"{k} bigint, key string, title string, day date")
    got, most = joined_rows(I.route_events(frame(rows, "id"), frame(held, "target")))
    assert len(got) == len(rows) and most <= 3 * n
    sim = {"Water Summit": 24 / 25, "Waters Summit": 26 / 27}
    for r, (k, _, title, when) in zip(sorted(got, key=lambda r: r.id), sorted(rows)):
        if k == 8002:
            want = ("absorb", 9001, 1.0)
        elif title == "Water Summit" and when == day:
            want = ("absorb", 9000, 1.0)
        elif title == "Wind" or when is None:
            want = ("create", None, 0.0)
        else:  # the same title in another month, or the plural of all words
            want = ("review", 9000, 1.0) if title == "Water Summit" else ("review", 10001, sim[title])
        assert (r.decision, r.target, round(r.score, 9)) == (want[0], want[1], round(want[2], 9)), (k, title, when)


def test_copies_of_candidates_are_matched_once(spark):
    n = 2000
    actors = [(k, ["Acme Water", "Acme Water (AW)", "Zeta"][k % 3]) for k in range(n)]
    held = [(10000 + k, "Acme Water" if k % 2 else "Acme Water (XY)", "ror" if k % 5 else "sec", "https://a.org") for k in range(n)] + [(5, "Zeta", "ror", ""), (6, "zeta", "openalex", "https://z.org"), (4, "Zeta", "openalex", "http://www.y.org")]
    frames = spark.createDataFrame(actors, "actor bigint, name string"), spark.createDataFrame(held, "candidate bigint, name string, provider string, website string")
    got, most = joined_rows(I.official_matches(*frames, ["ror", "openalex"]))
    assert most <= 2 * n
    want = {0: ("matched", 10001, "ror", 0.88), 1: ("matched", 10001, "ror", 0.88), 2: ("conflict", None, None, None)}
    assert {r.actor: tuple(r)[1:] for r in got} == {k: want[k % 3] for k in range(n)}
    one = spark.createDataFrame([(1, "Zeta")], "actor bigint, name string")
    assert [tuple(r) for r in I.official_matches(one, frames[1].where("candidate <> 6"), ["ror", "openalex"]).collect()] == [(1, "matched", 5, "ror", 0.88)]


def test_copies_of_titles_name_events_once(spark):
    n, day = 2000, datetime.date(2026, 5, 1)
    titles = [(k, ["Water Summit Lower Saxony Forum", "Forum: Saxony lower water SUMMIT 2026", "Lower Water Forum"][k % 3]) for k in range(n)]
    held = [(10000 + k, "Lower Saxony Water Forum", day if k % 2 else None) for k in range(n)] + [(9000, "Lower Saxony Water Forum 2025", None), (8000, "Water", day)]
    frames = spark.createDataFrame(titles, "k bigint, t string"), spark.createDataFrame(held, "h bigint, t string, d date")
    got, most = joined_rows(I.held_events(frames[0], "k", "t", frames[1], "h", "t", "d"))
    assert most <= 2 * n
    assert {r.key: r.held for r in got} == {k: 9000 if k % 3 == 0 else 10001 for k in range(n) if k % 3 < 2}


def test_copies_of_events_collapse_without_pairs(spark, monkeypatch):
    """Overlaps are joined between distinct words of a year, and the winners are those of one scan in order."""
    tried, joined = [], I.overlap_pairs
    monkeypatch.setattr(I, "overlap_pairs", lambda *x: [tried.append(x[0].count()), joined(*x)][1])
    titles = ["World Agri Tech Summit", "World Agri Tech Expo", "World Agri Solar Tech Expo", "Agri Solar Tech Expo Days", "Solar Wind"]
    rows = [(k, k % 2, titles[k * 7 % 5], f"2026-0{1 + k * 11 % 3}-01", k % 13 == 0, "review", float(k * 37 % 50)) for k in range(600)]
    got = {r.key: r.winner for r in I.collapsed_events(spark.createDataFrame(rows, "k bigint, run int, title string, start string, own boolean, band string, score double"), "run", "k", "title", "start", "own", "band", "score").collect()}
    winners, want = [], {}
    for k, run, title, start, own, _, score in sorted(rows, key=lambda r: (not r[4], -r[6], r[0])):
        words = {w for w in title.lower().split() if w != "summit"}
        share = lambda x, words=words: len(words & x) / min(len(words), len(x)) + 1e-12
        hit = next((o for o, r, d, x in winners if r == run and share(x) >= (0.7 if d == start else 0.85)), None)
        if hit is None:
            winners.append((k, run, start, words))
        want[k] = k if hit is None else hit
    assert got == want and tried == [10]


def test_hubs_stay_out_of_pairs(spark):
    """Pairs with a hub in common are told by brute force, over several parts of a block, and no array of hubs goes into the join of pairs."""
    rows = [(k, k % 3 if k % 10 else None) for k in range(90)] + [(None, 1), (200, 1)]
    items = [(k, k * 7 % 40) for k in range(90)] + [(k, k * 5 % 31) for k in range(90)] + [(5, None), (7, None), (None, 3)]
    frames = spark.createDataFrame(rows, "s bigint, n int"), spark.createDataFrame(items, "ls bigint, lo bigint")
    got = I.shared_hubs(frames[0], "s", "n", frames[1], "ls", "lo", part=4).collect()
    hubs = {k: {h for x, h in items if x == k and h is not None} for k, _ in rows}
    want = {(a, b, int(bool(hubs[a] & hubs[b]))) for a, n in rows for b, m in rows if n is not None and n == m and a is not None and b is not None and a < b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and {x[2] for x in want} == {0, 1}


def test_pages_are_made_plain_once(spark):
    """verified_items() makes a page plain once, whatever the number of its items."""
    from terravane.operators import facts as FA

    page = "The Acme water plant, built in 1998, serves the whole northern valley with clean water"
    items = ["Acme water plant", "northern valley, of Ohio", " ", "clean valley water northern plant", "built plant", "zzqx 99", None]
    rows = spark.createDataFrame([(1, page, items, "built in 1998 serves the plant"), (2, None, items, None), (3, page, None, None)], "k int, page string, items array<string>, quote string")
    out = rows.select("k", FA.verified_items(F.col("items"), F.col("quote"), F.col("page")).alias("v")).select("k", F.col("v.kept").alias("kept"), F.col("v.dropped").alias("dropped"))
    got = {r.k: (r.kept, r.dropped) for r in out.collect()}
    assert got[1] == (["Acme water plant", "northern valley, of Ohio", "clean valley water northern plant", "built plant"], ["zzqx 99"])
    assert not got[2][0] and got[3] == (None, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(page") == 1
