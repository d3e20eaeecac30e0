"""Operators on small tables: each rule by example, grouped operators against brute force, results free of row order."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from terravane.functions import dates, numbers, text, urls
from terravane.operators import curation, entity, evaluation, facts, graph, guard, ledger, places, relational, scoring, search
from terravane.sources import pages, sinks, uploads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value, want",
    [("  a  b ", "a b"), ("N/A", None), (None, None), ("unknown", None)],
)
def test_clean_text(spark, value, want):
    assert one(spark, text.clean_text(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("value, want", [("Été & Cie (EC)", "ete cie ec"), ("ÀÉÎÕÜ ñ", "aeiou n"), ("", "")])
def test_plain(spark, value, want):
    assert one(spark, text.plain(F.lit(value))) == want


def test_folded_unicode(spark):
    assert one(spark, text.folded_unicode(F.lit("Straße Ǻ Ω"))) == "strasse a ω"


@pytest.mark.parametrize("value, want", [("University of the Far West (UFW)", "ufw"), ("One", ""), ("Ab Cd", "ac")])
def test_acronym(spark, value, want):
    assert one(spark, text.acronym(F.lit(value))) == want


def test_ratios():
    assert text.indel_ratio("abcd", "abcd") == 100 and text.indel_ratio("", "") == 100 and text.indel_ratio("ab", "cd") == 0
    assert abs(text.indel_ratio("kitten", "sitting") - 100 * 2 * 4 / 13) < 1e-9
    assert text.token_sort("b a", "a b") == 100 and text.token_set("a b c", "a b") == 100
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        want = 100.0 if not a and not b else 200.0 * table[-1][-1] / (len(a) + len(b))
        assert abs(text.indel_ratio(a, b) - want) < 1e-9


def test_chunks():
    body = "\n\n".join(" ".join(f"w{i}.{j}." for j in range(60)) for i in range(20)) + "\n\n" + "x" * 3000
    own = text.chunked(body)
    assert all(len(c) <= 1200 for c in own) and all(w in " ".join(own) for w in body.split() if len(w) < 100)
    assert text.chunked("") == [] and text.chunked("a") == ["a"]


@pytest.mark.parametrize(
    "url, host, domain",
    [("https://www.A.example.org/x?y", "a.example.org", "example.org"), ("b.co.uk", "b.co.uk", "b.co.uk"), ("http://u:p@x.b.ac.uk:80/", "x.b.ac.uk", "b.ac.uk"), ("", "", "")],
)
def test_hosts(spark, url, host, domain):
    assert one(spark, urls.host(F.lit(url))) == host and one(spark, urls.registrable(F.lit(url))) == domain


def test_strict_canonical(spark):
    made = spark.createDataFrame([("https://Ex.Org",), ("http://a.b:8080/",), ("ftp://a.b/",), (None,), ("https://bücher.example/a?b=c#d",)], "u string")
    assert [r.x for r in made.select(urls.strict_canonical("u").alias("x")).collect()] == ["https://ex.org/", None, None, None, "https://xn--bcher-kva.example/a?b=c"]


@pytest.mark.parametrize(
    "value, want",
    [("2024-05-01", date(2024, 5, 1)), ("May 3rd, 2024", date(2024, 5, 3)), ("5/7/2024", date(2024, 5, 7)), ("May 3-5, 2024", date(2024, 5, 3)), ("soon", None)],
)
def test_parsed(spark, value, want):
    assert one(spark, dates.parsed(F.lit(value))) == want


def test_partial_and_status(spark):
    p = one(spark, dates.partial(F.lit("2024-02")))
    assert (p.first, p.last, p.exact) == (date(2024, 2, 1), date(2024, 2, 29), False)
    assert one(spark, dates.partial(F.lit("nothing"))) is None
    assert one(spark, dates.status(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"))) == "date unconfirmed"


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        numbers.weighted_sum({"a": F.lit(1)}, {"a": 0.5})
    with pytest.raises(ValueError):
        scoring.check_thresholds(0.8, 0.2)
    for weights in (scoring.RELEVANCE_WEIGHTS, scoring.PRIORITY_WEIGHTS, scoring.COMBINED_WEIGHTS, scoring.EVENT_WEIGHTS, scoring.PERSON_WEIGHTS):
        scoring.check_weights(weights, list(weights))


def test_capped_band(spark):
    assert one(spark, scoring.capped_band(F.lit("auto_high"), F.lit("research"), F.array(F.lit("bio or profile")))) == "review"


def test_safe_select(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert guard.is_safe_select(spark, "SELECT * FROM three;") and guard.is_safe_select(spark, "WITH a AS (SELECT 1) SELECT * FROM a")
    for bad in ("DROP TABLE three", "SELECT 1; SELECT 2", "INSERT INTO three SELECT 1", "CREATE TABLE x AS SELECT 1", "sel"):
        assert not guard.is_safe_select(spark, bad)
    assert guard.safe_select(spark, "SELECT * FROM three", cap=2).count() == 2


def test_follow(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 4), (5, 6), (6, 5), *[(i, i + 1) for i in range(20, 40)], (40, None)]
    got = {r.node: r.survivor for r in relational.follow(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b").collect()}
    assert (got[1], got[3], got[4], got[5], got[30], got[29]) == (3, 3, None, None, 40, None)


def test_families(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "n bigint")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3), (5, 3), (6, 0), (6, 7)], "c bigint, p bigint")
    got = {r.node: (r.root, r.resolved) for r in graph.families(nodes, edges, "n", "c", "p").collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (None, False), 4: (None, False), 5: (None, False), 6: (None, False), 7: (7, True)}


def test_radius_join_against_brute_force(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(900, 0.0, 179.99), (901, 89.9, 10.0)]
    b = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(900, 0.0, -179.99), (901, 89.9, -170.0)]
    for miles in (50, 700, 3000):
        got = places.radius_join(spark.createDataFrame(a, "a bigint, lat double, lon double"), spark.createDataFrame(b, "b bigint, lat2 double, lon2 double"), float(miles))
        want = sorted((x[0], y[0]) for x in a for y in b if places._miles(x[1], x[2], y[1], y[2]) <= miles)
        assert sorted((r.a, r.b) for r in got.collect()) == want


def test_matching():
    assert places.maximum_matching({"a": ["x"], "b": ["x", "y"], "c": ["y"]}) == 2
    assert places.maximum_matching({"a": ["x", "y"], "b": ["x"], "c": ["z"]}) == 3


def hub_rows(families, categories, city="a", at=0.0):
    return [("s", f"f{i}{city}", f"c{i % categories}", city, "ST", 40.0, at) for i in range(families)]


HUB = "sector string, family string, category string, city string, state string, lat double, lon double"


@pytest.mark.parametrize(
    "rows, hubs, want",
    [
        (hub_rows(10, 5), (), ["proposed"]),
        (hub_rows(9, 5), (), []),
        (hub_rows(10, 4), (), []),
        (hub_rows(10, 5) + hub_rows(12, 6, "b", 20.0), (), ["proposed", "proposed"]),
        (hub_rows(10, 5), (("s", 40.0, 0.1, 100.0),), ["covered"]),
    ],
)
def test_detection(spark, rows, hubs, want):
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        got = places.detect_clusters(spark.createDataFrame(rows, HUB), "sector", hubs=hubs).collect()
        assert sorted(r.outcome for r in got) == want


def test_fold(spark):
    rows = [("k", 1, "a", 1, 10, False, 1), ("k", 2, "a", 1, 11, False, 2), ("k", 3, "b", 1, 12, False, 3), ("k", 4, "c", 0, 13, False, 4), ("k", 5, "d", 2, 14, True, 5), ("k", 6, "e", 2, 15, False, 6), ("j", 7, "x", 0, 1, False, 9)]
    frame = spark.createDataFrame(rows, "k string, id bigint, hash string, confidence bigint, read_at bigint, human boolean, arrived bigint")
    want = {1: "accepted", 2: "corroborated", 3: "superseded", 4: "conflict_flagged", 5: "superseded", 6: "pending_update", 7: "accepted"}
    for parts in (1, 5):
        assert {r.id: r.outcome for r in facts.fold(frame.repartition(parts), ["k"]).collect()} == want


def test_presses(spark):
    base = 1_700_000_000
    runs = spark.createDataFrame([("u", 1, base), ("u", 2, base + 100), ("u", 3, base + 4000)], "k string, run bigint, s bigint").withColumn("ran", F.timestamp_seconds("s"))
    presses = spark.createDataFrame([("u", 10, base - 1000), ("u", 11, base + 150), ("u", 12, base + 100)], "k string, press bigint, s bigint").withColumn("pressed", F.timestamp_seconds("s"))
    got = {r.run: r.press for r in ledger.matched_presses(runs, presses, "k", "run", "ran", "press", "pressed").collect()}
    assert got == {1: 10, 2: 12}


def test_file_duplicates(spark):
    rows = [("f", 1, ["a", "b"], True), ("f", 2, ["b", "c"], True), ("f", 3, ["c"], True), ("f", 4, ["d"], False), ("f", 5, ["d"], True), ("g", 6, ["a"], True)]
    got = {r.row: r.duplicate_of for r in curation.file_duplicates(spark.createDataFrame(rows, "file string, row bigint, keys array<string>, ok boolean"), "file", "row", "keys", "ok").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}


def test_greedy_groups(spark):
    rows = [("b", 1, "alpha beta"), ("b", 2, "alpha beta gamma"), ("b", 3, "delta"), ("b", 4, "alpha betta")]
    frame = spark.createDataFrame(rows, "block string, id bigint, name string")
    got = {r.key: r.group for r in entity.greedy_groups(frame, ["block"], ["id"], "id", "name", lambda a, b: text.token_sort(a, b) >= 70).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_fetch_plan(spark):
    rows = [("r", i, d) for i, d in enumerate("aabcadbb")]
    got = [r.planned for r in scoring.fetch_plan(spark.createDataFrame(rows, "run string, i bigint, d string"), ["run"], "d", ["i"], 4, 2).orderBy("i").collect()]
    assert got == [True, True, True, False, True, False, False, False]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id bigint, d double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id bigint, s double")
    got = search.fused([a, b], "id", [[F.col("d")], [F.desc("s")]], 10).collect()
    assert [r.id for r in got] == [2, 1, 3] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-8


def test_facet_counts_leave_out_their_own_filter(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "t string, s string")
    got = {(r.facet, r.value): r.n for r in relational.facet_counts(rows, {"t": F.col("t"), "s": F.col("s")}, {"t": F.col("t") == "a", "s": F.col("s") == "x"}).collect()}
    assert got == {("t", "a"): 1, ("t", "b"): 1, ("s", "x"): 1, ("s", "y"): 1}


def test_curve(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    got = {r.threshold: (r.tp, r.fp) for r in evaluation.curve(rows, "score", "label").collect()}
    assert got == {0.9: (1, 0), 0.8: (2, 1), 0.1: (2, 2)}


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;city\n\"A; B\";Zürich\n".encode())
    (tmp_path / "b.csv").write_bytes("name,city\nA,Z\xfcrich\n".encode("latin-1"))
    for f in ("a.csv", "b.csv"):
        out = uploads.read_csv(spark, str(tmp_path / f))
        assert out.columns == ["name", "city"] and out.first().city == "Zürich"
    assert uploads.header_row([["x", None], ["Name", "City "], ["name", "q"]], {"name": "name", "city": "city"}) == (1, {0: "name", 1: "city"})
    assert uploads.renamed(out, {"NAME": "title"}).columns == ["title", "city"]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b"), (1, "é")], "i bigint, s string")
    sinks.to_csv(frame, f"{tmp_path}/csv", ["i"])
    body = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert body.decode("utf-8") == "﻿i,s\n1,é\n2,b\n"
    sinks.split(frame, F.col("i") == 1, f"{tmp_path}/k", f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/k").count() == 1 and spark.read.parquet(f"{tmp_path}/d").first().i == 2
    sinks.to_parquet(frame, f"{tmp_path}/p", ["s"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert sinks.markdown(frame.orderBy("i"), "T").splitlines()[4] == "| 1 | é |"


def test_listing_cards(spark):
    frame = spark.createDataFrame([(1, "<li><a href=\"/a\">A</a></li><li><a href=\"/b\">B</a></li>"), (2, None)], "page_id bigint, html string")
    got = [tuple(r) for r in pages.listing_cards(frame, r"<li><a [^>]*>[^<]*</a></li>", {"link": r'href="([^"]*)"'}, ["page_id"]).collect()]
    assert got == [(1, 0, "/a"), (1, 1, "/b")]


def test_workbooks_and_text_files(spark, tmp_path):
    import zipfile

    from terravane.sources import packages, sheets

    cell = '<c r="{}" t="inlineStr"><is><t>{}</t></is></c>'
    body = f'<row r="1">{cell.format("A1", "Name")}{cell.format("B1", "City")}</row><row r="2"/><row r="3">{cell.format("A3", "Ann")}<c r="B3" t="s"><v>0</v></c></row>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Rome</t></si></sst>')
    assert [(r.row_number, r["values"]) for r in sheets.read_xlsx(spark, str(tmp_path)).collect()] == [(3, {"Name": "Ann", "City": "Rome"})]
    with pytest.raises(ValueError):
        packages.checked_archive(None, packages.MOST_BYTES + 1)
    (tmp_path / "b.txt").write_bytes("a\r\nZ\xfcrich ".encode("latin-1"))
    assert sheets.read_text_files(spark, str(tmp_path)).first().text == "a\nZürich"
