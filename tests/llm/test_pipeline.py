"""The pipeline on a small written table: stages chain, decisions take effect, the rest stays."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from terravane.llm import quality_cnn


def test_pipeline(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_cnn, "STEPS", 120)
    clean = lambda i: " ".join(f"w{'abcdefghij'[(i * 7 + k * k) % 10]}{'klmnopqrst'[(i + k) % 10]}{'uvwxyz'[i % 6]}{'aeiou'[(i // 6) % 5]}" for k in range(60))
    rows = [(i, f"menu line\n{clean(i)}", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, " ".join(f"x{k}$$$" for k in range(i, i + 50)), "en", "s", 0) for i in range(40)]
    rows += [(300, clean(1) + " tail", "en", "s", 0), (301, clean(3) + ' password="aa11bb22cc33dd44"', "en", "t", 0), (302, clean(4), "en", "t", 0), (302, clean(9) + " " + clean(5), "en", "t", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1 if i < 100 else 0, 0) for i in [*range(60), *range(100, 140)]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {k: collections.Counter(r.doc_id for r in v) for k, v in seen.items()}
    assert not any(100 <= d < 140 for d in ids["quality classifier"]) and sum(d < 60 for d in ids["quality classifier"]) >= 57
    assert not any("menu line" in r.text for r in seen["line dedup"])
    assert ids["n-gram jaccard join"][300] == 0 and ids["n-gram jaccard join"][302] == 1
    text = {r.doc_id: r.text for r in seen["secret scans"]}
    assert all("aa11bb22" not in t for t in text.values())
    assert collections.Counter({r.doc_id: r.doc_tokens for r in seen["packing"]}).keys() == text.keys()
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def odd(spark, extra=False):
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
    rows = [(1, None, "en", "h", None), (None, None, "en", None, None), (None, "one two three four five six", None, "", 3), (2, "", "en", "h", 0), (3, long, "en", "h", 9), (3, long, "en", "h", 9), (4, "a\n\nb", "en", None, 1), (4, "x password=aa11bb22cc33 y", "en", "h", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for name in ("score", "_key", "_lines_in", "row", "copy_id", "start", "part", "host"):
            frame = frame.withColumn(name, F.lit("clash"))
    return frame


def test_stages_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_cnn, "STEPS", 20)
    spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for extra in (False, True):
        odd(spark, extra).repartition(2).write.parquet(f"{tmp_path}/docs-{extra}")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = spark.read.parquet(f"{tmp_path}/docs-{extra}")
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if i < 4:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            ids = collections.Counter(r.doc_id for r in got)
            if name in ("line dedup", "secret scans"):
                assert ids == {1: 1, None: 2, 2: 1, 3: 2, 4: 2} and sum(r.text is None for r in got) == 2
            if name == "n-gram jaccard join":
                assert ids == {1: 1, None: 2, 2: 1, 3: 1, 4: 2}  # the repeated long text goes, empty ones are no copies
            if name == "secret scans":
                assert not any("aa11bb22cc33" in (r.text or "") for r in got)
            if name == "packing":
                assert sum(r.length for r in got if r.doc_id == 3) == 2 * next(r.doc_tokens for r in got if r.doc_id == 3)
            assert stage(spark, docs.limit(0).select(*docs.columns) if name != "n-gram jaccard join" else spark.read.schema(docs.schema).parquet(empty(spark, docs, f"{tmp_path}/empty-{extra}")), str(tmp_path)).count() == 0


def empty(spark, docs, path):
    docs.where("false").write.mode("overwrite").parquet(path)
    return path


def test_rows_are_keyed_without_a_plain_scan(spark, tmp_path):
    frame = odd(spark)
    keys = [r._key for r in corpus_pipeline.keyed(frame).collect()]  # no files behind it
    assert len(set(map(tuple, keys))) == frame.count()
    frame.repartition(3).write.parquet(f"{tmp_path}/d")
    read = corpus_pipeline.keyed(spark.read.parquet(f"{tmp_path}/d"))
    assert len({tuple(r._key) for r in read.collect()}) == frame.count() and read.columns == [*frame.columns, "_key"]
