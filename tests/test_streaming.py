"""Streaming wrappers over small file streams give the batch operators' results."""

from pyspark.sql import functions as F

from terravane.operators import facts
from terravane.streaming import incremental as I

FACT = "k string, id bigint, hash string, confidence bigint, read_at bigint, human boolean, arrived bigint"


def test_fold_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i, f"h{i * 7 % 5}", i % 3, i, i % 11 == 0, i) for i in range(60)]
    frame = spark.createDataFrame(rows, FACT)
    for part in range(3):
        frame.where(F.floor(F.col("id") / 20) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = I.fold_stream(I.file_stream(spark, f"{tmp_path}/in", frame.schema), ["k"])
    query = stream.writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id: r.outcome for r in spark.table("folded").collect()}
    assert got == {r.id: r.outcome for r in facts.fold(frame, ["k"]).collect()}


def test_refresh_index(spark, tmp_path):
    frame = spark.createDataFrame([(i % 4, i) for i in range(20)], "key bigint, v bigint")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    query = I.refresh_index(I.file_stream(spark, f"{tmp_path}/in", frame.schema), ["key"], [F.desc("v")], lambda df, i: seen.extend(map(tuple, df.collect())), f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert sorted(seen) == [(0, 16), (1, 17), (2, 18), (3, 19)]


def test_fold_with_timers_goes_on_after_a_restart(spark, tmp_path):
    import datetime

    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)
    rows = [(f"k{i % 3}", i, f"h{i * 7 % 5}", i % 3, i, i % 11 == 0, i, day(i)) for i in range(60)]
    frame = spark.createDataFrame(rows, FACT + ", at timestamp")
    last = spark.createDataFrame([("k9", 1000, "h", 1, 1, False, 1000, day(24 * 40))], frame.schema)  # moves the watermark past every hold
    spark.conf.set(*I.STATE_STORE)
    try:
        for part, new in enumerate((frame.where("id < 20"), frame.where("id BETWEEN 20 AND 39"), frame.where("id >= 40"), last)):
            new.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # each run is a restart from the checkpoint
            stream = I.fold_with_timers(I.file_stream(spark, f"{tmp_path}/in", frame.schema), ["k"])
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
    finally:
        spark.conf.unset(I.STATE_STORE[0])
    got = [(r.id, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = {r.id: r.outcome for r in facts.fold(frame, ["k"]).collect()} | {1000: "accepted"}
    assert {i: o for i, o in got if o != "lapsed"} == want
    assert sorted(i for i, o in got if o == "lapsed") == sorted(i for i, o in want.items() if o == "conflict_flagged")
    assert len(got) == len(set(got))
