"""Exact dedup: heavy-hitter split.

One pass writes (row key, doc_id, SHA-256 of the text). Misra-Gries summaries of the digests, one per partition and
merged by sum, name every digest that could make up more than 1/counters of the rows; those few candidates are counted
exactly, and the verified winner of each is broadcast, so their rows are settled on the map side without a shuffle. All
other digests, each with a small share of the rows by the summary's guarantee, go through one ordinary shuffle.

Defined cases: null text counts as empty; null doc_id sorts below every other, so it stays only in a group of nulls; of
rows that tie on the largest doc_id exactly one is kept; an empty table gives an empty result; extra columns of the input
are ignored, so they cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Counters of each Misra-Gries summary, and so the most digests that are ever broadcast (32 bytes each and a winner).
COUNTERS = 1024


def misra_gries(batches, counters: int):
    """Summary of one stream of Arrow digest arrays: {digest: lower bound of its count}, at most `counters` entries.

    Whole batches are added at once; beyond `counters` entries the (counters+1)-th largest count is taken off all
    entries, which keeps the bound count - rows/counters <= entry <= count, and summaries stay mergeable by sum.
    """
    held: dict[bytes, int] = {}
    for column in batches:
        seen = pc.value_counts(column)
        for digest, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
            held[digest] = held.get(digest, 0) + n
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: v - cut for k, v in held.items() if v > cut}
    return held


def heavy_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests with the largest merged Misra-Gries counts; holds every digest of over rows/counters rows."""

    def summarise(batches):
        held = misra_gries((b.column(0) for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "low"])

    merged = rows.select("digest").mapInArrow(summarise, "digest binary, low bigint").groupBy("digest").agg(F.sum("low").alias("low"))
    return merged.where(F.col("low") > 1).orderBy(F.desc("low"), "digest").limit(counters).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; the row with the largest id of equal texts stays."""
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_key"),
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
        ),
        "digests",
    )
    heavy = heavy_digests(rows, counters)
    winners = (
        rows.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_key")).alias("win"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = written(winners, "winners")  # at most `counters` rows
    settled = rows.join(F.broadcast(winners), "digest").select(
        "doc_id",
        F.col("win.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_key") == F.col("win.row_key")).alias("kept"),
        "digest",
    )
    by_digest = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"), F.desc("row_key"))
    whole = by_digest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tail = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "doc_id",
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(by_digest) == 1).alias("kept"),
        "digest",
    )
    return settled.unionByName(tail).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
