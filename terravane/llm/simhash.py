"""SimHash near-dedup: 64-bit fingerprints of word shingles, pigeonhole blocks, verified Hamming distance.

1. Each text becomes the bitwise majority of the XXH64 hashes of its word shingles. Equal fingerprints are one node from here on,
   so a group of copies of any size is one row.
2. A fingerprint is split into four blocks of 16 bits. Two fingerprints at distance 2 or less differ in two blocks at most, so they agree on two
   whole blocks: the six pairs of blocks are the join keys, 32 bits each, which chance seldom makes equal.
3. The members of a bucket are compared with each other in one Arrow task, as one matrix of exclusive ors, and a bucket reports a
   spanning forest of its verified links, never its pairs.
4. A bucket of more than TILE members (a large group of near copies that differ in the other two blocks) is split by the same principle one
   step further: two fingerprints are at distance 2 or less exactly if some point lies within one bit of both. Each member
   is dealt to its 65 points; a point has 65 members at most, whatever the bucket's size, and links them to the least of them.
5. Connected components of the links; the least id of a component is joined back to the rows by fingerprint.

No bucket is capped and no pair is lost. A row is shuffled once as (id, fingerprint) and its fingerprint six times as a key.

Defined cases: null text counts as empty; a text without words has fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle of all its words; rows of one id are rows of their own; a null id is never the least unless a component has no other;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .chunks import text_slices
from .common import dropped, in_batches, table, written
from .components import components

WORDS, DISTANCE, BLOCKS, SEED = 3, 2, 4, 42
#: Members of a bucket that are compared with each other in one matrix; larger buckets are split by points.
TILE = 512
#: Shingles hashed before their bits are added up.
_RUN = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8."""
    words = text.translate(_LOWER).split()  # bytes split at the space and \x09-\x0D alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        starts, ends = starts[: 1 - n], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _RUN):
        spans = zip(starts[at : at + _RUN].tolist(), ends[at : at + _RUN].tolist())
        run = np.fromiter((hashed(line[a:b], SEED) for a, b in spans), "<u8", min(_RUN, len(starts) - at))
        ones += np.unpackbits(run.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a bigint) for every row."""

    def run(batches):
        for part, texts in text_slices(batches, 1):
            found = np.array([fingerprint(t, n) for t in texts.cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of every choice of blocks that a close pair may agree on, as signed 64-bit integers."""
    width = -(-64 // blocks)
    each = [((1 << min(width, 64 - at)) - 1) << at for at in range(0, 64, width)]
    masks = [sum(kept) for kept in itertools.combinations(each, len(each) - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tile_forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(member, lesser member) edges that connect exactly what links within the distance connect."""
    fps = np.unique(fps)
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= distance
    root = np.full(len(fps), -1)
    edges = []
    for i in range(len(fps)):
        if root[i] >= 0:
            continue
        root[i], front = i, [i]
        while front:
            fresh = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[fresh] = i
            edges.extend((int(fps[j]), int(fps[i])) for j in fresh)
            front = fresh.tolist()
    return edges


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: edges between fingerprints (column fp, each once) that connect what links within the distance connect."""
    masks = block_masks(distance)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    hits = distinct.select("fp", keys.alias("key")).select("fp", "key.choice", "key.bits")
    shared = hits.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(hits.join(shared, ["choice", "bits"]), "met")

    def verify(batches):
        for batch in batches:
            found = [e for members in batch.column(0) for e in tile_forest(np.asarray(members.values, np.int64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    tiles = met.where(F.col("n") <= TILE).groupBy("choice", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")
    small = in_batches(tiles, verify, "a bigint, b bigint")
    one_bit = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    points = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in one_bit]))
    large = met.where(F.col("n") > TILE).select("fp").distinct().select("fp", points.alias("point"))
    around = large.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    star = around.select(F.explode(F.slice("fps", 2, 64)).alias("a"), F.col("fps")[0].alias("b"))
    return small.unionByName(star).distinct()


def near_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row of prints (doc_id, fp); give a written table."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = components(links(distinct.select("fp"), distance))
    placed = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    held = written(placed.join(ids, "root").select("fp", "component_id"), "placed")
    dropped(distinct)
    return prints.join(held, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (the least id that links reach) for every row of docs."""
    return near_components(written(fingerprints(docs, id_col, text_col, n), "prints"), distance)


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_dedup(spread(table(spark, sf_dir, "documents"), "doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
