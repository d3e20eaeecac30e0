"""N-gram Jaccard join: MinHash banding, bands shuffled by hash, pairs verified on full n-gram sets.

1. Each document becomes the set of hashes of its word n-grams, a digest of that set and its MinHash bands; rows of bands
   and digests are written, sets are not. Documents of equal sets are one copy class; only classes go on.
2. Bands and rows a band are chosen for the target recall at the threshold. Classes are shuffled by band hash. A bucket gives
   its least member to each member, never its pairs, so a bucket of any size costs its size.
3. Connected components of those edges hold every candidate pair. A component of over one block, which may hang together
   by chance hits of weakly similar texts, is banded once more with more rows a band, whose hits are far more selective, and so falls apart where it can.
   The texts are read again and turned into full sets, and a component is verified by block against block: one tile of two blocks of
   bounded size at a time, as products of sparse 0/1 matrices with integer counts. A tile reports links by document and one edge for each document, never pairs.
4. Components of verified links are the near-duplicate classes: found inside the tile, or, for components of many blocks, by
   the same shuffled component search over the tiles' edges.

A component of m classes costs m times its blocks in rows and is verified exactly; no bucket, partner or component is
capped. Class ids and block counts, one row for each component, are broadcast within a counted bound; beyond it they are tables
of their own, so that adaptive execution can split the side of a component with many rows.

Defined cases: null text counts as empty; a text with fewer words than n is one n-gram of all its words; a text without words
links to nothing and is its own class; rows of equal id and text are copies; null ids sort last as representatives; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .chunks import text_slices
from .common import dropped, in_batches, small, table, written
from .components import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
#: Bounds of a block: members, and n-grams of all its members (or one member of any size).
BLOCK_MEMBERS, BLOCK_GRAMS = 256, 400_000
#: Ids of candidates up to this number are broadcast (ids alone), so that other texts are not shuffled.
BROADCAST_IDS = 500_000
#: Components up to this number are broadcast: their block counts and class ids.
BROADCAST_ROOTS = 500_000
#: Hashes of the second banding, and its recall.
FINE_HASHES, FINE_RECALL = 900, 0.9999
#: Columns of a matrix at once.
SPAN = 4096
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, enough for the recall at the threshold, fit `most` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) if hit < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[2]
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[3]
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: pa.Array, n: int = WORDS):
    """The sorted distinct 64-bit hashes of the word n-grams of each text."""
    lists = pc.utf8_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in distinct], np.uint64)
    empty = np.array([not w for w in distinct], bool)
    indices = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    if empty.any():
        full = ~empty[indices]
        indices, owner = indices[full], owner[full]
    counts = np.bincount(owner, minlength=len(texts))
    words = hashes[indices] if len(indices) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled = (rolled ^ words[k : k + len(rolled)]) * _MIX[0]
        rolled ^= rolled >> np.uint64(31)
    rolled = _mixed(rolled)
    for end, count in zip(ends, counts):
        if count == 0:
            yield np.zeros(0, np.uint64)
        elif count < n:
            x = np.uint64(count)
            for w in words[end - count : end]:
                x = np.uint64(int(x ^ w) * int(_MIX[1]) & 0xFFFFFFFFFFFFFFFF)
                x ^= x >> np.uint64(31)
            yield _mixed(np.array([x], np.uint64))
        else:
            yield np.unique(rolled[end - count : end - n + 1])


@functools.lru_cache(maxsize=4)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 1 << 32, count, np.uint32), rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(grams: np.ndarray, count: int) -> np.ndarray:
    """MinHash values of a set."""
    flip, factor = _functions(count)
    low = np.full(count, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = (short[at : at + 2048, None] ^ flip) * factor
        np.minimum(low, part.min(axis=0), out=low)
    return low


def band_hashes(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    own = low[: bands * rows].reshape(bands, rows).astype(np.uint64)
    x = np.arange(1, bands + 1, dtype=np.uint64) * _MIX[1]
    for r in range(rows):
        x = _mixed((x ^ own[:, r]) * _MIX[0])
    return x.view(np.int64)


def digest_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the set, grams (its size), bands (hashes) for every row of (doc_id, text)."""

    def run(batches):
        for part, texts in text_slices(batches, 1, 1 << 20):
            digests, sizes, hashes = [], [], []
            for grams in gram_sets(texts, n):
                digests.append(digest_of(grams))
                sizes.append(len(grams))
                hashes.append(band_hashes(signature(grams, bands * rows), bands, rows) if len(grams) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, hashes)]).astype(np.int32), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "digest", "grams", "bands"])

    return in_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, grams bigint, bands array<bigint>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right."""
    flat = np.concatenate([*left, *right])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    often = times > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    at, top = 0, int(often.sum())
    for lo in range(0, top, SPAN):
        to = int(np.searchsorted(column, lo + SPAN))
        m = np.zeros((len(left) + len(right), min(SPAN, top - lo)), np.float32)
        m[row[at:to], column[at:to] - lo] = 1
        out += np.rint(m[: len(left)] @ m[len(left) :].T).astype(np.int64)
        at = to
    return out


def tile_links(members: list[tuple[bytes, int, np.ndarray]], threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(digest, least digest that it reaches inside the tile, its links) of a tile's members (digest, block, set).

    A tile of one block links all its members; a tile of two links members of different blocks.
    """
    members = sorted(members, key=lambda m: (m[1], m[0]))
    blocks = sorted({m[1] for m in members})
    cut = sum(m[1] == blocks[0] for m in members) if len(blocks) > 1 else 0
    left, right = (range(cut), range(cut, len(members))) if cut else (range(len(members)), range(len(members)))
    sizes = np.array([len(m[2]) for m in members])
    shared = shared_counts([members[i][2] for i in left], [members[i][2] for i in right])
    a, b = sizes[list(left)][:, None], sizes[list(right)][None, :]
    linked = shared + 1e-9 >= threshold * (a + b - shared)
    if not cut:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(members), np.int64)
    links[list(left)] += linked.sum(axis=1)
    if cut:
        links[list(right)] += linked.sum(axis=0)
    root = list(range(len(members)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked)):
        x, y = find(left[i]), find(right[j])
        if x != y:
            root[max(x, y)] = min(x, y)
    least: dict[int, bytes] = {}
    for i, m in enumerate(members):
        least[find(i)] = min(least.get(find(i), m[0]), m[0])
    return [(m[0], least[find(i)], int(links[i])) for i, m in enumerate(members)]


def band_components(sketched: DataFrame) -> DataFrame:
    """node (digest), root: components of the classes (digest, bands) that share a band; classes that share none are left out.

    A member meets the least member of each of its buckets. It needs an edge to the least of these alone, if they are joined to that one as well; the
    latter edges are the same for all members of a bucket, so a group of m near copies gives about m edges, not m times its bands.
    """
    hits = sketched.select("digest", F.explode("bands").alias("band"))
    buckets = hits.groupBy("band").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least")
    met = hits.join(buckets, "band").groupBy("digest").agg(F.array_sort(F.collect_set("least")).alias("leasts"))
    edges = met.select(F.explode(F.array_union(F.array("digest"), "leasts")).alias("a"), F.col("leasts")[0].alias("b"))
    return components(edges.where("a <> b").distinct())


def texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The columns of members (digest and doc_id among them) with the text of each; a row more for each further text under the same id."""
    if members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # else all texts are shuffled to their sets
        wanted = members.select(F.col("doc_id").alias("_wanted")).distinct()
        docs = docs.join(F.broadcast(wanted), docs.doc_id.eqNullSafe(F.col("_wanted")), "left_semi")
    near = members.hint("merge").withColumnRenamed("doc_id", "_of")
    return docs.join(near, docs.doc_id.eqNullSafe(near._of)).select(*[c for c in members.columns if c != "doc_id"], "text")


def refined(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """members (digest, doc_id, grams, root) with the components of more than one block banded once more; what meets nothing there goes."""
    sizes = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_MEMBERS).select("root"), "wide")
    if not sizes.limit(1).count():
        return members
    sizes = small(sizes, BROADCAST_ROOTS)
    wide = written(members.join(sizes, "root", "left_semi"), "wide-members")
    bands, rows = band_shape(threshold, FINE_RECALL, FINE_HASHES)

    def run(batches):
        for part, column in text_slices(batches, 1, 1 << 20):
            for want, grams in zip(part.column(0).to_pylist(), gram_sets(column, n)):
                if digest_of(grams) == want:
                    own = band_hashes(signature(grams, bands * rows), bands, rows)
                    yield pa.RecordBatch.from_arrays([pa.array([want] * len(own), pa.binary()), pa.array(own)], ["digest", "band"])

    fine = written(in_batches(texts_of(docs, wide.select("digest", "doc_id")), run, "digest binary, band bigint").distinct(), "fine-bands")
    found = band_components(fine.select("digest", F.array("band").alias("bands")))
    again = wide.drop("root").join(found, F.col("digest") == F.col("node")).drop("node")
    return written(members.join(sizes, "root", "left_anti").unionByName(again), "refined")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, second_banding: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, copy_id, n_copies, class_id, n_links.

    copy_id: least id of the rows with the same n-gram set, n_copies: their number. class_id: least id of all that verified
    links connect. n_links: other copy classes whose sets reach the threshold with this one. second_banding: whether components of several blocks are banded once more
    before they are verified; without it every pair of a component is verified, so that the first banding alone decides what is missed.
    """
    bands, rows = band_shape(threshold, recall)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drawn = written(sketches(docs, n, bands, rows), "sketches")
    copies = written(
        drawn.groupBy("digest").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")),
        "copies",
    )
    roots = band_components(copies)
    near = copies.select("digest", F.col("copy_id").alias("doc_id"), "grams").join(roots, F.col("digest") == F.col("node")).drop("node")
    near = written(near, "near")
    near = refined(docs, near, n, threshold) if second_banding else near
    sizes = near.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    sizes = small(written(sizes, "sizes"), BROADCAST_ROOTS)
    members = written(
        near.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).select("root", "blocks", "block", "digest", "doc_id"),
        "members",
    )
    texts = texts_of(docs, members)

    def sets(batches):
        for part, column in text_slices(batches, 4, 1 << 20):
            wanted = part.column(3).to_pylist()
            found = list(gram_sets(column, n))
            keep = [i for i, (w, g) in enumerate(zip(wanted, found)) if digest_of(g) == w]  # another text under the same id
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(keep, pa.int64())) for k in range(4)), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["root", "blocks", "block", "digest", "set"])

    full = in_batches(texts, sets, "root binary, blocks int, block int, digest binary, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = full.withColumn("other", other).select(
        "root", "blocks", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), "block", "digest", "set"
    )
    key = ["root", "t1", "t2"]

    def verify(batches):
        out, held, now = [], {}, None

        def close():
            if held:
                many = now[3] > 1
                # a tile of two blocks with members of one only has nothing to compare
                if now[1] == now[2] or len({m[1] for m in held.values()}) > 1:
                    out.extend((a, b, links, many) for a, b, links in tile_links(list(held.values()), threshold))
                held.clear()

        for batch in batches:
            for root, blocks, t1, t2, block, digest, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[:3] != (root, t1, t2):
                    close()
                    now = (root, t1, t2, blocks)
                held[digest] = (digest, block, np.frombuffer(grams, np.uint64))  # once, however often its id and text repeat
            if len(out) > 10_000:
                yield _links_batch(out)
                out = []
        close()
        yield _links_batch(out)

    links = written(in_batches(tiles.repartition(*key).sortWithinPartitions(*key), verify, "a binary, b binary, links bigint, many boolean"), "links")
    wide = links.where("many")
    settled = links.where("NOT many").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if wide.limit(1).count():
        found = components(wide)
        lone = wide.select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
        settled = settled.unionByName(found).unionByName(lone)
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links")).join(settled, "node")
    counted = written(counted.join(copies.select(F.col("digest").alias("node"), "copy_id"), "node"), "counted")
    ids = small(written(counted.groupBy("root").agg(F.min("copy_id").alias("class_id")), "classes"), BROADCAST_ROOTS)
    placed = counted.join(ids, "root").select(F.col("node").alias("digest"), "class_id", "n_links")
    classed = written(
        copies.select("digest", "copy_id", "n_copies", "grams").join(placed, "digest", "left").select(
            "digest", "copy_id", "n_copies", "grams", F.when(F.col("n_links").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
        ),
        "classed",
    )
    for held in (copies, members, links, counted):
        dropped(held)
    lone = F.col("grams") == 0
    return drawn.select("doc_id", "digest").join(classed, "digest").select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(lone, F.lit(1)).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "n_links",
    )


def _links_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], ["a", "b", "links", "many"])


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents"), "doc_id"))
