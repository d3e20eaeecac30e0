"""Hard-negative mining: product quantisation with stored residual norms, rigorous windows, exact integer rerank.

1. Components become integers. Codebooks of 256 centroids for every two components are fitted on a bounded sample; every row is
   encoded and stored with the norm of what its codes leave out.
2. Rows are dealt into blocks of bounded size, and every anchor goes to every block. A task holds one block and reads its anchors as a stream. An
   anchor's lookup tables give the score of each row's codes; the true score lies within the anchor's norm times the row's
   residual norm of it, by Cauchy and Schwarz. So rows whose bounds cannot reach the first places of the window are left out with certainty.
3. The rest is scored exactly in integers, and a block gives each window its first places. First places of all blocks meet by window: blocks
   times places rows a window.
4. That is done twice: for an anchor's positives, and, with windows from their scores, for the negatives of each.

Anchors are a stated query set against all rows, in blocks; no block, candidate or window is capped. Only codebooks come from a sample, and they decide what is
scored exactly, never what is returned.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; a null id is an ordinary row after all others in ties
and never an anchor; repeated ids are rows of their own, and each is an anchor where its id is one; a row never is its own positive; a shorter vector counts as
filled up with zeros; a component is held within 2^27 in size, so that scores of 512 components fit a bigint; an anchor without positives, or a window without
rows, gives no rows; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import spread
from .common import in_batches, table, written

#: Rows that fit the codebooks, by the hash of their ids; components a codebook; centroids; rounds of fitting.
TRAIN_ROWS, SUB, CENTROIDS, ROUNDS = 4096, 2, 256, 6
#: Rows of a block at most, on average; blocks a core at least, so that few rows use all cores as well.
BLOCK_ROWS, BLOCKS_PER_CORE = 65_536, 4
#: Scores held at once.
TILE = 1 << 20
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
_MOST = 1 << 27


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """id, label, v (array of integers) of the rows that take part."""
    whole = F.transform(vector_col, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(_MOST)), F.lit(-_MOST)).cast("int"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    taken = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return taken.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v"))


class Codebooks:
    """Centroids of every SUB components."""

    def __init__(self, sample: list[list[int]]):
        width = -(-max([len(v) for v in sample] or [0]) // SUB) * SUB
        points = filled([np.array(v, np.float64) for v in sample], width).reshape(len(sample), width // SUB, SUB)
        rng = np.random.default_rng(11)
        self.centroids = np.zeros((width // SUB, CENTROIDS, SUB))
        for s in range(width // SUB):
            own = np.unique(points[:, s], axis=0)
            held = own if len(own) <= CENTROIDS else own[np.sort(rng.choice(len(own), CENTROIDS, replace=False))]
            for _ in range(ROUNDS if len(own) > CENTROIDS else 0):
                code = nearest(points[:, s], held)
                sums = np.stack([np.bincount(code, points[:, s, k], len(held)) for k in range(SUB)], axis=1)
                counts = np.bincount(code, minlength=len(held))[:, None]
                held = np.where(counts > 0, sums / np.maximum(counts, 1), held)
            self.centroids[s, : len(held)] = held
            self.centroids[s, len(held) :] = held[0]

    def encode(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, reach): the norm of what the codes leave out, with room for the rounding of the tables' sums."""
        subs = len(self.centroids)
        width = max([subs * SUB, *map(len, rows)])
        v = filled(rows, width)
        codes = np.zeros((len(rows), subs), np.uint8)
        for s in range(subs):
            part = v[:, s * SUB : (s + 1) * SUB]
            codes[:, s] = nearest(part, self.centroids[s])
        norms = np.sqrt((v**2).sum(axis=1))
        for s in range(subs):
            v[:, s * SUB : (s + 1) * SUB] -= self.centroids[s][codes[:, s]]
        left = np.sqrt((v**2).sum(axis=1))
        return codes, left + 1e-5 * (norms + left) * max(1.0, subs / 64) + 1e-6

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of each anchor's parts with the centroids: anchors, parts, centroids."""
        subs = len(self.centroids)
        q = filled(list(anchors), max(subs * SUB, anchors.shape[1]))[:, : subs * SUB].reshape(len(anchors), subs, SUB)
        return np.einsum("asd,scd->asc", q, self.centroids).astype(np.float32)


def filled(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for at in range(0, len(points), 8192):
        part = points[at : at + 8192]
        out[at : at + 8192] = np.argmin((centroids**2).sum(axis=1)[None, :] - 2 * part @ centroids.T, axis=1)
    return out


class Block:
    """The rows of a block, and its first places for an anchor."""

    def __init__(self, rows, ids, labels, vectors, codes, reach):
        order = sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))  # so that ties stand in the order of ids
        self.rows, self.ids = np.array([rows[i] for i in order], np.int64), [ids[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.int64)
        held = [np.frombuffer(vectors[i], "<i4") for i in order]
        self.v = np.zeros((len(order), max([0, *map(len, held)])), np.int32)
        for i, x in enumerate(held):
            self.v[i, : len(x)] = x
        self.codes = np.array([np.frombuffer(codes[i], np.uint8) for i in order]).reshape(len(order), -1)
        self.reach = np.array([reach[i] for i in order])
        self.tried = 0  # rows scored exactly

    def bounds(self, books: Codebooks, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores: anchors, rows."""
        tables = books.tables(anchors)
        about = np.zeros((len(anchors), len(self.rows)), np.float32)
        for s in range(tables.shape[1]):
            about += tables[:, s][:, self.codes[:, s]]
        room = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.reach[None, :] + 1
        return about - room, about + room

    def exact(self, chosen: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        self.tried += len(chosen)
        n = min(self.v.shape[1], len(anchor))
        return self.v[chosen, :n].astype(np.int64) @ anchor[:n].astype(np.int64)

    def first(self, may: np.ndarray, sure: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, n: int, least: int | None = None, most: int | None = None) -> list[tuple[int, int]]:
        """(row, score) of the first n rows in the window; may: rows that can be in it, sure: rows that are in it for certain."""
        if np.count_nonzero(sure) >= n:
            may = may & (high >= np.partition(low[sure], -n)[-n])
        chosen = np.flatnonzero(may)
        scores = self.exact(chosen, anchor)
        if least is not None:
            inside = (100 * scores >= least) & (100 * scores <= most)
            chosen, scores = chosen[inside], scores[inside]
        return [(int(chosen[i]), int(scores[i])) for i in np.argsort(-scores, kind="stable")[:n]]


_TILES = "block int, kind int, row bigint, id bigint, label bigint, v binary, codes binary, reach double, positives array<struct<row:bigint,id:bigint,score:bigint>>"
_FOUND = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, other bigint, other_id bigint, score bigint"


def first_places(index: DataFrame, anchors: DataFrame, books: Codebooks, blocks: int, negatives: bool, n: int) -> DataFrame:
    """The first n places of each block for each anchor (its positives), or for each of an anchor's positives (its negatives)."""
    none = F.lit(None)
    held = index.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "row", "id", "label", "v", "codes", "reach", none.cast("array<struct<row:bigint,id:bigint,score:bigint>>").alias("positives"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = anchors.select(everywhere, F.lit(1).alias("kind"), "row", "id", "label", "v", none.cast("binary").alias("codes"), none.cast("double").alias("reach"), "positives")
    tiles = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def run(batches):
        at, rows, block, waiting = None, [], None, []

        def answered():
            step = max(1, TILE // max(1, len(block.rows)))
            for i in range(0, len(waiting), step):
                yield places(block, books, waiting[i : i + step], negatives, n)
            waiting.clear()

        for batch in batches:
            for b, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at:
                    if waiting:
                        yield from answered()
                    at, rows, block = b, [], None
                if kind == 0:
                    rows.append(row[:6])
                elif rows:
                    block = block or Block(*zip(*rows))
                    waiting.append(row)
            if waiting:
                yield from answered()

    return in_batches(tiles, run, _FOUND)


def places(block: Block, books: Codebooks, asked: list[list], negatives: bool, n: int) -> pa.RecordBatch:
    out = []
    vectors = [np.frombuffer(q[3], "<i4") for q in asked]
    low, high = block.bounds(books, filled(vectors, max(map(len, vectors))))
    for i, (row, own_id, label, _, _, _, positives) in enumerate(asked):
        same = block.labels == label
        if not negatives:
            may = same & (block.rows != row)
            out += [(row, own_id, None, None, None, int(block.rows[j]), block.ids[j], score) for j, score in block.first(may, may, low[i], high[i], vectors[i], n)]
            continue
        for p in positives:
            least, most = LOW * p["score"], HIGH * p["score"]
            if least > most:
                continue
            may = ~same & (100.0 * high[i] >= least) & (100.0 * low[i] <= most)
            sure = may & (100.0 * low[i] >= least) & (100.0 * high[i] <= most)
            found = block.first(may, sure, low[i], high[i], vectors[i], n, least, most)
            out += [(row, own_id, p["row"], p["id"], p["score"], int(block.rows[j]), block.ids[j], score) for j, score in found]
    columns = list(zip(*out)) if out else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _FOUND.split(", ")])


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """row (a number of its own), id, label, v, codes, reach of every row."""

    def run(batches):
        for batch in batches:
            vectors = [np.array(v, "<i4") for v in batch.column(3).to_pylist()]
            codes, reach = books.encode(vectors)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(reach)],
                ["row", "id", "label", "v", "codes", "reach"],
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v")
    return in_batches(numbered, run, "row bigint, id bigint, label bigint, v binary, codes binary, reach double")


def fitted(rows: DataFrame) -> Codebooks:
    sample = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(TRAIN_ROWS).select("v")
    return Codebooks([r.v for r in sample.collect()])


def hard_negatives(rows: DataFrame, anchor: str = "id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: id, label, v of prepared(). anchor: the condition on id of anchors."""
    rows = written(rows, "vectors")
    books = fitted(rows)
    index = written(encoded(rows, books), "index")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(index.count() / BLOCK_ROWS), BLOCKS_PER_CORE * cores)
    anchors = index.where(anchor)
    ranked = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other"))
    near = first_places(index, anchors.withColumn("positives", F.lit(None).cast("array<struct<row:bigint,id:bigint,score:bigint>>")), books, blocks, False, positives)
    best = near.withColumn("rank", ranked(["anchor"])).where(F.col("rank") <= positives)
    wanted = best.groupBy("anchor").agg(F.collect_list(F.struct(F.col("other").alias("row"), F.col("other_id").alias("id"), "score")).alias("positives"))
    asked = written(anchors.join(wanted, F.col("row") == F.col("anchor")).drop("anchor"), "positives")
    found = first_places(index, asked, books, blocks, True, negatives)
    return found.withColumn("rank", ranked(["anchor", "positive"])).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 with the next of ten labels: a share of wrong labels."""
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives(relabelled(prepared(spread(vectors, "vec_id"))))


SQL = r"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM r AS a JOIN r ON r.id <> a.id WHERE a.id % 100 = 0
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
