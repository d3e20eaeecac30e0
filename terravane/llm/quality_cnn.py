"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the UTF-8 bytes of the whole document; a filter's response at a position is a sum of table
entries, one for each byte of its width. Responses are max-pooled over chunks of two blocks that overlap by one, a linear
layer gives each chunk a logit, and the mean logit of all chunks gives the document's probability.

The network is fitted on the driver on a bounded, documented sample of labelled rows (TRAIN_ROWS a class), whole texts, drawn by hash of the
id, from rows outside the held-out fold only. A step draws some chunks of each of its texts anew, from the whole text, so what a fit sees is no prefix and no fixed part. Scoring
reads every byte of every document in Arrow batches and shuffles nothing; the model is a constant of 80 KB.

Defined cases: null text counts as empty, and an empty text is one padding byte; without labels of both classes every
score is the smoothed share of label 1; null or other labels are ignored; a null id is in no held-out fold; rows of equal
id are scored one by one, and the least of them stands for a labelled id in the fit; other columns are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .chunks import text_slices
from .common import in_batches, table, text_of

BLOCK = 256  # a chunk is two blocks, and starts at each block
WIDTH, FILTERS = 5, 16
#: The bound of the sample that is fitted: rows of each class.
TRAIN_ROWS = 1500
#: Chunks of a text that a step of the fit draws.
DRAWN = 4
STEPS, BATCH_ROWS, RATE, DECAY = 400, 50, 0.02, 1e-4
THRESHOLD = 0.7
#: Positions whose responses are held at once.
SPAN = 1 << 15


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


class ByteCNN:
    """tables[k, byte, filter], bias[filter], weight[filter], offset."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.5, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Responses at all positions of `data` but the last WIDTH - 1, which only complete the windows before them."""
        n = data.shape[-1] - WIDTH + 1
        out = np.take(self.tables[0], data[..., :n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.tables[k], data[..., k : k + n], axis=0)
        return out

    def logits(self, texts: list[bytes | memoryview]) -> np.ndarray:
        """The document logit of each text; every byte counts, padding completes the last windows."""
        pad = b"\0" * (WIDTH - 1)
        parts, starts, owner, at = [], [], [], 0
        for d, text in enumerate(texts):
            n = max(1, len(text))
            parts += [text if len(text) else b"\0", pad]
            first = np.append(np.arange(at, at + n, BLOCK), at + n)  # the padding is a block of its own, which no chunk takes in
            starts.append(first)
            owner.append(np.append(np.full(len(first) - 1, d), -1))
            at += n + WIDTH - 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        top = np.empty((len(starts), FILTERS), np.float32)
        cuts = np.append(starts, len(data))
        b = 0
        while b < len(starts):
            e = max(b + 1, int(np.searchsorted(cuts, cuts[b] + SPAN, side="right")) - 1)
            lo, hi = cuts[b], cuts[e]
            piece = data[lo : min(hi + WIDTH - 1, len(data))]
            if len(piece) < hi - lo + WIDTH - 1:
                piece = np.concatenate([piece, np.zeros(hi - lo + WIDTH - 1 - len(piece), np.uint8)])
            top[b:e] = np.maximum.reduceat(self.responses(piece), starts[b:e] - lo, axis=0)
            b = e
        top, owner = top[owner >= 0], owner[owner >= 0]
        pooled = top.copy()
        same = owner[1:] == owner[:-1]
        pooled[:-1][same] = np.maximum(top[:-1][same], top[1:][same])
        last_of_many = np.append(~same, True) & np.append(False, same)  # its block is in the chunk before: no chunk of its own
        chunk = np.maximum(pooled + self.bias, 0) @ self.weight + self.offset[0]
        chunk, owner = chunk[~last_of_many].astype(np.float64), owner[~last_of_many]
        return np.bincount(owner, chunk, len(texts)) / np.bincount(owner, minlength=len(texts))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> None:
        """Adam on the logistic loss of whole documents, DRAWN random chunks of each a step, classes weighted equally."""
        size = 2 * BLOCK + WIDTH - 1
        lengths = np.array([max(1, len(t)) for t in texts])
        at = np.concatenate([[0], np.cumsum(lengths + size)])  # each text is followed by a chunk of padding
        data = np.zeros(at[-1], np.uint8)
        for a, t in zip(at, texts):
            data[a : a + len(t)] = np.frombuffer(t, np.uint8)
        starts = -(-np.maximum(1, lengths - BLOCK) // BLOCK)  # as many as there are chunks in scoring
        share = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        params = [self.tables, self.bias, self.weight, self.offset]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        while t < STEPS:
            for s in range(0, len(order), BATCH_ROWS):
                docs = order[s : s + BATCH_ROWS]
                drawn = [rng.permutation(starts[d])[:DRAWN] if starts[d] <= 4 * DRAWN else rng.integers(0, starts[d], DRAWN) for d in docs]
                counts = np.array([len(c) for c in drawn])
                local = np.repeat(np.arange(len(docs)), counts)
                first = at[docs][local] + np.concatenate(drawn) * BLOCK
                x = data[first[:, None] + np.arange(size)]
                r = self.responses(x)
                where = r.argmax(axis=1)  # chunk, filter -> position
                peak = np.take_along_axis(r, where[:, None, :], axis=1)[:, 0, :] + self.bias
                hidden = np.maximum(peak, 0)
                logit = np.bincount(local, hidden @ self.weight, len(docs)) / counts + self.offset[0]
                p = 1 / (1 + np.exp(-logit))
                g = ((p - labels[docs]) * share[docs] / len(docs)).astype(np.float32)
                gc = (g / counts)[local].astype(np.float32)
                back = gc[:, None] * self.weight * (peak > 0)
                grads = [np.zeros_like(self.tables), back.sum(0), hidden.T @ gc, np.array([g.sum()], np.float32)]
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (x[np.arange(len(x))[:, None], where + k], f), back)
                t += 1
                for j, (q, d) in enumerate(zip(params, grads)):
                    d = d + DECAY * q
                    m[j] = 0.9 * m[j] + 0.1 * d
                    v[j] = 0.999 * v[j] + 0.001 * d * d
                    q -= (RATE * (1 - 0.9 * t / max(t, STEPS)) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            order = rng.permutation(len(texts))


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one 0 or 1 for each labelled id outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, text: at most TRAIN_ROWS ids a class, none of the held-out fold, one row each, the least text, however often an id repeats."""
    usable = usable_labels(labels)
    picked = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for q in (0, 1)]
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> ByteCNN | float:
    """The fitted network; the smoothed share of label 1 where labels of both classes are missing."""
    rows = sorted(tuple(r) for r in training_sample(docs.select(F.col("doc_id").cast("bigint"), "text"), labels).collect())
    y = np.array([r[1] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return (float(y.sum()) + 1) / (len(y) + 2)
    net = ByteCNN()
    net.fit([r[2].encode() for r in rows], y)
    # classes count equally in the fit; the offset brings back their odds among all usable labels, which decide texts too short to tell
    zeros, ones = usable_labels(labels).agg(F.sum(1 - F.col("quality")), F.sum("quality")).first()
    net.offset += np.float32(np.log(max(1, ones) / max(1, zeros)))
    return net


def scored(docs: DataFrame, model: ByteCNN | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, as doc_id, and the score of every row."""

    def run(batches):
        for part, texts in text_slices(batches, 1, 2 << 20):
            if isinstance(model, float):
                scores = np.full(len(texts), model)
            else:
                logits = model.logits([memoryview(b.as_buffer()) for b in pc.cast(texts, pa.large_binary())])
                scores = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_quality_cnn(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "labels"))
