"""Packing: bounded-space online best fit.

Each partition reads its documents as a stream, encodes them, cuts off full windows and places the rest of each document
into the open window that it fits best, with a fixed number of windows open. When none fits, the fullest window is topped
up with a cut from the piece if its gap is worth a cut, and emitted. What is still open at the end of a partition is merged
in a second step: the leftover pieces of a fixed number of partitions meet in one task, which packs them once more, so
the pieces in a task are bounded by partitions a group times windows, whatever the input.

Only pieces (ids of documents, bounds, checksums) are written or shuffled, never token ids. Sequence ids come from the
partition's number and a counter, so they are unique without coordination; the pieces are written once, so that a lost
executor cannot change them between the steps.

Defined cases: null text counts as empty and is the one end token; an empty table gives an empty result; repeated rows are packed one
by one; other columns are not read; a document of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .chunks import chunked, gathered_array, text_slices
from .common import in_batches, table, written

WINDOW = 2048
END_ID = 1
#: Windows kept open in a partition; gaps below this are padded instead of filled by a cut; partitions merged in one task.
OPEN_WINDOWS = 16
LEAST_CUT = 16
MERGED_PARTITIONS = 32
#: Sequence ids: partition number or merge group in the upper bits; merged ones are above this bit.
_LEFTOVER_BIT = 1 << 61


#: White space of any kind, for patterns of Arrow.
_SPACE = r"[\s\pZ\x{85}\x{1c}-\x{1f}]"
#: Bytes of text encoded at once.
SLICE = 6 << 20


class ByteBPE:
    """Ids of whole texts by the tokenizers library, each distinct chunk between spaces encoded once a slice of rows.

    The pre-tokenizer joins a single space to what follows it, so where no other white space touches a space, the ids of a
    text are those of its chunks with their spaces. Texts in which white space touches a space are encoded as they are.
    """

    #: Bytes of chunks encoded in one string.
    JOINED = 1 << 13

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        size = self.model.get_vocab_size()
        self.bytes_of = np.array([len(self.model.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.odd_chunk = "|".join([f"^{_SPACE}", f"{_SPACE}$", "^$", *map(re.escape, self.special)])

    def ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _coded(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of " chunk" as bytes, and where each distinct chunk stands among them.

        Chunks are joined to long strings, encoded together and told apart by byte lengths. Empty chunks, those with white
        space at an end and those that hold a special token are encoded one by one.
        """
        odd = pc.match_substring_regex(distinct, self.odd_chunk)
        alone, joined = distinct.filter(odd).to_pylist(), distinct.filter(pc.invert(odd))
        ends = np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        marks = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, self.JOINED), side="right")
        bounds, own = np.unique(np.concatenate([[0], marks, [len(joined)]])).tolist(), joined.to_pylist()
        ids = [np.zeros(0, "<u4")]
        for a, b in zip(bounds, bounds[1:]):  # one string at a time: the library's results take up far more than their ids
            ids.append(np.array(self.model.encode_batch_fast([" " + " ".join(own[a:b])], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(ids)
        token_ends = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(token_ends, ends) + 1
        if len(ends) and (cuts[-1] != len(ids) or (token_ends[cuts - 1] != ends).any()):  # a token over the border of two chunks
            alone, joined, cuts, ids = [*alone, *joined.to_pylist()], joined.slice(0, 0), cuts[:0], ids[:0]
            order = np.concatenate([np.flatnonzero(odd.to_numpy(zero_copy_only=False)), np.flatnonzero(~odd.to_numpy(zero_copy_only=False))])
        else:
            order = np.concatenate([np.flatnonzero(~odd.to_numpy(zero_copy_only=False)), np.flatnonzero(odd.to_numpy(zero_copy_only=False))])
        offsets = np.append(0, cuts * 4).astype(np.int64)
        many = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4").tobytes())])
        place = np.empty(len(distinct), np.int64)
        place[order] = np.arange(len(distinct))
        return pa.concat_arrays([many, pa.array([self.ids(" " + c) for c in alone], pa.large_binary())]), place

    def encode_texts(self, texts: pa.Array):
        """Bytes of the little-endian 32-bit ids of each text."""
        odd = pc.match_substring_regex(texts, rf"( {_SPACE})|({_SPACE} )").to_numpy(zero_copy_only=False)
        offsets, indices, distinct = chunked(texts)
        values, place = self._coded(distinct)
        firsts = indices[offsets[:-1]]
        indices = place[indices]
        begun: dict[int, int] = {}
        for c in firsts.tolist():
            begun.setdefault(c, len(values) + len(begun))
        starts = pa.array([self.ids(c) for c in distinct.take(pa.array(list(begun), pa.int64())).to_pylist()], pa.large_binary())
        indices[offsets[:-1]] = [begun[c] for c in firsts.tolist()]
        run, at = gathered_array(pa.concat_arrays([values, starts]), indices, offsets)
        for r in range(len(texts)):
            yield self.ids(texts[r].as_py()) if odd[r] else run[at[r] : at[r + 1]]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


class Windows:
    """Open windows of one stream. A piece is (doc_id, start, length, crc, doc_tokens); `out` gets the closed windows' pieces."""

    def __init__(self, out, window: int, open_windows: int, least_cut: int):
        self.out, self.window, self.most, self.least_cut = out, window, open_windows, least_cut
        self.open: list[tuple[int, list]] = []

    def full(self, piece) -> None:
        self.out([piece])

    def place(self, length: int, cut) -> None:
        """cut(a, b) makes the piece of the tokens a to b of what is placed; without cuts it is called as cut(0, length)."""
        at = 0
        while at < length:
            need = length - at
            fits = [(self.window - used - need, i) for i, (used, _) in enumerate(self.open) if used + need <= self.window]
            if fits:
                gap, i = min(fits)
                used, pieces = self.open[i]
                pieces.append(cut(at, length))
                self.open[i] = (used + need, pieces)
                if gap == 0:
                    self.out(self.open.pop(i)[1])
                return
            if len(self.open) < self.most:
                self.open.append((need, [cut(at, length)]))
                return
            i = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open.pop(i)
            gap = self.window - used
            if self.least_cut and gap >= self.least_cut and need - gap >= self.least_cut:
                pieces.append(cut(at, at + gap))
                at += gap
            self.out(pieces)


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part bigint"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


class _Sequences:
    """Numbers closed windows and collects their rows."""

    def __init__(self, base: int, part: int | None = None):
        self.next, self.part, self.rows = base, part, []

    def __call__(self, pieces) -> None:
        offset = 0
        for doc_id, start, length, crc, total in pieces:
            self.rows.append((doc_id, start, length, crc, total, self.next, offset, self.part))
            offset += length
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches):
        bpe, part = load(path), TaskContext.get().partitionId()
        closed = _Sequences(part << 32)
        windows = Windows(closed, window, open_windows, least_cut)
        end = np.array([END_ID], "<u4").tobytes()
        for rows, texts in text_slices(batches, 1, SLICE):
            for doc_id, ids in zip(rows.column(0).to_pylist(), bpe.encode_texts(texts)):
                ids = bytes(ids) + end
                total = len(ids) // 4

                def cut(a, b, base=0, ids=ids, doc_id=doc_id, total=total):
                    return doc_id, base + a, b - a, zlib.crc32(ids[4 * (base + a) : 4 * (base + b)]), total

                whole = total // window * window
                for a in range(0, whole, window):
                    windows.full(cut(a, a + window))
                windows.place(total - whole, functools.partial(cut, base=whole))
            yield closed.batch()
        left = _Sequences(0, part)
        for _, pieces in windows.open:
            left(pieces)
        yield left.batch()

    def merge(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (-r[2], r[0] is None, r[0], r[1], r[3]))
        if not rows:
            return
        closed = _Sequences(_LEFTOVER_BIT | rows[0][7] // MERGED_PARTITIONS << 32)
        windows = Windows(closed, window, len(rows) + 1, 0)  # longest first into the best fit, all windows open
        for r in rows:
            windows.place(r[2], lambda a, b, r=r: r[:5])
        for _, pieces in windows.open:
            closed(pieces)
        yield closed.batch()

    pieces = written(in_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col), first, _PIECES, SLICE), "pieces")
    left = pieces.where(F.col("part").isNotNull())
    merged = left.groupBy(F.floor(F.col("part") / MERGED_PARTITIONS)).applyInArrow(lambda t: pa.Table.from_batches(list(merge(t.to_batches())), _batch([]).schema), _PIECES)
    return pieces.where(F.col("part").isNull()).unionByName(merged).drop("part")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spread(table(spark, sf_dir, "documents"), "doc_id"), public_tokenizers.path("byte_bpe_50k.json"))
