"""Texts as runs of distinct chunks: the shared first half of tokenizing a column.

A text is split at every single space by Arrow, and the chunks of a slice of rows are dictionary-encoded, so the slow work
per chunk is done once per distinct chunk of a slice (and once per worker while it stays in a bounded cache), and the
rest, from chunks back to whole texts, is two Arrow gathers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split and gathered at once, and entries of each worker's caches.
SLICE_BYTES = 2 << 20
CACHE_ENTRIES = 250_000


def text_slices(batches, text: int, limit: int = SLICE_BYTES):
    """(record batch slice, its texts with null as empty); at most `limit` bytes a slice, one row at least."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(column):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at), pc.fill_null(column.slice(at, to - at).cast(pa.large_string()), "")
            at = to
            pa.default_memory_pool().release_unused()


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, chunk indices, distinct chunks: row r is " ".join(distinct[i] for i in indices[offsets[r]:offsets[r+1]])."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def gathered(values: list[bytes], indices: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values at the indices as one run of bytes, and the byte bounds of each row in it."""
    return gathered_array(pa.array(values, pa.large_binary()), indices, offsets)


def gathered_array(values: pa.Array, indices: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
    run = values.take(pa.array(indices))
    bounds = np.frombuffer(run.buffers()[1], dtype=np.int64, count=len(run) + 1)
    data = run.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), bounds[offsets]


class Bounded(dict):
    """A cache that starts again when it is full."""

    def __init__(self, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
