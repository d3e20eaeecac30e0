"""BPE encoding and decoding by per-prefix dynamic programming.

Byte-pair encoding has a property that makes left-to-right work exact: the encoding of every prefix of a word ends in one
token that no other choice can replace. For each prefix the automaton of the vocabulary (its suffix links lead from the
longest token that ends here to all shorter ones) lists the tokens that end there, and the one is kept whose start is
the word's start, or whose pair with the last token of the shorter prefix is compatible, meaning that no merge across their border
would have come first. Following the stored tokens back from the end gives the ids.

Texts are handled whole, in Arrow batches, once per distinct chunk between spaces (see chunks.py); nothing is shuffled and
a lost executor's rows are simply encoded again. The vocabulary's path is a parameter and is read once per worker.

Defined cases: null text counts as empty and gives no ids; special tokens written out in a text are those tokens, as the
vocabulary file says; characters without a token cannot occur, since all bytes have one; rows of equal id are encoded one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..operators.relational import spread
from .chunks import Bounded, chunked, gathered, text_slices
from .common import in_batches, table

#: Moves a word's last symbol to code points of its own, since the vocabulary tells word ends apart.
_END = 0x1000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}
    return [chr(moved.get(b, b)) for b in range(256)]


class PrefixBPE:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.strings = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.strings[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.strings[i] = token
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        keys: dict[int, str] = {}
        for byte, s in enumerate(byte_symbols()):
            keys[vocab[s]] = chr(byte)
            keys[vocab[s + suffix]] = chr(byte + _END)
        self.rank: dict[int, int] = dict.fromkeys(keys, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[self.strings[left] + self.strings[right]]
            self.merge[left, right] = rank
            if whole not in self.rank:
                self.rank[whole], self.halves[whole], keys[whole] = rank, (left, right), keys[left] + keys[right]
        self.length = {i: len(k) for i, k in keys.items()}
        self.pairs: Bounded = Bounded(1_000_000)
        self.automaton = ahocorasick.Automaton()
        reachable = set()
        for i in sorted(keys, key=self.rank.__getitem__):
            if i not in self.halves or (reachable.issuperset(self.halves[i]) and self._border_holds(*self.halves[i], self.rank[i])):
                reachable.add(i)
                self.automaton.add_word(keys[i], i)
        self.automaton.make_automaton()
        self.words: Bounded = Bounded()
        self.chunks: Bounded = Bounded()

    def _spine(self, token: int, side: int):
        """(piece, rank at which its parent takes it in) from the token itself down its left (0) or right (1) edge."""
        until = 1 << 60
        while True:
            yield token, until
            if token not in self.halves:
                return
            until, token = self.rank[token], self.halves[token][side]

    def _border_holds(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """No merge over the border of two tokens comes (before rank `before`) while both its pieces are still free.

        A tie with the rule that takes in the left piece is won by that one, which stands further left; a tie with the rule
        that takes in the right piece is won by the merge over the border.
        """
        edge = list(self._spine(right, 0))
        for x, x_until in self._spine(left, 1):
            for y, y_until in edge:
                m = self.merge.get((x, y))
                if m is not None and (t := max(m, self.rank[x], self.rank[y])) < before and t < x_until and t <= y_until:
                    return False
        return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        held = self.pairs.get(key)
        return held if held is not None else self.pairs.put(key, self._border_holds(left, right))

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-tokenized word."""
        held = self.words.get(word)
        if held is not None:
            return held
        key = word.encode("utf-8").decode("latin-1")
        key = key[:-1] + chr(ord(key[-1]) + _END)
        last = [-1] * (len(key) + 1)
        length, pairs = self.length, self.pairs
        for at, token in self.automaton.iter(key):
            at += 1
            if last[at] >= 0:
                continue
            start = at - length[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 20 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[at] = token
        ids, at = [], len(key)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return self.words.put(word, tuple(reversed(ids)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text: special tokens, then normal form C, lower case character by character, words, ids."""
        ids, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern is not None else ():
            ids += [*self._encode_plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return ids + self._encode_plain(text[at:])

    def _encode_plain(self, text: str) -> list[int]:
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [i for word in self.pattern.findall(plain) for i in self.encode_word(word)]

    def decode(self, ids) -> str:
        """Token strings with a space between, as the vocabulary has no decoder of its own."""
        return " ".join([self.strings[i] for i in ids])

    def encoded_chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded tokens in UTF-8, a space after each."""
        held = self.chunks.get(chunk)
        if held is None:
            ids = self.encode(chunk)
            held = self.chunks.put(chunk, (np.array(ids, "<u4").tobytes(), (self.decode(ids) + " ").encode("utf-8") if ids else b""))
        return held

    def encode_texts(self, texts: pa.Array):
        """(bytes of ids, bytes of decoded text) of each text of an Arrow array."""
        offsets, indices, distinct = chunked(texts)
        coded = [self.encoded_chunk(c) for c in distinct.to_pylist()]
        ids, id_at = gathered([c[0] for c in coded], indices, offsets)
        said, said_at = gathered([c[1] for c in coded], indices, offsets)
        for r in range(len(texts)):
            yield ids[id_at[r] : id_at[r + 1]], said[said_at[r] : max(said_at[r], said_at[r + 1] - 1)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with_ids adds ids (array<int>) and decoded."""

    def run(batches):
        bpe = load(path)
        for rows, texts in text_slices(batches, 1):
            n, a, b, ids_out, said_out = [], [], [], [], []
            for ids, said in bpe.encode_texts(texts):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(said).hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    said_out.append(bytes(said).decode("utf-8"))
            columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(said_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return in_batches(docs.select(id_col, text_col), run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(spread(table(spark, sf_dir, "documents"), "doc_id"), public_tokenizers.path("word_bpe_49k.json"))
