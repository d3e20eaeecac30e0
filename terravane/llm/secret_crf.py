"""Secret scans: base patterns plus a linear-chain conditional random field.

The base patterns find the three fixed kinds exactly. The field tags tokens as beginning, inside or outside of a secret
from their shape, their neighbours and features of the whole text; Viterbi decodes the best tags, and tagged spans that touch no base span are added as
kind "crf". It is fitted here, by gradient ascent on the likelihood, on generated sentences in which keys, passwords and
signed tokens stand among look-alikes: numbers, addresses, dates, paths.

The field reads every token of every text. A sentence is decoded unless it provably has no secret: each token's own features, with the best that its context
could add, leave every other tag behind "outside" by more than the moves between tags could win back, so Viterbi would tag all of it outside (`CRF.quiet`); that
is a sum of learned weights, no word list. Tokens keep the symbols inside them; quotes, joining marks, brackets, closing marks and letters outside ASCII are tokens of their own, which neighbour
tags join to a secret. The word before and the word after a token are features by hash. A name that a joining mark follows (`DB_PASSWORD =`) is outside by rule. Nothing
is quadratic in the text. Rows are independent: no shuffle, and a lost executor's rows are scanned again.

Defined cases: null text counts as empty and has no spans; repeated rows are scanned one by one; an empty table gives an empty
result; columns other than id and text are not read by the scan and are carried through by redaction.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .chunks import text_slices
from .common import in_batches, table

#: The base patterns with their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_QUOTES = ("\"", "'", "`")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: HEX with its least length in it; runs are maximal either way.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: Holds wherever a base pattern can match.
_ANY_BASE = r"(?i)password|passwd|secret|token|api_?key|akia[a-z0-9]{12}|[0-9a-f]{32}"
_DIGIT = re.compile(r"[0-9]")
_SEGMENT = re.compile(r"\n|(?<=[.!?])\s")
_TOKEN = re.compile(r"""["'`]|[=:]|[,;()\[\]{}<>]|[^\x00-\x7f\s]+|[^\s"'`=:,;()\[\]{}<>\x80-\U0010ffff]+""")
_MARKS = "\"'`=:,;()[]{}<>"
KEY_WORDS = re.compile(r"(?i)pass(word|wd|phrase|wort)?$|pwd$|secret|token|api_?key|apikey|auth|credential|bearer|private|access_?key|signature|session|kennwort|contrase|密码|密碼|パスワード|비밀번호|пароль")
#: Holds in every text that KEY_WORDS finds a token in.
_KEYISH = re.compile(KEY_WORDS.pattern.replace("(word|wd|phrase|wort)?$", "").replace("$", ""))
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PARTS = re.compile(r"[A-Za-z]+([-_/.][A-Za-z]+)+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+([A-Z][a-z]+)+")
_NUMBER = re.compile(r"[-+]?[0-9][0-9.,/+-]*[a-zA-Z%]{0,2}")
#: Tokens before a token that its context features look at.
BEFORE = 6
OUT, BEGIN, INSIDE = 0, 1, 2
#: Hash buckets of the word before and of the word after a token.
BUCKETS = 32
FEATURES = (
    "bias len1 len3 len5 len7 len11 len15 len23 len39 len40 lower upper digit symbol mixed kinds3 flips3 flips6 rich richer hex digits number"
    " plain parts prefix mail path dotted accent quote joiner bracket close key_word odd"
    " assigned keyed near_key quoted glued glued_on names next_quote keyed_odd near_odd quoted_odd keyed_quoted keyed_plain glued_odd glued_mark"
    " after_key after_key_long code_text key_text digit_text"
).split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


class Outlined(dict):
    """Table of str.translate(): letters and digits to one sign a class, so that words of one outline are told apart by nothing; everything else stays, at its place."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if c.isascii():
            out = "0" if c.isdigit() else "g" if c.islower() else "G" if c.isupper() else c
        else:
            out = c if c.isspace() else "٣" if c.isdigit() else "é" if c.islower() else "É" if c.isupper() else "。"
        self[code] = ord(out)
        return ord(out)


OUTLINE = Outlined()


def stretches(text: str, quiet=None, keyish: bool = True):
    """Lists of token spans: all tokens of each line or sentence; without those whose outline is quiet and that hold nothing like a key word, where a test of an outline is given. keyish: whether the text may hold one."""
    outline = text.translate(OUTLINE) if quiet else ""
    keys = [m.start() for m in _KEYISH.finditer(text)] if quiet and keyish else []
    start, k = 0, 0
    for end, after in [*((m.start(), m.end()) for m in _SEGMENT.finditer(text)), (len(text), len(text))]:
        while k < len(keys) and keys[k] < start:
            k += 1
        if start < end and not (quiet and not (k < len(keys) and keys[k] < end) and quiet(outline[start:end])):
            chain = []
            for m in _TOKEN.finditer(text, start, end):
                a, b = m.span()
                body = a + len(m[0].rstrip(".!?"))
                chain += [span for span in ((a, body), (body, b)) if span[0] < span[1]]
            if chain:
                yield chain
        start = after


@functools.lru_cache(maxsize=1 << 14)
def bucket(word: str) -> int:
    """The hash bucket of a word; 0 stands for no word."""
    return 1 + zlib.crc32(word.lower().encode()) % (BUCKETS - 1)


def text_features(text: str) -> list[float]:
    n = max(1, len(text))
    marks = sum(map(text.count, "={};"))
    return [float(marks * 100 > n), float("key" in text or "secret" in text or "token" in text), float(len(_DIGIT.findall(text)) * 20 > n)]


@functools.lru_cache(maxsize=1 << 14)
def shape(run: str) -> tuple:
    """Features of a token alone; the last says that it looks drawn rather than written."""
    n = len(run)
    lower, upper, digit = (any(map(f, run)) for f in (str.islower, str.isupper, str.isdigit))
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in run]
    flips = sum(x != y for x, y in zip(classes, classes[1:]))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(run).values())
    ascii_ = run.isascii()
    mark, close = run in _MARKS, not run.strip(".!?")
    symbol = ascii_ and not mark and not close and any(k == 3 for k in classes)
    plain, parts, number, mail = bool(_PLAIN.fullmatch(run)), bool(_PARTS.fullmatch(run) or _CAMEL.fullmatch(run) and n >= 3 * (1 + sum(map(str.isupper, run[1:])))), bool(_NUMBER.fullmatch(run)), bool(re.fullmatch(r"[^@]+@[\w-]+(\.[\w-]+)+", run))
    path = run.count("/") >= 2 or run.startswith("www.")
    odd = ascii_ and n > 3 and not (mark or close or plain or parts or number or mail or path)
    return (
        1.0, n == 1, 2 <= n < 4, 4 <= n < 6, 6 <= n < 8, 8 <= n < 12, 12 <= n < 16, 16 <= n < 24, 24 <= n < 40, n >= 40, lower, upper, digit, symbol, lower and upper and digit,
        lower + upper + digit + symbol >= 3, flips >= 3, flips >= 6, entropy >= 3.0, entropy >= 3.7, n > 5 and all(c in "0123456789abcdefABCDEF" for c in run), run.isdigit(), number,
        plain, parts, bool(re.match(r"[A-Za-z]{2,6}[_-]", run)), mail, path, "." in run and not close, not ascii_, run in "\"'`", run in "=:", mark and run not in "\"'`=:", close, bool(KEY_WORDS.search(run)), odd,
    )


def chain_words(text: str, chain: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The buckets of the nearest word of letters before each token, and of the nearest after it."""
    runs = [text[a:b] for a, b in chain]
    words = [bucket(r) if r.isalpha() else 0 for r in runs]
    before, after, last = [], [], 0
    for w in words:
        before.append(last)
        last = w or last
    last = 0
    for w in reversed(words):
        after.append(last)
        last = w or last
    return before, after[::-1]


def contexts(chain: list[tuple[int, int]], runs: list[str], shapes: list[tuple]):
    """What stands around each token of a chain, as a tuple of truths."""
    for i, (a, b) in enumerate(chain):
        own = shapes[i]
        key, odd = own[-2], own[-1]
        back = [j for j in range(max(0, i - BEFORE), i) if runs[j] not in _QUOTES]
        assigned = bool(back) and runs[back[-1]] in "=:>"
        named = next((j for j in reversed(back) if runs[j] not in "=:>"), None)
        keyed = assigned and named is not None and bool(shapes[named][-2])
        near = any(shapes[j][-2] for j in back)
        after_key = bool(back) and bool(shapes[back[-1]][-2])
        opened = i > 0 and runs[i - 1] in _QUOTES and chain[i - 1][1] == a
        following = runs[i + 1] if i + 1 < len(runs) else ""
        quoted = opened and following != "" and following in _QUOTES and chain[i + 1][0] == b
        glued = i > 0 and chain[i - 1][1] == a and runs[i - 1] not in _QUOTES
        glued_on = following != "" and chain[i + 1][0] == b and following not in _QUOTES
        names = following != "" and following in "=:"
        mark = own[-6] or own[-5] or own[-4] or own[-3]
        yield (
            assigned, keyed, near, quoted, glued, glued_on, names, following != "" and following in _QUOTES, keyed and odd, near and odd, quoted and odd, keyed and (opened or quoted),
            bool(keyed and not odd and not key and not mark), glued and odd, bool(glued and mark), after_key, after_key and b - a >= 14,
        )


def chain_features(text: str, chain: list[tuple[int, int]], whole: list[float]) -> list[list[float]]:
    """Features of every token of a chain, without the words around it."""
    runs = [text[a:b] for a, b in chain]
    shapes = [shape(r) for r in runs]
    return [[*own, *around, *whole] for own, around in zip(shapes, contexts(chain, runs, shapes))]


_KEY, _NAMES = FEATURES.index("key_word"), FEATURES.index("names")
#: Bounds of the lengths of chains that are fitted together.
LENGTHS = (0, 8, 16, 24, 48, 96, 1 << 30)


def _padded(chains: list[tuple[list, list]]):
    """(features of all places as rows, seen sums of features by tag, seen pairs of tags, places after each chain's end) of chains, padded to the longest."""
    t = max(len(tags) for _, tags in chains)
    x, y, ended = np.zeros((len(chains), t, len(FEATURES) + 2 * BUCKETS), np.float32), np.zeros((len(chains), t), int), np.ones((len(chains), t), bool)
    for i, (f, tags) in enumerate(chains):
        x[i, : len(tags)], y[i, : len(tags)], ended[i, : len(tags)] = f, tags, False
    flat = x.reshape(len(chains) * t, -1)
    held = np.pad(y, ((0, 0), (1, 1)))
    seen_move = np.zeros((3, 3))
    np.add.at(seen_move, (held[:, :-1].ravel(), held[:, 1:].ravel()), 1)
    return flat, flat.T @ np.eye(3, dtype=np.float32)[y].reshape(len(flat), 3), seen_move, ended


class CRF:
    """Weights of features and of the words around (F + 2 * BUCKETS, 3) and of neighbouring tags (3, 3); a chain starts and ends outside."""

    def __init__(self):
        self.emit = np.zeros((len(FEATURES) + 2 * BUCKETS, 3))
        self.move = np.zeros((3, 3))
        self.move[OUT, INSIDE] = -1e4
        self._gains: dict[tuple, Gains] = {}
        self._own: dict[tuple, tuple] = {}
        self._around: dict[tuple, tuple] = {}

    def quiet(self, outline: str, whole: tuple) -> bool:
        """Whether the best tags of a sentence of this outline, without a key word, are all outside, for certain: no secret that begins, goes on or ends in any of its words could win (see Gains).

        whole: the features of the text.
        """
        gains = self._gains.get(whole)
        if gains is None:
            gains = self._gains[whole] = Gains(self, whole)
        words = outline.split()
        if gains.calm.issuperset(words):
            return True
        begun = -math.inf  # the most that a secret has won which goes on into the next word
        for inside, start, on, end in map(gains.__getitem__, words):
            if inside >= 0 or begun + end >= 0:
                return False
            begun += on
            if start > begun:
                begun = start
        return True

    def fit(self, chains: list[tuple[list, list]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3, word_decay: float = 6e-2) -> None:
        """Gradient ascent on the likelihood of chains (features of every place, tags), by scaled forward and backward sums.

        Chains of about one length are summed together; places after a chain's end are held outside, so the padding changes nothing.
        """
        groups = [_padded([c for c in chains if low < len(c[1]) <= high]) for low, high in zip(LENGTHS, LENGTHS[1:]) if any(low < len(c[1]) <= high for c in chains)]
        n, decays = len(chains), np.repeat([decay, word_decay], [len(FEATURES), 2 * BUCKETS])[:, None]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move)]
        for step in range(1, steps + 1):
            grads, m = [np.zeros_like(self.emit), np.zeros_like(self.move)], np.exp(self.move)
            for flat, seen_emit, seen_move, ended in groups:
                size, t = ended.shape
                e = (flat @ self.emit.astype(np.float32)).reshape(size, t, 3).astype(np.float64)
                e = np.exp(e - e.max(axis=2, keepdims=True))
                e[ended] = (1, 0, 0)
                f, b = np.empty_like(e), np.empty_like(e)
                f[:, 0] = m[OUT] * e[:, 0]
                f[:, 0] /= f[:, 0].sum(axis=1, keepdims=True)
                for i in range(1, t):
                    f[:, i] = (f[:, i - 1] @ m) * e[:, i]
                    f[:, i] /= f[:, i].sum(axis=1, keepdims=True)
                b[:, -1] = m[:, OUT]
                for i in range(t - 2, -1, -1):
                    b[:, i] = (e[:, i + 1] * b[:, i + 1]) @ m.T
                    b[:, i] /= b[:, i].sum(axis=1, keepdims=True)
                p = f * b
                p /= p.sum(axis=2, keepdims=True)
                pair = f[:, :-1, :, None] * m * (e[:, 1:] * b[:, 1:])[:, :, None, :]
                pair = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
                pair[OUT] += p[:, 0].sum(axis=0)
                pair[:, OUT] += p[:, -1].sum(axis=0)
                grads[0] += seen_emit - flat.T @ p.reshape(size * t, 3).astype(np.float32)
                grads[1] += seen_move - pair
            grads = [grads[0] / n - decays * self.emit, grads[1] / n]
            grads[1][OUT, INSIDE] = 0
            for param, g, (first, second) in zip((self.emit, self.move), grads, moments):
                first[:] = 0.9 * first + 0.1 * g
                second[:] = 0.999 * second + 0.001 * g * g
                param += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)

    def scores(self, text: str, chain: list[tuple[int, int]], whole: list[float]) -> np.ndarray:
        """The score of each tag at each token; a name that a joining mark follows is outside."""
        runs = [text[a:b] for a, b in chain]
        shapes = [shape(r) for r in runs]
        around = list(contexts(chain, runs, shapes))
        before, after = chain_words(text, chain)
        own = [self._part(self._own, s, 0) for s in shapes]
        near = [self._part(self._around, c, len(shapes[0])) for c in around]
        e = np.array(own) + np.array(near) + self.emit[len(FEATURES) :][before] + self.emit[len(FEATURES) + BUCKETS :][after] + np.array(whole) @ self.emit[len(FEATURES) - len(whole) : len(FEATURES)]
        for i, (s, c) in enumerate(zip(shapes, around)):
            if s[-2] and (c[6] or c[7] and i + 2 < len(runs) and runs[i + 2] in "=:"):
                e[i, 1:] = -1e4
        return e

    def _part(self, known: dict, values: tuple, at: int) -> tuple:
        """The scores of a tuple of features that stand from place `at` on."""
        out = known.get(values)
        if out is None:
            if len(known) > 1 << 16:
                known.clear()
            out = known[values] = tuple((np.array(values, float) @ self.emit[at : at + len(values)]).tolist())
        return out

    def decode(self, e: np.ndarray) -> list[int]:
        """Best tags of one chain by Viterbi, from the scores of its tags."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.move.tolist()  # nothing goes from outside to inside
        rows = e.tolist()
        o, b, i = oo + rows[0][0], ob + rows[0][1], -math.inf
        back = []
        for eo, eb, ei in rows[1:]:
            x, y, z = o + oo, b + bo, i + io
            no, fo = (x, OUT) if x >= y and x >= z else (y, BEGIN) if y >= z else (z, INSIDE)
            x, y, z = o + ob, b + bb, i + ib
            nb, fb = (x, OUT) if x >= y and x >= z else (y, BEGIN) if y >= z else (z, INSIDE)
            y, z = b + bi, i + ii
            ni, fi = (y, BEGIN) if y >= z else (z, INSIDE)
            o, b, i = no + eo, nb + eb, ni + ei
            back.append((fo, fb, fi))
        ends = (o + oo, b + bo, i + io)
        tags = [ends.index(max(ends))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]


class Gains(dict):
    """What a secret can win over "outside" at most in each run of signs between white space, by the run's outline and whatever stands around it, in a text of given features.

    Four sums of the features of its tokens and the moves into, within and out of a secret, each the best of all tags and with the most that letters, and words and joining marks around, could add: of a secret inside
    the run, of the part of one that begins in it and goes on, of one that goes on through it, and of one that ends in it. Quotes have effects further on: a run with one has no bound. calm: outlines whose first two
    sums are below nought and the others not above, so that no row of them holds a secret.
    """

    def __init__(self, crf: CRF, whole: tuple, limit: int = 1 << 18):
        super().__init__()
        self.move, self.gain, self.whole, self.size, self.calm = crf.move - crf.move[OUT, OUT], crf.emit[:, 1:] - crf.emit[:, :1], list(whole), limit, set()
        around = np.maximum(self.gain[len(FEATURES) :], 0).reshape(2, BUCKETS, 2).max(axis=1)
        most = lambda *names: np.maximum(self.gain[[FEATURES.index(f) for f in names]], 0)
        self.words, self.joint, self.named = around.sum(axis=0), most("assigned")[0], most("names")[0]
        self.rich, self.richer, self.hex, self.path = most("rich", "richer", "hex", "path")
        self.path = self.path + np.maximum(-self.gain[[FEATURES.index("odd"), FEATURES.index("glued_odd")]], 0).sum(axis=0)  # a path is not odd

    def __missing__(self, word: str) -> tuple[float, float, float, float]:
        if len(self) >= self.size:
            self.clear()
            self.calm.clear()
        chain = next(stretches(word), [])
        self[word] = out = self.sums(word, chain) if chain else (-math.inf, -math.inf, 0.0, -math.inf)
        if out[0] < 0 and out[1] < 0 and out[2] <= 0 and out[3] <= 0:
            self.calm.add(word)
        return out

    def sums(self, word: str, chain: list[tuple[int, int]]) -> tuple[float, float, float, float]:
        runs = [word[a:b] for a, b in chain]
        if any(r in _QUOTES for r in runs):
            return (math.inf,) * 4
        g = np.array(chain_features(word, chain, self.whole), float) @ self.gain[: len(FEATURES)] + self.words
        for i, r in enumerate(runs):  # what the letters decide: how many differ, whether all could be of a hexadecimal number, whether they are www
            g[i] += self.rich * (len(r) >= 8) + self.richer * (len(r) >= 13) + self.hex * (len(r) > 5 and not set(r) - set("gG0")) + self.path * r.startswith("ggg.")
        g[0] += self.joint
        g[-1] += self.named
        within, out, start = self.move[1:, 1:], self.move[1:, OUT], self.move[OUT, BEGIN]
        on, own = within.max(axis=0) + g[0], np.array([start + g[0][0], -math.inf])
        ends, inside = (on + out).max(), (own + out).max()
        for k in range(1, len(g)):
            on, own = (on[:, None] + within).max(axis=0) + g[k], (own[:, None] + within).max(axis=0) + g[k]
            own[0] = max(own[0], start + g[k][0])
            ends, inside = max(ends, (on + out).max()), max(inside, (own + out).max())
        return float(inside) + 1e-6, float(own.max()) + 1e-6, float(on.max()) + 1e-6, float(ends) + 1e-6  # room for rounding


def generated(n: int = 1800, seed: int = 5):
    """Training sentences: (text, spans of secrets)."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    hexa, low, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = [pick(low, rng.integers(2, 9)) for _ in range(400)]
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "private_key", "credential"]

    def secret():
        kind = rng.integers(0, 7)
        return (
            pick(hexa, rng.choice([32, 40, 64])), pick(alnum, rng.integers(20, 44)), "AKIA" + pick(alnum.upper(), 16), f"{pick(low, rng.integers(2, 4))}_{pick(low, 4) + '_' if rng.random() < 0.5 else ''}{pick(alnum if rng.random() < 0.6 else alnum[:52], rng.integers(24, 42))}",
            f"eyJ{pick(alnum, 17)}.eyJ{pick(alnum, 30)}.{pick(alnum + '_-', 43)}", pick(alnum + "+/", 40), pick(alnum, rng.integers(10, 18)),
        )[kind], kind

    def decoy():
        d = lambda k: pick("0123456789", k)
        return [
            lambda: d(16), lambda: f"{d(3)}.{d(3)}.{d(2)}.{d(3)}", lambda: f"{pick(low, 5)}.{d(2)}@{pick(low, 4)}{d(2)}.example.com", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
            lambda: f"20{d(2)}-0{rng.integers(1, 9)}-1{d(1)}", lambda: "".join(rng.choice(words, 4)), lambda: f"https://{pick(low, 8)}.example.com/{pick(low, 6)}/{d(8)}", lambda: f"{pick(low, 6)}-{pick(low, 7)}-{pick(low, 6)}-{d(2)}",
            lambda: f"{pick(low, 7)}_{pick(low, 6)}_{d(2)}", lambda: d(rng.integers(8, 14)), lambda: f"{pick(low, 8)}{d(2)}", lambda: f"/usr/{pick(low, 5)}/{pick(low, 7)}/{pick(low, 9)}{d(1)}", lambda: f"{pick(low, 5)}{d(4)}-{d(4)}", lambda: pick("#*$%", 3).join(rng.choice(words, 3)),
            lambda: f"version = {d(2)}.{d(2)}.{d(4)}", lambda: f"id: {d(10)}", lambda: pick(low, 24).capitalize(), lambda: f"1Z{pick(alnum.upper(), 6)}{d(10)}", lambda: f"{pick(low, 2).upper()}{d(2)} {d(4)} {d(4)} {d(4)} {d(2)}",
        ][rng.integers(0, 19)]()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(2, 5)):
            text += " ".join(rng.choice(words, rng.integers(2, 8))) + " "
            if rng.random() < 0.55:
                text += decoy() + " "
                continue
            s, kind = secret()
            named = kind == 6 or rng.random() < 0.6
            quote = rng.choice(["", "\"", "'"])
            text += (rng.choice(names) + rng.choice([" = ", "=", ": ", ":"]) if named else "") + quote
            spans.append((len(text), len(text) + len(s)))
            text += s + quote + rng.choice([" ", "\n", ". "])
        out.append((text, spans))
    return out


def generated_passwords(n: int = 1500, seed: int = 6):
    """Training sentences of what generated() lacks: secrets of letters alone, short ones, symbols, letters outside ASCII beside them; and prose with key words, quotes and names in code."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    low, digits, symbols = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!#$%&*@^+~?-_=.:,;()[]{}<>/|"
    both = low + low.upper()
    wide = ["密码", "是", "设置", "の", "鍵", "für", "é", "schlüssel", "ключ", "пароль", "café"]
    keys = ["AWS_SECRET_ACCESS_KEY", "API_TOKEN", "passphrase", "pwd", "pass", "password", "auth", "auth_key", "credential", "DB_PASSWORD", "secret", "passphrase", "token", "client_secret", "private_key", "Authorization", "smtp_pass", "session"]
    words = [pick(low, rng.integers(1, 10)) for _ in range(400)] + ["is", "the", "to", "your", "was", "please", "required", "expired", "reset", "manager"] * 4
    word = lambda: str(rng.choice(words))

    def secret():
        kind = rng.integers(0, 5)
        if kind == 0:
            return pick(both, rng.integers(10, 30))
        if kind == 1:
            return pick(both + digits, rng.integers(6, 13))
        if kind == 2:
            out = list(pick(both + digits, rng.integers(6, 16)))
            for _ in range(rng.integers(1, 4)):
                out[rng.integers(1, len(out))] = pick(symbols, 1)
            return "".join(out)
        if kind == 3:
            return word().capitalize() + pick(symbols[:12], 1) + word() + pick(digits, rng.integers(1, 4)) + pick("!#$%&*@", rng.integers(0, 2))
        return pick(both + digits + "+/", rng.integers(20, 44))

    def prose():
        return [
            lambda: f"the {rng.choice(keys)} {word()} {word()}", lambda: f"{rng.choice(keys)}: {word()}", lambda: f'"{word()} {word()}"', lambda: f"'{word()}'", lambda: f'"{word().capitalize()}"', lambda: f"{word()}{word().capitalize()}()",
            lambda: f"{word()}: {word()}, {word()}", lambda: f"{word()}={word()}", lambda: f"{word()}-{word()}-{word()}", lambda: f"({word()}, {word().capitalize()})", lambda: f"R&D {pick(digits, 2)}%", lambda: f"{word()}!", lambda: f"${pick(digits, 3)}.{pick(digits, 2)}",
            lambda: str(rng.choice(wide)) + word(), lambda: f"{rng.choice(keys)} = get{word().capitalize()}({word()})", lambda: f"{word()}'s", lambda: f"{pick(low, 5)}@{pick(low, 6)}.org", lambda: f"{word()}/{word()}", lambda: f'"{rng.choice(keys)}": "{word()}"',
            lambda: f"{word().capitalize()}{word().capitalize()}", lambda: f"{pick(digits, 2)}:{pick(digits, 2)}", lambda: "AT&T", lambda: f"{rng.choice(keys)} {word()} {word().capitalize()}",
        ][rng.integers(0, 23)]()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(rng.choice(words, rng.integers(0, 6))) + " "
            if rng.random() < 0.5:
                text += prose() + " "
                continue
            s, quote, stop = secret(), rng.choice(["", '"', "'", '"']), rng.choice([" ", "\n", ". ", ", "])
            if quote == "" and s[-1] in ".,;:!?)]}>":
                s = s[:-1] + "x"
            if rng.random() < 0.2 and len(s) >= 20:
                text += str(rng.choice(wide))
            elif rng.random() < 0.45:  # right after a key word, without a mark between them
                s = "".join(rng.choice(words[:400], 5)) if rng.random() < 0.5 else s
                s = s if len(s) >= 14 else s + pick(both, 12)
                text += str(rng.choice(["passphrase", "password", "token", "secret", "key is", "pwd", "bearer"])) + " "
            else:
                text += rng.choice(["", '"']) + str(rng.choice(keys))
                text += ('"' if text[-len(text.split()[-1])] == '"' else "") + str(rng.choice([" = ", "=", ": ", ":", " is ", " => "]))
            text += quote
            spans.append((len(text), len(text) + len(s)))
            text += s + quote + stop
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> CRF:
    """The fitted field; the same in every process."""
    chains = []
    for text, spans in [*generated(), *generated_passwords()]:
        whole = text_features(text)
        for chain in stretches(text):
            tags, inside = [], False
            for a, b in chain:
                own = any(s <= a and b <= e for s, e in spans)
                tags.append((INSIDE if inside and not any(s == a for s, _ in spans) else BEGIN) if own else OUT)
                inside = own
            hot = np.eye(BUCKETS)
            before, after = chain_words(text, chain)
            features, start = np.hstack([np.array(chain_features(text, chain, whole), float), hot[before], hot[after]]), 0
            for i, tag in enumerate(tags):  # cut outside of secrets, for less padding
                if i + 1 == len(tags) or (tag == OUT and i - start >= 14):
                    chains.append((features[start : i + 1], tags[start : i + 1]))
                    start = i + 1
    crf = CRF()
    crf.fit(chains)
    return crf


def crf_spans(text: str, crf: CRF, keyish: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the spans that the field tags as secret. keyish: whether the text may hold a key word."""
    found = []
    whole = text_features(text)
    for chain in stretches(text, lambda outline: crf.quiet(outline, tuple(whole)), keyish):
        tags = crf.decode(crf.scores(text, chain, whole))
        for (a, b), tag in zip(chain, tags):
            if tag == BEGIN:
                found.append([a, b])
            elif tag == INSIDE:
                found[-1][1] = b
    return [(a, b) for a, b in found]


def apart(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the others; one pass over both, in order of their starts. The spans are disjoint."""
    out, k, reach = [], 0, -1
    others = sorted(others)
    for a, b in spans:
        while k < len(others) and others[k][0] < b:
            reach = max(reach, others[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def all_spans(text: str, crf: CRF, may_match: bool = True, touching: bool = False, keyish: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end): base spans, and the field's spans that touch none of them, or all of the field's spans."""
    base = base_spans(text) if may_match else []
    found = crf_spans(text, crf, keyish)
    return sorted(base + [(a, 3, b) for a, b in (found if touching else apart(found, [(a, b) for a, _, b in base]))])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def merged(spans) -> list[tuple[int, int]]:
    """Spans as disjoint ranges."""
    out: list[list[int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(crf: CRF, texts: pa.Array, touching: bool = False):
    """The spans of each text of an Arrow array; base patterns are tried where one Arrow scan says that one can match."""
    base = pc.match_substring_regex(texts, _ANY_BASE).to_numpy(zero_copy_only=False)
    keyish = pc.match_substring_regex(texts, _KEYISH.pattern).to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        yield all_spans(texts[i].as_py(), crf, bool(base[i]), touching, bool(keyish[i]))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf for every row."""
    crf = trained()

    def run(batches):
        for part, texts in text_slices(batches, 1):
            rows = []
            for spans in _scan(crf, texts):
                base = [s for s in spans if s[1] < 3]
                n = Counter(k for _, k, _ in spans)
                rows.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text_col replaced by mark; null texts stay null, other columns are carried through."""
    crf = trained()
    at = docs.columns.index(text_col)

    def run(batches):
        for part, texts in text_slices(batches, at):
            out = []
            for i, spans in enumerate(_scan(crf, texts, True)):  # a secret that goes on after a base span goes whole
                if not spans:
                    out.append(part.column(at)[i].as_py())
                    continue
                text, pieces, last = texts[i].as_py(), [], 0
                for a, b in merged(spans):
                    pieces += [text[last:a], mark]
                    last = b
                out.append("".join(pieces) + text[last:])
            columns = list(part.columns)
            columns[at] = pa.array(out, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return in_batches(docs, run, docs.schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spread(table(spark, sf_dir, "documents"), "doc_id"))
