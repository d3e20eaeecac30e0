"""Hard-negative mining, SimHash near-dedup and conversation repair against brute force, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terravane.llm import hard_negatives, simhash, turn_repair

# SimHash


def brute_print(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=2):
    """rows: (id, fingerprint); the least id that links reach, for each row."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, p in rows:
        known = [x for x in (least.get(find(p)), i) if x is not None]
        least[find(p)] = min(known) if known else None
    return [(i, p, least[find(p)]) for i, p in rows]


def unsigned(x):
    return x & ((1 << 64) - 1)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "ONE two", "a B c", "a b c a b c a b c", "Ünder x ÀB \x1c y z", "x " * 70_000, " ".join(f"w{i % 811}" for i in range(40_000)), "\x0bt\x0cu\rv"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("point", F.lit(1))
    out = simhash.near_dedup(rows).collect()
    assert {r.doc_id: unsigned(r.fp) for r in out} == {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r.component_id for r in out if r.fp == 0} == {0}


@pytest.mark.parametrize("tile", [3, 512])
def test_near_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)  # 3: buckets are split by points
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6, 30])):
            p = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                p ^= 1 << b
            rows.append((rng.choice([None, rng.randrange(500)]), p))
    rows += [(7, 0), (8, 0), (9, 3), (None, (1 << 63) | 1)]
    frame = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id bigint, fp bigint")
    got = simhash.near_components(frame).collect()
    assert collections.Counter((r.doc_id, unsigned(r.fp), r.component_id) for r in got) == collections.Counter(brute_components(rows))
    assert simhash.near_components(frame.limit(0)).count() == 0


def test_close_fingerprints_share_a_key():
    rng, masks = random.Random(1), simhash.block_masks()
    assert len(masks) == 6
    for bits in itertools.combinations(range(64), 2):
        assert any(unsigned(m) & (1 << bits[0] | 1 << bits[1]) == 0 for m in masks)
    p = rng.getrandbits(64)
    assert len({p & unsigned(m) for m in masks}) > 1


def test_simhash_query(spark):
    import duckdb

    found = simhash.op12_simhash(spark, "/root/testdata/sf0.01").collect()
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = brute_components([(i, brute_print(t)) for i, t in docs])
    assert collections.Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found) == collections.Counter(want)
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in found)


# conversation repair


def brute_edits(initials, must, cut):
    """(cost, audit) by search over all edit strings in order of cost, then letters: rows' initials, whether they must go, whether truncated."""
    import heapq

    heap, seen = [(0, "", 0, 0)], set()
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    then = {0: 2, 1: 2, 3: 2, 2: 3}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(initials) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", at, then[state]))
        if at < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if not must[at]:
                heapq.heappush(heap, (cost + 2 + cut[at], audit + "R", at + 1, then[state]))
                to = follow.get(initials[at], {}).get(state)
                if to is not None:
                    heapq.heappush(heap, (cost + cut[at], audit + "K", at + 1, to))


def brute_repair(rows):
    """rows: (conv, turn, role, text) -> conv: the contract's columns, written out."""
    space, out = set(" \t\n\x0b\x0c\r"), {}
    one = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = one(role), one(text)
            kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            last = [c for c in text if c not in space][-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        cost, audit = brute_edits(initials, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        said, names, at, wait = [], itertools.cycle(["user", "assistant"]), 0, None
        for e in audit:
            row = None if e == "I" else kept[at]
            at += e != "I"
            if e == "D":
                continue
            if e == "K" and row[1][0] == "s":
                said.append(f"{row[1]}:{row[2]}")
                continue
            name = next(names)
            said.append(f"{name}:" if e == "I" else f"{row[1] if e == 'K' else name}:{row[2]}")
        count = collections.Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string"


def repair_of(spark, rows, path):
    spark.createDataFrame(rows, TURNS).withColumn("seq", F.lit("clash")).withColumn("audit", F.lit(1)).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = turn_repair.op13_turn_repair(spark, str(path)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_turn_repair(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "why?", "cut", "", " \t", None, "a.b", "end. ", " ", "x.\x0b", "Is it 日本?"]
    rows = [(c, rng.choice([t, t, t, None, 5]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ux"]), rng.choice(texts)) for c in range(400) for t in range(rng.randrange(1, 8))]
    rows += [(None, t, r, "Ok.") for t, r in enumerate(["user", "assistant"])]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(3000)]
    assert repair_of(spark, rows, tmp_path) == brute_repair(rows)


def test_turn_repair_of_an_empty_table(spark, tmp_path):
    assert repair_of(spark, [], tmp_path) == {}


def test_turn_repair_query(spark):
    import duckdb

    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    got = turn_repair.op13_turn_repair(spark, "/root/testdata/sf0.01").collect()
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == brute_repair(rows)


def test_signatures_by_search():
    letters = "suaoSUAx"
    for n in range(5):
        for s in map("".join, itertools.product(letters, repeat=n)):
            want = brute_edits(s.lower(), [c == "x" for c in s], [c.isupper() for c in s])
            assert turn_repair.Solver(s).solution() == want
    assert turn_repair.Solver("ua" * 5000 + "s").solution() == (3, "K" * 10_000 + "D")


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "A."), (1, 3, "user", "Whole."), (2, 0, "user", " ")], TURNS)
    seen = turn_repair.marked(rows).cache()
    audits = turn_repair.audited(seen)
    told = {r.conv_id: (r.signature, r.audit) for r in audits.collect()}
    assert told == {1: ("saxu", "KIKDKI"), 2: ("x", "D")}
    turns = turn_repair.repaired(seen, audits).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in turns] == [(1, 1, "K", "system", "S."), (1, 2, "I", "user", ""), (1, 3, "K", "assistant", "A."), (1, 4, "K", "user", "Whole."), (1, 5, "I", "assistant", "")]


# hard negatives


def brute_negatives(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=10):
    """rows: (id, vector, label), as the contract states it."""
    taken = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        taken.append((i, [math.floor(256 * float(x)) for x in v], label))
    out, order = [], lambda k: (-k[0], k[1] is None, k[1] or 0)
    for n, (i, v, label) in enumerate(taken):
        if i is None or not anchor(i):
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, own == label) for k, (j, w, own) in enumerate(taken) if k != n]
        for p in sorted((s for s in scores if s[2]), key=order)[:positives]:
            window = sorted((s for s in scores if not s[2] and 30 * p[0] <= 100 * s[0] <= 90 * p[0]), key=order)[:negatives]
            out += [(i, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(window, 1)]
    return out


VECTORS = "vec_id bigint, embedding array<float>, label int"


def mined(spark, rows, path):
    spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("clash")).withColumn("v", F.lit(1)).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    got = hard_negatives.op11_hard_negatives(spark, str(path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(map(tuple, got.collect()))


def test_hard_negatives_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(0.05, 0.12, 12)]
    rows = [(i, vector(), int(rng.integers(0, 3))) for i in range(0, 1200, 5)]
    rows += [(100, vector(), 1), (300, rows[60][1], rows[60][2]), (5, rows[1][1], 2)]  # repeated ids and rows
    rows += [(9, vector(), None), (11, None, 1), (13, [0.1, None], 1), (15, [float("nan")] * 12, 1), (17, [float("inf")], 0), (None, vector(), 1), (None, vector(), 0)]
    rows += [(19, [], 1), (21, [0.5], 0), (1200, vector()[:5], 0), (23, vector() + [0.5, -0.25, 1.0], 1)]
    rows += [(1000 + k, [0.125] * 12, k % 3) for k in range(1, 40)]  # ties
    rows += [(4000, [0.0] * 12, 2), (4100, [0.125] * 12, 2)]
    assert mined(spark, rows, tmp_path) == collections.Counter(brute_negatives(rows))


def test_hard_negatives_of_small_tables(spark, tmp_path):
    assert not mined(spark, [], tmp_path)
    assert not mined(spark, [(100, [0.5], 1), (200, None, 1)], tmp_path)  # no other row
    assert mined(spark, [(100, [0.5], 1), (1, [0.5], 1), (2, [0.25], 2)], tmp_path) == {(100, 1, 1, 2, 16384, 8192): 1}


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(0, 0.125, (3000, 64))).astype("<i4")
    books = hard_negatives.Codebooks(v[:1000].tolist())
    codes, reach = books.encode(list(v))
    block = hard_negatives.Block(range(3000), range(3000), rng.integers(0, 10, 3000), [x.tobytes() for x in v], [c.tobytes() for c in codes], reach)
    low, high = block.bounds(books, v[:20])
    true = v[:20].astype(np.int64) @ v.astype(np.int64).T
    assert (low <= true).all() and (true <= high).all()
    for a in range(20):
        everything = np.ones(3000, bool)
        block.tried = 0
        got = block.first(everything, everything, low[a], high[a], v[a], 5)
        assert [s for _, s in got] == sorted(true[a], reverse=True)[:5]
        assert block.tried < 600  # the rest is left out by bounds alone
