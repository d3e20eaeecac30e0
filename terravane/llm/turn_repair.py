"""Conversation structure repair: role and fault sequences as signatures, each distinct one solved once, edits replayed.

1. The rows of each conversation are numbered in order and marked with their first fault; a row becomes one letter, for its role's initial and what
   its fault asks for, and a conversation the string of its letters: its signature.
2. The cheapest edits depend on the signature alone. Each distinct signature is solved once, by recursion over (row, what came before)
   with every result kept; conversations share few signatures, so the work does not grow with the rows.
3. Audits are joined back by signature. A conversation's audit travels as row 0 in front of its rows, so the edits are replayed
   over a sorted stream that holds one row and one audit, never a conversation's texts.

A conversation passes through one task in order, since its audit and its digest are sequential by nature; nothing but its signature (a letter a row) is ever
held whole. A frequent signature stands on the side of a join that adaptive execution splits.

Defined cases: null roles and texts are one space; null turns come first; rows of equal turn are ordered by role, then text; a null conversation id is a
conversation; a role whose initial is not s, u or a fits nowhere and is rerolled or deleted; a conversation without rows has zeros, an
empty audit and the digest of the empty string; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import spread
from .common import in_batches, table, written

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: States by what the output ends with: nothing yet, the system turn, a user turn, an assistant turn. What a role's initial leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only turn that an inserted or rerolled one can become.
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Letters of a signature: s, u, a, o (another role), in capitals if truncated; x for a row that must go.
GONE = "x"
#: Recursion goes this deep at most; results are kept from the end on.
_DEPTH = 200
_SPACE = " \t\n\x0b\x0c\r"


class Solver:
    """The cheapest edits of one signature, ties by the least audit."""

    def __init__(self, signature: str):
        self.signature, self.known = signature, {}
        for at in range(len(signature), -1, -_DEPTH):
            for state in (START, SYSTEM, USER, ASSISTANT):
                self.least(at, state)

    def steps(self, at: int, state: int, inserts: int):
        """(letter, cost, next row, next state, inserts so far), in the order of the letters."""
        row = self.signature[at] if at < len(self.signature) else None
        more = TRUNCATED if row and row.isupper() else 0
        if row:
            yield "D", DELETE, at + 1, state, 0
        if inserts < 2:  # two in a row lead back to an assistant turn; more never pay
            yield "I", INSERT, at, _NEXT[state], inserts + 1
        if row and row != GONE:
            if (to := _AFTER.get(row.lower(), {}).get(state)) is not None:
                yield "K", more, at + 1, to, 0
            yield "R", REROLE + more, at + 1, _NEXT[state], 0

    def least(self, at: int, state: int, inserts: int = 0) -> float:
        """The least cost of the rest from row `at`."""
        key = at, state, inserts
        if key not in self.known:
            end = 0 if at == len(self.signature) and state in (START, ASSISTANT) else float("inf")
            self.known[key] = min([end, *(cost + self.least(to, then, k) for _, cost, to, then, k in self.steps(*key))])
        return self.known[key]

    def solution(self) -> tuple[int, str]:
        """(cost, audit)."""
        key, audit = (0, START, 0), []
        cost = rest = self.least(*key)
        while rest or key[0] < len(self.signature):
            letter, price, *to = next(s for s in self.steps(*key) if s[1] + self.least(*s[2:]) == rest)
            audit.append(letter)
            key, rest = tuple(to), rest - price
        return int(cost), "".join(audit)


class Replay:
    """Applies an audit to the rows of a conversation, one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            yield "I", _NAMES[self.state], ""

    def row(self, role: str, text: str):
        """(edit, role, text) of the turns up to this row."""
        yield from self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = _AFTER[role[0]][self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, _NAMES[self.state], text

    def end(self):
        """The turns after the last row."""
        yield from self._inserts()


def marked(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """conv_id, turn, seq (from 1), role, text, fault, letter, illegal, new_turn for every row, in order within conversations.

    present: rows where it is false only keep their conversation in the result (seq and letter are null).
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"), (F.lit(True) if present is None else present).alias("here"))
    order = [F.col("here").desc(), F.col("turn").asc_nulls_first(), "role", "text"]
    w = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumns({"seq": F.row_number().over(w), "before": F.lag(F.substring("role", 1, 1)).over(w), "turn_before": F.lag("turn").over(w)})
    again = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy("seq")) > 1  # within the same partitions: no second shuffle
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.rlike("[.!?]"), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(
        F.when(F.col("fault") == "truncated", F.upper(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))).otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    )
    pair = F.concat(F.col("before"), initial)
    return (
        rows.withColumn("again", again)
        .withColumn("fault", F.when(F.col("here"), fault))
        .select(
            "conv_id", "turn", F.when(F.col("here"), F.col("seq")).alias("seq"), "role", "text", "fault", F.when(F.col("here"), letter).alias("letter"),
            (F.col("here") & (F.col("seq") > 1) & ~pair.isin("su", "ua", "au")).alias("illegal"),
            (F.col("here") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
        )
    )


def audited(rows: DataFrame) -> DataFrame:
    """One row a conversation of marked rows: conv_id, gaps, counts of faults, illegal, signature, cost, audit."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    here = F.when(F.col("seq").isNotNull(), F.col("turn"))
    letters = F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "letter"))))
    told = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(here) - F.min(here) + 1 - count(F.col("new_turn")), F.lit(0)).cast("bigint").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x.letter), "").alias("signature"),
    )
    told = written(told, "signatures")

    def solve(batches):
        for batch in batches:
            solved = [Solver(s).solution() for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], ["solved", "cost", "audit"])

    solutions = in_batches(told.select("signature").distinct(), solve, "solved string, cost bigint, audit string")
    return told.join(solutions, F.col("signature") == F.col("solved")).drop("solved")


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, audit: each conversation's audit as row 0, then its rows, in order and in one partition."""
    heads = audits.select("conv_id", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    own = rows.where("seq IS NOT NULL").select("conv_id", "seq", "role", "text", F.lit(None).cast("string").alias("audit"))
    return heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit (K, R or I), role, text: the turns of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, replay, place = None, None, 0
        for batch in batches:
            out = []
            for conv_id, seq, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if seq == 0:
                    if replay:
                        out += [(conv, place := place + 1, *t) for t in replay.end()]
                    conv, replay, place = conv_id, Replay(audit), 0
                else:
                    out += [(conv, place := place + 1, *t) for t in replay.row(role, text)]
            yield _turns(out, batch.schema.field(0).type)
        if replay:
            yield _turns([(conv, place := place + 1, *t) for t in replay.end()], batch.schema.field(0).type)

    return in_batches(_streamed(rows, audits), run, f"conv_id {kind}, place int, edit string, role string, text string")


def _turns(rows: list[tuple], kind) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int32(), *[pa.string()] * 3))], ["conv_id", "place", "edit", "role", "text"])


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the digest of the repaired turns as role:text, joined by newlines, added up as they stream by."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, replay, digest, between, arrow = None, None, None, b"", None

        def add(turns):
            nonlocal between
            for _, role, text in turns:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"

        for batch in batches:
            ids, found, arrow = [], [], batch.schema.field(0).type
            for conv_id, seq, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if seq == 0:
                    if replay:
                        add(replay.end())
                        ids.append(conv)
                        found.append(digest.hexdigest())
                    conv, replay, digest, between = conv_id, Replay(audit), hashlib.sha256(), b""
                else:
                    add(replay.row(role, text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if replay:
            add(replay.end())
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return in_batches(_streamed(rows, audits), run, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here of conversations with faults put in by crc32 of id and turn; a dropped row stays with here false."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("here"), copies.alias("copy")).drop("copy")


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id")
    rows = written(marked(damaged(turns), present=F.col("here")), "marked")
    audits = written(audited(rows), "audits")
    own = digests(rows, audits).withColumnRenamed("conv_id", "_of")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return audits.join(own, F.col("conv_id").eqNullSafe(F.col("_of"))).select("conv_id", *counts, "audit", "repaired_sha256")


#: The same by recursion over a conversation's rows: the least (cost, audit) of each state after each row, with the turns said so far. States as above; moves: after a user turn comes an assistant turn, else a user turn.
SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE kind <> 0),
n AS (SELECT *, row_number() OVER w AS seq, lag(substr(role, 1, 1)) OVER w AS before, lag(turn) OVER w AS turn_before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, substr(role, 1, 1) AS ini, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) > 1 AS again FROM n),
m AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE seq > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2), (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)) v(s, k, e)),
r AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM t
  UNION ALL
  SELECT conv_id, any_value(i), s, min(cost), arg_min(audit, (cost, audit)), arg_min(said, (cost, audit)) FROM (
    SELECT r.conv_id, r.i + 1 AS i, a.s2 AS s, r.cost + 2 * o.k + a.price AS cost, r.audit || repeat('I', o.k) || a.edit AS audit,
           list_concat(list_concat(r.said, CASE WHEN o.k = 0 THEN [] WHEN o.k = 1 THEN [CASE WHEN o.e = 2 THEN 'user:' ELSE 'assistant:' END] WHEN o.e = 3 THEN ['user:', 'assistant:'] ELSE ['assistant:', 'user:'] END), a.line) AS said
    FROM r JOIN o ON o.s = r.s JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.seq = r.i + 1,
    LATERAL (SELECT 'D' AS edit, 3 AS price, o.e AS s2, []::VARCHAR[] AS line
      UNION ALL SELECT 'K', (m.fault IS NOT NULL)::INTEGER, CASE m.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, [m.role || ':' || m.text] WHERE coalesce(m.fault, '') NOT IN ('blank', 'duplicate') AND ((m.ini = 's' AND o.e = 0) OR (m.ini = 'u' AND o.e <> 2) OR (m.ini = 'a' AND o.e = 2))
      UNION ALL SELECT 'R', 2 + (m.fault IS NOT NULL)::INTEGER, CASE WHEN o.e = 2 THEN 3 ELSE 2 END, [CASE WHEN o.e = 2 THEN 'assistant:' ELSE 'user:' END || m.text] WHERE coalesce(m.fault, '') NOT IN ('blank', 'duplicate')) a
  ) GROUP BY conv_id, s
),
e AS (SELECT r.conv_id, min(r.cost + 2 * o.k) AS cost, arg_min(r.audit || repeat('I', o.k), (r.cost + 2 * o.k, r.audit || repeat('I', o.k))) AS audit,
  arg_min(list_concat(r.said, CASE WHEN o.k = 0 THEN [] WHEN o.k = 1 THEN [CASE WHEN o.e = 2 THEN 'user:' ELSE 'assistant:' END] ELSE ['user:', 'assistant:'] END), (r.cost + 2 * o.k, r.audit || repeat('I', o.k))) AS said
  FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.n = r.i JOIN o ON o.s = r.s AND o.e IN (0, 3) GROUP BY r.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
