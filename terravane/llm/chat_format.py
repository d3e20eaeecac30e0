"""Chat formatting, native: typed content parts become one training string with a loss mask.

A turn's content is an array of typed parts (text, image, audio, document). The visitor flattens them in order: text is
escaped, texts side by side as one, every other part becomes a numbered placeholder, its reference and the tokens it expands to are recorded. Turns
are framed by control strings; inside texts and roles a backslash escapes them reversibly, so a text can quote any
control string without ending its turn. The loss mask lists the code-point ranges of assistant texts.

Everything is a DataFrame expression; the one shuffle brings the turns of a conversation together.

Defined cases: null text or role counts as empty; a null part list is empty; a part of unknown type is a document; equal
turn numbers are ordered by role, then text; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The control strings of the template. None can occur in escaped text, where "<|" is always "<\|".
START, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
LOSS_ROLE = "assistant"
#: Tokens that a part expands to where it does not say so itself.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART_TYPE = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", "image", "audio"), part["type"]).otherwise("document")


def visited(parts: Column) -> Column:
    """struct(body, attachments): the escaped body with placeholders, and (kind, ref, ordinal, tokens) of each attachment."""
    files = F.filter(parts, lambda p: _kind(p) != "text")
    default = lambda p: F.coalesce(p["tokens"], *[F.when(_kind(p) == k, F.lit(v)) for k, v in PART_TOKENS.items()]).cast("bigint")
    attachments = F.transform(
        files,
        lambda p, i: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), (i + 1).cast("bigint").alias("ordinal"), default(p).alias("tokens")),
    )
    said = lambda r: F.concat(r["done"], escaped(r["run"]))

    def taken(r, p):
        """The body so far and the run of text after it: texts side by side are escaped as one."""
        text = _kind(p) == "text"
        mark = F.concat(F.lit("<|"), _kind(p), F.lit(":"), (r["n"] + 1).cast("string"), F.lit("|>"))
        return F.struct(
            F.when(text, r["done"]).otherwise(F.concat(said(r), mark)).alias("done"),
            F.when(text, F.concat(r["run"], F.coalesce(p["text"], F.lit("")))).otherwise("").alias("run"),
            F.when(text, r["n"]).otherwise(r["n"] + 1).alias("n"),
        )

    body = F.aggregate(parts, F.struct(F.lit("").alias("done"), F.lit("").alias("run"), F.lit(0).alias("n")), taken, said)
    return F.struct(body.alias("body"), attachments.alias("attachments"))


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive), attachments, n_attachment_tokens.

    With parts_col (array of PART_TYPE) a turn's content is its parts; else it is one part, the text of text_col.
    """
    if parts_col:
        parts = F.coalesce(F.col(parts_col).cast(f"array<{PART_TYPE}>"), F.array().cast(f"array<{PART_TYPE}>"))
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))
    content = visited(parts)
    role = F.coalesce(F.col(role_col), F.lit(""))
    framed = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), content.alias("c")).select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(START), escaped(F.col("role")), F.lit(BODY)).alias("head"),
        F.col("c.body").alias("body"),
        F.col("c.attachments").alias("attachments"),
    )
    framed = framed.withColumn("n", F.length("head") + F.length("body") + F.lit(len(END)))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body", F.to_json("attachments"))
    placed = framed.select(
        "*", F.row_number().over(order).alias("k"), (F.sum(F.col("n").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("before")
    )
    one = F.struct(
        F.col("k"),
        F.concat("head", "body", F.lit(END)).alias("s"),
        F.when(F.col("role") == LOSS_ROLE, F.coalesce("before", F.lit(0)) + F.length("head")).alias("from"),
        F.length("body").cast("bigint").alias("len"),
        "attachments",
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["k"].alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["ordinal"].alias("ordinal"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["s"]), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda t: t["from"].isNotNull()), lambda t: F.struct(t["from"].alias("start"), (t["from"] + t["len"]).alias("end"))
        ).alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct(role, text), unescaped. Placeholders of parts stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s, i: i > 0)
    return F.transform(
        pieces,
        lambda s: F.struct(
            unescaped(F.substring_index(s, BODY, 1)).alias("role"),
            unescaped(F.regexp_replace(F.regexp_replace(s, r"(?s)^.*?<\|body\|>", ""), r"<\|end\|>\n$", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, spans joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


#: Fixed values of the contract: a conversation whose texts quote control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    out = format_chat(rows.unionByName(probe))
    back = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(role, '\', '\\'), '<|', '<\|') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
