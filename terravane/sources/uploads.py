"""Uploaded sheets: CSV with marks, encodings and delimiters told apart, row limits, header rows found by name."""

from __future__ import annotations

import codecs
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of an upload: rows, code points of a cell, rows searched for the header.
MOST_ROWS, MOST_CELL, HEADER_ROWS = 1000, 4000, 8
DELIMITERS = (",", ";", "\t", "|")


def sniffed(head: bytes) -> tuple[str, str]:
    """(encoding, delimiter) from the first bytes of a file: UTF-8 where it decodes, else Latin-1, the one single-byte encoding that Spark's reader takes in every version."""
    line = head.removeprefix(b"\xef\xbb\xbf").split(b"\n", 1)[0]
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # a character cut off at the end of the head is no error
        encoding = "UTF-8"
    except UnicodeDecodeError:
        encoding = "ISO-8859-1"
    return encoding, max(DELIMITERS, key=lambda d: line.count(d.encode()))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A strict CSV read, all cells text unless a schema is given; only the file's head is looked at to tell its dialect."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("h")).first().h)
    encoding, delimiter = sniffed(head)
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", delimiter).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.withColumnRenamed(out.columns[0], out.columns[0].removeprefix("﻿"))


def upload_rows(df: DataFrame, file: Sequence[str], order: str, cells: Sequence[str], most_rows: int = MOST_ROWS, most_cell: int = MOST_CELL) -> DataFrame:
    """df with row_number (place in the file, the header being row 1), blank and refused.

    A file is refused whole, for the first of: a filled row beyond `most_rows`, a cell longer than `most_cell`. `refused` holds
    the reason on every row of such a file, so that nothing is dropped silently; blank rows are counted, not read.
    """
    filled = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cells]).isNotNull()
    place = Window.partitionBy(*file).orderBy(order)
    numbered = df.withColumn("row_number", F.row_number().over(place) + 1).withColumn("blank", ~filled)
    record = F.sum(F.when(filled, 1).otherwise(0)).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = numbered.withColumn("_record", record)
    stop = lambda kind, message: F.struct("row_number", F.lit(kind).alias("kind"), message.alias("message"))
    long = [stop(k, F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(f": a value in '{c}' is longer than {most_cell} characters."))) for k, c in enumerate(cells, 1)]
    first_long = F.coalesce(*[F.when(F.length(F.trim(c)) > most_cell, v) for c, v in zip(cells, long)])
    over = stop(0, F.lit(f"The file has more than {most_rows} records. Split it into several files."))
    stopped = F.when(filled, F.when(F.col("_record") > most_rows, over).otherwise(first_long))
    whole = Window.partitionBy(*file)
    return numbered.withColumn("_stop", stopped).withColumn("refused", F.min("_stop").over(whole)["message"]).drop("_record", "_stop")


def header_key(name: str | None) -> str:
    """A header as it is compared: letters and digits only, lower case."""
    return re.sub(r"[^a-z0-9]+", "", (name or "").lower())


def header_row(rows: Sequence[Sequence[str | None]], known: dict[str, str]) -> tuple[int, dict[int, str]]:
    """(index, {column: field}) of the row among the first few that names the most known headers; the first on a tie."""
    wanted = {header_key(k): v for k, v in known.items()}
    best = (0, {})
    for i, row in enumerate(rows[:HEADER_ROWS]):
        found = {c: wanted[header_key(v)] for c, v in enumerate(row) if header_key(v) in wanted}
        if len(found) > len(best[1]):
            best = (i, found)
    return best


def renamed(df: DataFrame, known: dict[str, str]) -> DataFrame:
    """Columns renamed to their fields where a known header matches."""
    wanted = {header_key(k): v for k, v in known.items()}
    return df.withColumnsRenamed({c: wanted[header_key(c)] for c in df.columns if header_key(c) in wanted})
