"""Sinks: sorted CSV with a byte order mark for spreadsheets, partitioned Parquet, reports as Markdown from aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """One sorted CSV file; for reports that people open, not for corpora. The first header carries a byte order mark."""
    ordered = df.orderBy(*order).coalesce(1)
    marked = ordered.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def to_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_a_file: int = 5_000_000) -> None:
    """Parquet in files of bounded rows; Spark rebalances partitions to even sizes first."""
    df.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(*partition_by).parquet(path)


def split(df: DataFrame, keep: Column, kept: str, deleted: str) -> None:
    """Rows that pass to one path, all others to another, from one cached read."""
    held = df.withColumn("_keep", F.coalesce(keep, F.lit(False))).persist()
    held.where("_keep").drop("_keep").write.mode("overwrite").parquet(kept)
    held.where("NOT _keep").drop("_keep").write.mode("overwrite").parquet(deleted)
    held.unpersist()


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """A report of at most so many aggregate rows."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def keep_delete(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with part and reason: delete with the first rule that holds, keep without one."""
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, holds in rules:
        reason = reason.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return rows.withColumn("reason", reason).withColumn("part", F.when(F.col("reason").isNull(), "keep").otherwise("delete"))


def digest_lines(rows: DataFrame, section: str, name: str, score: str, top: int = 3) -> DataFrame:
    """section, place, line: a report's lines, as Markdown: a heading, the count, and the best `top` names of each section, ties by name."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(section).orderBy(F.desc(score), name)))
    best = ranked.where(F.col("_k") <= top).select(F.col(section).alias("section"), (F.col("_k") + 2).alias("place"), F.concat(F.lit("- "), F.col(name).cast("string")).alias("line"))
    counted = rows.groupBy(F.col(section).alias("section")).agg(F.count(F.lit(1)).alias("n"))
    heads = counted.select("section", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.concat(F.lit("## "), F.col("section").cast("string")).alias("line")), F.struct(F.lit(2).alias("place"), F.concat(F.col("n").cast("string"), F.lit(" records")).alias("line")))).alias("e")).select("section", "e.place", "e.line")
    return heads.unionByName(best)
