"""Read-only SQL: one statement, parsed by Catalyst, refused unless its plan only reads."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

CAP = 200


def is_safe_select(spark: SparkSession, sql: str) -> bool:
    """Whether the text is one query without commands: the parser refuses several statements, and the plan tells commands apart."""
    text = sql.strip().rstrip(";")
    if not text.lower().startswith(("select", "with")):
        return False
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException:
        return False
    nodes = parsed.treeString()
    return not any(w in nodes for w in ("InsertInto", "CreateTable", "Command", "DeleteFrom", "UpdateTable", "MergeInto", "DropTable", "CreateView"))


def safe_select(spark: SparkSession, sql: str, cap: int = CAP) -> DataFrame:
    if not is_safe_select(spark, sql):
        raise ValueError("only one SELECT is allowed")
    return spark.sql(sql.strip().rstrip(";")).limit(cap)
