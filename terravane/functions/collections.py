"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_length(value: Column) -> Column:
    """Elements of a JSON array; 0 for anything else."""
    return F.coalesce(F.json_array_length(value), F.lit(0))


def decoded(value: Column) -> Column:
    """Text that may be JSON: a JSON string is unquoted, other JSON stays, other text stays."""
    return F.when(F.try_parse_json(value).isNull(), value).when(value.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its keys in order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def set_fingerprint(values: Column) -> Column:
    """SHA-256 of the sorted distinct values, one on a line."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


def cleaned_list(values: Column) -> Column:
    """Trimmed, non-empty, first of each spelling without regard to case."""
    own = F.filter(F.transform(values, lambda x: F.trim(x)), lambda v: v != "")
    keys = F.transform(own, F.lower)
    return F.filter(own, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def code_list(value: Column, separators: str = "[,;|]") -> Column:
    """Upper-case codes of a delimited text, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, separators), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
