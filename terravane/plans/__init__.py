"""Query catalogue: named plans over the fixture tables and their SQL."""

from __future__ import annotations

from . import domain, identities, judgements, more, relational, scalars, screens, workflows
from .registry import Tables, oracle_sql, queries

__all__ = ["entry", "identities", "judgements", "more", "oracle_sql", "queries", "relational", "scalars", "screens", "workflows"]


def entry(spark, sf_dir):
    """Hybrid retrieval: vector and keyword lists fused by reciprocal rank."""
    return domain.tk03(Tables(spark, sf_dir))
