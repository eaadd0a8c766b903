"""Linking a stream of addresses to a base that stands still.

Stateless: each micro-batch is parsed and joined by block, so no watermark is
needed and late rows are like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.link import candidates, parse_queries, scored
from ..vocab import THRESHOLD, TOLERANCE


def stream_links(queries: DataFrame, base: DataFrame, id_col: str, address_col: str, threshold: float = THRESHOLD, tolerance: int = TOLERANCE) -> DataFrame:
    """All links (query_id, record_id, score) of a streaming DataFrame to a blocked base."""
    pairs = candidates(parse_queries(queries, id_col, address_col), base, tolerance)
    return scored(pairs, threshold, tolerance).filter(F.col("is_match")).select("query_id", "record_id", "score")
