"""Connected components of a graph held as a table of links.

Star contraction: in turn, every node links its larger neighbours (then its
smaller ones) to the smallest node it knows. Each round is a partial-aggregated
minimum and an equi-join that adaptive execution may split at a hub; the number
of rounds grows with the logarithm of the longest chain. Only three numbers a
round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v > m").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u < v: each v hands its smaller neighbours to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    joined = edges.join(least, "v")
    return joined.filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: two columns of one ordered
    type, no order needed within a row); root is the smallest node reachable,
    and roots themselves have no row.

    Stops when a round changes nothing; raises if ``rounds`` do not suffice, so a
    result is never partial. No edges: no rows.
    """
    edges = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    mark = None
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")
