"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolver_audit.llm.storage import stored


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links each vertex's neighbours (only smaller ones, or larger ones) to its smallest neighbour."""
    if both_ways:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = near.join(least, F.col("a") == F.col("u"))
    out = linked.filter("b > u" if both_ways else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not both_ways:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex that each end of an edge (a, b) reaches."""
    edges = stored(edges.filter("a != b").select("a", "b"), "edges")
    before = None
    for _ in range(most_rounds):
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point in {most_rounds} rounds")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )
