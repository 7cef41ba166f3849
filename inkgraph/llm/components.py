"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import durable


def _lower(edges: DataFrame, both: bool) -> DataFrame:
    """One star step. Every node hangs its (larger, or all smaller) neighbours on the least of them.

    The least neighbour comes from a partially aggregated groupBy; the join that brings it
    back to the edges is one that adaptive execution can split, so a hub is never gathered.
    """
    if both:  # large star: u's neighbours above u hang on the least of u and its neighbours
        at = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = at.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return at.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
    at = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # small star: u and its smaller neighbours hang on the least
    least = at.groupBy("u").agg(F.min("v").alias("m"))
    hung = at.join(least, "u")
    return hung.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node reachable. Nodes without edges do not appear."""
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    now = durable(now)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(now)
    while True:
        now = durable(_lower(_lower(now, True), False))
        this = mark(now)
        if this == last:
            break
        last = this
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
