"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest id around it.

    A large star moves the neighbours above the node, a small star those below it
    and the node itself. Hot nodes add one row per task to the aggregate, and the
    join back is a plain equality join, which adaptive execution splits.
    """
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    if large:
        least = least.withColumn("low", F.least("a", "low"))
    least = c.written(least, "least")  # as a table, so that both sides of the join are dealt out by plain exchanges
    moved = edges.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:  # every edge has b < a
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of each node with an edge.

    edges: columns a, b of orderable ids, in any direction, repeated or not. Each
    round is a table in the shared folder, so that lineage stays short; the rounds
    grow with the logarithm of the longest chain. An empty table, or one of loops only, gives no rows.
    """
    edges = c.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        edges = c.written(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
