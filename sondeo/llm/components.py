"""Connected components by alternating star contraction (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least one.  Large star: those above a node, by all of its
    neighbours; small star: the node and those below it, by those below it."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    sides = down.unionByName(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))) if large else down
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = sides.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, component)``, the least node of
    each component.  Nodes without an edge to another node are not in the result.

    Every round is two aggregations and two joins, which Spark can split where a node has
    very many neighbours; the rounds grow with the logarithm of the number of nodes.
    Repeated, reversed and self edges change nothing; no edges give no rows."""
    shared_folder(edges.sparkSession)
    now = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    seen = None
    while True:
        now = _star(_star(now, True), False).checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
