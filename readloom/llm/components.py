"""Connected components of an edge table, by rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``edges``: a, b (long). Returns node, root for every node of an edge; root is the smallest node
    reachable. Large-star then small-star rounds: each node's larger neighbours are hung on its
    smallest one, then its smaller ones; the number of rounds grows with the logarithm of the longest
    path. Minima are pre-aggregated before shuffling, and each round is cut by a written table.
    Loops and repeated edges are harmless; null ends are dropped. Raises if ``rounds`` don't do.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    current = common.materialize(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    nodes = current
    before = None
    for _ in range(rounds):
        pairs = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = pairs.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(low, "a")
        small = hung.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        current = common.materialize(small.where("a <> b").distinct(), name)
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
        if before == now:
            roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            every = nodes.select(F.col("a").alias("node")).union(nodes.select(F.col("b").alias("node"))).distinct()
            return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        before = now
    raise RuntimeError(f"no fixpoint of the components after {rounds} rounds")
