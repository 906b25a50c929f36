"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import durable


def connect(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (a, b) of numbers.

    Alternates large-star and small-star steps: each node links its larger neighbours, then its
    smaller ones, to its smallest neighbour. Paths halve with each round, so the rounds grow as the
    logarithm of a component's diameter. Every round is written to the checkpoint folder; the end is
    noticed by comparing a count and a sum of hashes, nothing else reaches the driver. Edges of equal
    ends are ignored. RuntimeError if ``max_rounds`` don't suffice.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("y").alias("a"), F.col("m").alias("b")))
        now = durable(small.where("a <> b").distinct())
    raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
