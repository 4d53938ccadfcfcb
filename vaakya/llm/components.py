"""Connected components by alternating star contraction, in joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaakya.llm.scratch import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(ends.alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest of u and its neighbours."""
    two = _both_ways(edges)
    least = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return two.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return near.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node) for every node of ``edges(u, v)``.

    An edge of a node to itself and repeated edges change nothing; no edges give no rows.
    Each round writes its edges to the shared folder, so no plan grows with the rounds.
    ``rounds`` only guards against a loop without end: the edges then can't be a star forest.
    """
    now = materialise(edges.where("u != v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = materialise(_small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
