"""Connected components by star contraction, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.stages import materialize


def _lowest(directed: DataFrame) -> DataFrame:
    """Every neighbour of u joined to the lowest of u and its neighbours."""
    low = directed.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return directed.join(low, F.col("u") == F.col("_u"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root``: root is the lowest node of the component. ``edges(u, v)``, any direction.

    Rounds of two contractions: every node hands its higher neighbours to the lowest
    node it knows, then its lower ones. The edges become stars around the roots in a
    number of rounds that grows with the logarithm of the longest path. Hubs are
    summed up before the shuffle and their joins split like any skewed join; the
    driver sees counts only.
    """
    now = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name)
        small = _lowest(large)  # all edges lead downwards here
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), name)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
