"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: longs); root is the smallest id reachable.

    A round attaches each node's larger neighbours to its smallest one, then its smaller neighbours and itself; the
    number of rounds grows with the logarithm of a component's size. A node with very many neighbours is a group of rows
    in a join, which Spark splits if it is skewed; neighbour lists are never collected.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last, k = scratch.write(e, f"{name}0"), None, 0
    while (now := _state(e)) != last:
        last = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.least("m", "x").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*")
        e = scratch.write(small.where("u <> v").distinct(), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}")
        k += 1
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
