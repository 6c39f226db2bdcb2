"""Connected components by alternating stars (Kiveris and others, 2014).

Each round hangs every node on the smallest node of its neighbourhood, first from the larger
neighbours, then from the smaller ones; after a logarithmic number of rounds each component is a
star around its smallest node. Only a count and a checksum reach the driver; rounds are
checkpointed, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # one edge for each edge; those that became equal go after the other half of the round
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                         F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u > v").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node that has an edge to another; root is the component's smallest node."""
    now = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
                  .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = durable(_small(_large(now)))
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first())
        if new == mark or not new[0]:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
