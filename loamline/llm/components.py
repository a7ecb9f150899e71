"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that links reach.

    A large star ties each node's greater neighbours to its least one, a small star its lesser ones; both keep the
    components and end in stars around their least nodes after about log(n) rounds. Minima are combined before the
    shuffle and the joins are plain equi-joins, which skewed partitions may be split in. Each round is checkpointed.
    Nulls and self-links are left out; an empty table gives an empty one.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # minima are written before the joins, so that a hub's links may be split between tasks there
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = keep(small)
        # stars do not change any more: the sums over all links tell
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1000003))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = state
