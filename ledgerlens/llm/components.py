"""Connected components over a table of links, by alternating star steps.

Every step is a join or a grouping by node; links never reach the driver.  Each step hooks
neighbours to the smallest node in sight, so the number of steps grows with the logarithm of a
component's size.  What is joined back to the links is written first: then both sides of the join
are plain shuffles, and Spark splits the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame, left: str = "a", right: str = "b", name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Loops, repeated links and links with a null end change nothing.
    """
    a, b = F.col(left), F.col(right)
    edges = stage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), name)
    while True:
        # Large star: each node's larger neighbours go to the smallest node it sees.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), name)
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where(F.col("u") != F.col("v"))
        )
        large = stage(large, name)
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = stage(large.groupBy("u").agg(F.min("v").alias("low")), name)
        small = (
            large.join(low, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v")))
            .where(F.col("u") != F.col("v")).distinct()
        )
        small = stage(small, name)
        # Done when the table is a set of stars: every node has one parent, and no parent has a parent.
        seen = small.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("top")).unionByName(
            small.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("top")))
        uneven = seen.groupBy("node").agg(F.sum("child").alias("child"), F.max("top").alias("top")).where("child > 1 or child + top > 1")
        if uneven.isEmpty():
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
