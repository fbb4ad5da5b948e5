"""Least member of each component of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.session import durable


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """(a, b): the least node ``b`` of the component of every other node ``a``, for links a > b.

    Alternating star contraction: a round hands each node's links to the least node that it
    knows of (large star), then links the lesser neighbours of a node to the least of them (small
    star). The number of rounds follows the logarithm of the size. A round writes three slim
    relations; as tables their sizes are known, so the joins between them broadcast a small side
    or split skewed keys, and a lost executor costs no more than the round. A count and a checksum
    reach the driver.
    """
    links = durable(links.select("a", "b").distinct())
    state = None
    for _ in range(most):
        least = durable(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        found = links.join(least, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b"))
        links = durable(found.distinct())
        least = durable(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        across = links.join(least, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = durable(across.unionByName(least.toDF("a", "b")).distinct())
        checksum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        after = tuple(links.agg(F.count(F.lit(1)), checksum).first())
        if after == state:
            return links
        state = after
    raise RuntimeError(f"components did not settle in {most} rounds")
