"""Numbers without gaps for the rows of a table, by one offset per written partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.session import durable


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "row") -> DataFrame:
    """Number rows 0..n-1 in the order of ``order`` (which must be unique).

    Range partitions are sorted in parallel and written once; the per-partition
    offsets are one row per partition. There is no global sort in one task.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    return close_gaps(durable(placed), name)


def close_gaps(marked: DataFrame, name: str) -> DataFrame:
    partition = F.shiftright("__at", 33)
    sizes = marked.groupBy(partition.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition, so both the window and the broadcast are
    # bounded by the number of tasks that wrote the data.
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.col("__at") - F.shiftleft(F.col("__p"), 33)
    return (
        marked.withColumn("__p", partition)
        .join(F.broadcast(offsets), "__p")
        .withColumn(name, F.col("__before") + within)
        .drop("__p", "__at", "__before")
    )
