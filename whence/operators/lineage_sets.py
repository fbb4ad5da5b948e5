"""Sets of row ids, as relations and as bitmaps, and reports about them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.operators.frame import LineageFrame
from whence.session import durable
from whence.sources.numbering import dense_index


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two edge relations of the same shape, each edge once."""
    return a.unionByName(b).distinct()


def contains(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: does ``a`` hold every edge of ``b``? Columns keys, contains.

    Edges meet on key and row id together, so a large set is spread evenly; the
    flags per key are combined map side.
    """
    both = a.withColumns({"__a": F.lit(True), "__b": F.lit(False)}).unionByName(
        b.withColumns({"__a": F.lit(False), "__b": F.lit(True)})
    )
    edge = both.groupBy(*a.columns).agg(F.bool_or("__a").alias("__a"), F.bool_or("__b").alias("__b"))
    return edge.groupBy(*keys).agg(F.bool_and(~F.col("__b") | F.col("__a")).alias("contains"))


def bitmaps(df: DataFrame, keys: Sequence[str], rid: str) -> DataFrame:
    """Compressed sets of non-negative integer ids: keys, bucket, bits.

    A bucket covers 32 768 ids, so a set is many bounded rows, never one large
    value, and a hot key is spread over its buckets.
    """
    return df.groupBy(*keys, F.bitmap_bucket_number(rid).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(rid)).alias("bits")
    )


def id_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of ``columns`` (a row id of any type, compound or not) and their ``bit``, from 0 without gaps."""
    return durable(dense_index(df.select(*columns).distinct(), list(columns), "bit"))


def keyed_bitmaps(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ids: DataFrame) -> DataFrame:
    """As ``bitmaps`` for row ids that are no integers, by their bits in a dictionary that all sets share."""
    named = ids.toDF(*[f"__id{i}" for i in range(len(columns))], "__bit")
    on = [F.col(c).eqNullSafe(F.col(f"__id{i}")) for i, c in enumerate(columns)]
    return bitmaps(df.join(named, on), keys, "__bit")


def bitmap_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids that both sets of a key have; buckets of one side alone hold none."""
    both = a.unionByName(b).groupBy(*keys, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where("n = 2").drop("n")


def bitmap_algebra(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_a, n_b, n_both, n_either, n_only_a: sizes of two sets per key and of what they make together."""
    sized = [
        bitmap_sizes(sets, keys).withColumnRenamed("n", name)
        for sets, name in ((a, "n_a"), (b, "n_b"), (bitmap_intersection(a, b, keys), "n_both"))
    ]
    names = ["n_a", "n_b", "n_both"]
    wide = [df.select(*keys, *[F.col(n) if n in df.columns else F.lit(0).cast("bigint").alias(n) for n in names]) for df in sized]
    sums = reduce(DataFrame.unionByName, wide).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    return sums.select("*", (F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("n_either"), (F.col("n_a") - F.col("n_both")).alias("n_only_a"))


def bitmap_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_sizes(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def fault_report(frame: LineageFrame, flagged: Column, source: str, fault: Column) -> DataFrame:
    """How well the trace of suspicious outputs finds the faulty input rows.

    One row: tp, fp, fn, precision, recall.
    """
    src = frame.sources[source]
    traced = frame.trace_ids(flagged)[source].withColumns({"__t": F.lit(1), "__f": F.lit(0)})
    faulty = src.df.where(fault).select(*src.key, F.lit(0).alias("__t"), F.lit(1).alias("__f"))
    rows = traced.unionByName(faulty).groupBy(*src.key).agg(F.max("__t").alias("t"), F.max("__f").alias("f"))
    counts = rows.agg(
        F.count_if((F.col("t") == 1) & (F.col("f") == 1)).alias("tp"),
        F.count_if((F.col("t") == 1) & (F.col("f") == 0)).alias("fp"),
        F.count_if((F.col("t") == 0) & (F.col("f") == 1)).alias("fn"),
    )
    return counts.select(
        "tp", "fp", "fn",
        F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"),
    )


def entries(frame: LineageFrame, level: str) -> DataFrame:
    """Number of lineage entries kept for a result at level none, row or cell."""
    if level == "none":
        # Pointer columns that the untracked result carries along, for each of its rows.
        carried = [c for c in frame.plain.columns if c in frame.pointers]
        counted = frame.plain.agg((F.count(F.lit(1)) * len(carried)).alias("n"))
    elif level == "row":
        ids = [i.select(F.lit(1).alias("x")) for i in frame.trace_ids().values()]
        rows = ids[0]
        for more in ids[1:]:
            rows = rows.unionByName(more)
        counted = rows.agg(F.count("x").alias("n"))
    elif level == "cell":
        counted = frame.cells().agg(F.count(F.lit(1)).alias("n"))
    else:
        raise ValueError(f"unknown lineage level {level!r}")
    return counted.select(F.lit(level).alias("level"), "n")
