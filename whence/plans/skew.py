"""Joins and lists that stay balanced when one key holds much of the data.

AQE splits a skewed partition only where both join inputs come straight from a
shuffle. A side that was just aggregated does not, so joining rows back to a
per-key relation needs its own splitting. At most N / ``PART_ROWS`` keys hold more
than ``PART_ROWS`` rows; up to ``HOT_KEYS`` of them, the heaviest, fit a broadcast of
fixed size, and so every hot key of up to HOT_KEYS * PART_ROWS (6.5e10) rows is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.session import durable
from whence.sources.numbering import dense_index

HOT_KEYS = 1 << 16
PART_ROWS = 1_000_000
SAMPLE_EVERY = 64
LIST_ROWS = 10_000


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    part_rows: int = PART_ROWS,
    every: int = SAMPLE_EVERY,
) -> DataFrame:
    """The heaviest keys (at most HOT_KEYS rows) and how many parts each needs.

    Counts a hash sample of the row ids, so finding them shuffles next to
    nothing. The sample decides only how a key is spread, never which rows are
    kept, and being a function of the row it is the same wherever it is evaluated.
    """
    sampled = df.where(F.pmod(F.xxhash64(F.lit("hot"), *spread), F.lit(every)) == 0)
    counts = sampled.groupBy(*keys).agg((F.count(F.lit(1)) * every).alias("__n"))
    return (
        counts.where(F.col("__n") > part_rows)
        .orderBy(F.desc("__n"), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.ceil(F.col("__n") / part_rows).cast("int").alias("__parts"))
    )


def _null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def keyed_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    part_rows: int = PART_ROWS,
    every: int = SAMPLE_EVERY,
) -> DataFrame:
    """Join ``big`` to ``small``, which has few rows per key, without a hot task.

    Rows of a hot key are dealt over parts by the hash of their ``spread``
    columns (their row id), and the matching small rows are copied to each part.
    ``big`` is read twice, so make it durable first if it is costly.
    Keys compare null-safe. ``how`` is inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    hot_big = [f"__hb_{k}" for k in keys]
    hot_small = [f"__hs_{k}" for k in keys]
    small_keys = [f"__s_{k}" for k in keys]
    hot = hot_keys(big, keys, spread, part_rows, every)
    part = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("__parts"), F.lit(1)))
    left = (
        big.join(
            F.broadcast(hot.toDF(*hot_big, "__parts")), _null_safe(keys, hot_big), "left"
        )
        .withColumn("__part", part)
        .drop("__parts", *hot_big)
    )
    last = F.coalesce(F.col("__parts"), F.lit(1)).cast("bigint") - 1
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    right = (
        small.join(
            F.broadcast(hot.toDF(*hot_small, "__parts")), _null_safe(keys, hot_small), "left"
        )
        .withColumn("__copy", copies)
        .withColumnsRenamed(dict(zip(keys, small_keys)))
        .drop("__parts", *hot_small)
    )
    cond = _null_safe(keys, small_keys) & (F.col("__part") == F.col("__copy"))
    joined = left.join(right, cond, how)
    return joined.drop("__part", "__copy", *small_keys)


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Sequence[Column], spread: Sequence[str], **kw
) -> DataFrame:
    """Attach per-key aggregates to every row (map-side combined, then joined back)."""
    return keyed_join(df, df.groupBy(*keys).agg(*stats), keys, spread, **kw)


def bounded_lists(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    spread: Sequence[str],
    list_rows: int = LIST_ROWS,
    **_,
) -> DataFrame:
    """Sorted lists of ``item`` per key: columns keys, part, items.

    Part ``p`` holds the items from place ``p * list_rows`` on in the key's ascending order, so
    the parts of a key read one after the other are its sorted list, and no task builds an
    array of more than ``list_rows`` items. Nothing is dropped but items that are NULL.

    Only keys of more than one part need places. Their rows are range-partitioned by key and
    item, so one key may span any number of tasks, and numbered by one offset per partition.
    """
    keys = list(keys)
    rows = df.select(*keys, item.alias("__item"), *[F.col(c).alias(f"__s{i}") for i, c in enumerate(spread)])
    rows = rows.where(F.col("__item").isNotNull())
    large = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > list_rows).select(*keys))
    named = large.toDF(*[f"__l_{k}" for k in keys])
    on = _null_safe(keys, named.columns)
    part = rows.join(named, on, "left_anti").withColumn("part", F.lit(0))
    if not large.isEmpty():
        order = [*keys, "__item", *[f"__s{i}" for i in range(len(spread))]]
        placed = dense_index(rows.join(named, on, "left_semi"), order, "__row")
        first = placed.groupBy(*keys).agg(F.min("__row").alias("__first")).toDF(*named.columns, "__first")
        numbered = placed.join(durable(first), on).withColumn("part", F.expr(f"cast((__row - __first) div {list_rows} as int)"))
        part = part.unionByName(numbered.select(*part.columns))
    return part.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("__item")).alias("items"))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First ``n`` rows per key. Catalyst adds a WindowGroupLimit below the
    exchange, so at most ``n`` rows per key leave each map task."""
    if not keys:
        return df.orderBy(*order).limit(n)
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= n).drop("__rank")
