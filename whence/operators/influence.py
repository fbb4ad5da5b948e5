"""Which contributors of a group its lineage keeps.

An ``Influence`` turns the rows below an aggregate into the subset that mattered.
Every value argument may be any column expression, so ranking by a converted
value needs nothing extra. Ties are settled by the row pointer, smallest first,
which makes the answer independent of arrival order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.operators.combine import Combiner, RowTracker, combined, key_codes, tracked_rows
from whence.plans.skew import top_rows, with_group_stats

Keep = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Influence:
    keep: Keep
    predicate: Column | None = None


def everything() -> Influence:
    return keep_if(F.lit(True))


def keep_if(cond: Column) -> Influence:
    return Influence(lambda df, keys, ids: df.where(cond), cond)


def top_n(value: Column, n: int) -> Influence:
    def keep(df, keys, ids):
        return top_rows(df, keys, [value.desc_nulls_last(), *[F.col(i).asc() for i in ids]], n)

    return Influence(keep)


def bottom_n(value: Column, n: int) -> Influence:
    def keep(df, keys, ids):
        return top_rows(df, keys, [value.asc_nulls_last(), *[F.col(i).asc() for i in ids]], n)

    return Influence(keep)


def largest(value: Column) -> Influence:
    return top_n(value, 1)


def smallest(value: Column) -> Influence:
    return bottom_n(value, 1)


def abs_top_n(value: Column, n: int) -> Influence:
    return top_n(F.abs(value), n)


def _equal_to(value: Column, best: Callable[[Column], Column]) -> Influence:
    # Ties are unbounded, so no window: the best value per key is combined map
    # side and joined back with hot keys split.
    def keep(df, keys, ids):
        marked = with_group_stats(df.withColumn("__v", value), keys, [best(F.col("__v")).alias("__best")], ids)
        return marked.where(F.col("__v") == F.col("__best")).drop("__v", "__best")

    return Influence(keep)


def largest_with_ties(value: Column) -> Influence:
    return _equal_to(value, F.max)


def smallest_with_ties(value: Column) -> Influence:
    return _equal_to(value, F.min)


def outliers(value: Column, z: float = 3.0) -> Influence:
    """Rows at least ``z`` population standard deviations from their group's mean."""

    def keep(df, keys, ids):
        stats = [F.avg("__v").alias("__mean"), F.stddev_pop("__v").alias("__sd")]
        marked = with_group_stats(df.withColumn("__v", value.cast("double")), keys, stats, ids)
        far = F.abs(F.col("__v") - F.col("__mean")) >= z * F.col("__sd")
        return marked.where((F.col("__sd") > 0) & far).drop("__v", "__mean", "__sd")

    return Influence(keep)


def custom(tracker: Combiner | RowTracker, *columns: str) -> Influence:
    """Rows kept by a tracker of one's own: a row tracker over ``columns`` and the pointer columns, or a combiner
    over them whose result holds the pointer columns of the rows it keeps (``result(state, pointers)`` by name)."""

    def keep(df, keys, ids):
        if isinstance(tracker, RowTracker):
            return tracked_rows(df, keys, [*columns, *ids], tracker, ids)
        schema = ", ".join(f"`{i}` {df.schema[i].dataType.simpleString()}" for i in ids)
        named = replace(tracker, result=lambda state: tracker.result(state, list(ids)), schema=schema)
        return combined(df, keys, [*columns, *ids], named)

    return Influence(keep)


def extremes(value: str, n: int) -> Influence:
    """The ``n`` smallest and the ``n`` largest of a column in one pass, ties to the smaller row id.

    A group of up to 2 ``n`` rows stays as it is; of others, rows without a value and repeated rows go.
    """

    def ranked(rows: pa.Table, keys: list[str]):
        """The rows by key, value and row id; of each its place and its place among the largest, whether it
        has a value, and how many rows its key has."""
        column = rows.column(value)
        nan = pc.fill_null(pc.is_nan(column), False) if pa.types.is_floating(column.type) else pa.scalar(False)
        kind = pc.if_else(pc.is_null(column), 2, pc.if_else(nan, 1, 0))
        kind = kind if len(rows) and not isinstance(kind, pa.Scalar) else pa.array([], pa.int64())
        ids = [c for c in rows.column_names if c != value and c not in keys]
        marked = rows.append_column("__key", pa.array(key_codes(rows, keys))).append_column("__kind", kind)
        marked = marked.sort_by([(c, "ascending") for c in ("__key", "__kind", value, *ids)])
        key, kind, column = marked.column("__key").to_numpy(), marked.column("__kind").to_numpy(), marked.column(value)
        at = np.arange(len(key))
        first = np.searchsorted(key, key)
        count = np.searchsorted(key, key, "right") - first
        of = np.cumsum(at == first) - 1
        numbers = np.bincount(of[kind == 0], minlength=of[-1] + 1)[of] if len(of) else of
        # Equal values stand in a run, and in the same order on the way down.
        other = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(len(key) - 1, 0))), True).to_numpy()
        new = np.r_[True, other | (np.diff(key) != 0) | (np.diff(kind) != 0)][: len(key)]
        run = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        start, end = run[which] - first, np.r_[run[1:], len(key)][which] - first if len(run) else which
        place = at - first
        down = np.where(kind == 0, numbers - end + place - start, place)
        return marked.drop_columns(["__key", "__kind"]), place, down, kind < 2, count

    def shorten(rows: pa.Table, keys: list[str]) -> pa.Table:
        # Of more than 2 n rows more than 2 n stay, so that their number still shows.
        rows, place, down, has, _ = ranked(rows, keys)
        return rows.filter(pa.array((place <= 2 * n) | (has & (down < n))))

    def keep(rows: pa.Table, keys: list[str]) -> pa.Table:
        rows, place, down, has, count = ranked(rows, keys)
        chosen = (count <= 2 * n) | (has & ((place < n) | (down < n)))
        rows, whole = rows.filter(pa.array(chosen)), (count <= 2 * n)[chosen]
        same = np.r_[False, np.diff(key_codes(rows, rows.column_names)) == 0][: len(rows)]
        return rows.filter(pa.array(whole | ~same))

    return custom(RowTracker(shorten, keep), value)


def any_of(*members: Influence) -> Influence:
    """Rows kept by at least one member.

    Predicates fold into one filter. The others each prune before their shuffle
    and only the kept rows are united, so no group is gathered whole.
    """
    predicates = [m.predicate for m in members if m.predicate is not None]
    rest = [m for m in members if m.predicate is None]
    if predicates:
        cond = predicates[0]
        for p in predicates[1:]:
            cond = cond | p
        rest.append(keep_if(cond))
    if len(rest) == 1:
        return rest[0]

    def keep(df, keys, ids):
        slim = rest[0].keep(df, keys, ids)
        for member in rest[1:]:
            slim = slim.unionByName(member.keep(df, keys, ids))
        return slim.dropDuplicates([*keys, *ids])

    return Influence(keep)
