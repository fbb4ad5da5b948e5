"""Seeded changes to tables that keep co-dependent cells consistent."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whence.functions import mutations as M
from whence.functions.hashing import coin, draw, permuted
from whence.functions.scalars import is_number
from whence.operators.frame import Source, pointer_text
from whence.session import durable
from whence.sources.numbering import dense_index


def infer_category(df: DataFrame) -> DataFrame:
    """Per column: numerical if every value parses as a number, else other. NULL does not parse.

    One aggregate over all columns; columns col, category.
    """
    flags = [
        F.when(F.coalesce(F.bool_and(is_number(F.col(c).cast("string"))), F.lit(False)), "numerical")
        .otherwise("other")
        .alias(c)
        for c in df.columns
    ]
    return df.agg(*flags).unpivot([], df.columns, "col", "category")


def declared_categories(schema: T.StructType) -> dict[str, tuple[str, tuple[int, int] | None]]:
    """Category and range of each column from its schema metadata."""
    out = {}
    for field in schema:
        meta = field.metadata
        limits = (meta["min"], meta["max"]) if "min" in meta else None
        out[field.name] = (meta.get("category", "other"), limits)
    return out


def with_rid(source: Source) -> DataFrame:
    return source.df.withColumn("rid", pointer_text(source.df, source.key))


def perturb(rows: DataFrame, columns: Sequence[str], change: Callable[[Column, Column, str], Column]) -> DataFrame:
    """Long form of changed cells: rid, col, before, after.

    ``change(text, rid, column)`` gives the new text. ``rows`` has a ``rid``. The work is dealt evenly over
    all cores, as a table of short rows is one split of a file, however many rows it has.
    """
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    cells = [
        F.struct(
            F.lit(c).alias("col"),
            F.col(c).cast("string").alias("before"),
            change(F.col(c).cast("string"), F.col("rid"), c).alias("after"),
        )
        for c in columns
    ]
    return rows.select("rid", F.explode(F.array(*cells)).alias("c")).select("rid", "c.*")


def scramble_text(share: float = 0.5, seed: int = 0):
    return lambda text, rid, col: M.scramble(text, M.wide_draw(rid, col, seed), share)


def offset_numbers(seed: int = 0):
    return lambda text, rid, col: M.offset_number(text, M.wide_draw(rid, col, seed))


def number_formats():
    return lambda text, rid, col: M.change_format(text)


def blanks(share: float, seed: int = 0):
    return lambda text, rid, col: F.when(coin(rid, f"{col}/blank", share, seed), "").otherwise(text)


def mixed(seed: int = 0):
    return lambda text, rid, col: M.roulette(text, rid, col, seed)


def by_schema(categories: Mapping[str, tuple[str, tuple[int, int] | None]], seed: int = 0, share: float = 0.5):
    """Declared category and range decide; undeclared columns count as other."""

    def change(text: Column, rid: Column, col: str) -> Column:
        category, limits = categories.get(col, ("other", None))
        return M.mutate_value(text, M.wide_draw(rid, col, seed), share, category, limits)

    return change


def duplicate_rows(rows: DataFrame, share: float, most: int, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows get one to ``most`` - 1 copies: adds copy_no."""
    if most < 2:
        raise ValueError("most must be at least 2")
    copies = F.when(coin("rid", "dup", share, seed), draw("rid", "copies", seed) % (most - 1) + 1).otherwise(0)
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias("copy_no"))


def cell_groups(relation: DataFrame) -> DataFrame:
    """(ds, col, rid) -> the group that seeds the cell, for ``==`` groups.

    A cell in several groups follows the least; merge overlapping groups first
    where all of them must agree.
    """
    equal = relation.where("op = '=='")
    return equal.groupBy("ds", "col", "rid").agg(F.min("group_id").alias("group_id"))


def perturb_consistently(source: Source, relation: DataFrame, column: str, seed: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """The rows of a source with ``new_<column>``: co-dependent cells change
    together with their group, the others keep their text.

    Row ids are unique on both sides, so the join is even under any key skew.
    """
    rows = with_rid(source) if rows is None else rows
    groups = cell_groups(relation).where((F.col("ds") == source.name) & (F.col("col") == column))
    joined = rows.join(groups.select("rid", "group_id"), "rid", "left")
    old = F.col(column)
    new = F.when(F.col("group_id").isNull(), old.cast("string")).otherwise(
        M.consistent_key(old, F.col("group_id"), seed)
    )
    return joined.withColumn(f"new_{column}", new)


def permuted_keys(keys: DataFrame, seed: int = 0) -> DataFrame:
    """Distinct ``keys`` (one column or more, of any type) and, as ``new_<column>``, the key each becomes.

    The keys are numbered in their order (range partitions, no global sort) and a seeded
    permutation of the numbers says which key takes whose place. So new keys are of the same
    type and size as the old ones, no two fall together, and none meets a key that stays.
    """
    names = keys.columns
    numbered = durable(dense_index(keys.distinct(), names, "__rank"))
    n = numbered.count()
    if not n:
        return numbered.select(*names, *[F.col(c).alias(f"new_{c}") for c in names])
    moved = numbered.select(*names, permuted(F.col("__rank"), n, seed).alias("__to"))
    return moved.join(numbered.toDF(*[f"new_{c}" for c in names], "__to"), "__to").drop("__to")


def permute_consistently(
    sources: Mapping[str, tuple[Source, Sequence[str]]], relation: DataFrame, seed: int = 0
) -> dict[str, DataFrame]:
    """Rows of each source with ``new_<column>`` for its key columns: co-dependent keys change alike.

    ``sources`` maps a name to (source, key columns); the n-th column of each plays the same
    part of a compound key. A key that stands in a cell of an ``==`` group of ``relation`` moves
    to the place of another such key, wherever it stands; other keys and NULLs stay. Joins on
    the keys therefore keep every match, for texts, dates and integers of any size.
    """
    parts = [f"__k{i}" for i in range(len(next(iter(sources.values()))[1]))]
    tied, keyed = [], {}
    for name, (source, columns) in sources.items():
        rows = with_rid(source).withColumns({k: F.col(c) for k, c in zip(parts, columns)})
        keyed[name] = rows
        cells = relation.where((F.col("op") == "==") & (F.col("ds") == source.name) & F.col("col").isin(*columns))
        tied.append(rows.join(cells.select("rid").distinct(), "rid", "left_semi").select(*parts))
    # Written, so its size is known; rows of a hot key are split in the join.
    mapping = durable(permuted_keys(reduce(DataFrame.unionByName, tied).dropna(subset=parts), seed))
    out = {}
    for name, (source, columns) in sources.items():
        joined = keyed[name].join(mapping, parts, "left")
        changed = F.col(f"new_{parts[0]}").isNotNull()
        new = {f"new_{c}": F.when(changed, F.col(f"new_{k}")).otherwise(F.col(k)) for k, c in zip(parts, columns)}
        out[name] = joined.withColumns(new).drop(*parts, *[f"new_{k}" for k in parts])
    return out


def copy_id(rid: Column, copy_no: Column) -> Column:
    return F.when(copy_no == 0, rid).otherwise(F.concat(rid, F.lit("+"), copy_no.cast("string")))


def duplicate_group(source: Source, group: DataFrame, copies: int) -> DataFrame:
    """All rows of a source, and ``copies`` copies of those in ``group``.

    Copies have ids ``rid+n``; columns of the source, rid, copy_no.
    """
    wanted = group.where(F.col("ds") == source.name).select("rid").distinct().withColumn("__hit", F.lit(copies))
    rows = with_rid(source).join(wanted, "rid", "left")
    last = F.coalesce(F.col("__hit"), F.lit(0))
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("copy_no")).drop("__hit")
    return numbered.withColumn("rid", copy_id(F.col("rid"), F.col("copy_no")))


def extend_groups(relation: DataFrame, group: DataFrame, copies: int) -> DataFrame:
    """Relation plus the cells of the copied rows, in the groups of the originals."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    added = group.select("*", numbers.alias("n")).withColumn("rid", copy_id(F.col("rid"), F.col("n"))).drop("n")
    return relation.unionByName(added)


def keyed_copies(
    sources: Mapping[str, tuple[Source, Sequence[str]]], keys: int = 3, values: int = 3, seed: int = 0
) -> tuple[dict[str, DataFrame], DataFrame]:
    """``keys`` times ``values`` copies of one row of each source, to feed its groups: (rows by name, relation).

    The row is chosen by the hash of its id. Copies have ids ``rid+n``; every ``values`` copies in a
    row form a group of equal key cells, over all sources, in the relation of ``==`` groups. So
    once groups are changed consistently, there are ``keys`` new keys with ``values`` rows each.
    """
    rows, cells = {}, []
    for name, (source, columns) in sources.items():
        own = with_rid(source)
        one = own.orderBy(draw("rid", "row", seed), "rid").limit(1).select("rid").withColumn("__hit", F.lit(keys * values))
        # One row, so its side of the join is.
        hit = own.join(F.broadcast(one), "rid", "left")
        numbered = hit.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("__hit", F.lit(0)))).alias("copy_no")).drop("__hit")
        rows[name] = numbered.withColumn("rid", copy_id(F.col("rid"), F.col("copy_no")))
        group = F.concat(F.lit("copies:"), F.expr(f"cast((n - 1) div {values} as string)"))
        added = one.select("rid", F.explode(F.sequence(F.lit(1), F.lit(keys * values))).alias("n"))
        added = added.select(
            group.alias("group_id"), F.lit("==").alias("op"), F.lit(source.name).alias("ds"),
            F.explode(F.array(*[F.lit(c) for c in columns])).alias("col"), copy_id(F.col("rid"), F.col("n")).alias("rid"),
        )
        cells.append(added)
    return rows, reduce(DataFrame.unionByName, cells)


def perturb_together(
    sources: Mapping[str, tuple[Source, str, Sequence[str]]],
    relation: DataFrame,
    group: DataFrame,
    copies: int = 9,
    seed: int = 0,
    unguided_share: float = 0.0001,
) -> dict[str, DataFrame]:
    """Copy one group, change key cells consistently and all other cells freely.

    ``sources`` maps a name to (source, key column, other columns). Each result
    has cells rid, col, before, after. With probability ``unguided_share`` (one
    draw per seed) every cell takes the unguided mixture instead.
    """
    extended = extend_groups(relation, group, copies)
    unguided = coin(F.lit("run"), "unguided", unguided_share, seed)
    free = mixed(seed)
    guided = lambda text, rid, col: M.mutate_value(text, M.wide_draw(rid, col, seed))
    out = {}
    for name, (source, key, others) in sources.items():
        rows = duplicate_group(source, group, copies)
        changed = perturb_consistently(source, extended, key, seed, rows)

        def change(text: Column, rid: Column, col: str, key=key) -> Column:
            kept = F.col(f"new_{key}") if col == key else guided(text, rid, col)
            return F.when(unguided, free(text, rid, col)).otherwise(kept)

        out[name] = perturb(changed, [key, *others], change)
    return out
