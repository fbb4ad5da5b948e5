"""Groups of input cells that an operator ties together.

A co-dependence relation has columns ``group_id, op, ds, col, rid``: the cells of
one group must stay consistent when the data is changed. Monitors emit such
relations for joins, group-bys and predicates; the functions below bring them to
normal form and cut the inputs down to witness rows. Everything stays relational,
so a group may be as large as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions.hashing import coin, draw
from whence.operators.frame import LineageFrame, Source, pointer_text
from whence.plans.skew import keyed_join, top_rows, with_group_stats
from whence.session import durable
from whence.sources.text import dense_index

CELL = ["ds", "col", "rid"]
COLUMNS = ["group_id", "op", *CELL]
#: Rows of a group and source that stand for it in a reduced table.
WITNESS_ROWS = 5


# -- monitors ---------------------------------------------------------------------


def _emit(frame: LineageFrame, columns: Sequence[str], group: Column, op: str) -> DataFrame:
    """The source cells that ``columns`` read in each row, in the row's group."""
    legs = {leg.name: leg for leg in frame.legs}
    found = sorted(frame.reads(*columns))
    if any(name not in legs or legs[name].source is None for name, _ in found):
        raise ValueError("monitored columns must come from tracked sources")
    cells = [
        F.struct(F.lit(legs[name].source.name).alias("ds"), F.lit(col).alias("col"), frame.rid(name).alias("rid"))
        for name, col in found
    ]
    # One cell per row needs no generator, so the projection stays in codegen.
    cell = cells[0] if len(cells) == 1 else F.explode(F.array(*cells))
    rows = frame.df.select(group.alias("group_id"), cell.alias("c"))
    return rows.select("group_id", F.lit(op).alias("op"), "c.*")


def _label(label: str, *keys: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), F.concat_ws("-", *[k.cast("string") for k in keys]))


def join_groups(
    left: LineageFrame, right: LineageFrame, on: tuple[str, str], label: str, cap: int | None = None
) -> DataFrame:
    """Key cells of the rows that meet in ``left`` join ``right``, one group per key.

    With a ``cap``, at most that many rows per key and side are kept, chosen by
    row id before any join. Without, all are, and hot keys are split.
    """
    sides = []
    for frame, key in zip((left, right), on):
        df = frame.select(key).df.where(F.col(key).isNotNull())
        if cap is not None:
            df = top_rows(df, [key], [F.col(c).asc() for c in frame.pointers], cap)
        sides.append((frame.select(key), key, df))
    out = []
    for (frame, key, df), (_, other_key, other) in (sides, sides[::-1]):
        keys = other.select(F.col(other_key).alias(key)).distinct()
        if cap is not None:
            met = df.join(keys, key, "left_semi")
        else:
            met = keyed_join(df, keys, [key], frame.pointers, "left_semi")
        out.append(_emit(LineageFrame(met, frame.legs, frame.colmap), [key], _label(label, F.col(key)), "=="))
    return out[0].unionByName(out[1])


def group_groups(
    frame: LineageFrame,
    keys: Sequence[str],
    label: str,
    share: float = 1.0,
    cap: int | None = None,
    seed: int = 0,
    order: Callable[[str], Column] = F.asc,
) -> DataFrame:
    """Key cells grouped by key: all of them, or on request of a repeatable ``share`` of
    the rows and of at most ``cap`` rows per key, the first in ``order`` of the row id."""
    slim = frame.select(*keys)
    if share < 1:
        slim = slim.filter(coin(pointer_text(slim.df, slim.pointers), "group", share, seed))
    if cap is not None:
        df = top_rows(slim.df, keys, [order(c) for c in slim.pointers], cap)
        slim = LineageFrame(df, slim.legs, slim.colmap)
    return _emit(slim, keys, _label(label, *[F.col(k) for k in keys]), "==")


def predicate_cells(
    frame: LineageFrame, cond: Column, columns: Sequence[str], label: str, op: str = "=="
) -> DataFrame:
    """Cells used by a predicate in every row where it holds; a row is a group."""
    held = frame.filter(cond)
    row = F.concat_ws("|", *[held.rid(leg.name) for leg in held.legs])
    return _emit(held, columns, _label(label, row), op)


def gte_witness(frame: LineageFrame, lhs: str, rhs: str, label: str) -> DataFrame:
    """Both operands' cells in the first row (by row id) where ``lhs >= rhs``."""
    first = frame.filter(F.col(lhs) >= F.col(rhs)).top(1, *[F.col(c).asc() for c in frame.pointers])
    return _emit(first, [lhs, rhs], F.lit(label), ">=")


def consolidate(*relations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, relations)


# -- normal form --------------------------------------------------------------------


#: Cells of a group that are looked at one by one, rarest first, before pairs are listed; and
#: how many pairs may be listed, as a multiple of the cells.
PREFIX_CELLS = 8
PAIRS = 4


def drop_subsets(relation: DataFrame, transitive: Sequence[str] | None = None) -> DataFrame:
    """Drop copies of a group and groups strictly inside a larger one.

    ``transitive`` names the operators whose groups may absorb others (default:
    all). A containing group has all cells of the contained one, so also its rarest, its two
    rarest, and so on. These prefixes form a tree over all groups; a level of it attaches to
    each node the groups that have all cells on the way there, so that groups with a common
    prefix share the work and no cell lists pairs of its groups. It goes down while the pairs
    that the nodes stand for are more than ``PAIRS`` times the cells, at most ``PREFIX_CELLS``
    levels; what is left is listed and decided by all its cells.
    """
    cells = durable(relation.select(*COLUMNS).distinct())
    sized = durable(
        with_group_stats(cells, ["group_id", "op"], [F.count(F.lit(1)).alias("n")], CELL)
    )
    kept = _without_copies(sized)
    absorbing = kept if transitive is None else kept.where(F.col("op").isin(*transitive))
    absorbing = absorbing.select(F.col("group_id").alias("sup"), F.col("n").alias("sup_n"), *CELL)
    inside = _contained(kept, absorbing)
    return keyed_join(
        kept, inside.withColumnRenamed("sub", "group_id"), ["group_id"], CELL, "left_anti"
    ).select(*COLUMNS)


def prefixes(kept: DataFrame) -> DataFrame:
    """sub, sub_n, cells, nodes: the rarest cells of every group whose rarest cell others have too, and
    a name for each stretch from the first on."""
    frequency = kept.groupBy(*CELL).agg(F.count(F.lit(1)).alias("f"))
    rated = keyed_join(kept, frequency, CELL, ["group_id"])
    # Pruned below the exchange, so a group of any size leaves a task with a few cells.
    first = top_rows(rated, ["group_id"], [F.col(c).asc() for c in ("f", *CELL)], PREFIX_CELLS)
    lists = first.groupBy(F.col("group_id").alias("sub"), F.col("n").alias("sub_n")).agg(
        F.array_sort(F.collect_list(F.struct("f", *CELL))).alias("cells")
    )
    stretch = lambda i: F.md5(F.to_json(F.slice("cells", F.lit(1), i)))
    nodes = F.transform(F.sequence(F.lit(1), F.size("cells")), stretch)
    return lists.where("cells[0].f > 1").withColumn("nodes", nodes)


def _contained(kept: DataFrame, absorbing: DataFrame) -> DataFrame:
    """sub: the groups that lie strictly inside another."""
    subs = durable(prefixes(kept))
    bound = PAIRS * kept.count()
    found, held = [], None
    for k in range(1, PREFIX_CELLS + 1):
        cell = F.col("cells")[k - 1]
        level = subs.where(F.size("cells") >= k).select(
            (F.col("nodes")[k - 2] if k > 1 else F.lit("")).alias("above"), F.col("nodes")[k - 1].alias("node"),
            *[cell[c].alias(c) for c in CELL], "sub_n",
        )
        children = durable(level.groupBy("above", "node", *CELL).agg(F.min("sub_n").alias("least")))
        if held is None:
            met = keyed_join(absorbing, children.drop("above"), CELL, ["sup"]).where("sup_n > least")
        else:
            below = held.withColumnRenamed("node", "above").join(children, "above").where("sup_n > least")
            met = below.join(absorbing.select("sup", *CELL), ["sup", *CELL], "left_semi")
        held = durable(met.select("node", "sup", "sup_n"))
        at = held.groupBy("node").agg(F.max("sup_n").alias("most"), F.count(F.lit(1)).alias("sups"))
        # The lists of cells stay behind.
        mine = subs.where(F.size("cells") >= k).select("sub", "sub_n", F.col("nodes")[k - 1].alias("node"))
        named = durable(mine.join(at, "node").select("sub", "sub_n", "most", "sups"))
        # All cells of these have been looked at.
        found.append(named.where(f"sub_n = {k} AND most > sub_n").select("sub"))
        pairs = named.where(f"sub_n > {k}").agg(F.sum("sups")).first()[0] or 0
        if pairs <= bound:
            break
    pairs = subs.where(f"sub_n > {k}").select("sub", "sub_n", F.col("nodes")[k - 1].alias("node")).join(held, "node")
    listed = durable(pairs.where("sup_n > sub_n").select("sub", "sup", "sub_n"))
    found.append(_covered(kept, listed, absorbing).select("sub"))
    return durable(reduce(DataFrame.unionByName, found).distinct())


def _without_copies(sized: DataFrame) -> DataFrame:
    """Keep one group (the least id) of every set of equal groups of an operator."""
    code = F.xxhash64(*CELL)
    sums = [
        F.sum(code.cast("decimal(38,0)")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("x"), *CELL)).alias("h2"),
    ]
    signature = ["op", "n", "h1", "h2"]
    signed = sized.groupBy("group_id", "op", "n").agg(*sums)
    first = signed.groupBy(*signature).agg(F.min("group_id").alias("sup"))
    pairs = (
        keyed_join(signed, first, signature, ["group_id"])
        .where("group_id <> sup")
        .select(F.col("group_id").alias("sub"), "sup", F.col("n").alias("sub_n"))
    )
    # Signatures only propose; the cells decide.
    pairs = durable(pairs)
    if pairs.isEmpty():
        return sized
    others = sized.select(F.col("group_id").alias("sup"), *CELL)
    same = _covered(sized, pairs, others).select(F.col("sub").alias("group_id"))
    return durable(keyed_join(sized, same, ["group_id"], CELL, "left_anti"))


def _covered(cells: DataFrame, pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (sub, sup) for which ``others`` has every cell of sub in sup."""
    mine = keyed_join(
        cells.select(F.col("group_id").alias("sub"), *CELL), pairs, ["sub"], CELL
    )
    shared = keyed_join(mine, others.select("sup", *CELL), ["sup", *CELL], ["sub"], "left_semi")
    return (
        shared.groupBy("sub", "sup", "sub_n")
        .agg(F.count(F.lit(1)).alias("m"))
        .where("m = sub_n")
        .select("sub", "sup")
    )


def merge_overlaps(relation: DataFrame, unit: Sequence[str] = CELL, max_rounds: int = 60) -> DataFrame:
    """Unite ``==`` groups that share a cell: columns component and ``unit``.

    The component is named by its least cell. ``unit=("ds", "rid")`` merges on
    rows instead of cells.
    """
    unit = list(unit)
    # A letter leads, so that a group without an id is one of its own.
    group = F.coalesce(F.concat(F.lit("g"), F.col("group_id")), F.lit(""))
    cells = relation.where("op = '=='").select(group.alias("group"), *unit)
    # Groups are united, not cells: a unit hangs on its least group, and links it with the others.
    held = [F.min("group").alias("least"), F.max("group").alias("most"), F.count(F.lit(1)).alias("n")]
    units = durable(cells.groupBy(*unit).agg(*held))
    links = units.where("least <> most").select(F.col("most").alias("a"), F.col("least").alias("b"))
    many = units.where("least <> most AND n > 2").select("least", *[F.col(c).alias(f"__{c}") for c in unit])
    if not many.isEmpty():
        # Of these there may be groups between the least and the last.
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in unit])
        middle = cells.join(many, same).where("group > least").select(F.col("group").alias("a"), F.col("least").alias("b"))
        links = links.unionByName(middle)
    roots = connected_components(links, max_rounds)
    # The row id leads: long common prefixes make comparisons slow.
    node = F.concat_ws("|", *reversed(unit))
    first = units.groupBy(F.col("least").alias("a")).agg(F.min(node).alias("node"))
    rooted = durable(first.join(roots, "a", "left").select("a", F.coalesce("b", "a").alias("root"), "node"))
    named = with_group_stats(rooted, ["root"], [F.min("node").alias("component")], ["a"])
    named = durable(named.select(F.col("a").alias("least"), "component"))
    return keyed_join(units.select("least", *unit), named, ["least"], unit).select("component", *unit)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least node of each component, for links (a, b) with a > b.

    Alternating star contraction: every round points children at the least
    parent of their parent, then parents of one child at the least of them. The
    number of rounds grows with the logarithm of the size, not with the length
    of chains. Only a row count and a checksum reach the driver per round.
    """
    links = durable(links.distinct())
    state = _checksum(links)
    for _ in range(max_rounds):
        parent = links.groupBy("a").agg(F.min("b").alias("p"))
        up = parent.withColumnsRenamed({"a": "b"})
        large = (
            keyed_join(links, up, ["b"], ["a"], "left")
            .select("a", F.least("b", F.coalesce("p", "b")).alias("b"))
            .distinct()
        )
        large = durable(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both = keyed_join(large, least, ["a"], ["b"])
        small = (
            both.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = durable(small)
        after = _checksum(links)
        if after == state:
            return links
        state = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


# -- witnesses -------------------------------------------------------------------------


def witness_ids(relation: DataFrame, cap: int = WITNESS_ROWS) -> DataFrame:
    """(ds, rid) of at most ``cap`` rows per group and source."""
    rows = relation.select("op", "group_id", "ds", "rid").distinct()
    return top_rows(rows, ["op", "group_id", "ds"], [F.col("rid").asc()], cap).select("ds", "rid").distinct()


def witness_rows(ids: DataFrame, source: Source, order: Callable[[str], Column] = F.asc) -> DataFrame:
    """The rows of one source that witness the relation, with a dense new id ``row`` in ``order`` of the key."""
    # Written on its own, so that its size is known: a small one goes to the rows, which then stay where they are.
    wanted = durable(ids.where(F.col("ds") == source.name).select(F.col("rid").alias("__rid")))
    rid = pointer_text(source.df, source.key)
    # The printed id is a condition, not a column, so it does not travel with the rows.
    rows = source.df.join(wanted, rid == F.col("__rid"), "left_semi")
    return dense_index(rows, [order(c) for c in source.key]).select(*source.df.columns, rid.alias("rid"), "row")


def row_map(
    ids: DataFrame, sources: Mapping[str, Source], order: Callable[[str], Column] = F.asc
) -> DataFrame:
    """(ds, rid, row): where each witness row went."""
    ids = durable(ids)
    keys = {name: Source(s.name, s.df.select(*s.key), s.key) for name, s in sources.items()}
    parts = [
        witness_rows(ids, s, order).select(F.lit(name).alias("ds"), "rid", "row") for name, s in keys.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def remap(relation: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells re-addressed to the witness rows; ``left_out`` has those of other rows."""
    moved = keyed_join(relation, rows, ["ds", "rid"], ["group_id", "op", "col"])
    return moved.select("group_id", "op", "ds", "col", F.col("row").cast("string").alias("rid"))


def left_out(relation: DataFrame, rows: DataFrame) -> DataFrame:
    """The cells that ``remap`` has no new address for."""
    return keyed_join(relation, rows.select("ds", "rid"), ["ds", "rid"], ["group_id", "op", "col"], "left_anti")


def row_level(relation: DataFrame) -> DataFrame:
    return relation.select("ds", "rid").distinct()


def pick_group(relation: DataFrame, seed: int = 0) -> DataFrame:
    """One group, chosen by seeded hash."""
    chosen = (
        relation.select("group_id", "op").distinct()
        .orderBy(draw("group_id", "pick", seed), "group_id", "op")
        .limit(1)
    )
    return relation.join(F.broadcast(chosen), ["group_id", "op"], "left_semi")
