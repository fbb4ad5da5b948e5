"""LineageFrame: a DataFrame whose rows know which source rows made them.

Lineage is kept factorised, as ordinary relations:

* every source (``Leg``) contributes its key columns as hidden columns, so a row
  carries one pointer per source and nothing that grows;
* an aggregate replaces those pointers by its own group key and remembers a lazy
  edge relation (group key -> pointers of the rows below), which is never
  computed unless somebody traces;
* which source columns an output column reads is static (``colmap``), so cell
  lineage is edges x column map.

Filters, projections, joins and aggregates are plain DataFrame plans: Catalyst
prunes the pointers nobody asks for.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whence.functions.hashing import coin, digest, poisson
from whence.operators.combine import Combiner, combined
from whence.operators.influence import Influence
from whence.operators.trace import EdgeStep, Leg, Source, follow, write_index
from whence.plans.skew import bounded_lists
from whence.session import durable

_group_numbers = itertools.count(1)

Cell = tuple[str, str]


def pointer_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Pointer columns printed as one text, dates as yyyy-MM-dd."""
    parts = []
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            parts.append(F.col(name).cast("date").cast("string"))
        else:
            parts.append(F.col(name).cast("string"))
    return F.concat_ws("-", *parts)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row (empty when ``key`` identifies rows)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def tag(
    df: DataFrame, name: str, key: Sequence[str], role: str | None = None, check: bool = False
) -> "LineageFrame":
    """Start tracking ``df``; ``key`` identifies its rows.

    ``role`` tells two uses of one source apart (a dimension joined twice).
    ``check`` runs a job that rejects a key with duplicates.
    """
    if check and not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"{name}: {list(key)} does not identify rows")
    leg_name = role or name
    hidden = tuple(f"__{leg_name}__{k}" for k in key)
    tagged = df.withColumns({h: F.col(k) for h, k in zip(hidden, key)})
    leg = Leg(leg_name, hidden, source=Source(name, df, tuple(key)))
    return LineageFrame(tagged, (leg,), {c: frozenset({(leg_name, c)}) for c in df.columns})


@dataclass(frozen=True)
class LineageFrame:
    df: DataFrame
    legs: tuple[Leg, ...]
    colmap: Mapping[str, frozenset[Cell]]
    #: Of an aggregate of which no row has been dropped: visible group column -> pointer column.
    keys: Mapping[str, str] | None = None

    # -- shape ---------------------------------------------------------------
    @property
    def pointers(self) -> list[str]:
        return [c for leg in self.legs for c in leg.hidden]

    @property
    def visible(self) -> list[str]:
        hidden = set(self.pointers)
        return [c for c in self.df.columns if c not in hidden]

    @property
    def plain(self) -> DataFrame:
        """The result without lineage."""
        return self.df.select(*self.visible)

    @property
    def sources(self) -> dict[str, Source]:
        found: dict[str, Source] = {}

        def walk(legs: Iterable[Leg]) -> None:
            for leg in legs:
                if leg.source:
                    found.setdefault(leg.source.name, leg.source)
                else:
                    walk(leg.step.legs)

        walk(self.legs)
        return found

    def reads(self, *columns: str) -> frozenset[Cell]:
        cells = [self.colmap.get(c, frozenset()) for c in columns]
        return frozenset().union(*cells)

    # -- narrow operators: pointers pass through -----------------------------
    def select(self, *columns: str) -> "LineageFrame":
        kept = {c: self.colmap.get(c, frozenset()) for c in columns}
        keys = {c: h for c, h in (self.keys or {}).items() if c in columns}
        return replace(self, df=self.df.select(*columns, *self.pointers), colmap=kept, keys=keys)

    def rename(self, names: Mapping[str, str]) -> "LineageFrame":
        colmap = {names.get(c, c): cells for c, cells in self.colmap.items()}
        keys = {names.get(c, c): h for c, h in (self.keys or {}).items()}
        return replace(self, df=self.df.withColumnsRenamed(dict(names)), colmap=colmap, keys=keys)

    def derive(self, name: str, expr: Column, inputs: Sequence[str] = ()) -> "LineageFrame":
        """Add a column. ``inputs`` are the columns ``expr`` reads; the new column
        inherits their source cells. A literal contributes none."""
        colmap = {**self.colmap, name: self.reads(*inputs)}
        keys = {c: h for c, h in (self.keys or {}).items() if c != name}
        return replace(self, df=self.df.withColumn(name, expr), colmap=colmap, keys=keys)

    def map(self, **outputs: tuple[Column, Sequence[str]]) -> "LineageFrame":
        """Replace the visible columns: ``name=(expr, inputs)``."""
        exprs = [expr.alias(name) for name, (expr, _) in outputs.items()]
        colmap = {name: self.reads(*inputs) for name, (_, inputs) in outputs.items()}
        return replace(self, df=self.df.select(*exprs, *self.pointers), colmap=colmap, keys=None)

    def winner(self, name: str, which: str, *columns: str, least: bool = False) -> "LineageFrame":
        """Largest (or ``least``) of several columns, and the cell it came from (first on ties).

        Which input wins depends on the data, so it is a column; the static map
        still lists all of them."""
        best = F.least(*columns) if least else F.greatest(*columns)
        label = F.lit(None).cast("string")
        for c in reversed(columns):
            text = ",".join(sorted(f"{ds}.{col}" for ds, col in self.reads(c)))
            label = F.when(F.col(c) == best, text).otherwise(label)
        return self.derive(name, best, columns).derive(which, label, columns)

    def flat_map(self, name: str, items: Column, inputs: Sequence[str]) -> "LineageFrame":
        """One row per item of an array expression; each inherits its row's lineage."""
        df = self.df.select("*", F.explode(items).alias(name))
        return replace(self, df=df, colmap={**self.colmap, name: self.reads(*inputs)}, keys=None)

    def table_function(self, function: Callable[..., DataFrame], inputs: Sequence[str], outputs: Sequence[str]) -> "LineageFrame":
        """One row for every row that a table function gives for the ``inputs`` of a row; each
        inherits its row's lineage, and the ``outputs`` read the cells of the inputs."""
        df = self.df.lateralJoin(function(*[F.col(c).outer() for c in inputs]))
        colmap = dict(self.colmap) | {name: self.reads(*inputs) for name in outputs}
        return replace(self, df=df, colmap=colmap, keys=None)

    def filter(self, cond: Column) -> "LineageFrame":
        return replace(self, df=self.df.where(cond), keys=None)

    def sort(self, *order: Column) -> "LineageFrame":
        return replace(self, df=self.df.orderBy(*order))

    def top(self, k: int, *order: Column) -> "LineageFrame":
        """First ``k`` rows of an order; planned as TakeOrderedAndProject."""
        return replace(self, df=self.df.orderBy(*order).limit(k), keys=None)

    def sample(self, share: float, seed: int, replacement: bool = False) -> "LineageFrame":
        """Repeatable sample by the hash of a row's pointer, so that a trace sees the very same draw.

        With ``replacement`` a row comes as often as a Poisson count of mean ``share`` says.
        """
        if not replacement:
            return self.hash_sample(share, "draw", seed)
        rid = pointer_text(self.df, self.pointers)
        drawn = self.df.withColumn("__times", poisson(rid, "draw", share, seed)).where("__times > 0")
        again = drawn.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        return replace(self, df=again.drop("__times", "__again"), keys=None)

    def take_sample(self, n: int, seed: int = 0) -> "LineageFrame":
        """Exactly ``n`` rows (all, if fewer), those with the least hashes of their pointers."""
        rid = pointer_text(self.df, self.pointers)
        return self.top(n, digest(rid, "take", seed).asc(), *[F.col(c).asc() for c in self.pointers])

    def hash_sample(self, share: float, tag: str = "s", seed: int = 0) -> "LineageFrame":
        """Repeatable sample: a row is in or out by the hash of its pointer."""
        rid = pointer_text(self.df, self.pointers)
        return self.filter(coin(rid, tag, share, seed))

    def limit(self, n: int) -> "LineageFrame":
        """Any ``n`` rows. They are written, so that a trace explains these and no others."""
        return replace(self, df=durable(self.df.limit(n)), keys=None)

    def persist(self) -> "LineageFrame":
        return replace(self, df=self.df.persist())

    def unpersist(self) -> "LineageFrame":
        return replace(self, df=self.df.unpersist())

    def count(self) -> int:
        return self.df.count()

    def take(self, n: int, lineage: bool = False) -> list:
        """The first ``n`` rows on the driver, on request with their row ids."""
        return (self.with_lineage() if lineage else self.plain).take(n)

    # -- joins ---------------------------------------------------------------
    def join(self, other: "LineageFrame", on: Sequence[str | tuple[str, str]], how: str = "inner") -> "LineageFrame":
        """Equi-join; a result row carries the pointers of both sides.

        ``left`` keeps rows without a partner: their lineage on the right is empty.
        ``left_semi`` and ``left_anti`` filter the left side and keep its lineage alone.
        """
        how = {"semi": "left_semi", "anti": "left_anti", "left_outer": "left"}.get(how, how)
        if how not in ("inner", "left", "left_semi", "left_anti"):
            raise ValueError(f"join {how!r}: use inner, left, left_semi or left_anti")
        pairs = [(k, k) if isinstance(k, str) else k for k in on]
        shared = {l for l, r in pairs if l == r}
        one_sided = how in ("left_semi", "left_anti")
        clash = set() if one_sided else (set(self.df.columns) & set(other.df.columns)) - shared
        if clash:
            raise ValueError(f"both sides have {sorted(clash)}: rename, or tag with a role")
        if one_sided:
            wanted = other.df.select(*[F.col(r).alias(f"__on_{i}") for i, (_, r) in enumerate(pairs)])
            cond = [F.col(l) == F.col(f"__on_{i}") for i, (l, _) in enumerate(pairs)]
            return replace(self, df=self.df.join(wanted, cond, how), keys=None)
        legs = other.legs
        if how == "left":
            legs = tuple(replace(leg, here=leg.here or f"__{leg.name}__here") for leg in legs)
        marks = {leg.here: F.lit(True) for leg in legs if leg.here and leg.here not in other.df.columns}
        right = other.df.withColumns(marks) if marks else other.df
        right = right.withColumnsRenamed({c: f"__on_{c}" for c in shared})
        cond = F.lit(True)
        for l, r in pairs:
            cond = cond & (F.col(l) == F.col(f"__on_{r}" if r in shared else r))
        df = self.df.join(right, cond, how).drop(*[f"__on_{c}" for c in shared])
        colmap = {**other.colmap, **self.colmap}
        for c in shared:
            colmap[c] = self.reads(c) | other.reads(c)
        return LineageFrame(df, self.legs + legs, colmap)

    # -- aggregates ----------------------------------------------------------
    def agg(
        self,
        keys: Sequence[str],
        influence: Influence | None = None,
        count_as: str | None = None,
        **outputs: tuple[Column, Sequence[str]],
    ) -> "LineageFrame":
        """Group and aggregate: ``name=(expr, inputs)``.

        The result is an ordinary partial/final aggregate. Lineage is the lazy
        edge relation; ``influence`` decides which contributors it keeps.
        ``count_as`` adds the number of rows below each group to the same pass.
        """
        if count_as:
            outputs = {**outputs, count_as: (F.count(F.lit(1)), ())}
        name = f"g{next(_group_numbers)}"
        hidden = tuple(f"__{name}__{k}" for k in keys) or (f"__{name}__all",)
        kept = influence.keep(self.df, keys, self.pointers) if influence else self.df
        if keys:
            pointer = [F.col(k).alias(h) for k, h in zip(keys, hidden)]
            out = self.df.groupBy(*keys)
            points_to = {h: F.col(k) for k, h in zip(keys, hidden)}
        else:
            pointer = [F.lit(True).alias(hidden[0])]
            out = self.df.groupBy()
            points_to = {hidden[0]: F.lit(True)}
        edges = kept.select(*pointer, *self.pointers)
        exprs = [expr.alias(c) for c, (expr, _) in outputs.items()]
        df = out.agg(*exprs) if exprs else self.df.select(*keys).distinct()
        colmap = {k: self.reads(k) for k in keys}
        colmap |= {c: self.reads(*inputs) for c, (_, inputs) in outputs.items()}
        leg = Leg(name, hidden, step=EdgeStep(edges, self.legs), whole=not keys)
        return LineageFrame(df.withColumns(points_to), (leg,), colmap, dict(zip(keys, hidden)))

    def combine(
        self, keys: Sequence[str], inputs: Sequence[str], combiner: Combiner, influence: Influence | None = None
    ) -> "LineageFrame":
        """Group by ``keys`` with a combiner over ``inputs`` (see ``combine``); lineage as for ``agg``."""
        shape = self.agg(keys, influence)
        df = combined(self.df, keys, inputs, combiner)
        outputs = [c for c in df.columns if c not in keys]
        (leg,) = shape.legs
        colmap = {k: self.reads(k) for k in keys} | {c: self.reads(*inputs) for c in outputs}
        pointer = {h: F.col(k) for k, h in zip(keys, leg.columns)}
        return replace(shape, df=df.withColumns(pointer), colmap=colmap, keys=None)

    def distinct(self) -> "LineageFrame":
        return self.agg(self.visible)

    def group_lists(self, keys: Sequence[str], value: Column, name: str = "value", **kw) -> DataFrame:
        """Grouped values with per-element lineage: keys, part, items[rid, value]."""
        item = F.struct(pointer_text(self.df, self.pointers).alias("rid"), value.alias(name))
        return bounded_lists(self.df, keys, item, self.pointers, **kw)

    def retag(self, name: str, key: Sequence[str]) -> "LineageFrame":
        """Forget the lineage so far and start again from this result."""
        return tag(self.plain, name, key)

    # -- looking at lineage --------------------------------------------------
    def rid(self, leg: str) -> Column:
        found = next(l for l in self.legs if l.name == leg)
        text = pointer_text(self.df, found.columns)
        return F.when(F.col(found.here).isNotNull(), text) if found.here else text

    def with_lineage(self, cells: bool = False) -> DataFrame:
        """Visible columns, ``<leg>_rid`` per leg and, on request, the cells read."""
        out = self.df.select(
            *self.visible, *[self.rid(leg.name).alias(f"{leg.name}_rid") for leg in self.legs]
        )
        return out.withColumn("cols", F.lit(self.cols_text())) if cells else out

    def cols_text(self, *columns: str) -> str:
        cells = self.reads(*(columns or self.visible))
        return ",".join(sorted(f"{ds}.{c}" for ds, c in cells))

    def edges(self) -> DataFrame:
        """Group key -> contributing rows of the last aggregate, as text ids."""
        (leg,) = self.legs
        if leg.step is None:
            raise ValueError("edges() needs an aggregated frame")
        df = leg.step.edges
        rids = [pointer_text(df, inner.columns).alias(f"{inner.name}_rid") for inner in leg.step.legs]
        names = [F.col(h).alias(h.split("__", 2)[2]) for h in leg.columns]
        return df.select(*names, *rids)

    def edge_counts(self, name: str = "n_rows") -> DataFrame:
        """Contributing rows per group, combined map side."""
        edges = self.edges()
        keys = edges.columns[: len(self.legs[0].columns)]
        return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    def to_cells(self) -> DataFrame:
        """Long form of a source: ds, col, rid, value (as text)."""
        (leg,) = self.legs
        rid = pointer_text(self.df, leg.columns).alias("rid")
        texts = [F.col(c).cast("string").alias(c) for c in self.visible]
        wide = self.df.select(rid, *texts)
        return wide.unpivot("rid", self.visible, "col", "value").select(
            F.lit(leg.name).alias("ds"), "col", "rid", "value"
        )

    def indexed(self, buckets: int = 64) -> "LineageFrame":
        """The same frame over a written edge index: each aggregate's edges, bucketed by group pointer.

        For results that are traced again and again; a trace then reads the index and no source.
        """
        done: dict[str, Leg] = {}
        return replace(self, legs=tuple(write_index(leg, buckets, done) for leg in self.legs))

    def trace_ids(self, flagged: Column | None = None) -> dict[str, DataFrame]:
        """Backward trace: per source, the distinct keys behind the flagged rows.

        Each aggregate is crossed once, by a semi-join of its edges with the pointers
        wanted so far (see ``trace``). Nothing is collected.
        """
        ids: dict[str, list[DataFrame]] = {}
        for found in follow(self, flagged):
            for leg in found.legs:
                ids.setdefault(leg.source.name, []).append(found.of(leg).toDF(*leg.source.key))
        return {name: _once(rows) for name, rows in ids.items()}

    def trace_rids(self, flagged: Column | None = None) -> DataFrame:
        """(ds, rid): the printed id of every source row behind the flagged rows, each once."""
        return self._listed(flagged, lambda leg: F.lit(None).cast("array<string>")).select("ds", "rid")

    def trace_back(self, flagged: Column | None = None) -> dict[str, DataFrame]:
        """Per source, the rows that explain the flagged output rows."""
        ids = self.trace_ids(flagged)
        return {
            name: source.df.join(ids[name], list(source.key), "left_semi")
            for name, source in self.sources.items()
        }

    def _listed(self, flagged: Column | None, columns: Callable[[Leg], Column]) -> DataFrame:
        """ds, rid and ``columns`` of the leg, in one pass over every relation of the trace; distinct."""
        parts, seen = [], []
        for found in follow(self, flagged):
            is_ = [F.col("leg") == leg.name for leg in found.legs]
            values = {
                "ds": [F.lit(leg.source.name) for leg in found.legs],
                "rid": [pointer_text(found.rows, leg.columns) for leg in found.legs],
                "cols": [columns(leg) for leg in found.legs],
            }
            seen += [leg.source.name for leg in found.legs]
            parts.append(found.rows.where(reduce(Column.__or__, is_)).select(*[_case(is_, v).alias(n) for n, v in values.items()]))
        rows = reduce(DataFrame.unionByName, parts)
        return rows if len(seen) == len(set(seen)) else rows.distinct()

    def cells(self, *columns: str, flagged: Column | None = None) -> DataFrame:
        """(ds, col, rid) cells behind the given output columns of the flagged rows.

        A source in two roles gives for each role the columns read through it, not the
        columns of both for the rows of both.
        """
        wanted = self.reads(*(columns or self.visible))

        def read(leg: Leg) -> Column:
            names = sorted(c for name, c in wanted if name == leg.name)
            return F.array(*[F.lit(c) for c in names]).cast("array<string>")

        cells = self._listed(flagged, read).select("ds", F.explode("cols").alias("col"), "rid")
        twice = len(self._source_names()) > len(self.sources)
        return cells.distinct() if twice else cells

    def touched(self, *columns: str, flagged: Column | None = None) -> DataFrame:
        """(ds, col) pairs that the flagged rows' lineage touches."""
        return self.cells(*columns, flagged=flagged).select("ds", "col").distinct()

    def _source_names(self) -> dict[str, str]:
        names: dict[str, str] = {}

        def walk(legs: Iterable[Leg]) -> None:
            for leg in legs:
                if leg.source:
                    names[leg.name] = leg.source.name
                else:
                    walk(leg.step.legs)

        walk(self.legs)
        return names


def _once(parts: list[DataFrame]) -> DataFrame:
    """The union of relations that hold each row once."""
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()


def _case(conditions: Sequence[Column], values: Sequence[Column]) -> Column:
    found = values[-1]
    for is_, value in zip(conditions[-2::-1], values[-2::-1]):
        found = F.when(is_, value).otherwise(found)
    return found
