"""Backward traces: from flagged output rows to the source rows behind them.

A trace goes down the aggregates, each of them once, the last made first, so that all
that points to an aggregate is known before its edges are followed. Wherever several legs
meet, one relation holds the distinct pointers of all of them (a row names its leg); it is
written once, so a pipeline is read once per aggregate and not once per leg, and as a
written table its size is known: a small one is broadcast down to the source scans as a
semi-join, a large one is joined by a shuffle whose skewed keys are split, before which
Spark can filter the scan by a Bloom filter of the wanted pointers.

A condition on the group columns alone filters the edges themselves; the aggregate is not
computed for it. ``indexed`` writes the edges of a frame, bucketed by group pointer, for
frames that are traced again and again: later traces read only the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whence.session import durable, scratch_dir

if TYPE_CHECKING:
    from whence.operators.frame import LineageFrame


@dataclass(frozen=True)
class Source:
    name: str
    df: DataFrame
    key: tuple[str, ...]


@dataclass(frozen=True)
class EdgeStep:
    """Rows below an aggregate: group pointer columns plus the inner pointers."""

    edges: DataFrame
    legs: tuple["Leg", ...]
    #: Bucketed by the encoded group pointers (see ``encoded``).
    bucketed: bool = False


@dataclass(frozen=True)
class Leg:
    name: str
    columns: tuple[str, ...]
    source: Source | None = None
    step: EdgeStep | None = None
    #: An aggregate without keys: one group holds all rows.
    whole: bool = False
    #: Column that is NULL where an outer join found no row for this leg.
    here: str | None = None

    @property
    def hidden(self) -> tuple[str, ...]:
        return self.columns + ((self.here,) if self.here else ())


@dataclass(frozen=True)
class Found:
    """Distinct pointers of the source legs ``legs``; a row's ``leg`` names the leg it belongs to."""

    rows: DataFrame
    legs: tuple[Leg, ...]

    def of(self, leg: Leg) -> DataFrame:
        return self.rows.where(F.col("leg") == leg.name).select(*leg.columns)


def stacked(front: DataFrame, legs: Sequence[Leg]) -> DataFrame:
    """leg and the pointer columns of all legs: the distinct pointers of each leg, from one pass over ``front``."""
    kinds = {c: front.schema[c].dataType for leg in legs for c in leg.columns}
    rows = []
    for leg in legs:
        values = [(F.col(c) if c in leg.columns else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()]
        row = F.struct(F.lit(leg.name).alias("leg"), *values)
        rows.append(F.when(F.col(leg.here).isNotNull(), row) if leg.here else row)
    if len(rows) == 1:
        exploded = front.select(rows[0].alias("row"))
    else:
        exploded = front.select(F.explode(F.array(*rows)).alias("row"))
    return exploded.where(F.col("row").isNotNull()).select("row.*").distinct()


def by_key_alone(frame: "LineageFrame", flagged: Column) -> bool:
    """Does the condition read nothing but the group columns of the aggregate that ``frame`` is?"""
    if not frame.keys:
        return False
    # An empty relation of these columns alone: a projection would still resolve the others.
    only = T.StructType([frame.df.schema[k] for k in frame.keys])
    try:
        frame.df.sparkSession.createDataFrame([], only).where(flagged).schema
    except AnalysisException:
        return False
    return True


def follow(frame: "LineageFrame", flagged: Column | None = None) -> list[Found]:
    """The source pointers behind the flagged rows."""
    found: list[Found] = []
    steps: dict[str, Leg] = {}
    wanted: dict[str, list[DataFrame]] = {}

    def take(front: DataFrame, legs: Sequence[Leg]) -> None:
        rows = stacked(front, legs)
        if len(legs) > 1 or legs[0].step:
            rows = durable(rows)
        ends = tuple(leg for leg in legs if leg.source)
        if ends:
            found.append(Found(rows, ends))
        for leg in legs:
            if leg.step:
                steps[leg.name] = leg
                wanted.setdefault(leg.name, []).append(Found(rows, ()).of(leg))

    if flagged is not None and by_key_alone(frame, flagged):
        (leg,) = frame.legs
        named = leg.step.edges.withColumns({k: F.col(h) for k, h in frame.keys.items()})
        take(named.where(flagged), leg.step.legs)
    else:
        take(frame.df if flagged is None else frame.df.where(flagged), frame.legs)
    while wanted:
        # An aggregate is numbered after those below it.
        name = max(wanted, key=lambda n: int(n[1:]))
        below = edges_of(steps[name], wanted.pop(name))
        take(below, steps[name].step.legs)
    return found


def edges_of(leg: Leg, wanted: Sequence[DataFrame]) -> DataFrame:
    """The edges below the wanted groups of an aggregate."""
    rows = wanted[0]
    for more in wanted[1:]:
        rows = rows.unionByName(more)
    if leg.whole:
        # One group: its pointer relation is a single row.
        return leg.step.edges.join(F.broadcast(rows.limit(1)), list(leg.columns), "left_semi")
    if leg.step.bucketed:
        codes = [c for pair in encoded(rows, leg.columns).values() for c in pair]
        rows = rows.select(*[c.alias(f"__w{i}") for i, c in enumerate(codes)])
        on = [F.col(_code(i)) == F.col(f"__w{i}") for i in range(len(codes))]
    else:
        rows = rows.toDF(*[f"__w{i}" for i in range(len(leg.columns))])
        on = [F.col(c).eqNullSafe(F.col(f"__w{i}")) for i, c in enumerate(leg.columns)]
    return leg.step.edges.join(rows, on, "left_semi")


# -- the index ---------------------------------------------------------------


def _code(i: int) -> str:
    return f"__code{i}"


def encoded(df: DataFrame, columns: Iterable[str]) -> dict[str, tuple[Column, Column]]:
    """Per column a value that is never NULL and whether the column is NULL: they join by plain
    equality, so the buckets of the index fit the join."""
    found = {}
    for c in columns:
        kind = df.schema[c].dataType
        plain = "" if isinstance(kind, T.StringType) else b"" if isinstance(kind, T.BinaryType) else False
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            plain = "1970-01-01"
        elif isinstance(kind, T.NumericType):
            plain = 0
        found[c] = (F.coalesce(F.col(c), F.lit(plain).cast(kind)), F.col(c).isNull())
    return found


BUCKETED = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def write_index(leg: Leg, buckets: int, done: dict[str, Leg]) -> Leg:
    """``leg`` over written edges; those of an aggregate that several legs share are written once."""
    if leg.source:
        return leg
    if leg.name in done:
        return replace(done[leg.name], here=leg.here)
    edges, legs = leg.step.edges, tuple(write_index(inner, buckets, done) for inner in leg.step.legs)
    spark = edges.sparkSession
    if leg.whole or not all(isinstance(edges.schema[c].dataType, BUCKETED) for c in leg.columns):
        step = EdgeStep(durable(edges), legs)
    else:
        codes = {_code(i): c for i, c in enumerate(c for pair in encoded(edges, leg.columns).values() for c in pair)}
        table = f"edges_{uuid.uuid4().hex}"
        writer = edges.withColumns(codes).write.bucketBy(buckets, *codes).sortBy(*codes)
        writer.option("path", scratch_dir(spark, table)).saveAsTable(table)
        step = EdgeStep(spark.table(table), legs, bucketed=True)
    done[leg.name] = replace(leg, step=step)
    return done[leg.name]
