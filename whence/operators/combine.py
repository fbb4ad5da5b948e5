"""Aggregates with a state of one's own, combined before the exchange.

A ``Combiner`` says how rows are added to the state of their key, how two states merge and
what a state comes to. Every task keeps a state per key and sends one row for it, so an
exchange moves states, not rows, and the task that finishes a key holds as many states of it
as there were tasks, however many rows the key has.

``add`` gets the rows of one key in a batch as an Arrow table, ``merge`` two states. Any
partitioning of the rows must give the same result, so both must not depend on order.

Where the state of a key is some of its rows, a ``RowTracker`` says which for many keys at once,
so that keys of a few rows each cost no call and no pickled state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

#: Keys whose states a task holds before it sends them on.
STATES = 50_000
#: Rows that are looked at together.
ROWS = 100_000


@dataclass(frozen=True)
class Combiner:
    #: (state or None, rows of a key) -> state; states are pickled.
    add: Callable[[Any, pa.Table], Any]
    #: (state, state) -> state
    merge: Callable[[Any, Any], Any]
    #: state -> columns by name, one row or more for the key
    result: Callable[[Any], dict[str, Sequence]]
    #: Types of the result's columns, as DDL; None: the types of the columns that were read.
    schema: str | None = None


@dataclass(frozen=True)
class RowTracker:
    """Both get an Arrow table with rows of any number of keys and the names of its key columns.

    ``shorten`` gives rows of which ``keep`` keeps the same as of all, whatever rows are added to
    both; ``keep`` gets all that was left of a key and gives the rows kept in the end.
    """

    shorten: Callable[[pa.Table, list[str]], pa.Table]
    keep: Callable[[pa.Table, list[str]], pa.Table]


def key_codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for the key of each row; NULLs are values."""
    code = np.zeros(len(table), np.int64)
    for k in keys:
        column = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)
    return code


def groups_of(table: pa.Table, keys: Sequence[str], columns: Sequence[str]):
    """(key values, rows of the columns) for each key in a table; NULLs are values."""
    code = key_codes(table, keys)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    named = [table.column(k).take(pa.array(order[starts])).to_pylist() for k in keys]
    rows = table.select(columns).take(pa.array(order))
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(order)])):
        yield tuple(values[i] for values in named), rows.slice(a, b - a)


def many_rows(batches, most: int = ROWS):
    """The batches' rows, as tables of ``most`` rows or somewhat more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def tracked_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tracker: RowTracker, outputs: Sequence[str]) -> DataFrame:
    """keys and ``outputs`` (some of the columns): the rows that the tracker keeps of every key."""
    keys, columns, outputs = list(keys), list(dict.fromkeys(columns)), list(outputs)
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[df[k].alias(n) for k, n in zip(keys, names)], *columns)
    final = StructType([*[slim.schema[n] for n in names], *[slim.schema[c] for c in outputs]])
    states_schema, final_schema = to_arrow_schema(slim.schema), to_arrow_schema(final)

    def start(batches):
        held = None
        for table in many_rows(batches):
            held = tracker.shorten(table if held is None else pa.concat_tables([held, table]), names)
            if len(held) > ROWS:
                yield from held.cast(states_schema).to_batches()
                held = None
        if held is not None:
            yield from held.cast(states_schema).to_batches()

    def finish(batches):
        """Rows come by key; those of a table's last key wait for the next table."""
        held = None
        for table in many_rows(batches):
            rows = table if held is None else pa.concat_tables([held, table])
            code = key_codes(rows, names)
            last = code == code[-1]
            held = tracker.shorten(rows.filter(pa.array(last)), names)
            yield from tracker.keep(rows.filter(pa.array(~last)), names).select(final_schema.names).cast(final_schema).to_batches()
        if held is not None:
            yield from tracker.keep(held, names).select(final_schema.names).cast(final_schema).to_batches()

    states = slim.mapInArrow(start, slim.schema)
    by_key = states.repartition(*names).sortWithinPartitions(*names) if names else states.repartition(1)
    return by_key.mapInArrow(finish, final).toDF(*keys, *outputs)


def combined(df: DataFrame, keys: Sequence[str], columns: Sequence[str], combiner: Combiner) -> DataFrame:
    """keys and the result's columns: the state of every key of ``df`` over ``columns``."""
    keys, columns = list(keys), list(dict.fromkeys(columns))
    key_fields = [StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    names = [f.name for f in key_fields]
    slim = df.select(*[df[k].alias(n) for k, n in zip(keys, names)], *columns)
    partial = StructType([*key_fields, StructField("state", BinaryType())])
    if combiner.schema is None:
        fields = [df.schema[c] for c in columns]
    else:
        fields = list(StructType.fromDDL(combiner.schema))
    final = StructType([*key_fields, *fields])
    states_schema, final_schema = to_arrow_schema(partial), to_arrow_schema(final)

    def packed(states: dict) -> pa.RecordBatch:
        values = [pa.array([k[i] for k in states], states_schema.field(n).type) for i, n in enumerate(names)]
        return pa.RecordBatch.from_arrays([*values, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], schema=states_schema)

    def start(batches):
        states: dict = {}
        for table in many_rows(batches):
            for key, rows in groups_of(table, names, columns):
                states[key] = combiner.add(states.get(key), rows)
            if len(states) > STATES:
                yield packed(states)
                states = {}
        yield packed(states)

    def finish(table: pa.Table) -> pa.Table:
        state = None
        for sent in table.column("state"):
            other = pickle.loads(sent.as_buffer())
            state = other if state is None else combiner.merge(state, other)
        found = combiner.result(state)
        size = len(next(iter(found.values())))
        key = {n: pa.concat_arrays([table.column(n).combine_chunks().slice(0, 1)] * size) if size else [] for n in names}
        return pa.table({n: key.get(n, found.get(n)) for n in final_schema.names}, schema=final_schema)

    states = slim.mapInArrow(start, partial)
    return states.groupBy(*names).applyInArrow(finish, final).toDF(*keys, *[f.name for f in fields])
