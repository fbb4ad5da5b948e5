"""Named queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from whence.session import tune
from whence.sources.tables import Tables

# SQL spellings of the printed row ids.
LI_RID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "strftime(l_shipdate, '%Y-%m-%d'))"
)
O_RID = "o_orderkey::varchar"
C_RID = "c_custkey::varchar"
P_RID = "p_partkey::varchar"


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(build, sql)
        return build

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: q.build(Tables(tune(spark), path))
