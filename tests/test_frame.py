"""Lineage laws of the tracked frame."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence import tag
from whence.operators import influence as I


@pytest.fixture
def sales(rows):
    data = [(1, "a", 10.0), (2, "a", 20.0), (3, "b", 5.0), (4, "b", 7.0), (5, None, 1.0), (6, "c", 100.0)]
    return tag(rows(data, "id long, shop string, price double"), "sales", ["id"], check=True)


@pytest.fixture
def shops(rows):
    data = [("a", "north"), ("b", "north"), ("c", "south")]
    return tag(rows(data, "name string, area string"), "shops", ["name"])


def test_key_check_rejects_duplicates(rows):
    with pytest.raises(ValueError, match="does not identify"):
        tag(rows([(1,), (1,)], "id long"), "t", ["id"], check=True)


def test_narrow_operators_keep_pointers(sales):
    f = sales.filter(F.col("price") > 6).derive("twice", F.col("price") * 2, ["price"]).select("twice")
    assert as_set(f.with_lineage()) == {(20.0, "1"), (40.0, "2"), (14.0, "4"), (200.0, "6")}
    assert f.reads("twice") == {("sales", "price")}


def test_literal_reads_nothing(sales):
    assert sales.derive("one", F.lit(1)).reads("one") == frozenset()


def test_flat_map_inherits_the_row(rows):
    f = tag(rows([(1, "x y"), (2, "z")], "id long, t string"), "docs", ["id"])
    words = f.flat_map("w", F.split("t", " "), ["t"]).select("w")
    assert as_set(words.with_lineage()) == {("x", "1"), ("y", "1"), ("z", "2")}


def test_join_keeps_both_sides(sales, shops):
    j = sales.join(shops, [("shop", "name")]).select("area", "price")
    assert (("north", 5.0, "3", "b")) in as_set(j.with_lineage())
    assert len(j.legs) == 2


def test_join_rejects_ambiguous_columns(sales):
    with pytest.raises(ValueError, match="rename"):
        sales.join(sales, ["shop"])


def test_self_join_with_roles(rows):
    df = rows([("a", 1), ("b", 2)], "code string, lat int")
    left = tag(df, "places", ["code"], role="start").rename({"code": "c1", "lat": "lat1"})
    right = tag(df, "places", ["code"], role="end").rename({"code": "c2", "lat": "lat2"})
    trips = tag(rows([(1, "a", "b")], "id long, f string, t string"), "trips", ["id"])
    j = trips.join(left, [("f", "c1")]).join(right, [("t", "c2")])
    traced = j.trace_ids()
    assert as_set(traced["places"]) == {("a",), ("b",)}
    assert as_set(traced["trips"]) == {(1,)}


def test_aggregate_trace_with_null_group(sales):
    totals = sales.agg(["shop"], total=(F.sum("price"), ["price"]))
    assert as_set(totals.trace_ids(F.col("shop").isNull())["sales"]) == {(5,)}
    assert as_set(totals.trace_ids(F.col("total") > 20)["sales"]) == {(1,), (2,), (6,)}


def test_chain_of_aggregates(sales, shops):
    by_shop = sales.agg(["shop"], total=(F.sum("price"), ["price"]))
    areas = by_shop.join(shops, [("shop", "name")]).agg(["area"], best=(F.max("total"), ["total"]))
    traced = areas.trace_back(F.col("area") == "north")
    assert as_set(traced["sales"].select("id")) == {(1,), (2,), (3,), (4,)}
    assert as_set(traced["shops"].select("name")) == {("a",), ("b",)}
    assert areas.reads("best") == {("sales", "price")}


def test_replay_of_the_trace_gives_the_same_output(sales):
    totals = sales.agg(["shop"], total=(F.sum("price"), ["price"]))
    traced = totals.trace_back(F.col("shop") == "a")["sales"]
    again = tag(traced, "sales", ["id"]).agg(["shop"], total=(F.sum("price"), ["price"]))
    assert as_set(again.plain) == {("a", 30.0)}


def test_union_of_traces_is_what_passed_the_filters(sales):
    f = sales.filter(F.col("price") > 6).agg(["shop"], n=(F.count(F.lit(1)), []))
    assert as_set(f.trace_ids()["sales"]) == {(1,), (2,), (4,), (6,)}


def test_global_aggregate(sales):
    total = sales.agg([], total=(F.sum("price"), ["price"]))
    assert total.plain.first()["total"] == 143.0
    assert total.trace_ids()["sales"].count() == 6
    assert total.trace_ids(F.col("total") < 0)["sales"].count() == 0


def test_distinct_counts_contributors(sales):
    d = sales.select("shop").distinct()
    assert as_set(d.edge_counts()) == {("a", 2), ("b", 2), ("c", 1), (None, 1)}


def test_sample_share_is_clipped(sales):
    assert sales.sample(5.0, 1).df.count() == 6


def test_actions(sales):
    f = sales.sort(F.asc("id")).select("price")
    assert f.count() == 6 and f.limit(2).count() == 2
    assert [tuple(r) for r in f.take(2)] == [(10.0,), (20.0,)]
    assert [tuple(r) for r in f.take(1, lineage=True)] == [(10.0, "1")]


def test_count_as_is_part_of_the_aggregate(sales):
    f = sales.agg(["shop"], count_as="n", total=(F.sum("price"), ["price"]))
    assert as_set(f.plain.select("shop", "n")) == as_set(f.edge_counts())


def test_retag_starts_afresh(sales):
    f = sales.agg(["shop"], total=(F.sum("price"), ["price"])).retag("totals", ["shop"])
    assert list(f.sources) == ["totals"]
    assert f.reads("total") == {("totals", "total")}


def test_pandas_udf_with_declared_inputs(sales):
    @F.pandas_udf("double")
    def plus_one(s: pd.Series) -> pd.Series:
        return s + 1

    f = sales.derive("more", plus_one("price"), ["price"]).select("more")
    assert (6.0, "3") in as_set(f.with_lineage())
    assert f.reads("more") == {("sales", "price")}


def test_cells_are_edges_times_columns(sales, shops):
    j = sales.join(shops, [("shop", "name")]).agg(["area"], total=(F.sum("price"), ["price"]))
    cells = as_set(j.cells("total", flagged=F.col("area") == "south"))
    assert cells == {("sales", "price", "6")}
    assert as_set(j.touched()) == {("sales", "price"), ("shops", "area")}


def test_tracking_does_not_change_the_plan_of_the_result(sales, shops):
    """Edges stay lazy: the traced result reads each source once."""
    j = sales.join(shops, [("shop", "name")]).agg(["area"], total=(F.sum("price"), ["price"]))
    plan = j.plain._jdf.queryExecution().optimizedPlan().toString()
    assert "__sales__id" not in plan


@pytest.fixture
def measured(rows):
    data = [(i, "g", float(v)) for i, v in enumerate([5, 1, 9, 9, -20, 3])] + [(10, "h", 2.0), (11, "h", 2.0)]
    return tag(rows(data, "id long, k string, v double"), "m", ["id"])


@pytest.mark.parametrize(
    "rule, kept",
    [
        (lambda v: I.everything(), {0, 1, 2, 3, 4, 5, 10, 11}),
        (lambda v: I.largest(v), {2, 10}),
        (lambda v: I.smallest(v), {4, 10}),
        (lambda v: I.top_n(v, 2), {2, 3, 10, 11}),
        (lambda v: I.bottom_n(v, 2), {4, 1, 10, 11}),
        (lambda v: I.abs_top_n(v, 1), {4, 10}),
        (lambda v: I.largest_with_ties(v), {2, 3, 10, 11}),
        (lambda v: I.smallest_with_ties(v), {4, 10, 11}),
        (lambda v: I.keep_if(v > 4), {0, 2, 3}),
        (lambda v: I.outliers(v, 2.0), {4}),
        (lambda v: I.top_n(-v, 1), {4, 10}),
        (lambda v: I.any_of(I.largest(v), I.smallest(v)), {2, 4, 10}),
        (lambda v: I.any_of(I.keep_if(v > 8), I.keep_if(v < 0)), {2, 3, 4}),
        (lambda v: I.any_of(I.keep_if(v == 3), I.largest(v)), {2, 5, 10}),
    ],
)
def test_influence(measured, rule, kept):
    f = measured.agg(["k"], rule(F.col("v")), total=(F.sum("v"), ["v"]))
    assert {int(r["m_rid"]) for r in f.edges().collect()} == kept
    assert as_set(f.plain) == {("g", 7.0), ("h", 4.0)}
