"""Traces: what they read, roles, outer joins, the edge index, and draws that stay the same."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence import tag
from whence.operators import trace
from whence.plans import load
from whence.plans.registry import QUERIES
from whence.sources.tables import Tables

load()
SMALL = "/root/testdata/sf0.001"


def scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"(?:FileScan|Scan ExistingRDD|BatchScan|LocalTableScan)", plan))


@pytest.fixture
def counted(monkeypatch):
    """Counts the scans of every relation that a trace writes."""
    seen = []
    real = trace.durable

    def durable(df):
        seen.append(scans(df))
        return real(df)

    monkeypatch.setattr(trace, "durable", durable)
    return seen


@pytest.mark.parametrize("name, most", [("traced_q19", 12), ("traced_share", 12), ("trace_back_join", 6), ("traced_delays", 6)])
def test_scans_of_a_trace(spark, counted, name, most):
    """All of them: those of the written relations and those of the result."""
    found = QUERIES[name].build(Tables(spark, SMALL))
    assert sum(counted) + scans(found) <= most


@pytest.fixture
def places(rows):
    return rows([("a", 1, 10), ("b", 2, 20)], "code string, lat int, lon int")


def test_cells_of_a_source_in_two_roles(rows, places):
    start = tag(places, "places", ["code"], role="start").select("code", "lat").rename({"code": "c1", "lat": "lat1"})
    end = tag(places, "places", ["code"], role="end").select("code", "lon").rename({"code": "c2", "lon": "lon2"})
    trips = tag(rows([(1, "a", "b")], "id long, f string, t string"), "trips", ["id"])
    joined = trips.join(start, [("f", "c1")]).join(end, [("t", "c2")])
    assert as_set(joined.cells("lat1", "lon2")) == {("places", "lat", "a"), ("places", "lon", "b")}
    assert as_set(joined.touched("lat1", "lon2")) == {("places", "lat"), ("places", "lon")}


@pytest.fixture
def shops(rows):
    sales = tag(rows([(1, "a", 5), (2, "b", 7), (3, None, 9)], "id long, shop string, n int"), "sales", ["id"])
    names = tag(rows([("a", "north"), ("c", "south")], "name string, area string"), "shops", ["name"])
    return sales, names


def test_left_join(shops):
    sales, names = shops
    joined = sales.join(names, [("shop", "name")], "left").select("n", "area")
    assert as_set(joined.with_lineage()) == {(5, "north", "1", "a"), (7, None, "2", None), (9, None, "3", None)}
    assert as_set(joined.trace_ids()["shops"]) == {("a",)}
    assert as_set(joined.agg(["area"], n=(F.sum("n"), ["n"])).trace_ids(F.col("area").isNull())["sales"]) == {(2,), (3,)}
    assert as_set(joined.agg(["area"], n=(F.sum("n"), ["n"])).trace_ids(F.col("area").isNull())["shops"]) == set()


def test_left_join_with_an_aggregate(shops):
    """A group without a name is a group; a row without a group has none."""
    sales, names = shops
    totals = sales.agg(["shop"], total=(F.sum("n"), ["n"])).rename({"shop": "of"})
    joined = names.join(totals, [("name", "of")], "left").select("name", "total")
    assert as_set(joined.trace_ids()["sales"]) == {(1,)}
    assert as_set(totals.trace_ids(F.col("of").isNull())["sales"]) == {(3,)}


def test_semi_and_anti_joins_filter(shops):
    sales, names = shops
    assert as_set(sales.join(names, [("shop", "name")], "left_semi").select("n").with_lineage()) == {(5, "1")}
    assert as_set(sales.join(names, [("shop", "name")], "left_anti").select("n").with_lineage()) == {(7, "2"), (9, "3")}
    with pytest.raises(ValueError, match="inner, left"):
        sales.join(names, [("shop", "name")], "full")


def test_condition_on_keys_alone(shops):
    sales, _ = shops
    totals = sales.agg(["shop"], total=(F.sum("n"), ["n"]))
    assert trace.by_key_alone(totals, F.col("shop") == "a")
    assert not trace.by_key_alone(totals, F.col("total") > 5)
    assert not trace.by_key_alone(totals.filter(F.col("total") > 5), F.col("shop") == "a")
    renamed = totals.rename({"shop": "s"}).derive("total", F.lit(1))
    assert as_set(renamed.trace_ids(F.col("s") == "a")["sales"]) == {(1,)}
    other = totals.derive("shop", F.lit("a"))
    assert as_set(other.trace_ids(F.col("shop") == "a")["sales"]) == {(1,), (2,), (3,)}


def test_index_gives_the_same_trace(spark, rows, counted):
    sales = tag(rows([(i, i % 7 if i % 5 else None, i % 3) for i in range(100)], "id long, k int, j int"), "sales", ["id"])
    groups = sales.agg(["k", "j"], n=(F.count(F.lit(1)), []))
    top = groups.agg(["j"], most=(F.max("n"), ["n"]))
    flagged = F.col("most") > 4
    want = as_set(top.trace_ids(flagged)["sales"])
    indexed = top.indexed(8)
    assert as_set(indexed.trace_ids(flagged)["sales"]) == want
    assert indexed.legs[0].step.bucketed and indexed.legs[0].step.legs[0].step.bucketed
    plan = indexed.trace_ids(flagged)["sales"]._jdf.queryExecution().executedPlan().toString()
    assert "edges_" in plan or "Scan parquet" in plan


def test_large_pointer_sets_filter_the_scan(spark):
    """Beyond a broadcast, Spark sends a Bloom filter of the wanted pointers to the scan of the edges."""
    keep = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    old = {k: spark.conf.get(k, None) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        orders = Tables(spark, SMALL).tagged("orders").agg(["o_custkey"], total=(F.sum("o_totalprice"), ["o_totalprice"]))
        ids = orders.trace_ids(F.col("total") > 2_000_000)["orders"]
        plan = ids._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in plan or "bloom" in plan.lower()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_limit_is_traced_as_it_was(rows):
    frame = tag(rows([(i, i) for i in range(50)], "id long, v int"), "t", ["id"]).limit(5)
    assert as_set(frame.trace_ids()["t"]) == {(r["id"],) for r in frame.plain.collect()}


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 4.5])
def test_draw_with_replacement(spark, mean):
    frame = tag(spark.range(20_000), "t", ["id"]).sample(mean, 4, replacement=True)
    drawn = frame.plain.groupBy("id").count().collect()
    n = sum(r["count"] for r in drawn)
    assert abs(n - 20_000 * mean) <= 5 * (20_000 * mean) ** 0.5
    assert {r["id"] for r in drawn} == {r["id"] for r in frame.trace_ids()["t"].collect()}
    if mean == 1.0:
        once = sum(r["count"] == 1 for r in drawn) / 20_000
        assert abs(once - 0.3679) < 0.02


def test_exact_sample(spark):
    frame = tag(spark.range(1000).repartition(7), "t", ["id"])
    chosen = as_set(frame.take_sample(50, 1).plain)
    assert len(chosen) == 50 and chosen == as_set(frame.take_sample(50, 1).trace_ids()["t"])
    assert chosen != as_set(frame.take_sample(50, 2).plain)
    assert frame.take_sample(5000, 1).count() == 1000


def test_winner_of_least(rows):
    f = tag(rows([(1, 5, 3), (2, 2, 2)], "id long, a int, b int"), "t", ["id"]).winner("low", "from", "a", "b", least=True)
    assert as_set(f.plain.select("low", "from")) == {(3, "t.b"), (2, "t.a")}
