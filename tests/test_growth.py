"""Steps whose cost once grew faster than the tables, or that wrote more than they had to."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tests.test_codependence import components
from whence.functions import scalars as S
from whence.operators import codependence as C
from whence.operators import influence as I
from whence.operators import perturb as P
from whence.operators.frame import tag
from whence.plans.tracked import box_overlaps
from whence.sources import numbering
from whence.sources.tables import Tables

CELLS = "group_id string, op string, ds string, col string, rid string"


@pytest.fixture
def written(monkeypatch):
    """Rows and columns of every table that the co-dependence operators write."""
    sizes, write = [], C.durable

    def counted(df):
        table = write(df)
        sizes.append((table.count(), table.columns))
        return table

    monkeypatch.setattr(C, "durable", counted)
    return sizes


# -- merged groups -----------------------------------------------------------------------


def test_cells_of_merged_groups_are_written_once(rows, written):
    """Only groups go through the rounds, however many cells they have."""
    data = [(f"g{i // 50}", "==", "t", "k", f"{i:04d}") for i in range(1000)]
    data += [("g0", "==", "t", "k", "0999")]
    merged = C.merge_overlaps(rows(data, CELLS))
    assert merged.count() == 1000
    assert merged.where("component = '0000|k|t'").count() == 100
    assert sum(n for n, _ in written) < 1200


def test_merged_groups_against_brute_force(rows):
    """Cells in many groups, groups without an id, repeated cells, and other operators."""
    rng = random.Random(4)
    data = [(rng.choice([None, "", *map(str, range(12))]), "==", "t", rng.choice("ab"), str(rng.randrange(60))) for _ in range(70)]
    data += data[:9] + [("0", ">=", "t", "a", str(i)) for i in range(60)]
    equal = {(g, r) for g, op, _, _, r in data if op == "=="}
    edges = [(("row", r), ("group", str(g) if g is not None else "none")) for g, r in equal]
    root = dict(components(edges))
    found = {}
    for g, r in equal:
        found.setdefault(root.get(("row", r), ("row", r)), set()).add(r)
    want = {(min(f"{r}|t" for r in rs), "t", r) for rs in found.values() for r in rs}
    assert as_set(C.merge_overlaps(rows(data, CELLS), unit=("ds", "rid"))) == want


# -- checked arithmetic ------------------------------------------------------------------


@pytest.mark.parametrize("kind, bits", S.INTEGER_BITS.items())
def test_checked_results_at_the_ends(rows, kind, bits):
    """No operation is tried that may fail: a failure costs an exception per row."""
    top, root = 2 ** (bits - 1) - 1, 2 ** (bits // 2) // 2
    values = [0, 1, -1, 2, -2, 3, -3, top, -top - 1, top - 1, -top, top // 2, top // 2 + 1, -(top // 2) - 1, root, -root, 2 * root - 1, None]
    pairs = rows([(a, b) for a in values for b in values], f"a {kind}, b {kind}")
    found = pairs.select("a", "b", *[S.checked(op, "a", "b", kind).alias(n) for op, n in zip("+-*", "sdp")])
    assert [t for _, t in found.dtypes] == [kind] * 5
    assert "try_" not in str(found._jdf.queryExecution().analyzed())
    fits = lambda v: v if -top - 1 <= v <= top else None
    for a, b, *got in found.collect():
        assert got == ([None] * 3 if None in (a, b) else [fits(a + b), fits(a - b), fits(a * b)]), (a, b)


# -- trackers ------------------------------------------------------------------------------


def kept_ends(mine, n):
    """Rows (v, id) kept of one key; a row may come twice."""
    if len(mine) <= 2 * n:
        return sorted(mine, key=str)
    known = [r for r in mine if r[0] is not None]
    up, down = sorted(known), sorted(known, key=lambda r: (-r[0], r[1]))
    return sorted({*up[:n], *down[:n]}, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_extremes_of_small_and_large_groups(spark, parts):
    """Which rows stay depends on the whole group, not on how its rows are dealt; no row costs a call."""
    rng = random.Random(parts)
    data = [(k, rng.choice([None, *range(6)]), i) for k in [None, *range(40)] for i in range(rng.randrange(1, 12))]
    data += [(99, i % 1000, i) for i in range(3000)]
    data += rng.sample(data, 60)
    frame = tag(spark.createDataFrame(data, "k int, v int, id long").repartition(parts), "t", ["id"])
    edges = frame.agg(["k"], I.extremes("v", 2), n=(F.count(F.lit(1)), [])).edges()
    want = [(k, str(i)) for k in {r[0] for r in data} for _, i in kept_ends([r[1:] for r in data if r[0] == k], 2)]
    assert sorted(map(tuple, edges.collect()), key=str) == sorted(want, key=str)
    assert plan(edges).count("MapInArrow") == 2 and "FlatMapGroups" not in plan(edges)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# -- box pairs and changed texts -----------------------------------------------------------


def test_pairs_of_boxes_are_compared_by_numbers(spark, rows, tmp_path):
    """The common box is made of pairs that touch; conditions read its corner without making it."""
    data = [(1, k, 1, k, 5.0, "R") for k in range(1, 9)]
    lines = rows(data, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string")
    lines.withColumn("l_shipdate", F.lit("1999-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    met = box_overlaps(Tables(spark, str(tmp_path))).df.where("cut.x > 100")
    (join,) = [line for line in plan(met).splitlines() if "Join Inner" in line and "other_tx" in line]
    assert join.count("CASE WHEN") == 2
    corner = lambda k: k * 37 + 7
    want = sum(
        corner(a) <= corner(b) + 20 * b and corner(b) <= corner(a) + 20 * a and max(corner(a), corner(b)) > 100
        for a in range(1, 9) for b in range(1, 9)
    )
    assert met.count() == want


def test_changed_texts_are_dealt_and_drawn_once(spark, rows):
    people = rows([(str(i), "some text") for i in range(50)], "rid string, name string").coalesce(1)
    changed = P.perturb(people, ["name"], P.scramble_text())
    assert changed.rdd.getNumPartitions() > 1
    assert plan(changed).count("md5(") == 1


# -- witnesses and contained groups --------------------------------------------------------


def test_witness_rows_travel_as_keys(rows, monkeypatch):
    write, seen = numbering.durable, []
    monkeypatch.setattr(numbering, "durable", lambda df: seen.append(df.columns) or write(df))
    wide = tag(rows([(i, i % 3, "wide", i) for i in range(9)], "id long, k long, note string, price long"), "t", ["id"])
    ids = C.witness_ids(C.group_groups(wide, ["k"], "k"), 2)
    assert as_set(C.row_map(ids, wide.sources)) == {("t", str(i), i) for i in range(6)}
    assert seen == [["id", "__at"]]
    whole = C.witness_rows(ids, wide.sources["t"])
    assert whole.columns == ["id", "k", "note", "price", "rid", "row"] and whole.count() == 6


def test_cells_of_contained_groups_are_written_twice_at_most(rows, written):
    """Once distinct and once with the sizes of their groups; lists of cells are written once."""
    data = [(f"l{i}", "==", "t", "k", str(10 * i + j)) for i in range(30) for j in range(10)]
    data += [(f"s{i}", "==", "t", "k", str(10 * i + j)) for i in range(30) for j in range(4)]
    assert as_set(C.drop_subsets(rows(data, CELLS)).select("group_id").distinct()) == {(f"l{i}",) for i in range(30)}
    assert sum(n == len(data) for n, _ in written) == 2
    assert sum("cells" in columns for _, columns in written) == 1
