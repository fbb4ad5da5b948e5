"""Normal form, components and witnesses against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence import tag
from whence.operators import codependence as C
from whence.plans import load
from whence.plans.registry import QUERIES
from whence.sources.tables import Tables

load()


def relation(rows, groups, op="=="):
    """{group: [cells]} with a cell written as one letter or number."""
    data = [(g, op, "d", "c", str(cell)) for g, cells in groups.items() for cell in cells]
    return rows(data, "group_id string, op string, ds string, col string, rid string")


def survivors(groups):
    sets = {g: frozenset(map(str, cells)) for g, cells in groups.items()}
    first = {}
    for g in sorted(sets):
        first.setdefault(sets[g], g)
    kept = {g: s for s, g in first.items()}
    return {g for g, s in kept.items() if not any(s < other for other in kept.values())}


@pytest.mark.parametrize("seed", range(3))
def test_drop_subsets_matches_brute_force(rows, seed):
    rnd = random.Random(seed)
    groups = {f"g{i}": rnd.sample(range(12), rnd.randint(1, 6)) for i in range(40)}
    out = C.drop_subsets(relation(rows, groups))
    assert {r["group_id"] for r in out.select("group_id").distinct().collect()} == survivors(groups)


def test_many_copies_of_a_group_leave_one(rows):
    groups = {f"g{i:03d}": ["a", "b"] for i in range(60)} | {"z": ["a", "b", "c"], "y": ["q"]}
    out = C.drop_subsets(relation(rows, groups))
    assert as_set(out.select("group_id").distinct()) == {("z",), ("y",)}


def test_only_transitive_operators_absorb(rows):
    small = relation(rows, {"s": [1]})
    large = relation(rows, {"l": [1, 2]}, ">=")
    both = C.consolidate(small, large)
    assert as_set(C.drop_subsets(both).select("group_id").distinct()) == {("l",)}
    assert as_set(C.drop_subsets(both, ["=="]).select("group_id").distinct()) == {("l",), ("s",)}


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(n, find(n)) for n in parent if find(n) != n}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_connected_components(rows, shape):
    rnd = random.Random(5)
    name = lambda i: f"n{i:04d}"
    if shape == "chain":
        order = list(range(200))
        rnd.shuffle(order)
        pairs = list(zip(order, order[1:]))
    elif shape == "star":
        pairs = [(150, i) for i in range(150)] + [(300, i) for i in range(151, 300)]
    else:
        pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    edges = [(name(max(p)), name(min(p))) for p in pairs if p[0] != p[1]]
    out = C.connected_components(rows(edges, "a string, b string"), 30)
    assert as_set(out) == components(edges)


def test_merge_overlaps_is_a_partition_of_cells(rows):
    groups = {"a": [1, 2], "b": [2, 3], "c": [7], "d": [8, 9], "e": [9, 1]}
    merged = C.merge_overlaps(relation(rows, groups))
    assert merged.count() == len({c for g in groups.values() for c in g})
    by = {}
    for r in merged.collect():
        by.setdefault(r["component"], set()).add(r["rid"])
    assert sorted(map(sorted, by.values())) == [["1", "2", "3", "8", "9"], ["7"]]


@pytest.fixture
def people(rows):
    c = tag(rows([(1, "x"), (2, "y"), (3, "z")], "cid long, name string"), "people", ["cid"])
    o = tag(rows([(i, 1 + i % 2, i * 10) for i in range(8)], "oid long, owner long, price long"), "buys", ["oid"])
    return c, o


def test_join_groups_only_hold_keys_on_both_sides(people):
    c, o = people
    whole = C.join_groups(c, o, ("cid", "owner"), "k", None)
    assert {r["group_id"] for r in whole.collect()} == {"k:1", "k:2"}
    assert whole.where("ds = 'buys'").count() == 8
    capped = C.join_groups(c, o, ("cid", "owner"), "k", 2)
    assert as_set(capped.where("ds = 'buys'").select("rid")) == {("0",), ("1",), ("2",), ("3",)}


def test_predicate_and_gte_witness(people):
    _, o = people
    cells = C.predicate_cells(o, F.col("price") > 50, ["price", "owner"], "p")
    assert as_set(cells.select("col", "rid")) == {(c, r) for c in ("price", "owner") for r in ("6", "7")}
    first = C.gte_witness(o, "price", "owner", "g")
    assert as_set(first.select("op", "col", "rid")) == {(">=", "owner", "1"), (">=", "price", "1")}


def test_witnesses_are_renumbered_without_gaps(people):
    c, o = people
    relation = C.join_groups(c, o, ("cid", "owner"), "k", 2)
    sources = {"people": c.sources["people"], "buys": o.sources["buys"]}
    moves = C.row_map(C.witness_ids(relation, 2), sources)
    assert as_set(moves) == {
        ("people", "1", 0), ("people", "2", 1), ("buys", "0", 0), ("buys", "1", 1), ("buys", "2", 2), ("buys", "3", 3)
    }
    moved = C.remap(relation, moves)
    assert moved.count() == relation.count()
    assert C.row_level(moved).count() == 6


def test_witnesses_are_chosen_from_all_lines(spark, rows, tmp_path):
    """No line item is left out before the choice; ids are ordered as numbers, those that are null last."""
    keys = [(8 + j, supplier, supplier) for supplier in range(1, 21) for j in range(supplier % 5 + 1)]
    keys += [(30, n, 21) for n in (None, 3, 2, 1)] + [(31, n, 22) for n in (None, 1)] + [(32, n, None) for n in (1, 2)]
    lines = rows([(o, n, 5, s) for o, n, s in keys], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines = lines.withColumn("l_shipdate", F.lit("1999-01-01").cast("timestamp_ntz"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows([(o, 2) for o in (9, 10, 11, 12)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    ordered = sorted(keys, key=lambda k: [(x is None, x or 0) for x in k])
    first = [k for i, k in enumerate(ordered) if sum(k[2] == other[2] for other in ordered[:i]) < 3]
    text = lambda o, n, s: "-".join(str(x) for x in (o, n, 5, s, "1999-01-01") if x is not None)
    want = {("lineitem", text(*k), i) for i, k in enumerate(first)} | {("customer", "2", 0)}
    want |= {("orders", "9", 0), ("orders", "10", 1), ("orders", "11", 2)}
    found = QUERIES["witness_reduce"].build(Tables(spark, str(tmp_path))).select("ds", "rid", "row")
    assert found.count() == len(want) and as_set(found) == want


def test_pick_group_is_one_group(people):
    c, o = people
    relation = C.join_groups(c, o, ("cid", "owner"), "k", None)
    assert C.pick_group(relation, 3).select("group_id").distinct().count() == 1


def subsets(groups):
    return {g for g, cells in groups.items() if any(cells < other for other in groups.values())}


@pytest.mark.parametrize("bound", [0, 4])
def test_subsets_of_frequent_cells(rows, monkeypatch, bound):
    """Groups that share nothing but frequent cells, beside one large group and single cells."""
    monkeypatch.setattr(C, "PAIRS", bound)
    rng = random.Random(8)
    groups = {f"g{i}": frozenset(rng.sample(range(14), rng.randint(1, 11))) for i in range(250)}
    groups |= {"large": frozenset(range(10, 80)), "inside": frozenset(range(20, 45)), "apart": frozenset({99, 3})}
    data = [(g, "==", "t", "c", str(c)) for g, cells in groups.items() for c in cells]
    left = C.drop_subsets(rows(data, "group_id string, op string, ds string, col string, rid string"))
    distinct = {}
    for g, cells in sorted(groups.items()):
        distinct.setdefault(cells, g)
    want = {g for g in distinct.values() if g not in subsets(groups)}
    assert {r["group_id"] for r in left.select("group_id").distinct().collect()} == want


def test_listed_pairs_stay_in_proportion(rows, monkeypatch):
    """All groups share two cells that stand in every group; pairs per cell would grow with the square."""
    listed = []
    real = C._covered
    monkeypatch.setattr(C, "_covered", lambda cells, pairs, others: listed.append(pairs.count()) or real(cells, pairs, others))
    sizes = {}
    for n in (100, 400):
        data = []
        for i in range(n):
            cells = ["all", "every", f"a{i % 10}", f"b{i // 10 % 10}", f"c{i // 100}"]
            data += [(f"g{i}", "==", "t", "c", c) for c in cells]
            data += [(f"s{i}", "==", "t", "c", c) for c in (cells[:2] + cells[3:])]
        listed.clear()
        left = C.drop_subsets(rows(data, "group_id string, op string, ds string, col string, rid string"))
        assert {r[0] for r in left.select("group_id").distinct().collect()} == {f"g{i}" for i in range(n)}
        sizes[n] = listed[-1], len(data)
    assert all(pairs <= C.PAIRS * cells for pairs, cells in sizes.values())
