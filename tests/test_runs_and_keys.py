"""Comparison of runs, permuted keys, long lists, numbered text, combiners."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence import tag
from whence.functions import mutations as M
from whence.functions import scalars as S
from whence.functions.hashing import permuted
from whence.operators import codependence as C
from whence.operators import compare as D
from whence.operators import influence as I
from whence.operators import perturb as P
from whence.operators.combine import Combiner, combined
from whence.operators.frame import Source
from whence.plans.skew import bounded_lists
from whence.session import scratch_dir
from whence.sources.text import read_numbered, tag_lines

# -- runs ------------------------------------------------------------------------------


def test_types_tell_outputs_apart(rows):
    assert not D.same_output(rows([(1,)], "v int"), rows([("1",)], "v string"))
    assert D.same_output(rows([(1,), (2,)], "v int"), rows([(2,), (1,)], "v int"))


def test_runs(spark, rows):
    a = rows([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "k int, v string")
    equal = D.compare_runs(spark, a, lambda: a.repartition(3), ["k"]).first()
    assert tuple(equal) == ("equal", "", 4, 4, 0, 0, 0)
    b = rows([(1, "x"), (2, "y"), (3, "n"), (None, None)], "k int, v string")
    assert tuple(D.compare_runs(spark, a, b, ["k"]).first()) == ("rows", "", 4, 4, 0, 1, 2)
    found = {r["k"]: (r["status"], r["n_a"], r["n_b"]) for r in D.diff_rows(a, b, ["k"]).collect()}
    assert found == {2: ("changed", 1, 0), 3: ("only_b", 0, 1), None: ("changed", 1, 1)}
    typed = D.compare_runs(spark, a, rows([("1", "x", 1)], "k string, v string, w int"), ["k"]).first()
    assert (typed["status"], typed["columns"], typed["rows_b"]) == ("schema", "k,w", 1)


def test_runs_that_fail(spark, rows):
    good = rows([(1,)], "k int")
    bad = good.select(F.raise_error(F.lit("no")).cast("int").alias("k"))

    def missing():
        return good.select("nothing")

    assert D.compare_runs(spark, good, bad, ["k"]).first()["status"] == "failed b"
    assert D.compare_runs(spark, missing, good, ["k"]).first()["status"] == "failed a"
    assert D.compare_runs(spark, missing, bad, ["k"]).first()["status"] == "failed both"


def test_only_ranges_that_differ_are_compared(spark):
    a = spark.range(50_000).withColumn("v", F.col("id") * 3)
    b = a.withColumn("v", F.when(F.col("id") == 777, 0).otherwise(F.col("v")))
    assert D.differing_leaves(a, b, ["id"]).count() == 1
    assert [tuple(r) for r in D.diff_rows(a, b, ["id"]).collect()] == [(777, "changed", 1, 1)]
    assert D.differing_leaves(a, a.repartition(5), ["id"]).count() == 0


def test_a_key_on_one_side_differs_in_every_column(rows):
    a, b = rows([(1, 1, 1), (2, 2, 2)], "k int, v int, w int"), rows([(1, 1, 5), (3, 2, 2)], "k int, v int, w int")
    assert as_set(D.diff_columns(a, b, ["k"])) == {("v", 2), ("w", 3)}


# -- keys ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 1009])
def test_permutation(spark, n):
    found = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 5)).collect()]
    assert sorted(found) == list(range(n))
    if n >= 1000:
        assert sum(i == x for i, x in enumerate(found)) < 15
        assert found != [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 6)).collect()]


KINDS = {
    "text": (lambda i: f"key<{i}>", "string"), "large": (lambda i: 10**12 + i * 2**31, "long"),
    "negative": (lambda i: -(2**63) + i, "long"), "decimal": (lambda i: i * 10**25, "decimal(38,0)"),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_permuted_keys_keep_the_join(spark, rows, kind):
    from decimal import Decimal

    make, type_ = KINDS[kind]
    key = (lambda i: Decimal(make(i))) if kind == "decimal" else make
    a = [(i, None if i == 7 else key(i % 50)) for i in range(200)]
    b = [(i, key(0 if i < 120 else i % 80)) for i in range(200)]
    left = tag(rows(a, f"id long, k {type_}"), "a", ["id"])
    right = tag(rows(b, f"oid long, j {type_}"), "b", ["oid"])
    relation = C.join_groups(left, right, ("k", "j"), "k", None)
    out = P.permute_consistently({"a": (left.sources["a"], ["k"]), "b": (right.sources["b"], ["j"])}, relation, 2)
    x, y = out["a"], out["b"]
    before = left.df.join(right.df, F.col("k") == F.col("j")).count()
    assert x.join(y, F.col("new_k") == F.col("new_j")).count() == before
    assert x.schema["new_k"].dataType == left.df.schema["k"].dataType
    assert x.where("k <> new_k").count() > 100 and x.where("k IS NULL AND new_k IS NULL").count() == 1
    assert x.select("k").distinct().count() == x.select("new_k").distinct().count()
    assert x.count() == y.count() == 200
    shared = {r[0] for r in left.df.select("k").collect()} & {r[0] for r in right.df.select("j").collect()}
    assert all((r["j"] in shared) or r["j"] == r["new_j"] for r in y.collect())


def test_compound_keys(rows):
    a = Source("a", rows([(i, i % 5, str(i % 3)) for i in range(60)], "id long, p int, q string"), ("id",))
    b = Source("b", rows([(i, i % 4, str(i % 7)) for i in range(60)], "id long, p int, q string"), ("id",))
    pairs = a.df.select("p", "q").intersect(b.df.select("p", "q"))
    parts = [s.df.join(pairs, ["p", "q"]).selectExpr("'x' AS group_id", "'==' AS op", f"'{s.name}' AS ds", "'p' AS col", "cast(id as string) AS rid") for s in (a, b)]
    out = P.permute_consistently({"a": (a, ["p", "q"]), "b": (b, ["p", "q"])}, parts[0].unionByName(parts[1]), 1)
    before = a.df.join(b.df, ["p", "q"]).count()
    assert out["a"].join(out["b"], ["new_p", "new_q"]).count() == before > 0
    assert out["a"].select("new_p", "new_q").distinct().count() == a.df.select("p", "q").distinct().count()


def test_keys_of_any_kind_are_changed(spark):
    found = spark.range(300).select(
        M.consistent_key(F.lit(2**31) + F.col("id"), F.concat(F.lit("g"), F.col("id"))).alias("large"),
        M.consistent_key(F.concat(F.lit("k"), F.col("id")), F.concat(F.lit("g"), F.col("id"))).alias("text"),
    )
    assert found.select("large").distinct().count() == found.select("text").distinct().count() == 300


@pytest.mark.parametrize(
    "text", ["9" * 18, "9" * 20, "123456789012345678901234", "-" + "9" * 25, "9" * 36, "9" * 37, "1" * 60, "-" + "7" * 50, "+5", str(2**63 - 1)]
)
def test_long_numbers_are_changed_not_lost(spark, text):
    got = spark.range(1).select(M.offset_number(F.lit(text), F.lit(2**31 - 2).cast("bigint"))).first()[0]
    if len(text) <= M.WHOLE_DIGITS:
        assert int(got) == int(text) + 2**31 - 2
    else:
        assert len(got) == len(text) and got[:-18] == text[:-18] and int(got[-18:]) == (int(text[-18:]) + 2**31 - 2) % 10**18


# -- lists -----------------------------------------------------------------------------


@pytest.mark.parametrize("size, list_rows", [(10_001, 10_000), (10_000, 10_000), (60_000, 7000), (3, 1)])
def test_parts_of_a_list_are_contiguous(spark, size, list_rows):
    df = spark.range(size + 500).select(
        "id", F.when(F.col("id") < size, "hot").when(F.col("id") % 9 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("k")
    )
    lists = bounded_lists(df, ["k"], -F.col("id"), ["id"], list_rows=list_rows)
    hot = sorted((r["part"], r["items"]) for r in lists.where("k = 'hot'").collect())
    assert [p for p, _ in hot] == list(range(-(-size // list_rows)))
    assert all(len(items) == list_rows for _, items in hot[:-1])
    assert [i for _, items in hot for i in items] == [-i for i in range(size - 1, -1, -1)]
    assert lists.select(F.sum(F.size("items"))).first()[0] == size + 500


# -- text ------------------------------------------------------------------------------


def test_line_numbers_do_not_depend_on_splits(spark):
    path = scratch_dir(spark, "numbered")
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(path)
    found = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4k", "50k", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(as_set(read_numbered(spark, path)))
    assert found[0] == found[1] == found[2]
    assert sorted(n for _, n in found[0]) == list(range(5000)) and {x for x, _ in found[0]} == set(lines)
    traced = tag_lines(spark, path, "t").filter(F.col("value").startswith("line 7 ")).trace_ids()["t"]
    assert traced.count() == 1


# -- combiners and trackers ------------------------------------------------------------


def test_combiner_is_the_same_under_any_partitioning(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", None, "b", "hot", "hot", "hot"]), rng.randint(0, 99), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, id long")
    best = Combiner(
        add=lambda s, rows: max(rows.column("v").to_pylist() + ([s] if s is not None else [])),
        merge=max, result=lambda s: {"most": [s]}, schema="most int",
    )
    want = {(k, max(v for x, v, _ in data if x == k)) for k in {x for x, _, _ in data}}
    for n in (1, 3, 17):
        assert as_set(combined(df.repartition(n), ["k"], ["v"], best)) == want
    assert combined(df.limit(0), ["k"], ["v"], best).count() == 0


def test_tracker_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", None, "b"]), None if i % 50 == 0 else rng.randint(0, 9), i) for i in range(400)]
    frame = tag(spark.createDataFrame(data, "k string, v int, id long").repartition(9), "t", ["id"])
    edges = frame.agg(["k"], I.extremes("v", 3), n=(F.count(F.lit(1)), [])).edges()
    want = set()
    for k in ("a", None, "b"):
        mine = [(v, i) for x, v, i in data if x == k and v is not None]
        want |= {(k, str(i)) for _, i in sorted(mine)[:3]} | {(k, str(i)) for _, i in sorted(mine, key=lambda r: (-r[0], r[1]))[:3]}
    assert as_set(edges) == want


def test_combined_frame_is_traced(rows):
    frame = tag(rows([(1, "a", 2), (2, "a", 3), (3, "b", 9)], "id long, k string, v int"), "t", ["id"])
    total = Combiner(
        add=lambda s, rows: (s or 0) + sum(rows.column("v").to_pylist()), merge=lambda a, b: a + b,
        result=lambda s: {"total": pa.array([s], pa.int64())}, schema="total bigint",
    )
    sums = frame.combine(["k"], ["v"], total)
    assert as_set(sums.plain) == {("a", 5), ("b", 9)}
    assert as_set(sums.trace_ids(F.col("total") > 5)["t"]) == {(3,)}
    assert sums.reads("total") == {("t", "v")}


# -- scalars ---------------------------------------------------------------------------


@pytest.mark.parametrize("a, b", [(2**53 + 1, 1), (-7, 2), (7, -2), (-8, 2), (2**63 - 1, 3), (-(2**63), 7), (5, 0)])
def test_floor_division(spark, a, b):
    got = spark.range(1).select(S.floor_div(F.lit(a).cast("bigint"), F.lit(b))).first()[0]
    assert got == (a // b if b else None)


def test_checked_arithmetic(spark):
    least = F.lit(-(2**31))
    found = spark.range(1).select(S.checked("+", F.lit(2**31 - 1), F.lit(1)), S.checked("*", F.lit(3), F.lit(4)), S.negated(least)).first()
    assert tuple(found) == (None, 12, None)
    with pytest.raises(Exception, match="int overflow in"):
        spark.range(1).select(S.negated(least, strict=True)).collect()
