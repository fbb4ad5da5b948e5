"""Cases that once gave wrong answers."""

import pytest
from pyspark.sql import functions as F

from whence import tag
from whence.functions import scalars as S
from whence.functions.hashing import coin
from whence.operators import perturb as P


@pytest.mark.parametrize("share", [1e-5, 4e-4, 0.05, 1.0])
def test_small_shares(spark, share):
    n = 1_000_000
    found = spark.range(n).filter(coin(F.col("id"), "s", share)).count()
    assert abs(found - n * share) <= 5 * (n * share) ** 0.5 * (share < 1)


def test_group_key_named_all(rows):
    frame = tag(rows([(1, 1), (2, 2), (3, 3)], "k int, all int"), "t", ["k"]).agg(["all"], n=(F.count(F.lit(1)), []))
    assert sorted(r.k for r in frame.trace_ids()["t"].collect()) == [1, 2, 3]


def test_group_key_named_like_an_id(rows):
    frame = tag(rows([(1, 1), (2, 2), (3, 2)], "k int, a_rid int"), "t", ["k"]).agg(["a_rid"], n=(F.count(F.lit(1)), []))
    assert sorted((r.a_rid, r.n_rows) for r in frame.edge_counts().collect()) == [(1, 1), (2, 2)]


def test_null_is_no_number(rows):
    found = P.infer_category(rows([(1, None), (2, None)], "a int, b int"))
    assert {tuple(r) for r in found.collect()} == {("a", "numerical"), ("b", "other")}


def test_copies_need_room(rows):
    with pytest.raises(ValueError):
        P.duplicate_rows(rows([("x",)], "rid string"), 0.5, 1)


def test_whole_amounts(spark):
    assert spark.range(1).select(S.parse_currency(F.lit("$123456"))).first()[0] == 123456
