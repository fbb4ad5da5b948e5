"""The programs' formulas on hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence.functions import scalars as S
from whence.plans.apps import changed_box_overlaps


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("age, label", [(41, "40-65"), (65, "40-65"), (32, "20-39"), (19, "0-19"), (66, ">65")])
def test_age_bracket(spark, age, label):
    assert one(spark, S.age_bracket(F.lit(age))) == label


@pytest.mark.parametrize("d, t, speed, label", [(4100, 78, 52, "car"), (1100, 18, 61, "car"), (100, 5, 20, "public"), (15, 1, 15, "onfoot")])
def test_speed_class(spark, d, t, speed, label):
    value = S.int_div(F.lit(d), F.lit(t))
    assert one(spark, value) == speed
    assert one(spark, S.speed_class(value)) == label


def test_delay_bucket(spark):
    delay = (1748938409 - 1189419654) - (95880023 - 68370870)
    assert delay == 532009602
    assert one(spark, S.delay_bucket(F.lit(delay))) == 295560
    assert one(spark, S.delay_bucket(F.lit(-1799))) == 0
    assert one(spark, S.int_div(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize("text, value", [("1000", 1000), ("$100000", 100000), ("200", 200), ("abc", None), ("$12345", 12345)])
def test_currency(spark, text, value):
    assert one(spark, S.parse_currency(F.lit(text))) == value


def bounded_length(n, bound=30):
    length = 1
    while n != 1 and length < bound:
        n, length = (n // 2 if n % 2 == 0 else 3 * n + 1), length + 1
    return length


def test_collatz(spark):
    df = spark.range(1, 500).select("id", S.collatz_length("id").alias("n"))
    assert as_set(df) == {(n, bounded_length(n)) for n in range(1, 500)}
    found = sorted(r["id"] for r in df.where("n = 25").collect())
    assert found[:5] == [49, 50, 51, 288, 296]
    assert one(spark, S.collatz_length(F.lit(0))) == 0
    assert one(spark, S.collatz_length(F.lit(27))) == 30


@pytest.mark.parametrize("text, value", [("1.5", 1.5), (" 2 ", 2.0), ("", 0.0), (None, 0.0), ("1e3", 1000.0), ("x1", 0.0)])
def test_tolerant_double(spark, text, value):
    assert one(spark, S.to_double_or_zero(F.lit(text))) == value


@pytest.mark.parametrize(
    "line, words",
    [("a b", ["a", "b"]), ("a  b ", ["a", "", "b"]), ("", [""]), ("  ", []), (" a", ["", "a"]), ("a\tb", ["a", "b"])],
)
def test_line_words(spark, line, words):
    assert one(spark, S.line_words(F.lit(line))) == words


def test_haversine(spark):
    # A quarter of the equator.
    miles = one(spark, S.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert miles == pytest.approx(6373.0 * 0.621371 * 3.141592653589793 / 2)


def test_date_interval_is_open(spark):
    inside = lambda d: one(spark, S.date_between(F.lit(d), "1998-01-01", "1998-02-01"))
    assert inside("1998-01-15") and not inside("1998-01-01") and not inside("1998-02-01") and not inside("junk")


def test_compound_growth(spark):
    assert one(spark, S.compound(F.lit(3400.0), F.lit(0.0211), F.lit(40))) == pytest.approx(3400 * 1.0211**40)


def boxes(rows, *data):
    df = rows(list(data), "site string, box_id long, kind string, x long, y long, h long, w long")
    return df.select("site", "box_id", "kind", S.box("x", "y", "h", "w").alias("box"))


def test_box_changes(rows):
    before = boxes(rows, ("s", 1, "a", 0, 0, 10, 10), ("s", 2, "a", 5, 5, 500, 900), ("s", 3, "a", 2000, 0, 1, 1))
    after = boxes(rows, ("s", 1, "a", 2, 0, 10, 10), ("s", 2, "a", 5, 5, 500, 900), ("s", 3, "a", 2000, 0, 1, 1))
    got = as_set(changed_box_overlaps(before, after))
    # Box 1 moved: it meets itself and the large unchanged box, over several tiles but once.
    assert got == {("s", 1, "a", 1, 2, 0, 10, 10), ("s", 1, "a", 2, 5, 5, 5, 7)}


def test_boxes_meet_once_however_many_tiles_they_share(rows):
    before = boxes(rows, ("s", 1, "a", 0, 0, 1000, 1000), ("s", 2, "b", 10, 10, 900, 900))
    after = boxes(rows, ("s", 1, "a", 1, 0, 1000, 1000), ("s", 2, "b", 10, 10, 900, 900))
    assert changed_box_overlaps(before, after).count() == 2
