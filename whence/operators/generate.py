"""Synthetic datasets, made in parallel and repeatable.

A generator maps a table of ids to rows. Every column is a seeded function of
the id alone, so a lost task rebuilds the very same rows and no state passes
between partitions. Ids are ``ids(spark, n)`` or a key column of any table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.functions.hashing import between, digest, draw, pick

# Fixed values of the generated domains.
STATUSES = ("scheduled", "departed", "completed")
BOX_TYPES = ("header", "footer", "body", "advertisement", "sidebar")
SENTENCE = "This is a sentence"
SCREEN = (1920, 1080)
AIRPORTS = 85
INT_MAX = 2**31 - 1

Generator = Callable[[DataFrame, int], DataFrame]


def ids(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, rows, 1, partitions)


def _num(tag: str, low: int, high: int, seed: int) -> Column:
    return between("id", tag, low, high, seed)


def _wide(tag: str, seed: int) -> Column:
    """Non-negative 31-bit integer."""
    return F.conv(F.substr(digest("id", tag, seed), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % INT_MAX


def _unit(tag: str, seed: int) -> Column:
    """Number in [0, 1) with four digits."""
    return draw("id", tag, seed) % 10_000 / 10_000.0


def _letters(tag: str, seed: int, length: int = 10) -> Column:
    text = F.substr(digest("id", tag, seed), F.lit(1), F.lit(length))
    return F.translate(text, "0123456789", "ghijklmnop")


def airport_code(n: Column) -> Column:
    """Three capitals for a number below 26^3."""
    letters = [F.chr(F.lit(65) + F.floor(n / 26**k) % 26) for k in (2, 1, 0)]
    return F.concat(*letters)


def _airport(tag: str, seed: int) -> Column:
    return airport_code(_num(tag, 0, AIRPORTS - 1, seed))


def _minute(tag: str, seed: int) -> Column:
    part = lambda name, low, high: F.lpad(_num(f"{tag}/{name}", low, high, seed).cast("string"), 2, "0")
    return F.concat(
        F.lit("20"), part("y", 15, 22), F.lit("-"), part("mo", 1, 12), F.lit("-"), part("d", 1, 28),
        F.lit(" "), part("h", 0, 23), F.lit(":"), part("mi", 0, 59),
    )


def _zip(tag: str, seed: int) -> Column:
    return _num(tag, 90_000, 90_099, seed)


def airports(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        _airport("code", seed).alias("code"), _letters("name", seed).alias("name"), _letters("city", seed).alias("city"),
        (_unit("lon", seed) * 360 - 180).alias("lon"), (_unit("lat", seed) * 180 - 90).alias("lat"),
        _letters("zone", seed).alias("timezone"),
    )


def flights(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        _num("fid", 0, 99_998, seed).alias("flight_id"),
        F.concat(F.lit("PG"), _num("no", 1000, 9999, seed)).alias("flight_no"),
        _minute("dep", seed).alias("sched_dep"), _minute("arr", seed).alias("sched_arr"),
        _airport("from", seed).alias("dep_airport"), _airport("to", seed).alias("arr_airport"),
        pick("id", "status", STATUSES, seed).alias("status"),
        F.concat(F.lit("CR"), _num("craft", 1, 10, seed)).alias("aircraft"),
    )


def boxes(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        F.concat(F.lit("www."), _letters("url", seed, 2), F.lit(".com")).alias("url"),
        _num("x", 0, SCREEN[0] - 1, seed).alias("x"), _num("y", 0, SCREEN[1] - 1, seed).alias("y"),
        _num("h", 0, SCREEN[1] - 1, seed).alias("height"), _num("w", 0, SCREEN[0] - 1, seed).alias("width"),
        _num("box", 0, 9, seed).alias("box_id"), pick("id", "type", BOX_TYPES, seed).alias("type"),
    )


def customers(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        _num("cid", 0, 998, seed).alias("customer_id"), _letters("name", seed).alias("name"),
        _letters("place", seed).alias("location"),
    )


def orders(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        F.concat(F.lit("order"), _num("oid", 0, 998, seed)).alias("order_id"),
        _num("cid", 0, 998, seed).alias("customer_id"), _wide("time", seed).alias("epoch_s"),
        F.concat(F.lit("item"), _wide("item", seed)).alias("item"),
    )


def stations(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        F.concat(F.lit("trip"), _num("trip", 0, 99_998, seed)).alias("trip_id"),
        _wide("time", seed).alias("time"), _wide("due", seed).alias("advertised"),
        F.concat(F.lit("route"), _num("route", 0, 99, seed)).alias("route"),
    )


def ages(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        _zip("zip", seed).alias("zip"), _num("age", 0, 100, seed).alias("age"), _num("income", 0, 9999, seed).alias("income")
    )


def income(base: DataFrame, seed: int = 0) -> DataFrame:
    return ages(base, seed + 1)


def trips(base: DataFrame, seed: int = 0) -> DataFrame:
    """Distance follows the zip gap, time follows a drawn speed, at least 1."""
    gap = F.abs(F.col("from_zip") - F.col("to_zip"))
    # Slow trips are sped up by 10 for 99 of 100 draws.
    lift = F.when((F.col("v") <= 10) & (_zip("lift", seed) % 100 != 1), 10).otherwise(0)
    rows = base.select("id", _zip("from", seed).alias("from_zip"), _zip("to", seed).alias("to_zip"), _num("v", 3, 72, seed).alias("v"))
    rows = rows.withColumn("distance", gap * 100 + _num("extra", 0, 9, seed)).withColumn("speed", F.col("v") + lift)
    time = F.greatest(F.floor(F.col("distance") / F.col("speed")), F.lit(1))
    return rows.select(F.lit("sr").alias("mode"), "from_zip", "to_zip", "distance", time.alias("time"))


def deliveries(base: DataFrame, seed: int = 0) -> DataFrame:
    named = lambda prefix: F.concat(F.lit(prefix), _num(prefix, 0, 99_998, seed))
    return base.select(
        named("dlvry").alias("delivery_id"), named("cust").alias("customer"), named("vend").alias("vendor"),
        _num("rating", 1, 5, seed).alias("rating"),
    )


def salaries(base: DataFrame, seed: int = 0) -> DataFrame:
    amount = _num("salary", 100, 999_999, seed)
    dollar = F.when((amount > 99_999) & (draw("id", "dollar", seed) % 2 == 0), "$").otherwise("")
    return base.select(F.concat(dollar, amount.cast("string")).alias("salary"))


def circles(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        _num("x", 1, 100, seed).alias("x"), _num("y", 1, 100, seed).alias("y"), _num("r", 1, 2000, seed).alias("r")
    )


def loans(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(
        _num("principal", 1000, 9999, seed).alias("principal"), _num("years", 10, 50, seed).alias("years"),
        _unit("rate", seed).alias("rate"), _letters("name", seed).alias("name"),
    )


def ratings(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(_letters("title", seed).alias("title"), _num("rating", 0, 100, seed).alias("rating"))


def numbers(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(_num("n", 1, 500, seed).alias("n"), _num("m", 1, 500, seed).alias("m"))


def grades(base: DataFrame, seed: int = 0) -> DataFrame:
    course = F.concat(F.lit("CS"), _num("course", 100, 700, seed))
    return base.select(course.alias("course"), _num("score", 0, 100, seed).alias("score"))


def sentences(base: DataFrame, seed: int = 0) -> DataFrame:
    return base.select(F.lit(SENTENCE).alias("line"))


GENERATORS: dict[str, Generator] = {
    f.__name__: f
    for f in (
        airports, flights, boxes, customers, orders, stations, ages, income, trips, deliveries, salaries, circles,
        loans, ratings, numbers, grades, sentences,
    )
}


def generate(
    spark: SparkSession, name: str, rows: int, partitions: int | None = None, seed: int = 0
) -> DataFrame:
    return GENERATORS[name](ids(spark, rows, partitions), seed)
