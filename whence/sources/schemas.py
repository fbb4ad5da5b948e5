"""Declared inputs of the programs and tables: column types, categories, ranges."""

from __future__ import annotations

from pyspark.sql import types as T


def number(name: str, kind: T.DataType, low: int | None = None, high: int | None = None) -> T.StructField:
    """A numerical column, on request with the range that changed values stay in."""
    limits = {} if low is None else {"min": low, "max": high}
    return T.StructField(name, kind, True, {"category": "numerical", **limits})


def category(name: str) -> T.StructField:
    """A text column with few values."""
    return T.StructField(name, T.StringType(), True, {"category": "categorical"})


def other(name: str, kind: T.DataType | None = None) -> T.StructField:
    return T.StructField(name, kind or T.StringType(), True, {"category": "other"})


INT, DOUBLE, TEXT, BOOLEAN = T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()

# The columns of the programs' datasets with their categories, in file order.
PROGRAMS = {
    "ages": [
        number("zip", TEXT), number("age", INT), number("income", INT),
    ],
    "income": [
        number("zip", TEXT), number("age", INT), number("income", INT),
    ],
    "trips": [
        other("mode"), number("from_zip", TEXT), number("to_zip", TEXT), number("distance", INT), number("time", INT),
    ],
    "locations": [
        number("zip", TEXT), number("lat", DOUBLE), number("lng", DOUBLE), other("city"), other("state_id"),
        other("state"), other("zcta", BOOLEAN), other("parent"), number("population", INT), number("density", DOUBLE),
        number("county_fips", INT), other("county"), other("weights"), other("county_names"),
        number("county_fips_all", TEXT), other("imprecise", BOOLEAN), other("military", BOOLEAN), other("timezone"),
    ],
    "customers": [
        other("customer_id"), other("name"), other("location"),
    ],
    "orders": [
        number("order_id", TEXT), other("customer_id"), number("epoch_s", INT), other("item"),
    ],
    "stations": [
        other("trip_id"), number("time", INT), number("advertised", INT), other("route"),
    ],
    "deliveries": [
        other("delivery_id"), other("customer"), other("vendor"), number("rating", DOUBLE),
    ],
    "lines": [
        other("line"),
    ],
    "salaries": [
        number("salary", TEXT),
    ],
    "flights": [
        number("flight_id", INT), category("flight_no"), other("sched_dep"), other("sched_arr"),
        category("dep_airport"), category("arr_airport"), category("status"), other("aircraft"), other("actual_dep"),
        other("actual_arr"),
    ],
    "airports": [
        category("code"), category("name"), category("city"), number("coord_a", DOUBLE), number("coord_b", DOUBLE),
        category("timezone"),
    ],
    "circles": [
        number("x", INT), number("y", INT), number("r", INT),
    ],
    "loans": [
        number("principal", DOUBLE), number("years", INT), number("rate", DOUBLE), other("name"),
    ],
    "ratings": [
        other("title"), number("rating", INT),
    ],
    "numbers": [
        number("n", INT), number("m", INT),
    ],
    "grades": [
        other("course"), number("score", INT),
    ],
    "boxes": [
        other("url"), number("x", INT), number("y", INT), number("height", INT), number("width", INT),
        number("box_id", INT), other("type"),
    ],
    "rectangles": [
        other("id"), number("x", INT), number("y", INT), number("h", INT), number("w", INT),
    ],
}

#: Columns of the tables here that changes may touch; nations and sizes keep to their ranges.
TABLES = {
    "customer": [other("c_name"), number("c_nationkey", INT, 0, 24), number("c_acctbal", DOUBLE), category("c_mktsegment")],
    "part": [other("p_name"), category("p_brand"), category("p_type"), number("p_size", INT, 1, 50)],
}

_DECLARED = PROGRAMS | TABLES


def schema(dataset: str) -> T.StructType:
    """Types and per-column metadata {category[, min, max]} of a declared dataset."""
    return T.StructType(list(_DECLARED[dataset]))


def datasets() -> list[str]:
    return sorted(_DECLARED)
