"""Queries of the scalar function groups, each with its value lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import scalars as S
from whence.plans.registry import LI_RID, query
from whence.sources.tables import Tables


@query("""SELECT c_custkey::varchar AS customer_rid, length(c_name) AS len, string_split(c_name, '#')[1] AS head,
  substr(c_name, 10, 4) AS middle, length(c_name) - instr(reverse(c_name), '0') AS last_zero, trim('  ' || c_name || ' ') AS trimmed,
  c_name || '/' || c_mktsegment AS joined, 'customer.c_mktsegment,customer.c_name' AS cols FROM customer
  WHERE instr(c_name, '0') > 0""")
def scalar_text(t: Tables) -> DataFrame:
    f = t.tagged("customer").filter(F.instr("c_name", "0") > 0).map(
        len=(F.length("c_name").cast("bigint"), ["c_name"]),
        head=(F.split("c_name", "#")[0], ["c_name"]),
        middle=(F.substring("c_name", 10, 4), ["c_name"]),
        last_zero=(S.last_index_of("c_name", "0").cast("bigint"), ["c_name"]),
        trimmed=(F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))), ["c_name"]),
        joined=(F.concat("c_name", F.lit("/"), "c_mktsegment"), ["c_name", "c_mktsegment"]),
    )
    return f.with_lineage(cells=True)


@query(f"""SELECT {LI_RID} AS lineitem_rid, l_orderkey & l_partkey AS both_bits, l_orderkey | l_partkey AS any_bits,
  xor(l_orderkey, l_partkey) AS odd_bits, l_orderkey << 3 AS up, l_orderkey >> 2 AS down, -l_orderkey - 1 AS flipped,
  (l_orderkey - l_partkey) // 7 AS whole, floor((l_orderkey - l_partkey) / 7)::bigint AS floored,
  (((l_orderkey - l_partkey) % 7) + 7) % 7 AS modulo, abs(l_orderkey - l_partkey) AS distance,
  sign(l_orderkey - l_partkey)::int AS signum, CASE WHEN l_orderkey >= l_partkey THEN (l_orderkey - l_partkey) >> 2
    ELSE (18446744073709551616::hugeint + l_orderkey - l_partkey) // 4 END::bigint AS unsigned_down FROM lineitem""")
def scalar_integers(t: Tables) -> DataFrame:
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    pair = ["l_orderkey", "l_partkey"]
    f = t.tagged("lineitem").map(
        both_bits=(a.bitwiseAND(b), pair),
        any_bits=(a.bitwiseOR(b), pair),
        odd_bits=(a.bitwiseXOR(b), pair),
        up=(F.shiftleft(a, 3), ["l_orderkey"]),
        down=(F.shiftright(a, 2), ["l_orderkey"]),
        flipped=(F.bitwise_not(a), ["l_orderkey"]),
        whole=(S.int_div(a - b, F.lit(7)), pair),
        floored=(S.floor_div(a - b, F.lit(7)), pair),
        modulo=(S.floor_mod(a - b, F.lit(7)), pair),
        distance=(F.abs(a - b), pair),
        signum=(F.signum(a - b).cast("int"), pair),
        unsigned_down=(F.shiftrightunsigned(a - b, 2), pair),
    )
    return f.with_lineage()


def _curves() -> dict[str, Column]:
    x = F.col("l_discount")
    return {
        "sine": F.sin(x), "cosine": F.cos(x), "tangent": F.tan(x), "arc_sine": F.asin(x), "arc_cosine": F.acos(x),
        "arc_tangent": F.atan(x), "angle": F.atan2(x, F.lit(2.0)), "rad": F.radians(x), "deg": F.degrees(x),
        "hypotenuse": F.hypot(x, F.lit(2.0)), "root": F.sqrt(x), "cube_root": F.cbrt(x), "power": F.pow(x, F.lit(3)),
        "growth": F.exp(x), "growth_less_one": F.expm1(x), "natural": F.log(1 + x), "plus_one": F.log1p(x),
        "decimal_log": F.log10(1 + x), "sinh": F.sinh(x), "cosh": F.cosh(x), "tanh": F.tanh(x),
    }


_CURVES_SQL = {
    "sine": "sin(x)", "cosine": "cos(x)", "tangent": "tan(x)", "arc_sine": "asin(x)", "arc_cosine": "acos(x)",
    "arc_tangent": "atan(x)", "angle": "atan2(x, 2.0::double)", "rad": "radians(x)", "deg": "degrees(x)",
    "hypotenuse": "sqrt(x * x + 4)", "root": "sqrt(x)", "cube_root": "cbrt(x)", "power": "pow(x, 3)", "growth": "exp(x)",
    "growth_less_one": "exp(x) - 1", "natural": "ln(1 + x)", "plus_one": "ln(1 + x)", "decimal_log": "log10(1 + x)",
    "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)",
}


@query("SELECT rid AS lineitem_rid, " + ", ".join(f"round({sql}, 9) AS {name}" for name, sql in _CURVES_SQL.items())
       + f" FROM (SELECT {LI_RID} AS rid, l_discount AS x FROM lineitem)")
def scalar_curves(t: Tables) -> DataFrame:
    outputs = {name: (F.round(expr, 9), ["l_discount"]) for name, expr in _curves().items()}
    return t.tagged("lineitem").map(**outputs).with_lineage()


@query(f"""SELECT {LI_RID} AS lineitem_rid, ceil(l_extendedprice)::bigint AS up, floor(l_extendedprice)::bigint AS down,
  round_even(l_extendedprice, 0)::bigint AS even, greatest(l_discount, l_tax) AS larger, least(l_discount, l_tax) AS smaller,
  CASE WHEN l_partkey * 4000000 > 2147483647 THEN NULL ELSE (l_partkey * 4000000)::int END AS product
  FROM lineitem""")
def scalar_rounding(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    wide = F.col("l_partkey") * 4_000_000
    f = t.tagged("lineitem").map(
        up=(F.ceil(price), ["l_extendedprice"]),
        down=(F.floor(price), ["l_extendedprice"]),
        even=(F.rint(price).cast("bigint"), ["l_extendedprice"]),
        larger=(F.greatest("l_discount", "l_tax"), ["l_discount", "l_tax"]),
        smaller=(F.least("l_discount", "l_tax"), ["l_discount", "l_tax"]),
        # A 32-bit product that does not fit is NULL.
        product=(F.when(wide <= 2**31 - 1, wide).cast("int"), ["l_partkey"]),
    )
    return f.with_lineage()


@query(f"""SELECT rid AS lineitem_rid, CASE WHEN k * 70000 BETWEEN -2147483648 AND 2147483647 THEN (k * 70000)::int END AS product,
  CASE WHEN k + 2147470000 <= 2147483647 THEN (k + 2147470000)::int END AS sum,
  CASE WHEN -2147470000 - k >= -2147483648 THEN (-2147470000 - k)::int END AS difference,
  (CASE WHEN k % 7 = 0 THEN NULL ELSE -k END)::int AS negated,
  (9223372036854775807 - k)::bigint AS large, CASE WHEN k < 5 THEN 9223372036854775803 + k END::bigint AS larger
  FROM (SELECT {LI_RID} AS rid, l_partkey AS k FROM lineitem)""")
def scalar_checked(t: Tables) -> DataFrame:
    """Sums, products and negations that do not fit their type are NULL, not wrapped around."""
    k, pair = F.col("l_partkey"), ["l_partkey"]
    least = F.lit(-(2**31))
    f = t.tagged("lineitem").map(
        product=(S.checked("*", k, F.lit(70_000)), pair),
        sum=(S.checked("+", k, F.lit(2_147_470_000)), pair),
        difference=(S.checked("-", F.lit(-2_147_470_000), k), pair),
        negated=(S.negated(F.when(k % 7 == 0, least).otherwise(k)), pair),
        large=(S.checked("-", F.lit(2**63 - 1), k, "bigint", strict=True), pair),
        larger=(S.checked("+", F.lit(2**63 - 5), k, "bigint"), pair),
    )
    return f.with_lineage()


@query("""SELECT o_orderkey, o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-03-01'
    AND o_orderstatus <> 'F' AS inside FROM orders""")
def date_interval(t: Tables) -> DataFrame:
    """Open interval on date text; text that is no date is outside."""
    day = F.col("o_orderdate").cast("date").cast("string")
    text = F.when(F.col("o_orderstatus") == "F", F.lit("not a date")).otherwise(day)
    return t.orders.select("o_orderkey", S.date_between(text, "1998-01-01", "1998-03-01").alias("inside"))
