"""Domain formulas of the workloads as column expressions (JVM side, no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in km and miles per km.
EARTH_RADIUS_KM = 6373.0
MILES_PER_KM = 0.621371
# Decimal numbers, and the white space that separates words.
NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Infinity)\s*$"
OTHER_BLANKS = "\t\x0b\f\r"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bracket(value: Column | str, steps: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """First label whose condition holds."""
    out = None
    for cond, label in steps:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def age_bracket(age: Column | str) -> Column:
    age = as_col(age)
    return bracket(
        age,
        [
            ((age >= 40) & (age <= 65), "40-65"),
            ((age >= 20) & (age < 40), "20-39"),
            (age < 20, "0-19"),
        ],
        ">65",
    )


def speed_class(speed: Column | str) -> Column:
    speed = as_col(speed)
    return bracket(speed, [(speed > 40, "car"), (speed > 15, "public")], "onfoot")


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division truncating toward zero; NULL for a zero divisor."""
    a, b = as_col(a).cast("bigint"), as_col(b).cast("bigint")
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def delay_bucket(delay: Column | str, width: int = 1800) -> Column:
    return int_div(delay, F.lit(width))


def parse_currency(text: Column | str) -> Column:
    """An integer with or without ``$`` before it; NULL if it does not parse."""
    text = as_col(text)
    digits = F.when(text.startswith("$"), F.substr(text, F.lit(2))).otherwise(text)
    return digits.try_cast("bigint")


def is_number(text: Column | str) -> Column:
    """The text is a decimal number. Checked by pattern: a failing cast costs an
    exception per row."""
    return F.coalesce(as_col(text).rlike(NUMBER), F.lit(False))


def to_double_or_zero(text: Column | str) -> Column:
    text = as_col(text).cast("string")
    return F.when(is_number(text), text.try_cast("double")).otherwise(F.lit(0.0))


def item_or(items: Column | str, index: int, default: str = "error") -> Column:
    """Array item at a 0-based position, or ``default`` past the end."""
    return F.coalesce(F.get(as_col(items), F.lit(index)), F.lit(default))


def between_exclusive(value: Column | str, low, high) -> Column:
    value = as_col(value)
    return (value > low) & (value < high)


def date_between(text: Column | str, low: str, high: str) -> Column:
    """Open interval on ``yyyy-MM-dd`` text; unparsable text is outside."""
    day = F.try_to_timestamp(as_col(text), F.lit("yyyy-MM-dd")).cast("date")
    inside = between_exclusive(day, F.lit(low).cast("date"), F.lit(high).cast("date"))
    return F.coalesce(inside, F.lit(False))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), 2
    )
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_RADIUS_KM * MILES_PER_KM


def collatz_length(n: Column | str, bound: int = 30) -> Column:
    """Numbers in the 3n+1 sequence of ``n`` down to 1, cut at ``bound``; 0 for n <= 0."""
    start = F.struct(as_col(n).cast("bigint").alias("at"), F.lit(1).alias("length"))

    def step(acc: Column, _: Column) -> Column:
        at, length = acc["at"], acc["length"]
        following = F.when(at % 2 == 0, F.shiftright(at, 1)).otherwise(at * 3 + 1)
        return F.when(at == 1, acc).otherwise(
            F.struct(following.alias("at"), (length + 1).alias("length"))
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(bound - 1)), start, step, lambda acc: acc["length"])
    return F.when(as_col(n) <= 0, F.lit(0)).otherwise(walked)


def compound(principal, rate, years) -> Column:
    return as_col(principal) * F.pow(1 + as_col(rate), as_col(years))


def box(x, y, height, width) -> Column:
    return F.struct(
        as_col(x).cast("bigint").alias("x"),
        as_col(y).cast("bigint").alias("y"),
        as_col(height).cast("bigint").alias("h"),
        as_col(width).cast("bigint").alias("w"),
    )


def boxes_touch(a: Column, b: Column) -> Column:
    """Closed rectangles share at least a point."""
    return (
        (a["x"] + a["w"] >= b["x"])
        & (b["x"] + b["w"] >= a["x"])
        & (a["y"] + a["h"] >= b["y"])
        & (b["y"] + b["h"] >= a["y"])
    )


def common_box(a: Column, b: Column) -> Column:
    """Common rectangle of boxes that touch."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    right = F.least(a["x"] + a["w"], b["x"] + b["w"])
    top = F.least(a["y"] + a["h"], b["y"] + b["h"])
    return box(x, y, top - y, right - x)


def box_intersection(a: Column, b: Column) -> Column:
    """Common rectangle, or NULL where the boxes are apart.

    To filter many pairs, ask for ``boxes_touch`` first and take a field of the ``common_box``: below a
    condition the rectangle is made whole for every pair.
    """
    return F.when(boxes_touch(a, b), common_box(a, b))


def last_index_of(text: Column | str, char: str) -> Column:
    """0-based position of the last ``char``, or -1."""
    text = as_col(text)
    at = F.instr(F.reverse(text), char)
    return F.when(at > 0, F.length(text) - at).otherwise(F.lit(-1))


def floor_div(a: Column | str, b: Column | str) -> Column:
    """Integer division toward minus infinity, exact for all 64-bit integers; NULL for a zero divisor."""
    a, b = as_col(a).cast("bigint"), as_col(b).cast("bigint")
    divisor = F.nullif(b, F.lit(0).cast("bigint"))
    below = ((a % divisor) != 0) & ((a < 0) != (b < 0))
    return F.call_function("div", a, divisor) - F.when(below, 1).otherwise(0)


# The integer types and their bits.
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def checked(op: str, a: Column | str, b: Column | str, kind: str = "int", strict: bool = False) -> Column:
    """``a op b`` (+, - or *) in the integer type ``kind``: NULL where it does not fit, or an error if ``strict``.

    Whether it fits is known before the sum or product is taken: one that fails costs an exception per row.
    """
    a, b = as_col(a).cast(kind), as_col(b).cast(kind)
    top = 2 ** (INTEGER_BITS[kind] - 1) - 1
    if kind == "bigint":
        found = F.when(_fits(op, a, b), _applied(op, a, b))
    else:
        wide = _applied(op, a.cast("bigint"), b.cast("bigint"))
        found = F.when(wide.between(-top - 1, top), wide.cast(kind))
    if not strict:
        return found
    known = a.isNotNull() & b.isNotNull() & found.isNull()
    return F.when(known, F.raise_error(F.lit(f"{kind} overflow in {op}"))).otherwise(found)


def _applied(op: str, a: Column, b: Column) -> Column:
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _fits(op: str, a: Column, b: Column) -> Column:
    """``a op b`` is a bigint; nothing in here can overflow."""
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    if op == "+":
        return F.when(b >= 0, a <= high - b).otherwise(a >= low - b)
    if op == "-":
        return F.when(b >= 0, a >= low + b).otherwise(a <= high + b)
    by = F.when((b < -1) | (b > 0), b)
    ends = [F.call_function("div", end, by) for end in (low, high)]
    return F.when(b > 0, a.between(*ends)).when(b < -1, a.between(*ends[::-1])).when(b == -1, a > low).otherwise(b == 0)


def negated(a: Column | str, kind: str = "int", strict: bool = False) -> Column:
    """-a in the integer type ``kind``, checked: its least value has no counterpart."""
    return checked("-", F.lit(0), a, kind, strict)


def floor_mod(a: Column | str, b: Column | str) -> Column:
    return F.pmod(as_col(a), as_col(b))


def line_words(line: Column | str) -> Column:
    """Words of one line, cut at each white-space character.

    Neighbouring blanks give empty words; trailing empty words are not kept and a
    line of blanks only has no words.
    """
    spaced = F.translate(as_col(line), OTHER_BLANKS, " " * len(OTHER_BLANKS))
    kept = F.rtrim(spaced)
    none = (kept == "") & (spaced != "")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.split(kept, " "))
