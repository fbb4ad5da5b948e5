"""Cell and line mutations as column expressions.

Every mutation takes the value as text and an integer draw, so the result is a
pure function of the row id and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whence.functions.hashing import digest, draw
from whence.functions.scalars import is_number

# The printable ASCII characters without the comma.
PRINTABLE = "".join(chr(c) for c in range(33, 127) if chr(c) != ",")
# The per-character draw steps through a prime field.
CHAR_STEP, CHAR_FIELD = 611_953, 1_000_003
# Weights of the cell mutations, in thousandths and in this order; a value
# mutation stands thrice, as the number or text change, the flipped category and the rest.
ROULETTE = (("value", 900), ("format", 20), ("value", 20), ("drop", 20), ("blank", 20), ("value", 20))
DUMMY = "testdummy"
KEY_BITS = 31


def wide_draw(rid: Column | str, tag: str, seed: int = 0) -> Column:
    """Integer in [0, 2^31 - 1)."""
    return F.conv(F.substr(digest(rid, tag, seed), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % (2**31 - 1)


def scramble(text: Column, h: Column, share: float) -> Column:
    """Replace about ``share`` of the characters by printable ones, never a comma."""
    limit = round(share * 1000)
    printable = F.array(*[F.lit(c) for c in PRINTABLE])

    def all_of(draw: Column) -> Column:
        def one(char: Column, i: Column) -> Column:
            u = (draw + (i.cast("bigint") + 1) * CHAR_STEP) % CHAR_FIELD
            place = F.call_function("div", u, F.lit(1000)) % len(PRINTABLE)
            return F.when(u % 1000 < limit, F.get(printable, place.cast("int"))).otherwise(char)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    # Bound to a variable, the draw is hashed once a text, not twice a character.
    return F.transform(F.array(h), all_of)[0]


def is_integer(text: Column) -> Column:
    return text.rlike(r"^[+-]?\d+$")


#: Integers of up to so many digits are added to as a whole.
WHOLE_DIGITS = 36


def offset_number(text: Column, h: Column) -> Column:
    """Add a non-negative integer; text that is no number stays.

    Of an integer of more than ``WHOLE_DIGITS`` digits only the last 18 change: the
    integer is added to them modulo 10^18.
    """
    whole = F.try_add(text.try_cast("decimal(38,0)"), h.cast("decimal(38,0)")).cast("string")
    n = F.length(text)
    low = F.pmod(F.substr(text, n - 17, F.lit(18)).try_cast("bigint") + h, F.lit(10**18)).cast("string")
    long = F.concat(F.substr(text, F.lit(1), n - 18), F.lpad(low, 18, "0"))
    exact = (text.try_cast("decimal(28,8)") + h.cast("decimal(28,8)")).cast("string")
    trimmed = F.regexp_replace(exact, r"\.?0+$", "")
    number = F.when(is_number(text), F.coalesce(trimmed, text)).otherwise(text)
    return F.when(is_integer(text), F.when(n > WHOLE_DIGITS, long).otherwise(whole)).otherwise(number)


def number_in_range(h: Column, low: int, high: int) -> Column:
    return (h % (high - low + 1) + low).cast("string")


def change_format(text: Column) -> Column:
    """``12`` becomes ``12.0`` and ``12.7`` becomes ``12``; other text stays."""
    return (
        F.when(text.rlike(r"^\d+$"), F.concat(text, F.lit(".0")))
        .when(text.rlike(r"^\d+\.\d*$"), F.regexp_replace(text, r"\..*$", ""))
        .otherwise(text)
    )


def mutate_value(text: Column, h: Column, share: float = 0.5, category: str | None = None, limits=None) -> Column:
    """Number or text mutation, by declared category or by what the value looks like."""
    number = number_in_range(h, *limits) if limits else offset_number(text, h)
    if category == "numerical":
        return number
    if category is not None:
        return scramble(text, h, share)
    return F.when(is_number(text), number).otherwise(scramble(text, h, share))


def roulette(text: Column, rid: Column, tag: str, seed: int = 0, category: str | None = None) -> Column:
    """One mutation per cell, chosen by weight."""
    point = draw(rid, f"{tag}/pick", seed) % 1000
    h = wide_draw(rid, tag, seed)
    changed = {
        "value": mutate_value(text, h, category=category),
        "format": change_format(text) if category in (None, "numerical") else text,
        "drop": F.lit(""),
        "blank": F.lit(""),
    }
    out, below = None, 0
    for kind, weight in ROULETTE:
        below += weight
        out = F.when(point < below, changed[kind]) if out is None else out.when(point < below, changed[kind])
    return out


def break_delimiter(line: Column, h: Column, delimiter: str = ",", broken: str = "~") -> Column:
    """One delimiter of the line becomes ``broken``."""
    parts = F.split(line, f"[{delimiter}]")
    n = F.size(parts)
    at = (h % F.greatest(n - 1, F.lit(1))).cast("int") + 1
    cut = F.concat(
        F.array_join(F.slice(parts, F.lit(1), at), delimiter),
        F.lit(broken),
        F.array_join(F.slice(parts, at + 1, n), delimiter),
    )
    return F.when(n < 2, line).otherwise(cut)


def drop_fields(line: Column, rid: Column, tag: str, seed: int = 0, most: int = 2, delimiter: str = ",") -> Column:
    """Drop up to ``most`` fields of the line."""
    parts = F.split(line, f"[{delimiter}]")
    n = F.size(parts)
    draws = [(draw(rid, f"{tag}/{i}", seed) % n).cast("int") for i in range(most)]
    count = draw(rid, f"{tag}/count", seed) % most + 1

    def stays(_: Column, i: Column) -> Column:
        hit = F.lit(False)
        for place, at in enumerate(draws):
            hit = hit | ((F.lit(place) < count) & (i == at))
        return ~hit

    return F.array_join(F.filter(parts, stays), delimiter)


def consistent_key(old: Column, group: Column, seed: int = 0) -> Column:
    """New text for a key cell: equal for equal old keys of a group, different for
    different ones.

    A tenth of the groups gets a dummy token, the rest a large number. Both keep
    the old key inside, so two keys never fall together and joins keep their
    matches. Keys that are no integers in [0, 2^31) all get the token. Where keys of
    both kinds meet, or new keys must not look like others of the table, use
    ``perturb.permute_consistently``.
    """
    h = draw(group, "consistent", seed)
    text = old.cast("string")
    key = text.try_cast("bigint")
    fits = text.rlike(r"^(0|[1-9]\d*)$") & (key >= 0) & (key < 2**KEY_BITS)
    number = (F.shiftleft(h % 2**20, KEY_BITS) + key).cast("string")
    token = F.concat(F.lit(f"<{DUMMY}:"), text, F.lit(">"))
    return F.when((h % 10 != 0) & F.coalesce(fits, F.lit(False)), number).otherwise(token)
