"""Portable, seeded draws.

A draw is a pure function of (row id, tag, seed): the same value after a task
retry, under any partitioning, and in any SQL engine that has ``md5``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 28
DRAW_RANGE = 1 << DRAW_BITS


def digest(rid: Column | str, tag: str, seed: int = 0) -> Column:
    rid = F.col(rid) if isinstance(rid, str) else rid
    return F.md5(F.concat_ws(":", rid.cast("string"), F.lit(tag), F.lit(str(seed))))


def draw(rid: Column | str, tag: str, seed: int = 0) -> Column:
    """Integer in [0, 2^28)."""
    return F.conv(F.substr(digest(rid, tag, seed), F.lit(1), F.lit(7)), 16, 10).cast("bigint")


def coin(rid: Column | str, tag: str, share: float, seed: int = 0) -> Column:
    """True for about ``share`` of the ids, in steps of 2^-28."""
    return draw(rid, tag, seed) < round(min(share, 1.0) * DRAW_RANGE)


def between(rid: Column | str, tag: str, low: int, high: int, seed: int = 0) -> Column:
    """Integer in [low, high], both ends included."""
    return draw(rid, tag, seed) % (high - low + 1) + low


def pick(rid: Column | str, tag: str, values: Iterable[str], seed: int = 0) -> Column:
    values = list(values)
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (draw(rid, tag, seed) % len(values) + 1).cast("int"))


def coin_sql(rid: str, tag: str, share: float, seed: int = 0) -> str:
    """The same coin as DuckDB SQL text."""
    return f"({draw_sql(rid, tag, seed)} < {round(min(share, 1.0) * DRAW_RANGE)})"


def draw_sql(rid: str, tag: str, seed: int = 0) -> str:
    """The same draw as DuckDB SQL text."""
    return f"('0x' || substr(md5(concat_ws(':', {rid}, '{tag}', '{seed}')), 1, 7))::bigint"


# -- permutations ----------------------------------------------------------------

ROUNDS = 24
_BIG = 15  # hex digits of a round constant


def permuted(rank: Column, n: Column | int, seed: int = 0) -> Column:
    """A seeded permutation of 0 .. n - 1, for any n.

    A swap-or-not network, the Feistel network for sizes that are no power of two: a round
    pairs x with (k - x) mod n and swaps the two, or not, by a bit drawn from the larger. Each
    round is its own inverse, so no two ranks ever fall together.
    """
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n

    def one(x: Column, i: Column) -> Column:
        k = F.conv(F.substr(F.md5(F.concat_ws(":", F.lit("k"), i.cast("string"), F.lit(str(seed)))), F.lit(1), F.lit(_BIG)), 16, 10)
        partner = F.pmod(k.cast("bigint") % n - x, n)
        bit = F.md5(F.concat_ws(":", F.greatest(x, partner).cast("string"), i.cast("string"), F.lit(str(seed))))
        return F.when(F.substr(bit, F.lit(1), F.lit(1)) < "8", partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), rank.cast("bigint"), one)


def permuted_sql(rank: str, n: str, seed: int = 0) -> str:
    """The same permutation as DuckDB SQL text."""
    k = f"(('0x' || substr(md5(concat_ws(':', 'k', i, '{seed}')), 1, {_BIG}))::bigint % ({n}))"
    partner = f"((({k} - x) % ({n}) + ({n})) % ({n}))"
    bit = f"substr(md5(concat_ws(':', greatest(x, {partner}), i, '{seed}')), 1, 1)"
    return f"""list_reduce(list_prepend(({rank})::bigint, range(1, {ROUNDS + 1})),
      lambda x, i: CASE WHEN {bit} < '8' THEN {partner} ELSE x END)"""


def poisson(rid: Column | str, tag: str, mean: float, seed: int = 0) -> Column:
    """How often a row is drawn with replacement: a Poisson count from the hash of its id.

    The draw is compared with the cumulated probabilities, in steps of 2^-28, as far as these
    steps tell counts apart.
    """
    u = draw(rid, tag, seed)
    return sum((F.when(u >= bound, 1).otherwise(0) for bound in poisson_bounds(mean)), F.lit(0))


def poisson_bounds(mean: float) -> list[int]:
    """Draws from which on a Poisson count is over 0, 1, 2, ..."""
    if not 0 <= mean <= 32:
        raise ValueError("mean must be between 0 and 32")
    bounds, term, upto, k = [], math.exp(-mean), 0.0, 0
    while True:
        upto += term
        bound = round(upto * DRAW_RANGE)
        # Beyond the peak the terms fall for good.
        if bound >= DRAW_RANGE or (k > mean and term * DRAW_RANGE < 0.5):
            return bounds
        bounds.append(bound)
        k += 1
        term *= mean / k


def poisson_sql(rid: str, tag: str, mean: float, seed: int = 0) -> str:
    u = draw_sql(rid, tag, seed)
    return "(" + " + ".join(["0", *[f"({u} >= {bound})::int" for bound in poisson_bounds(mean)]]) + ")"
