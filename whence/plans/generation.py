"""Queries of the generators: one generated row per row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from whence.functions.hashing import draw_sql
from whence.operators import generate as G
from whence.plans.registry import query


def num(tag: str, low: int, high: int, seed: int = 0) -> str:
    return f"({draw_sql('id', tag, seed)} % {high - low + 1} + {low})"


def wide(tag: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', id, '{tag}', '0')), 1, 8))::bigint % {G.INT_MAX})"


def unit(tag: str) -> str:
    return f"({draw_sql('id', tag)} % 10000 / 10000.0::double)"


def letters(tag: str, length: int = 10) -> str:
    return f"translate(substr(md5(concat_ws(':', id, '{tag}', '0')), 1, {length}), '0123456789', 'ghijklmnop')"


def airport(tag: str) -> str:
    n = num(tag, 0, G.AIRPORTS - 1)
    return f"(chr((65 + {n} // 676 % 26)::int) || chr((65 + {n} // 26 % 26)::int) || chr((65 + {n} % 26)::int))"


def minute(tag: str) -> str:
    part = lambda name, low, high: f"lpad({num(f'{tag}/{name}', low, high)}::varchar, 2, '0')"
    return (
        f"'20' || {part('y', 15, 22)} || '-' || {part('mo', 1, 12)} || '-' || {part('d', 1, 28)} || ' ' "
        f"|| {part('h', 0, 23)} || ':' || {part('mi', 0, 59)}"
    )


def picked(tag: str, values) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][{draw_sql('id', tag)} % {len(values)} + 1]"


def ages_sql(seed: int) -> dict[str, str]:
    return {
        "zip": num("zip", 90_000, 90_099, seed),
        "age": num("age", 0, 100, seed),
        "income": num("income", 0, 9999, seed),
    }


_GAP = f"(abs({num('from', 90_000, 90_099)} - {num('to', 90_000, 90_099)}) * 100 + {num('extra', 0, 9)})"
_SPEED = f"({num('v', 3, 72)} + CASE WHEN {num('v', 3, 72)} <= 10 AND {num('lift', 90_000, 90_099)} % 100 <> 1 THEN 10 ELSE 0 END)"
_SALARY = num("salary", 100, 999_999)

# generator -> (table and key that supply the ids, column -> SQL)
SPECS = {
    "airports": ("supplier", "s_suppkey", {
        "code": airport("code"), "name": letters("name"), "city": letters("city"),
        "lon": f"{unit('lon')} * 360 - 180", "lat": f"{unit('lat')} * 180 - 90", "timezone": letters("zone")}),
    "flights": ("orders", "o_orderkey", {
        "flight_id": num("fid", 0, 99_998), "flight_no": f"'PG' || {num('no', 1000, 9999)}",
        "sched_dep": minute("dep"), "sched_arr": minute("arr"), "dep_airport": airport("from"),
        "arr_airport": airport("to"), "status": picked("status", G.STATUSES), "aircraft": f"'CR' || {num('craft', 1, 10)}"}),
    "boxes": ("pages", "page_id", {
        "url": f"'www.' || {letters('url', 2)} || '.com'", "x": num("x", 0, 1919), "y": num("y", 0, 1079),
        "height": num("h", 0, 1079), "width": num("w", 0, 1919), "box_id": num("box", 0, 9),
        "type": picked("type", G.BOX_TYPES)}),
    "customers": ("customer", "c_custkey", {
        "customer_id": num("cid", 0, 998), "name": letters("name"), "location": letters("place")}),
    "orders": ("orders", "o_orderkey", {
        "order_id": f"'order' || {num('oid', 0, 998)}", "customer_id": num("cid", 0, 998), "epoch_s": wide("time"),
        "item": f"'item' || {wide('item')}"}),
    "stations": ("orders", "o_orderkey", {
        "trip_id": f"'trip' || {num('trip', 0, 99_998)}", "time": wide("time"), "advertised": wide("due"),
        "route": f"'route' || {num('route', 0, 99)}"}),
    "ages": ("customer", "c_custkey", ages_sql(0)),
    "income": ("customer", "c_custkey", ages_sql(1)),
    "trips": ("events", "event_id", {
        "mode": "'sr'", "from_zip": num("from", 90_000, 90_099), "to_zip": num("to", 90_000, 90_099),
        "distance": _GAP, "time": f"greatest({_GAP} // {_SPEED}, 1)"}),
    "deliveries": ("orders", "o_orderkey", {
        "delivery_id": f"'dlvry' || {num('dlvry', 0, 99_998)}", "customer": f"'cust' || {num('cust', 0, 99_998)}",
        "vendor": f"'vend' || {num('vend', 0, 99_998)}", "rating": num("rating", 1, 5)}),
    "salaries": ("customer", "c_custkey", {
        "salary": f"CASE WHEN {_SALARY} > 99999 AND {draw_sql('id', 'dollar')} % 2 = 0 THEN '$' ELSE '' END || {_SALARY}"}),
    "circles": ("part", "p_partkey", {"x": num("x", 1, 100), "y": num("y", 1, 100), "r": num("r", 1, 2000)}),
    "loans": ("customer", "c_custkey", {
        "principal": num("principal", 1000, 9999), "years": num("years", 10, 50), "rate": unit("rate"), "name": letters("name")}),
    "ratings": ("part", "p_partkey", {"title": letters("title"), "rating": num("rating", 0, 100)}),
    "numbers": ("part", "p_partkey", {"n": num("n", 1, 500), "m": num("m", 1, 500)}),
    "grades": ("customer", "c_custkey", {"course": f"'CS' || {num('course', 100, 700)}", "score": num("score", 0, 100)}),
    "sentences": ("documents", "doc_id", {"line": f"'{G.SENTENCE}'"}),
}

for _name, (_table, _key, _columns) in SPECS.items():
    _listed = ", ".join(f"{expr} AS {column}" for column, expr in _columns.items())

    @query(f"SELECT {_listed} FROM (SELECT {_key} AS id FROM {_table})", f"gen_{_name}")
    def _build(t, name=_name, table=_table, key=_key):
        return G.GENERATORS[name](getattr(t, table).select(F.col(key).alias("id")), 0)
