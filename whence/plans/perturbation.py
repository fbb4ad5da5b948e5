"""Queries of the perturbation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.functions import mutations as M
from whence.functions.hashing import coin_sql, draw_sql, permuted_sql
from whence.operators import codependence as C
from whence.operators import perturb as P
from whence.operators.frame import Source, tag
from whence.plans.codependence import order_keys
from whence.plans.registry import LI_RID, query
from whence.session import durable
from whence.sources.schemas import schema
from whence.sources.tables import ROW_KEYS, Tables

PRINTABLE_SQL = M.PRINTABLE.replace("'", "''")


def source(t: Tables, name: str) -> Source:
    return Source(name, getattr(t, name), ROW_KEYS[name])


def wide_sql(rid: str, tag: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {rid}, '{tag}', '{seed}')), 1, 8))::bigint % 2147483647)"


def scramble_sql(text: str, h: str, share: float = 0.5) -> str:
    u = f"(({h} + i * {M.CHAR_STEP}) % {M.CHAR_FIELD})"
    return f"""array_to_string(list_transform(string_split({text}, ''), lambda c, i: CASE WHEN {u} % 1000 < {round(share * 1000)}
      THEN substr('{PRINTABLE_SQL}', ({u} // 1000 % {len(M.PRINTABLE)} + 1)::int, 1) ELSE c END), '')"""


def offset_sql(text: str, h: str) -> str:
    return f"""CASE WHEN regexp_full_match({text}, '[+-]?\\d+') THEN (try_cast({text} AS bigint) + {h})::varchar
      ELSE coalesce(regexp_replace((try_cast({text} AS decimal(28,8)) + {h})::varchar, '\\.?0+$', ''), {text}) END"""


def value_sql(text: str, h: str) -> str:
    return f"CASE WHEN try_cast({text} AS double) IS NOT NULL THEN {offset_sql(text, h)} ELSE {scramble_sql(text, h)} END"


def format_sql(text: str) -> str:
    return f"""CASE WHEN regexp_full_match({text}, '\\d+') THEN {text} || '.0'
      WHEN regexp_full_match({text}, '\\d+\\.\\d*') THEN regexp_replace({text}, '\\..*$', '') ELSE {text} END"""


def mixed_sql(text: str, rid: str, tag: str) -> str:
    point, h = f"{draw_sql(rid, tag + '/pick')} % 1000", wide_sql(rid, tag)
    value = value_sql(text, h)
    return f"""CASE WHEN {point} < 900 THEN {value} WHEN {point} < 920 THEN {format_sql(text)}
      WHEN {point} < 940 THEN {value} WHEN {point} < 980 THEN '' ELSE {value} END"""


def cells_sql(columns: dict[str, tuple[str, str]], table: str = "customer", rid: str = "c_custkey::varchar") -> str:
    """{col: (before, after)} as UNION ALL over a table."""
    return " UNION ALL ".join(
        f"SELECT {rid} AS rid, '{c}' AS col, {before} AS before, {after} AS after FROM {table}"
        for c, (before, after) in columns.items()
    )


RID = "c_custkey::varchar"
TEXTS = {c: f"{c}::varchar" for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}


@query("""SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS col,
  unnest([bool_and(try_cast(p_partkey::varchar AS double) IS NOT NULL), bool_and(try_cast(p_name AS double) IS NOT NULL),
    bool_and(try_cast(p_brand AS double) IS NOT NULL), bool_and(try_cast(p_type AS double) IS NOT NULL),
    bool_and(try_cast(p_size::varchar AS double) IS NOT NULL),
    bool_and(try_cast(p_retailprice::varchar AS double) IS NOT NULL)]) AS ok FROM part""".join(
    ["SELECT col, CASE WHEN ok THEN 'numerical' ELSE 'other' END AS category FROM (", ")"]))
def infer_category(t: Tables) -> DataFrame:
    return P.infer_category(t.part)


def _customers(t: Tables, columns, change) -> DataFrame:
    return P.perturb(P.with_rid(source(t, "customer")), columns, change)


@query(cells_sql({"c_name": ("c_name", scramble_sql("c_name", wide_sql(RID, "c_name")))}))
def perturb_string(t: Tables) -> DataFrame:
    return _customers(t, ["c_name"], P.scramble_text())


@query(cells_sql({c: (TEXTS[c], offset_sql(TEXTS[c], wide_sql(RID, c))) for c in ("c_nationkey", "c_acctbal", "c_name")}))
def perturb_number(t: Tables) -> DataFrame:
    return _customers(t, ["c_nationkey", "c_acctbal", "c_name"], P.offset_numbers())


@query(cells_sql({c: (TEXTS[c], format_sql(TEXTS[c])) for c in ("c_nationkey", "c_acctbal", "c_name")}))
def perturb_number_format(t: Tables) -> DataFrame:
    return _customers(t, ["c_nationkey", "c_acctbal", "c_name"], P.number_formats())


@query(cells_sql({"c_name": ("c_name", f"CASE WHEN {coin_sql(RID, 'c_name/blank', 0.2)} THEN '' ELSE c_name END")}))
def perturb_blank(t: Tables) -> DataFrame:
    return _customers(t, ["c_name"], P.blanks(0.2))


@query(cells_sql({c: (text, mixed_sql(text, RID, c)) for c, text in TEXTS.items()}))
def perturb_mixed(t: Tables) -> DataFrame:
    return _customers(t, list(TEXTS), P.mixed())


@query(cells_sql({c: (text, scramble_sql(text, wide_sql(RID, c), 0.3)) for c, text in TEXTS.items()}))
def perturb_unguided(t: Tables) -> DataFrame:
    return _customers(t, list(TEXTS), P.scramble_text(0.3))


# Declared categories: balances move freely, nations stay in their range.
CATEGORIES = {"c_acctbal": ("numerical", None), "c_nationkey": ("numerical", (0, 24)), "c_mktsegment": ("categorical", None)}


@query(cells_sql(
    {
        "c_name": ("c_name", scramble_sql("c_name", wide_sql("rid", "c_name"))),
        "c_mktsegment": ("c_mktsegment", scramble_sql("c_mktsegment", wide_sql("rid", "c_mktsegment"))),
        "c_nationkey": (TEXTS["c_nationkey"], f"({wide_sql('rid', 'c_nationkey')} % 25)::varchar"),
        "c_acctbal": (TEXTS["c_acctbal"], offset_sql(TEXTS["c_acctbal"], wide_sql("rid", "c_acctbal"))),
    },
    table=f"""(SELECT *, {RID} || CASE WHEN copy_no = 0 THEN '' ELSE '+' || copy_no END AS rid FROM
      (SELECT *, unnest(range(0, 1 + CASE WHEN {coin_sql(RID, 'dup', 0.5)} THEN {draw_sql(RID, 'copies')} % 2 + 1
       ELSE 0 END)) AS copy_no FROM customer))""",
    rid="rid",
))
def perturb_schema_aware(t: Tables) -> DataFrame:
    """Rows are copied at random first; then every cell changes by its category."""
    rows = P.duplicate_rows(P.with_rid(source(t, "customer")), 0.5, 3)
    rows = rows.withColumn("rid", P.copy_id(F.col("rid"), F.col("copy_no")))
    return P.perturb(rows, list(TEXTS), P.by_schema(CATEGORIES))


LINE_SQL = "concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment)"


def _lines(t: Tables, change) -> DataFrame:
    line = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = P.with_rid(source(t, "customer")).select("rid", line.alias("before"))
    return rows.withColumn("after", change(F.col("before"), F.col("rid")))


@query(f"""SELECT rid, before, array_to_string(p[1:k], ',') || '~' || array_to_string(p[k + 1:len(p)], ',') AS after FROM
  (SELECT {RID} AS rid, {LINE_SQL} AS before, string_split({LINE_SQL}, ',') AS p, {draw_sql(RID, 'comma')} % 3 + 1 AS k FROM customer)""")
def perturb_delimiter(t: Tables) -> DataFrame:
    return _lines(t, lambda line, rid: M.break_delimiter(line, M.draw(rid, "comma")))


@query(f"""SELECT {RID} AS rid, {LINE_SQL} AS before, array_to_string(list_filter(string_split({LINE_SQL}, ','), lambda x, i:
    NOT (i - 1 = {draw_sql(RID, 'drop/0')} % 4 OR ({draw_sql(RID, 'drop/count')} % 2 = 1 AND i - 1 = {draw_sql(RID, 'drop/1')} % 4))), ',')
  AS after FROM customer""")
def perturb_drop_columns(t: Tables) -> DataFrame:
    return _lines(t, lambda line, rid: M.drop_fields(line, rid, "drop"))


@query(f"""SELECT {RID} AS rid, unnest(range(0, 1 + CASE WHEN {coin_sql(RID, 'dup', 0.3)}
  THEN {draw_sql(RID, 'copies')} % 2 + 1 ELSE 0 END)) AS copy_no FROM customer""")
def duplicate_rows(t: Tables) -> DataFrame:
    return P.duplicate_rows(P.with_rid(source(t, "customer")).select("rid"), 0.3, 3)


# -- consistent changes over two tables --------------------------------------------------


def _key_sql(key: str, group: str) -> str:
    h = draw_sql(group, "consistent")
    return f"""CASE WHEN {h} % 10 = 0 THEN '<{M.DUMMY}:' || {key} || '>'
      ELSE ({h} % 1048576 * 2147483648 + {key})::varchar END"""


GROUP_SQL = "'custkey:' || {0}"


@query(f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders)
    THEN {_key_sql('c_custkey', GROUP_SQL.format('c_custkey'))} ELSE c_custkey::varchar END AS k2 FROM customer),
  o AS (SELECT o_custkey AS k, {_key_sql('o_custkey', GROUP_SQL.format('o_custkey'))} AS k2 FROM orders)
  SELECT (SELECT count(*) FROM c JOIN o USING (k)) AS n_before, (SELECT count(*) FROM c JOIN o USING (k2)) AS n_after,
    (SELECT count(*) FROM c WHERE k::varchar <> k2) + (SELECT count(*) FROM o WHERE k::varchar <> k2) AS changed""")
def perturb_codependent(t: Tables) -> DataFrame:
    """Change customer keys in both tables; the join must keep its size."""
    relation = durable(order_keys(t, None))
    c = P.perturb_consistently(source(t, "customer"), relation, "c_custkey")
    o = P.perturb_consistently(source(t, "orders"), relation, "o_custkey")

    def count_of(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("what"))

    def moved(df: DataFrame, key: str) -> DataFrame:
        return count_of(df.where(F.col(key).cast("string") != F.col(f"new_{key}")), "changed")

    before = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    after = c.select("new_c_custkey").join(o.select("new_o_custkey"), F.col("new_c_custkey") == F.col("new_o_custkey"))
    counted = C.consolidate(
        count_of(before, "n_before"), count_of(after, "n_after"), moved(c, "c_custkey"), moved(o, "o_custkey")
    )
    return counted.agg(*[F.count_if(F.col("what") == n).alias(n) for n in ("n_before", "n_after", "changed")])


# Text keys of both tables: customers as the orders name them.
NAMED_SQL = """(SELECT {0} AS rid, 'C' || {1} % 97 || '/' || {1} AS k, {1} AS id FROM {2})"""


def _named(t: Tables, table: str, rid: str, key: str) -> Source:
    name = F.concat(F.lit("C"), (F.col(key) % 97).cast("string"), F.lit("/"), F.col(key).cast("string"))
    return Source(table, getattr(t, table).select(F.col(rid), name.alias("k")), (rid,))


@query(f"""WITH c AS {NAMED_SQL.format('c_custkey::varchar', 'c_custkey', 'customer')},
  o AS {NAMED_SQL.format('o_orderkey::varchar', 'o_custkey', 'orders')},
  d AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS n FROM (SELECT k FROM c INTERSECT SELECT k FROM o)),
  m AS (SELECT d.k, e.k AS k2 FROM d JOIN d e ON e.r = {permuted_sql('d.r', 'd.n')})
  SELECT ds, rid, k AS before, coalesce(k2, k) AS after FROM
    (SELECT 'customer' AS ds, rid, k FROM c UNION ALL SELECT 'orders', rid, k FROM o) LEFT JOIN m USING (k)""")
def perturb_codependent_text(t: Tables) -> DataFrame:
    """Text keys of two tables change alike: each takes the place of another."""
    customer, orders = _named(t, "customer", "c_custkey", "c_custkey"), _named(t, "orders", "o_orderkey", "o_custkey")
    frames = [tag(s.df, s.name, s.key).rename({"k": f"k_{s.name}"}) for s in (customer, orders)]
    relation = durable(C.join_groups(*frames, ("k_customer", "k_orders"), "name", None))
    changed = P.permute_consistently({"customer": (customer, ["k"]), "orders": (orders, ["k"])}, relation)
    parts = [
        df.select(F.lit(name).alias("ds"), "rid", F.col("k").alias("before"), F.col("new_k").alias("after"))
        for name, df in changed.items()
    ]
    return parts[0].unionByName(parts[1])


_PAIR_SQL = """(SELECT l_partkey AS p, l_suppkey AS s, {0} AS rid FROM lineitem WHERE l_linestatus = '{1}')"""


@query(f"""WITH a AS {_PAIR_SQL.format(LI_RID, 'F')}, b AS {_PAIR_SQL.format(LI_RID, 'O')},
  d AS (SELECT p, s, row_number() OVER (ORDER BY p, s) - 1 AS r, count(*) OVER () AS n
    FROM (SELECT p, s FROM a INTERSECT SELECT p, s FROM b)),
  m AS (SELECT d.p, d.s, e.p AS p2, e.s AS s2 FROM d JOIN d e ON e.r = {permuted_sql('d.r', 'd.n', 3)}),
  c AS (SELECT 'a' AS side, p, s, coalesce(p2, p) AS p2, coalesce(s2, s) AS s2 FROM a LEFT JOIN m USING (p, s)
    UNION ALL SELECT 'b', p, s, coalesce(p2, p), coalesce(s2, s) FROM b LEFT JOIN m USING (p, s))
  SELECT (SELECT count(*) FROM c x JOIN c y USING (p, s) WHERE x.side = 'a' AND y.side = 'b') AS n_before,
    (SELECT count(*) FROM c x JOIN c y USING (p2, s2) WHERE x.side = 'a' AND y.side = 'b') AS n_after,
    (SELECT count(*) FROM c WHERE (p, s) <> (p2, s2)) AS changed,
    (SELECT sum(p2 * 7 + s2)::BIGINT FROM c) AS checksum""")
def perturb_codependent_compound(t: Tables) -> DataFrame:
    """Compound keys (part, supplier) of shipped and open lines change alike; the join keeps its size."""
    frames, sources = [], {}
    for side, status in (("a", "F"), ("b", "O")):
        rows = t.lineitem.where(F.col("l_linestatus") == status).select(
            *ROW_KEYS["lineitem"], F.struct("l_partkey", "l_suppkey").alias("pair")
        )
        frame = tag(rows, side, ROW_KEYS["lineitem"]).rename({"pair": f"pair_{side}"})
        frames.append(frame.select(f"pair_{side}"))
        plain = rows.select(*ROW_KEYS["lineitem"], F.col("pair.l_partkey").alias("p"), F.col("pair.l_suppkey").alias("s"))
        sources[side] = (Source(side, plain, ROW_KEYS["lineitem"]), ["p", "s"])
    pairs = C.join_groups(*frames, ("pair_a", "pair_b"), "pair", None)
    relation = durable(pairs.withColumn("col", F.lit("p")))
    a, b = P.permute_consistently(sources, relation, 3).values()
    moved = F.count_if((F.col("p") != F.col("new_p")) | (F.col("s") != F.col("new_s"))).alias("changed")
    sums = a.unionByName(b).agg(moved, F.sum(F.col("new_p") * 7 + F.col("new_s")).alias("checksum"))
    old = a.select("p", "s").join(b.select("p", "s"), ["p", "s"]).agg(F.count(F.lit(1)).alias("n_before"))
    keys = ["new_p", "new_s"]
    new = a.select(*keys).join(b.select(*keys), keys).agg(F.count(F.lit(1)).alias("n_after"))
    one = [df.withColumn("__one", F.lit(1)) for df in (old, new, sums)]
    return one[0].join(one[1], "__one").join(one[2], "__one").drop("__one")


COPIES = 9

PICK_SQL = f"""(SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
  ORDER BY {draw_sql(GROUP_SQL.format('c_custkey'), 'pick')}, {GROUP_SQL.format('c_custkey')} LIMIT 1)"""

PICKED_ORDERS_SQL = f"""(SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM {PICK_SQL}))"""


def _copied_sql(table: str, key: str, hit: str) -> str:
    return f"""(SELECT *, {key}::varchar || CASE WHEN copy_no = 0 THEN '' ELSE '+' || copy_no END AS rid FROM
      (SELECT *, unnest(range(0, 1 + CASE WHEN {hit} THEN {COPIES} ELSE 0 END))::int AS copy_no FROM {table}))"""


CUSTOMERS_SQL = _copied_sql("customer", "c_custkey", f"c_custkey IN (SELECT k FROM {PICK_SQL})")
ORDERS_SQL = _copied_sql("orders", "o_orderkey", f"o_orderkey IN (SELECT o_orderkey FROM {PICKED_ORDERS_SQL})")


@query(f"""SELECT 'customer' AS ds, rid, copy_no FROM {CUSTOMERS_SQL}
  UNION ALL SELECT 'orders', rid, copy_no FROM {ORDERS_SQL}""")
def duplicate_codependent(t: Tables) -> DataFrame:
    group = C.pick_group(durable(order_keys(t, None)))
    parts = [
        P.duplicate_group(source(t, name), group, COPIES).select(F.lit(name).alias("ds"), "rid", "copy_no")
        for name in ("customer", "orders")
    ]
    return parts[0].unionByName(parts[1])


def _guided_sql(columns: dict[str, str], key: str, table: str, group: str, grouped: str) -> str:
    after = {c: (text, value_sql(text, wide_sql("rid", c))) for c, text in columns.items()}
    after[key] = (f"{key}::varchar", f"CASE WHEN {grouped} THEN {_key_sql(key, group)} ELSE {key}::varchar END")
    return cells_sql(after, table, "rid")


@query(f"""SELECT 'customer' AS ds, * FROM ({_guided_sql({c: TEXTS[c] for c in ('c_name', 'c_acctbal')}, 'c_custkey',
    CUSTOMERS_SQL, GROUP_SQL.format('c_custkey'), 'c_custkey IN (SELECT o_custkey FROM orders)')})
  UNION ALL SELECT 'orders', * FROM ({_guided_sql({'o_orderpriority': 'o_orderpriority', 'o_orderstatus': 'o_orderstatus'},
    'o_custkey', ORDERS_SQL, GROUP_SQL.format('o_custkey'), 'true')})""")
def perturb_combined(t: Tables) -> DataFrame:
    relation = durable(order_keys(t, None))
    group = C.pick_group(relation)
    sources = {
        "customer": (source(t, "customer"), "c_custkey", ["c_name", "c_acctbal"]),
        "orders": (source(t, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"]),
    }
    changed = P.perturb_together(sources, relation, group, COPIES)
    parts = [df.select(F.lit(name).alias("ds"), "rid", "col", "before", "after") for name, df in changed.items()]
    return parts[0].unionByName(parts[1])


def _fodder_sql(table: str, key: str, column: str) -> str:
    pick = f"(SELECT {key} FROM {table} ORDER BY {draw_sql(key, 'row')}, {key}::varchar LIMIT 1)"
    h = draw_sql("g", "consistent")
    text = f"CASE WHEN {h} % 10 = 0 THEN '<{M.DUMMY}:' || k || '>' ELSE ({h} % 1048576 * 2147483648 + k)::varchar END"
    return f"""SELECT '{table}' AS ds, rid, copy_no, k::varchar AS before, CASE WHEN copy_no = 0 THEN k::varchar ELSE {text} END AS after
      FROM (SELECT *, 'copies:' || ((copy_no - 1) // 3) AS g, id || CASE WHEN copy_no = 0 THEN '' ELSE '+' || copy_no END AS rid
        FROM (SELECT {key}::varchar AS id, {column} AS k,
          unnest(range(0, CASE WHEN {key} = {pick} THEN 10 ELSE 1 END))::int AS copy_no FROM {table}))"""


@query(f"{_fodder_sql('customer', 'c_custkey', 'c_nationkey')} UNION ALL {_fodder_sql('orders', 'o_orderkey', 'o_custkey')}")
def duplicate_keys_values(t: Tables) -> DataFrame:
    """Nine copies of a row of each table in three groups; the keys of a group change together."""
    sources = {"customer": (source(t, "customer"), ["c_nationkey"]), "orders": (source(t, "orders"), ["o_custkey"])}
    rows, relation = P.keyed_copies(sources)
    parts = []
    for name, (own, (column,)) in sources.items():
        changed = P.perturb_consistently(own, relation, column, 0, rows[name])
        parts.append(
            changed.select(
                F.lit(name).alias("ds"), "rid", "copy_no", F.col(column).cast("string").alias("before"),
                F.col(f"new_{column}").alias("after"),
            )
        )
    return parts[0].unionByName(parts[1])


_PART_TEXTS = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type"}


@query(cells_sql(
    {c: (text, scramble_sql(text, wide_sql("p_partkey::varchar", c))) for c, text in _PART_TEXTS.items()}
    | {"p_size": ("p_size::varchar", f"({wide_sql('p_partkey::varchar', 'p_size')} % 50 + 1)::varchar")},
    "part", "p_partkey::varchar",
))
def perturb_declared(t: Tables) -> DataFrame:
    """Cells of a table change as its declaration says: texts freely, sizes within their range."""
    declared = P.declared_categories(schema("part"))
    return P.perturb(P.with_rid(source(t, "part")), list(declared), P.by_schema(declared))
