"""Queries of the co-dependence operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions.hashing import coin_sql
from whence.operators import codependence as C
from whence.operators.compare import coverage
from whence.plans.registry import LI_RID, query
from whence.session import durable
from whence.sources.tables import Tables

LI_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def order_keys(t: Tables, cap: int | None) -> DataFrame:
    return C.join_groups(t.tagged("customer"), t.tagged("orders"), ("c_custkey", "o_custkey"), "custkey", cap)


def line_keys(t: Tables, cap: int | None) -> DataFrame:
    return C.join_groups(t.tagged("orders"), t.tagged("lineitem"), ("o_orderkey", "l_orderkey"), "orderkey", cap)


ORDER_KEYS_SQL = """SELECT 'custkey:' || k AS group_id, '==' AS op, ds, col, rid FROM (
  SELECT c_custkey AS k, 'customer' AS ds, 'c_custkey' AS col, c_custkey::varchar AS rid, 1 AS place FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT o_custkey, 'orders', 'o_custkey', o_orderkey::varchar,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer))"""

LINE_KEYS_SQL = f"""SELECT 'orderkey:' || k AS group_id, '==' AS op, ds, col, rid FROM (
  SELECT o_orderkey AS k, 'orders' AS ds, 'o_orderkey' AS col, o_orderkey::varchar AS rid, 1 AS place FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT l_orderkey, 'lineitem', 'l_orderkey', {LI_RID},
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER}) FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""


@query(f"{ORDER_KEYS_SQL} WHERE place <= 3")
def codep_join(t: Tables) -> DataFrame:
    return order_keys(t, 3)


@query(ORDER_KEYS_SQL)
def codep_join_full(t: Tables) -> DataFrame:
    """All rows of every key, hot or not."""
    return order_keys(t, None)


@query(f"""SELECT 'suppkey:' || l_suppkey AS group_id, '==' AS op, 'lineitem' AS ds, 'l_suppkey' AS col,
  {LI_RID} AS rid FROM lineitem""")
def codep_group_full(t: Tables) -> DataFrame:
    return C.group_groups(t.tagged("lineitem"), ["l_suppkey"], "suppkey")


def supplier_groups(t: Tables) -> DataFrame:
    return C.group_groups(t.tagged("lineitem"), ["l_suppkey"], "suppkey", 0.1, 3)


SUPPLIER_GROUPS_SQL = f"""SELECT 'suppkey:' || l_suppkey AS group_id, '==' AS op, 'lineitem' AS ds, 'l_suppkey' AS col,
  {LI_RID} AS rid FROM lineitem WHERE {coin_sql(LI_RID, 'group', 0.1)}
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {LI_ORDER}) <= 3"""


@query(SUPPLIER_GROUPS_SQL)
def codep_group(t: Tables) -> DataFrame:
    return supplier_groups(t)


def large_quantities(t: Tables) -> DataFrame:
    return C.predicate_cells(t.tagged("lineitem"), F.col("l_quantity") > 45, ["l_quantity"], "quantity")


LARGE_SQL = f"""SELECT 'quantity:' || {LI_RID} AS group_id, '==' AS op, 'lineitem' AS ds, 'l_quantity' AS col,
  {LI_RID} AS rid FROM lineitem WHERE l_quantity > 45"""


@query(LARGE_SQL)
def codep_predicate(t: Tables) -> DataFrame:
    return large_quantities(t)


def discount_witness(t: Tables) -> DataFrame:
    return C.gte_witness(t.tagged("lineitem"), "l_discount", "l_tax", "discount>=tax")


GTE_SQL = f"""SELECT 'discount>=tax' AS group_id, '>=' AS op, 'lineitem' AS ds, unnest(['l_discount', 'l_tax']) AS col, rid
  FROM (SELECT {LI_RID} AS rid FROM lineitem WHERE l_discount >= l_tax ORDER BY {LI_ORDER} LIMIT 1)"""


@query(GTE_SQL)
def codep_gte(t: Tables) -> DataFrame:
    return discount_witness(t)


@query(f"""{ORDER_KEYS_SQL} WHERE place <= 3 UNION ALL {SUPPLIER_GROUPS_SQL}
  UNION ALL {LARGE_SQL} UNION ALL {GTE_SQL}""")
def codep_all(t: Tables) -> DataFrame:
    return C.consolidate(order_keys(t, 3), supplier_groups(t), large_quantities(t), discount_witness(t))


# Overlapping groups over the whole customer and order tables: join keys, the same
# keys split by status (inside the former) and customers by nation (crossing them).


def overlapping(t: Tables) -> DataFrame:
    orders = t.tagged("orders")
    by_status = C.group_groups(orders, ["o_custkey", "o_orderstatus"], "status", 1.0, None).where("col = 'o_custkey'")
    customers = t.tagged("customer")
    by_nation = C.group_groups(
        customers.derive("c_custkey", F.col("c_nationkey"), ["c_custkey"]), ["c_custkey"], "nation", 1.0, None
    )
    return C.consolidate(order_keys(t, None), by_status, by_nation)


OVERLAPPING_SQL = f"""(SELECT group_id, ds || '|' || col || '|' || rid AS cell FROM ({ORDER_KEYS_SQL})
  UNION SELECT 'status:' || o_custkey || '-' || o_orderstatus, 'orders|o_custkey|' || o_orderkey FROM orders
  UNION SELECT 'nation:' || c_nationkey, 'customer|c_custkey|' || c_custkey FROM customer)"""


@query(f"""WITH g AS {OVERLAPPING_SQL}, s AS (SELECT group_id, count(*) AS n FROM g GROUP BY group_id),
  same AS (SELECT a.group_id AS x, b.group_id AS y, count(*) AS m FROM g a JOIN g b USING (cell)
    WHERE a.group_id <> b.group_id GROUP BY x, y),
  dropped AS (SELECT x FROM same JOIN s sx ON x = sx.group_id JOIN s sy ON y = sy.group_id
    WHERE m = sx.n AND (sy.n > sx.n OR (sy.n = sx.n AND y < x)))
  SELECT group_id, n FROM s WHERE group_id NOT IN (SELECT x FROM dropped)""")
def codep_drop_subsets(t: Tables) -> DataFrame:
    return C.drop_subsets(overlapping(t)).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE g AS (SELECT group_id, rid || '|' || ds AS node FROM ({ORDER_KEYS_SQL})
    UNION SELECT group_id, rid || '|' || ds FROM ({LINE_KEYS_SQL})),
  link AS (SELECT DISTINCT node, min(node) OVER (PARTITION BY group_id) AS root FROM g),
  both_ways AS (SELECT node AS a, root AS b FROM link UNION SELECT root, node FROM link),
  reach AS (SELECT DISTINCT node AS a, node AS b FROM g
    UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
  SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) GROUP BY component""")
def codep_merge_overlaps(t: Tables) -> DataFrame:
    relation = C.consolidate(order_keys(t, None), line_keys(t, None))
    merged = C.merge_overlaps(relation, unit=("ds", "rid"))
    return merged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


# -- witnesses -------------------------------------------------------------------------


def supplier_lines(t: Tables) -> DataFrame:
    """Cells of the line items that stand for their supplier: its first three of the whole table."""
    return C.group_groups(t.tagged("lineitem"), ["l_suppkey"], "suppkey", cap=3, order=F.asc_nulls_last)


def _witnesses(t: Tables, lines: DataFrame, order: Callable[[str], Column] = F.asc) -> DataFrame:
    """Where the rows went that stand for the join keys and for the groups of ``lines``."""
    # Written: every source's witnesses are read from it.
    relation = durable(C.consolidate(order_keys(t, 3), lines))
    frames = [t.tagged(n) for n in ("customer", "orders", "lineitem")]
    sources = {f.legs[0].name: f.legs[0].source for f in frames}
    return durable(C.row_map(C.witness_ids(relation, 3), sources, order))


def _whole(t: Tables) -> DataFrame:
    """All key cells of the joins, written, as they meet the witnesses by address twice."""
    return durable(C.consolidate(order_keys(t, None), supplier_groups(t)))


def map_sql(lines: str) -> str:
    return f"""(SELECT 'customer' AS ds, c_custkey::varchar AS rid, row_number() OVER (ORDER BY c_custkey) - 1 AS row
    FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'orders', o_orderkey::varchar, row_number() OVER (ORDER BY o_orderkey) - 1 FROM
    (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
     QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3)
  UNION ALL SELECT 'lineitem', {LI_RID}, row_number() OVER (ORDER BY {LI_ORDER}) - 1 FROM
    (SELECT * FROM {lines}
     QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {LI_ORDER}) <= 3))"""


MAP_SQL = map_sql(f"lineitem WHERE {coin_sql(LI_RID, 'group', 0.1)}")


@query(f"SELECT ds, rid, row FROM {map_sql('lineitem')}")
def witness_reduce(t: Tables) -> DataFrame:
    # Ids that are null come last, as in the SQL: of the whole table, many rows of an order meet.
    return _witnesses(t, supplier_lines(t), F.asc_nulls_last)


@query(f"""SELECT group_id, op, ds, col, m.row::varchar AS rid FROM
  (SELECT group_id, op, ds, col, rid FROM ({ORDER_KEYS_SQL}) WHERE rid IS NOT NULL
   UNION ALL SELECT * FROM ({SUPPLIER_GROUPS_SQL})) r JOIN {MAP_SQL} m USING (ds, rid)""")
def codep_remap(t: Tables) -> DataFrame:
    rows = _witnesses(t, supplier_groups(t))
    return C.remap(_whole(t), rows)


@query(f"""SELECT ds, count(*) AS n FROM (SELECT group_id, op, ds, col, rid FROM ({ORDER_KEYS_SQL})
   UNION ALL SELECT * FROM ({SUPPLIER_GROUPS_SQL})) r ANTI JOIN {MAP_SQL} m USING (ds, rid) GROUP BY ds""")
def codep_left_out(t: Tables) -> DataFrame:
    """How many cells of each source stand in no witness row."""
    rows = _witnesses(t, supplier_groups(t))
    rest = C.left_out(_whole(t), rows)
    return rest.groupBy("ds").agg(F.count(F.lit(1)).alias("n"))


def branches() -> dict[str, object]:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return {
        "tiny": price < 1000,
        "small": price < 50_000,
        "huge": price > 499_000,
        "open": status == "O",
        "partial": status == "P",
        "urgent late": (F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 2000),
    }


BRANCHES_SQL = """count(*) AS n_rows, bool_or(o_totalprice < 1000)::int + bool_or(o_totalprice < 50000)::int
  + bool_or(o_totalprice > 499000)::int + bool_or(o_orderstatus = 'O')::int + bool_or(o_orderstatus = 'P')::int
  + bool_or(o_orderpriority = '1-URGENT' AND year(o_orderdate) = 2000)::int AS covered"""


@query(f"""SELECT version, n_rows, covered, 6 AS branches FROM (SELECT 'full' AS version, {BRANCHES_SQL} FROM orders
  UNION ALL SELECT 'reduced', {BRANCHES_SQL} FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3)
  UNION ALL SELECT 'sampled', {BRANCHES_SQL} FROM orders WHERE {coin_sql('o_orderkey', 's', 0.2)})""")
def reduction_report(t: Tables) -> DataFrame:
    """Rows and covered branches of the whole, the reduced and a sampled table."""
    orders = t.tagged("orders")
    source = orders.legs[0].source
    reduced = C.witness_rows(C.witness_ids(order_keys(t, 3), 3), source)
    versions = {"full": source.df, "reduced": reduced, "sampled": orders.hash_sample(0.2).plain}
    parts = [
        coverage(df, branches()).select(F.lit(name).alias("version"), "n_rows", "covered", "branches")
        for name, df in versions.items()
    ]
    return C.consolidate(*parts)
