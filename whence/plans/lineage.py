"""Queries of the lineage operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.functions import scalars as S
from whence.functions.hashing import coin_sql, poisson_sql
from whence.operators import influence as I
from whence.operators import lineage_sets as L
from whence.operators.combine import Combiner
from whence.operators.frame import LineageFrame, tag
from whence.plans.apps import (
    BRACKET_SQL,
    CLASS_SQL,
    TOP_SQL,
    age,
    best_customers,
    class_totals,
)
from whence.plans.registry import LI_RID, query
from whence.plans.skew import LIST_ROWS
from whence.session import scratch_dir
from whence.sources.tables import Tables
from whence.sources.text import parse, read_lines, tag_lines, write_lines

LI_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def items(t: Tables) -> LineageFrame:
    return t.tagged("lineitem")


# -- sources and sinks -----------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey::varchar AS rid FROM orders")
def tag_rows(t: Tables) -> DataFrame:
    f = t.tagged("orders").select("o_orderkey")
    return f.df.select("o_orderkey", f.rid("orders").alias("rid"))


@query("""SELECT 'customer' AS ds, col, rid, value FROM (
  SELECT c_custkey::varchar AS rid, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS col,
    unnest([c_custkey::varchar, c_name, c_nationkey::varchar, c_acctbal::varchar, c_mktsegment]) AS value FROM customer)""")
def tag_cells(t: Tables) -> DataFrame:
    return t.tagged("customer").to_cells()


@query("SELECT c_custkey, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def parse_delimited(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    lines = t.customer.select(F.concat_ws(",", "c_custkey", quoted, "c_nationkey", "c_acctbal").alias("value"))
    return parse(lines, "c_custkey bigint, name string, nation int, balance double", quotes=True).drop("name")


@query("SELECT s_suppkey, s_name FROM supplier")
def sink_roundtrip(t: Tables) -> DataFrame:
    path = write_lines(t.supplier.select("s_suppkey", "s_name"), scratch_dir(t.spark, "suppliers"))
    return parse(read_lines(t.spark, path), "s_suppkey bigint, s_name string")


@query("""SELECT o_orderkey, o_orderkey::varchar AS orders_rid, 'orders.o_orderkey,orders.o_orderpriority' AS cols
  FROM orders WHERE o_orderpriority = '1-URGENT'""")
def result_with_lineage(t: Tables) -> DataFrame:
    urgent = t.tagged("orders").select("o_orderkey", "o_orderpriority").filter(F.col("o_orderpriority") == "1-URGENT")
    return urgent.with_lineage(cells=True).drop("o_orderpriority")


# -- narrow operators ------------------------------------------------------------


@query("""SELECT o_orderkey, trunc(o_totalprice)::bigint // 1000 AS k, o_orderkey::varchar AS orders_rid,
  'orders.o_orderkey,orders.o_totalprice' AS cols FROM orders""")
def map_lineage(t: Tables) -> DataFrame:
    mapped = t.tagged("orders").map(
        o_orderkey=(F.col("o_orderkey"), ["o_orderkey"]),
        k=(S.int_div("o_totalprice", F.lit(1000)), ["o_totalprice"]),
    )
    return mapped.with_lineage(cells=True)


@query("""SELECT unnest(string_split(text, ' ')) AS word, doc_id::varchar AS documents_rid FROM documents""")
def flatmap_lineage(t: Tables) -> DataFrame:
    f = t.tagged("documents").select("text").flat_map("word", F.split("text", " "), ["text"])
    return f.select("word").with_lineage()


@query(f"SELECT {LI_RID} AS lineitem_rid, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_lineage(t: Tables) -> DataFrame:
    return items(t).filter(F.col("l_quantity") > 45).select("l_quantity").with_lineage()


@query(f"SELECT c_custkey, {BRACKET_SQL} AS label FROM customer")
def bracket_label(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.age_bracket(age()).alias("label"))


@query("""SELECT doc_id, coalesce(try_cast(substr(source, 4) AS double), 0) AS v,
  coalesce(try_cast(lang AS double), 0) AS w, coalesce(string_split(text, ' ')[401], 'error') AS e FROM documents""")
def tolerant_cast(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        S.to_double_or_zero(F.substr(F.col("source"), F.lit(4))).alias("v"),
        S.to_double_or_zero("lang").alias("w"),
        S.item_or(F.split("text", " "), 400).alias("e"),
    )


@query(f"""SELECT {LI_RID} AS lineitem_rid, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS net,
  'lineitem.l_discount,lineitem.l_extendedprice,lineitem.l_tax' AS cols FROM lineitem""")
def derive_column_lineage(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    f = items(t).derive("net", F.round(net, 6), ["l_extendedprice", "l_discount", "l_tax"])
    return f.select("net").with_lineage(cells=True)


@query(f"""SELECT {LI_RID} AS lineitem_rid, greatest(l_discount, l_tax) AS v,
  CASE WHEN l_discount >= l_tax THEN 'lineitem.l_discount' ELSE 'lineitem.l_tax' END AS won FROM lineitem""")
def winner_lineage(t: Tables) -> DataFrame:
    return items(t).winner("v", "won", "l_discount", "l_tax").select("v", "won").with_lineage()


@query(f"""SELECT {LI_RID} AS rid, 'lineitem.l_discount,lineitem.l_extendedprice,lineitem.l_tax' AS cols,
  2 AS n_parts FROM lineitem""")
def nested_lineage(t: Tables) -> DataFrame:
    nested = F.struct("l_extendedprice", F.array("l_tax", "l_discount").alias("rates"))
    f = items(t).derive("nested", nested, ["l_extendedprice", "l_tax", "l_discount"]).select("nested")
    return f.df.select(
        f.rid("lineitem").alias("rid"),
        F.lit(f.cols_text("nested")).alias("cols"),
        F.size("nested.rates").alias("n_parts"),
    )


# -- joins and aggregates ---------------------------------------------------------


@query("""SELECT c_custkey::varchar AS customer_rid, o_orderkey::varchar AS orders_rid, o_totalprice
  FROM customer JOIN orders ON c_custkey = o_custkey""")
def join_lineage(t: Tables) -> DataFrame:
    customers = t.tagged("customer").select("c_custkey")
    orders = t.tagged("orders").select("o_custkey", "o_totalprice")
    return customers.join(orders, [("c_custkey", "o_custkey")]).select("o_totalprice").with_lineage()


def customer_spend(t: Tables) -> LineageFrame:
    orders = t.tagged("orders").select("o_custkey", "o_totalprice")
    return orders.agg(["o_custkey"], total=(F.sum("o_totalprice"), ["o_totalprice"]))


@query("SELECT o_custkey, o_orderkey::varchar AS orders_rid FROM orders")
def agg_lineage_edges(t: Tables) -> DataFrame:
    return customer_spend(t).edges()


@query("""SELECT l_returnflag, sum(l_quantity)::bigint AS total, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag""")
def reduce_by_key_lineage(t: Tables) -> DataFrame:
    total = F.sum("l_quantity").cast("bigint")
    return items(t).agg(["l_returnflag"], count_as="n_rows", total=(total, ["l_quantity"])).plain


@query("""SELECT l_linestatus, round(avg(l_quantity), 8) AS mean, count(*) AS n_rows FROM lineitem GROUP BY l_linestatus""")
def aggregate_by_key_lineage(t: Tables) -> DataFrame:
    mean = F.round(F.sum("l_quantity") / F.count("l_quantity"), 8)
    return items(t).agg(["l_linestatus"], count_as="n_rows", mean=(mean, ["l_quantity"])).plain


#: Orders with the part of their customer's list that they stand in.
PARTS_SQL = f"""(SELECT *, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::varchar) - 1) // {LIST_ROWS})::int AS part
  FROM orders)"""


@query(f"""SELECT o_custkey, part, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey::varchar) AS rids
  FROM {PARTS_SQL} GROUP BY o_custkey, part""")
def group_by_key_lineage(t: Tables) -> DataFrame:
    lists = t.tagged("orders").group_lists(["o_custkey"], F.col("o_totalprice"))
    return lists.select("o_custkey", "part", F.array_join("items.rid", ",").alias("rids"))


@query(f"""SELECT o_custkey, part, string_agg(o_orderkey::varchar || '=' ||
    (round(o_totalprice * 200))::bigint::varchar, ',' ORDER BY o_orderkey::varchar) AS elements, count(*)::int AS n
  FROM {PARTS_SQL} GROUP BY o_custkey, part""")
def group_elements_lineage(t: Tables) -> DataFrame:
    lists = t.tagged("orders").group_lists(["o_custkey"], F.col("o_totalprice"), "price")

    def doubled(item: Column) -> Column:
        cents = F.round(item["price"] * 200).cast("bigint").cast("string")
        return F.concat(item["rid"], F.lit("="), cents)

    elements = F.array_join(F.transform("items", doubled), ",")
    return lists.select("o_custkey", "part", elements.alias("elements"), F.size("items").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def distinct_lineage(t: Tables) -> DataFrame:
    return items(t).select("l_returnflag", "l_linestatus").distinct().edge_counts()


# -- order and samples -------------------------------------------------------------


@query("SELECT o_orderkey::varchar AS orders_rid, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_lineage(t: Tables) -> DataFrame:
    f = t.tagged("orders").select("o_orderkey", "o_totalprice").sort(F.desc("o_totalprice"), F.asc("o_orderkey"))
    return f.select("o_totalprice").with_lineage()


@query("""SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::int AS place, o_orderkey::varchar AS orders_rid,
  o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def topk_lineage(t: Tables) -> DataFrame:
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    top = t.tagged("orders").select("o_orderkey", "o_totalprice").top(10, *order)
    # The window numbers the ten rows that are left.
    place = F.row_number().over(Window.orderBy(*order))
    return top.derive("place", place).with_lineage().drop("o_orderkey")


@query(f"SELECT {LI_RID} AS lineitem_rid FROM lineitem WHERE {coin_sql(LI_RID, 's', 0.1)}")
def hash_sample(t: Tables) -> DataFrame:
    return items(t).select().hash_sample(0.1).with_lineage()


@query(f"""SELECT 'lineitem' AS ds, {LI_RID} AS rid FROM lineitem WHERE {coin_sql(LI_RID, 's', 0.05, 7)}
  UNION ALL SELECT 'orders', o_orderkey::varchar FROM orders WHERE {coin_sql('o_orderkey', 's', 0.05, 7)}""")
def sample_sources(t: Tables) -> DataFrame:
    """One sample share, split evenly over the sources."""
    frames = [items(t).select(), t.tagged("orders").select()]
    drawn = [f.hash_sample(0.1 / len(frames), seed=7) for f in frames]
    parts = [
        d.df.select(F.lit(d.legs[0].name).alias("ds"), d.rid(d.legs[0].name).alias("rid")) for d in drawn
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"""SELECT rid AS orders_rid, c_name, o_totalprice FROM (SELECT o_orderkey::varchar AS rid, *,
    unnest(range(0, {poisson_sql('o_orderkey', 'draw', 0.8, 5)})) AS i FROM orders) JOIN customer ON o_custkey = c_custkey""")
def resample_with_replacement(t: Tables) -> DataFrame:
    """Orders drawn 0.8 times each on average; a join below sees the very same draw."""
    drawn = t.tagged("orders").select("o_custkey", "o_totalprice").sample(0.8, 5, replacement=True)
    customers = t.tagged("customer").select("c_custkey", "c_name")
    joined = drawn.join(customers, [("o_custkey", "c_custkey")]).select("c_name", "o_totalprice")
    return joined.with_lineage().drop("customer_rid")


@query("""SELECT o_orderkey::varchar AS orders_rid, o_totalprice FROM orders
  ORDER BY md5(concat_ws(':', o_orderkey, 'take', '3')), o_orderkey LIMIT 200""")
def sample_exact_k(t: Tables) -> DataFrame:
    return t.tagged("orders").take_sample(200, 3).select("o_totalprice").with_lineage()


@query(f"""SELECT 'orders' AS ds, o_orderkey::varchar AS rid FROM orders WHERE {poisson_sql('o_orderkey', 'draw', 0.3, 9)} > 0
  AND o_orderstatus = 'F'""")
def traced_resample(t: Tables) -> DataFrame:
    """A trace of a draw with replacement finds the rows that were drawn."""
    drawn = t.tagged("orders").sample(0.3, 9, replacement=True)
    counts = drawn.agg(["o_orderstatus"], n=(F.count(F.lit(1)), []))
    return counts.trace_rids(F.col("o_orderstatus") == "F")


@query("""SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::varchar AS lines_rid, c_mktsegment AS segment, c_nationkey AS nation
  FROM customer WHERE c_nationkey < 9""")
def tag_text_lines(t: Tables) -> DataFrame:
    """Key-less text: a line is known by its number in its files, from the scan alone."""
    small = t.customer.where("c_nationkey < 9").select("c_custkey", "c_nationkey", "c_mktsegment").orderBy("c_custkey")
    path = write_lines(small, scratch_dir(t.spark, "lines"))
    lines = tag_lines(t.spark, path, "lines")
    part = F.split("value", ",")
    fields = lines.derive("nation", part[1].cast("int"), ["value"]).derive("segment", part[2], ["value"])
    return fields.select("segment", "nation").with_lineage()


# -- influence ---------------------------------------------------------------------

def _kept(influence: I.Influence, t: Tables) -> DataFrame:
    f = items(t).agg(["l_partkey"], influence, total=(F.sum("l_extendedprice"), ["l_extendedprice"]))
    return f.edges()


def _ranked_sql(order: str, n: int) -> str:
    return f"""SELECT l_partkey, {LI_RID} AS lineitem_rid FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {order}, {LI_ORDER}) <= {n}"""


_ALL_SQL = f"SELECT l_partkey, {LI_RID} AS lineitem_rid FROM lineitem"

INFLUENCE = {
    "influence_all": (lambda: I.everything(), _ALL_SQL),
    "influence_max": (lambda: I.largest(F.col("l_extendedprice")), _ranked_sql("l_extendedprice DESC", 1)),
    "influence_min": (lambda: I.smallest(F.col("l_extendedprice")), _ranked_sql("l_extendedprice", 1)),
    "influence_top_n": (lambda: I.top_n(F.col("l_extendedprice"), 3), _ranked_sql("l_extendedprice DESC", 3)),
    "influence_bottom_n": (lambda: I.bottom_n(F.col("l_extendedprice"), 3), _ranked_sql("l_extendedprice", 3)),
    "influence_abs_top_n": (
        lambda: I.abs_top_n(F.col("l_quantity") - 25, 3),
        _ranked_sql("abs(l_quantity - 25) DESC", 3),
    ),
    "influence_union": (
        lambda: I.any_of(I.largest(F.col("l_extendedprice")), I.bottom_n(F.col("l_extendedprice"), 2)),
        f"""{_ranked_sql("l_extendedprice DESC", 1)} UNION {_ranked_sql("l_extendedprice", 2)}""",
    ),
    "influence_filter": (lambda: I.keep_if(F.col("l_quantity") > 45), f"{_ALL_SQL} WHERE l_quantity > 45"),
    "influence_converted": (
        lambda: I.top_n(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2),
        _ranked_sql("l_extendedprice * (1 - l_discount) DESC", 2),
    ),
    "influence_outlier": (
        lambda: I.outliers(F.col("l_quantity"), 2.0),
        f"""SELECT l_partkey, {LI_RID} AS lineitem_rid FROM lineitem
          QUALIFY stddev_pop(l_quantity) OVER (PARTITION BY l_partkey) > 0
          AND abs(l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey))
            >= 2.0::double * stddev_pop(l_quantity) OVER (PARTITION BY l_partkey)""",
    ),
    "influence_max_ties": (
        lambda: I.largest_with_ties(F.col("l_quantity")),
        f"{_ALL_SQL} QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) = 1",
    ),
    "influence_min_ties": (
        lambda: I.smallest_with_ties(F.col("l_quantity")),
        f"{_ALL_SQL} QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity) = 1",
    ),
}

INFLUENCE["custom_tracker"] = (
    lambda: I.extremes("l_quantity", 2),
    f"""{_ranked_sql("l_quantity DESC", 2)} UNION {_ranked_sql("l_quantity", 2)}""",
)

for _name, (_influence, _sql) in INFLUENCE.items():
    query(_sql, _name)(lambda t, make=_influence: _kept(make(), t))


@query("""SELECT l_suppkey, sum(l_quantity)::bigint AS total, max(l_quantity)::bigint AS largest, count(*) AS n_rows
  FROM lineitem GROUP BY l_suppkey""")
def combiner_lineage(t: Tables) -> DataFrame:
    """A combiner of one's own (create, add, merge, finish) with the rows below each group."""
    totals = items(t).combine(["l_suppkey"], ["l_quantity"], quantities())
    counts = totals.edge_counts().withColumnRenamed("l_suppkey", "key")
    return totals.plain.join(counts, F.col("l_suppkey") == F.col("key")).drop("key")


def quantities() -> Combiner:
    def add(state, rows):
        values = rows.column("l_quantity").to_numpy()
        total, largest = state or (0.0, 0.0)
        return total + float(values.sum()), max(largest, float(values.max()))

    return Combiner(
        add, lambda a, b: (a[0] + b[0], max(a[1], b[1])),
        lambda state: {"total": [int(state[0])], "largest": [int(state[1])]}, "total bigint, largest bigint",
    )


@query("""SELECT 'lineitem' AS ds, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    strftime(l_shipdate, '%Y-%m-%d')) AS rid FROM lineitem WHERE l_suppkey = 3""")
def traced_combiner(t: Tables) -> DataFrame:
    return items(t).combine(["l_suppkey"], ["l_quantity"], quantities()).trace_rids(F.col("l_suppkey") == 3)


_LINES_SQL = """(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::int AS place FROM documents)"""


def long_lines():
    """(place, size) of the lines of a text that have over 400 characters."""

    class LongLines:
        def eval(self, text: str):
            for place, line in enumerate((text or "").split("\n")):
                if len(line) > 400:
                    yield place, len(line)

    return F.udtf(LongLines, returnType="place int, size int", useArrow=True)


def measured_lines(t: Tables) -> LineageFrame:
    return t.tagged("documents").select("text", "lang").table_function(long_lines(), ["text"], ["place", "size"])


@query(f"""SELECT doc_id::varchar AS documents_rid, place, length(line)::int AS size FROM {_LINES_SQL} WHERE length(line) > 400""")
def udtf_lineage(t: Tables) -> DataFrame:
    """Rows of a table function carry the pointer of the row that they come from."""
    return measured_lines(t).select("place", "size").with_lineage()


@query(f"""SELECT DISTINCT 'documents' AS ds, 'text' AS col, doc_id::varchar AS rid FROM {_LINES_SQL}
  WHERE length(line) > 400 AND place = 0""")
def traced_udtf(t: Tables) -> DataFrame:
    longest = measured_lines(t).agg(["place"], size=(F.max("size"), ["size"]))
    return longest.cells(flagged=F.col("place") == 0)


# -- sets and traces ----------------------------------------------------------------


def flag_edges(t: Tables, cond: Column) -> DataFrame:
    f = items(t).filter(cond).select("l_returnflag")
    return f.agg(["l_returnflag"]).edges()


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 40 OR l_discount > 0.05
  GROUP BY l_returnflag""")
def lineage_merge(t: Tables) -> DataFrame:
    merged = L.merge(flag_edges(t, F.col("l_quantity") > 40), flag_edges(t, F.col("l_discount") > 0.05))
    return merged.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, bool_and(NOT (l_quantity > 40 AND l_shipdate < TIMESTAMP '2000-01-01')
    OR (l_discount > 0.05 OR l_returnflag = 'R')) AS contains FROM lineitem
  WHERE (l_discount > 0.05 OR l_returnflag = 'R') OR (l_quantity > 40 AND l_shipdate < TIMESTAMP '2000-01-01')
  GROUP BY l_returnflag, l_linestatus""")
def lineage_contains(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    rows = items(t)
    outer = rows.filter((F.col("l_discount") > 0.05) | (F.col("l_returnflag") == "R")).agg(keys).edges()
    early = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    inner = rows.filter((F.col("l_quantity") > 40) & early).agg(keys).edges()
    return L.contains(outer, inner, keys)


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def lineage_bitmap_count(t: Tables) -> DataFrame:
    sets = L.bitmaps(t.events, ["event_type"], "event_id")
    return L.bitmap_sizes(sets, ["event_type"])


@query("""SELECT event_type, count(DISTINCT event_id) AS n FROM events WHERE value > 50 OR user_id < 20 GROUP BY event_type""")
def lineage_bitmap_union(t: Tables) -> DataFrame:
    a = L.bitmaps(t.events.where("value > 50"), ["event_type"], "event_id")
    b = L.bitmaps(t.events.where("user_id < 20"), ["event_type"], "event_id")
    return L.bitmap_sizes(L.bitmap_union(a, b, ["event_type"]), ["event_type"])


@query(f"""SELECT DISTINCT ds, col FROM (SELECT 'customer' AS ds, 'c_custkey' AS col FROM ({TOP_SQL})
  UNION ALL SELECT 'orders', 'o_orderkey' FROM ({TOP_SQL}))""")
def lineage_columns(t: Tables) -> DataFrame:
    return best_customers(t).touched()


@query(f"""SELECT 'customer' AS ds, 'c_custkey' AS col, c_custkey::varchar AS rid FROM ({TOP_SQL})
  UNION ALL SELECT 'orders', 'o_orderkey', o_orderkey::varchar FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'
  AND o_custkey IN (SELECT c_custkey FROM ({TOP_SQL}))""")
def lineage_cells(t: Tables) -> DataFrame:
    return best_customers(t).cells()


_BUYERS_SQL = "(SELECT o_orderpriority, count(DISTINCT (c_name, c_mktsegment)) AS n FROM {0} GROUP BY o_orderpriority)"
_BUYS_SQL = "(SELECT DISTINCT o_orderpriority, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE {0})"


@query(f"""WITH a AS {_BUYS_SQL.format("o_orderstatus = 'F'")}, b AS {_BUYS_SQL.format('o_totalprice > 300000')},
  i AS (SELECT * FROM a INTERSECT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b)
  SELECT o_orderpriority, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(i.n, 0) AS n_both, u.n AS n_either,
    coalesce(a.n, 0) - coalesce(i.n, 0) AS n_only_a
  FROM {_BUYERS_SQL.format('u')} u LEFT JOIN {_BUYERS_SQL.format('a')} a USING (o_orderpriority)
  LEFT JOIN {_BUYERS_SQL.format('b')} b USING (o_orderpriority) LEFT JOIN {_BUYERS_SQL.format('i')} i USING (o_orderpriority)""")
def lineage_bitmap_algebra(t: Tables) -> DataFrame:
    """Sets of customers, known by two text columns, as bitmaps over one dictionary: and, or, and-not."""
    customers = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    bought = t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rid = ["c_name", "c_mktsegment"]
    ids = L.id_dictionary(customers, rid)
    sets = [
        L.keyed_bitmaps(bought.where(cond), ["o_orderpriority"], rid, ids)
        for cond in ("o_orderstatus = 'F'", "o_totalprice > 300000")
    ]
    return L.bitmap_algebra(*sets, ["o_orderpriority"])


_NATIONS_SQL = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'"""


@query(f"""SELECT DISTINCT 'nation' AS ds, 'n_name' AS col, c_nationkey::varchar AS rid FROM {_NATIONS_SQL} AND s_nationkey < 5
  UNION SELECT DISTINCT 'nation', 'n_regionkey', s_nationkey::varchar FROM {_NATIONS_SQL} AND s_nationkey < 5
  UNION SELECT DISTINCT 'nation', 'n_nationkey', s_nationkey::varchar FROM {_NATIONS_SQL} AND s_nationkey < 5
  UNION SELECT DISTINCT 'supplier', 's_nationkey', s_suppkey::varchar FROM {_NATIONS_SQL} AND s_nationkey < 5""")
def cells_two_roles(t: Tables) -> DataFrame:
    """One source in two roles: the buyer's nation is read for its name, the seller's for its region."""
    buyers = t.tagged("nation", "buyer").select("n_nationkey", "n_name").rename({"n_nationkey": "b_key", "n_name": "buyer"})
    sellers = t.tagged("nation", "seller").select("n_nationkey", "n_regionkey").rename({"n_nationkey": "s_key"})
    lines = items(t).filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_suppkey")
    rows = (
        lines.join(t.tagged("orders").select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")])
        .join(t.tagged("customer").select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
        .join(t.tagged("supplier").select("s_suppkey", "s_nationkey"), [("l_suppkey", "s_suppkey")])
        .join(buyers, [("c_nationkey", "b_key")])
        .join(sellers, [("s_nationkey", "s_key")])
        .derive("seller", F.least("s_nationkey", "s_key"), ["s_nationkey", "s_key"])
        .agg(["seller", "n_regionkey"], names=(F.max("buyer"), ["buyer"]))
    )
    return rows.cells(flagged=F.col("seller") < 5)


@query("""SELECT c_custkey::varchar AS customer_rid, o_orderkey::varchar AS orders_rid, c_custkey, o_totalprice
  FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey""")
def left_join_lineage(t: Tables) -> DataFrame:
    """A row without a partner has no lineage on that side."""
    dear = t.tagged("orders").filter(F.col("o_totalprice") > 400_000).select("o_custkey", "o_totalprice")
    joined = t.tagged("customer").select("c_custkey").join(dear, [("c_custkey", "o_custkey")], "left")
    return joined.select("c_custkey", "o_totalprice").with_lineage()


@query("""SELECT 'customer' AS ds, c_custkey::varchar AS rid FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT 'orders', o_orderkey::varchar FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey = 3 AND o_totalprice > 400000""")
def traced_left_join(t: Tables) -> DataFrame:
    dear = t.tagged("orders").filter(F.col("o_totalprice") > 400_000).select("o_custkey", "o_totalprice")
    joined = t.tagged("customer").select("c_custkey", "c_nationkey").join(dear, [("c_custkey", "o_custkey")], "left")
    nations = joined.agg(["c_nationkey"], total=(F.sum("o_totalprice"), ["o_totalprice"]))
    return nations.trace_rids(F.col("c_nationkey") == 3)


@query("""SELECT c_custkey::varchar AS customer_rid, c_custkey FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def anti_join_lineage(t: Tables) -> DataFrame:
    dear = t.tagged("orders").filter(F.col("o_totalprice") > 300_000)
    return t.tagged("customer").select("c_custkey").join(dear, [("c_custkey", "o_custkey")], "left_anti").with_lineage()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 450000 AND o_orderstatus = 'F'")
def trace_back_filter(t: Tables) -> DataFrame:
    f = t.tagged("orders").filter(F.col("o_totalprice") > 450000).select("o_orderkey", "o_orderstatus")
    return f.trace_back(F.col("o_orderstatus") == "F")["orders"].select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN
  (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 4000000)""")
def trace_back_agg(t: Tables) -> DataFrame:
    rows = customer_spend(t).trace_back(F.col("total") > 4_000_000)["orders"]
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


_PUBLIC_SQL = f"""SELECT lineitem.*, part.* FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_brand = 'Brand#12' AND {CLASS_SQL} = 'public'"""


@query(f"""SELECT 'lineitem' AS ds, {LI_RID} AS rid, round(l_extendedprice, 2) AS price FROM ({_PUBLIC_SQL})
  UNION ALL SELECT DISTINCT 'part', p_partkey::varchar, p_retailprice FROM ({_PUBLIC_SQL})""")
def trace_back_join(t: Tables) -> DataFrame:
    rows = class_totals(t).trace_back(F.col("class") == "public")
    lines = tag(rows["lineitem"], "lineitem", t.tagged("lineitem").legs[0].source.key)
    parts = tag(rows["part"], "part", ["p_partkey"])
    return lines.df.select(
        F.lit("lineitem").alias("ds"), lines.rid("lineitem").alias("rid"), F.col("l_extendedprice").alias("price")
    ).unionByName(
        parts.df.select(F.lit("part").alias("ds"), parts.rid("part").alias("rid"), F.col("p_retailprice").alias("price"))
    )


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN
  (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 4000000)""")
def trace_row_ids(t: Tables) -> DataFrame:
    return customer_spend(t).trace_ids(F.col("total") > 4_000_000)["orders"]


@query("SELECT o_custkey::varchar AS spend_rid, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def retag(t: Tables) -> DataFrame:
    again = customer_spend(t).retag("spend", ["o_custkey"])
    return again.derive("total", F.round("total", 2), ["total"]).select("total").with_lineage()


@query("""WITH s AS (SELECT l_suppkey, avg(l_quantity) < 25 AS flagged FROM lineitem GROUP BY l_suppkey),
  m AS (SELECT flagged AS t, l_quantity < 3 AS f FROM lineitem JOIN s USING (l_suppkey)),
  c AS (SELECT count(*) FILTER (t AND f) AS tp, count(*) FILTER (t AND NOT f) AS fp,
    count(*) FILTER (f AND NOT t) AS fn FROM m)
  SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def fault_trace_report(t: Tables) -> DataFrame:
    means = items(t).agg(["l_suppkey"], mean=(F.avg("l_quantity"), ["l_quantity"]))
    return L.fault_report(means, F.col("mean") < 25, "lineitem", F.col("l_quantity") < 3)


@query(f"""SELECT 'none' AS level, 0 * count(DISTINCT p_partkey) AS n FROM part
  UNION ALL SELECT 'row', (SELECT count(*) FROM ({_ALL_SQL.replace('FROM lineitem', "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12'")}))
    + (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12')
  UNION ALL SELECT 'cell', 2 * count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12'""")
def lineage_levels(t: Tables) -> DataFrame:
    totals = class_totals(t)
    return reduce(DataFrame.unionByName, [L.entries(totals, level) for level in ("none", "row", "cell")])
