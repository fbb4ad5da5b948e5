"""The small analytics programs, as DataFrame queries on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.functions import scalars as S
from whence.operators.frame import LineageFrame
from whence.plans.registry import LI_RID, query
from whence.plans.skew import LIST_ROWS, bounded_lists, keyed_join
from whence.session import durable
from whence.sources.tables import ROW_KEYS, Tables

LI_KEY = ROW_KEYS["lineitem"]


def li_rid() -> Column:
    return F.concat_ws("-", *LI_KEY[:-1], F.col("l_shipdate").cast("date").cast("string"))


def age(balance: str = "c_acctbal") -> Column:
    return S.int_div(balance, F.lit(100))


AGE_SQL = "trunc(c_acctbal)::bigint // 100"
BRACKET_SQL = f"""CASE WHEN {AGE_SQL} BETWEEN 40 AND 65 THEN '40-65'
  WHEN {AGE_SQL} >= 20 AND {AGE_SQL} < 40 THEN '20-39'
  WHEN {AGE_SQL} < 20 THEN '0-19' ELSE '>65' END"""

SPEED_SQL = "trunc(l_extendedprice)::bigint // 100 // l_quantity::bigint"
CLASS_SQL = f"""CASE WHEN {SPEED_SQL} > 40 THEN 'car'
  WHEN {SPEED_SQL} > 15 THEN 'public' ELSE 'onfoot' END"""


def speed() -> Column:
    return S.int_div(S.int_div("l_extendedprice", F.lit(100)), "l_quantity")


@query(f"SELECT c_custkey, {BRACKET_SQL} AS label, c_acctbal FROM customer WHERE c_nationkey = 7")
def bracket_filter(t: Tables) -> DataFrame:
    rows = t.customer.where(F.col("c_nationkey") == 7)
    return rows.select("c_custkey", S.age_bracket(age()).alias("label"), "c_acctbal")


@query(f"""SELECT label, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM
  (SELECT {BRACKET_SQL} AS label, c_acctbal FROM customer WHERE c_nationkey = 7) GROUP BY label""")
def bracket_count_avg(t: Tables) -> DataFrame:
    return (
        bracket_filter(t)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    )


@query(f"""SELECT class, round(avg(speed), 4) AS mean_speed FROM
  (SELECT {SPEED_SQL} AS speed, {CLASS_SQL} AS class FROM lineitem) GROUP BY class""")
def ratio_class_avg(t: Tables) -> DataFrame:
    trips = t.lineitem.select(speed().alias("speed"))
    return (
        trips.groupBy(S.speed_class("speed").alias("class"))
        .agg(F.round(F.avg("speed"), 4).alias("mean_speed"))
    )


def class_totals(t: Tables) -> LineageFrame:
    """Speed total per class of the line items of one brand, tracked."""
    parts = t.tagged("part").filter(F.col("p_brand") == "Brand#12").select("p_partkey", "p_brand")
    trips = (
        t.tagged("lineitem")
        .derive("speed", speed(), ["l_extendedprice", "l_quantity"])
        .derive("class", S.speed_class("speed"), ["speed"])
        .select("l_partkey", "speed", "class")
    )
    joined = trips.join(parts, [("l_partkey", "p_partkey")])
    return joined.agg(["class"], total=(F.sum("speed"), ["speed"]))


@query(f"""SELECT class, sum(speed)::bigint AS total FROM
  (SELECT {SPEED_SQL} AS speed, {CLASS_SQL} AS class FROM lineitem JOIN part ON l_partkey = p_partkey
   WHERE p_brand = 'Brand#12') GROUP BY class""")
def ratio_class_join_sum(t: Tables) -> DataFrame:
    return class_totals(t).plain


def customer_orders(t: Tables) -> LineageFrame:
    customers = t.tagged("customer").select("c_custkey", "c_name")
    orders = (
        t.tagged("orders")
        .filter(F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz"))
        .select("o_custkey", "o_orderkey")
    )
    return customers.join(orders, [("c_custkey", "o_custkey")])


def order_counts(t: Tables) -> LineageFrame:
    """Customers with at least three recent orders, tracked."""
    counted = customer_orders(t).agg(["c_custkey"], n_orders=(F.count(F.lit(1)), ["o_orderkey"]))
    return counted.filter(F.col("n_orders") >= 3)


def best_customers(t: Tables) -> LineageFrame:
    return order_counts(t).top(3, F.desc("n_orders"), F.asc("c_custkey"))


def best_customers_plain(t: Tables) -> DataFrame:
    """The untracked twin, for measuring what tracking costs."""
    orders = t.orders.where(F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz"))
    counted = (
        t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    return counted.where("n_orders >= 3").orderBy(F.desc("n_orders"), "c_custkey").limit(3)


TOP_SQL = """SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey
  WHERE o_orderdate > TIMESTAMP '1997-01-01' GROUP BY c_custkey HAVING count(*) >= 3
  ORDER BY n_orders DESC, c_custkey LIMIT 3"""


def rewards(top: DataFrame) -> DataFrame:
    # The window runs over the three rows that are left.
    enough = F.count(F.lit(1)).over(Window.partitionBy()) >= 3
    text = F.concat(F.col("c_custkey").cast("string"), F.lit(" has won $100.0"))
    return top.withColumn("reward", F.when(enough, text).otherwise("not enough data"))


@query(f"""SELECT *, CASE WHEN count(*) OVER () >= 3 THEN c_custkey || ' has won $100.0'
  ELSE 'not enough data' END AS reward FROM ({TOP_SQL})""")
def top_customers(t: Tables) -> DataFrame:
    return rewards(best_customers(t).plain)


@query(f"""SELECT ds, rid FROM (SELECT 'customer' AS ds, c_custkey::varchar AS rid FROM ({TOP_SQL})
  UNION ALL SELECT 'orders', o_orderkey::varchar FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'
  AND o_custkey IN (SELECT c_custkey FROM ({TOP_SQL})))""")
def trace_top_customers(t: Tables) -> DataFrame:
    ids = best_customers(t).trace_ids()
    return ids["customer"].select(F.lit("customer").alias("ds"), F.col("c_custkey").cast("string").alias("rid")).unionByName(
        ids["orders"].select(F.lit("orders").alias("ds"), F.col("o_orderkey").cast("string").alias("rid"))
    )


@query("""SELECT l_returnflag, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE date_diff('day', o_orderdate, l_shipdate) // 30 > 2 GROUP BY l_returnflag""")
def delay_bucket_counts(t: Tables) -> DataFrame:
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    late = S.delay_bucket(F.datediff("l_shipdate", "o_orderdate"), 30) > 2
    return joined.where(late).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_orderkey, part, string_agg(l_suppkey::varchar, ',' ORDER BY l_suppkey) AS suppliers FROM
  (SELECT *, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1) // {LIST_ROWS})::int AS part FROM lineitem
   WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2 AND avg(l_quantity) < 12))
  GROUP BY l_orderkey, part""")
def low_mean_groups(t: Tables) -> DataFrame:
    items = t.lineitem
    low = (
        items.groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"))
        .where("n > 2 AND mean < 12")
        .select("l_orderkey")
    )
    # Few rows of many, read for their counts and again for the lists.
    kept = durable(keyed_join(items.select(*LI_KEY), low, ["l_orderkey"], LI_KEY, "left_semi"))
    lists = bounded_lists(kept, ["l_orderkey"], F.col("l_suppkey"), LI_KEY)
    return lists.select("l_orderkey", "part", F.array_join("items", ",").alias("suppliers"))


def words(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.explode(S.line_words("line")).alias("word"))


WORDS_SQL = r"""(SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(line, '\s+$', ''), '\s')) AS word
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE line = '' OR regexp_replace(line, '\s+$', '') <> '')"""


@query(f"SELECT word, count(*) AS n FROM {WORDS_SQL} GROUP BY word")
def word_count(t: Tables) -> DataFrame:
    return words(t).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT word, count(*) AS n FROM {WORDS_SQL} GROUP BY word HAVING log10(count(*)) > 1")
def frequent_words(t: Tables) -> DataFrame:
    return word_count(t).where(F.log10("n") > 1)


@query("SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents")
def first_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.split("text", "\n")[0].alias("line"))


@query("""SELECT sum(v)::bigint AS total, count(*) AS n
  FROM (SELECT trunc(o_totalprice)::bigint AS v FROM orders) WHERE v < 30000""")
def currency_sum(t: Tables) -> DataFrame:
    whole = F.col("o_totalprice").cast("bigint").cast("string")
    priced = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), F.lpad(whole, 6, "0"))).otherwise(whole)
    amounts = t.orders.select(S.parse_currency(priced).alias("v"))
    return amounts.where("v < 30000").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def nation_places(t: Tables, role: str) -> LineageFrame:
    """Nations with coordinates derived from their key, in one of two roles."""
    key = F.col("n_nationkey")
    placed = t.tagged("nation", role).derive("lat", (key * 7 % 180 - 90).cast("double"), ["n_nationkey"])
    placed = placed.derive("lon", (key * 13 % 360 - 180).cast("double"), ["n_nationkey"])
    return placed.select("n_nationkey", "lat", "lon").rename(
        {"n_nationkey": f"{role}_nation", "lat": f"{role}_lat", "lon": f"{role}_lon"}
    )


def shipments(t: Tables) -> LineageFrame:
    """Line items with the places of their supplier and their customer."""
    items = t.tagged("lineitem").select("l_orderkey", "l_suppkey")
    orders = t.tagged("orders").select("o_orderkey", "o_custkey")
    customers = t.tagged("customer").select("c_custkey", "c_nationkey")
    suppliers = t.tagged("supplier").select("s_suppkey", "s_nationkey")
    return (
        items.join(orders, [("l_orderkey", "o_orderkey")])
        .join(customers, [("o_custkey", "c_custkey")])
        .join(suppliers, [("l_suppkey", "s_suppkey")])
        .join(nation_places(t, "origin"), [("s_nationkey", "origin_nation")])
        .join(nation_places(t, "target"), [("c_nationkey", "target_nation")])
    )


@query(f"""SELECT rid, origin, target, round(2 * atan2(sqrt(a), sqrt(1 - a)) * 6373.0::double * 0.621371::double, 4) AS miles FROM
  (SELECT {LI_RID} AS rid, s_nationkey AS origin, c_nationkey AS target,
    pow(sin((radians(c_nationkey * 7 % 180 - 90) - radians(s_nationkey * 7 % 180 - 90)) / 2), 2)
    + cos(radians(s_nationkey * 7 % 180 - 90)) * cos(radians(c_nationkey * 7 % 180 - 90))
    * pow(sin((radians(c_nationkey * 13 % 360 - 180) - radians(s_nationkey * 13 % 360 - 180)) / 2), 2) AS a
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
   JOIN supplier ON l_suppkey = s_suppkey)""")
def pairwise_haversine(t: Tables) -> DataFrame:
    f = shipments(t)
    miles = S.haversine_miles("origin_lat", "origin_lon", "target_lat", "target_lon")
    return f.df.select(
        f.rid("lineitem").alias("rid"),
        F.col("s_nationkey").alias("origin"),
        F.col("c_nationkey").alias("target"),
        F.round(miles, 4).alias("miles"),
    )


@query(f"""SELECT {LI_RID} AS rid FROM lineitem WHERE (l_partkey % 100 + 1) * (l_partkey % 100 + 1)
  + (l_suppkey % 100 + 1) * (l_suppkey % 100 + 1) < l_quantity::bigint * l_quantity::bigint""")
def inside_circle(t: Tables) -> DataFrame:
    x, y, r = F.col("l_partkey") % 100 + 1, F.col("l_suppkey") % 100 + 1, F.col("l_quantity").cast("bigint")
    return t.lineitem.where(x * x + y * y < r * r).select(li_rid().alias("rid"))


@query("""SELECT o_orderkey, round(o_totalprice * pow(1 + (o_orderkey % 5) / 100.0::double, o_custkey % 40 + 10), 2)
  AS amount FROM orders""")
def compound_growth(t: Tables) -> DataFrame:
    amount = S.compound("o_totalprice", F.col("o_orderkey") % 5 / 100.0, F.col("o_custkey") % 40 + 10)
    return t.orders.select("o_orderkey", F.round(amount, 2).alias("amount"))


@query("SELECT l_partkey, sum(l_quantity)::bigint AS total FROM lineitem WHERE l_quantity > 4 GROUP BY l_partkey")
def filtered_sum(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_quantity > 4")
    return rows.groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("total"))


@query("""WITH RECURSIVE walk AS (SELECT p_partkey AS n, p_partkey AS cur, 1 AS length FROM part WHERE p_partkey > 0
  UNION ALL SELECT n, CASE WHEN cur % 2 = 0 THEN cur // 2 ELSE cur * 3 + 1 END, length + 1 FROM walk
  WHERE cur <> 1 AND length < 30)
  SELECT n, max(length)::int AS length FROM walk GROUP BY n HAVING max(length) = 25""")
def collatz_25(t: Tables) -> DataFrame:
    lengths = t.part.select(F.col("p_partkey").alias("n"), S.collatz_length("p_partkey").alias("length"))
    return lengths.where("length = 25")


@query("""SELECT p_brand || CASE WHEN p_size * 2 > 40 THEN ' Pass' ELSE ' Fail' END AS outcome, count(*) AS n
  FROM part GROUP BY outcome""")
def pass_fail_counts(t: Tables) -> DataFrame:
    passed = F.when(F.col("p_size") * 2 > 40, " Pass").otherwise(" Fail")
    return t.part.groupBy(F.concat("p_brand", passed).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# -- page boxes ----------------------------------------------------------------

TILE = 240


def on_tiles(boxes: DataFrame) -> DataFrame:
    """One copy of a box per screen tile it covers."""
    b = F.col("box")
    spans = [
        F.explode(F.sequence(S.floor_div(b["x"], F.lit(TILE)), S.floor_div(b["x"] + b["w"], F.lit(TILE)))).alias("tx"),
        F.explode(F.sequence(S.floor_div(b["y"], F.lit(TILE)), S.floor_div(b["y"] + b["h"], F.lit(TILE)))).alias("ty"),
    ]
    return boxes.select("*", spans[0]).select("*", spans[1])


def changed_box_overlaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """Boxes that changed, cut with every box of the same site.

    Inputs have columns site, box_id, kind, box. A box that meets nothing has no
    row. Boxes meet inside screen tiles, so a site is never one task and apart
    boxes are never paired; a pair on several tiles counts on the tile that
    holds its lower corner.
    """
    old = before.withColumnsRenamed({"box": "old_box"})
    changed = (
        after.join(old, ["site", "box_id", "kind"])
        .where(~F.col("box").eqNullSafe(F.col("old_box")))
        .select("site", "box_id", "kind", "box")
    )
    others = after.select("site", F.col("box_id").alias("other_id"), F.col("box").alias("other"), "box")
    others = on_tiles(others).drop("box")
    meets = on_tiles(changed).join(others, ["site", "tx", "ty"])
    cut = S.common_box(F.col("other"), F.col("box"))
    corner = (S.floor_div(F.col("cut")["x"], F.lit(TILE)) == F.col("tx")) & (
        S.floor_div(F.col("cut")["y"], F.lit(TILE)) == F.col("ty")
    )
    pairs = meets.where(S.boxes_touch(F.col("other"), F.col("box"))).withColumn("cut", cut).where(corner)
    return pairs.select("site", "box_id", "kind", "other_id", "cut.x", "cut.y", "cut.h", "cut.w")


def item_boxes(t: Tables, moved: bool) -> DataFrame:
    """Screen boxes laid out from line items; ``moved`` shifts the returned ones."""
    x = F.col("l_partkey") * 37 % 1920
    if moved:
        x = x + F.when(F.col("l_returnflag") == "R", 7).otherwise(0)
    return t.lineitem.select(
        F.col("l_suppkey").alias("site"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"),
        F.col("l_returnflag").alias("kind"),
        S.box(x, F.col("l_orderkey") * 13 % 1080, "l_quantity", F.col("l_linenumber") * 20).alias("box"),
    )


def _boxes_sql(shift: str) -> str:
    return f"""(SELECT l_suppkey AS site, l_orderkey * 8 + l_linenumber AS box_id, l_returnflag AS kind,
      l_partkey * 37 % 1920{shift} AS x, l_orderkey * 13 % 1080 AS y, l_quantity::bigint AS h,
      l_linenumber * 20 AS w FROM lineitem)"""


AFTER_SQL = _boxes_sql(" + CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END")


@query(f"""SELECT c.site, c.box_id, c.kind, o.box_id AS other_id, greatest(c.x, o.x) AS x, greatest(c.y, o.y) AS y,
  least(c.y + c.h, o.y + o.h) - greatest(c.y, o.y) AS h, least(c.x + c.w, o.x + o.w) - greatest(c.x, o.x) AS w
  FROM (SELECT a.* FROM {AFTER_SQL} a JOIN {_boxes_sql("")} b
    ON a.site = b.site AND a.box_id = b.box_id AND a.kind = b.kind
    WHERE (a.x, a.y, a.h, a.w) <> (b.x, b.y, b.h, b.w)) c
  JOIN {AFTER_SQL} o ON c.site = o.site AND c.x + c.w >= o.x AND o.x + o.w >= c.x
    AND c.y + c.h >= o.y AND o.y + o.h >= c.y""")
def box_changes_intersections(t: Tables) -> DataFrame:
    return changed_box_overlaps(item_boxes(t, False), item_boxes(t, True))
