"""Tracked twins of the programs: the source rows behind chosen outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import scalars as S
from whence.operators.frame import LineageFrame
from whence.plans.apps import (
    BRACKET_SQL,
    CLASS_SQL,
    TILE,
    WORDS_SQL,
    age,
    speed,
)
from whence.plans.decision import NET_SQL, WEB, net, ts
from whence.plans.registry import LI_RID, query
from whence.sources.tables import Tables

def count_rows() -> tuple[Column, list[str]]:
    return F.count(F.lit(1)), []


def rids(frame: LineageFrame, flagged: Column | None = None) -> DataFrame:
    """(ds, rid) of every source row behind the flagged outputs."""
    return frame.trace_rids(flagged)


def traced_sql(rows: str, **sources: str) -> str:
    """UNION of the distinct row ids of the named sources in a relation."""
    return f"WITH r AS ({rows}) " + " UNION ALL ".join(
        f"SELECT DISTINCT '{ds}' AS ds, {rid} AS rid FROM r" for ds, rid in sources.items()
    )


# -- programs -----------------------------------------------------------------------


def brackets(t: Tables) -> LineageFrame:
    people = t.tagged("customer").filter(F.col("c_nationkey") == 7)
    labelled = people.derive("label", S.age_bracket(age()), ["c_acctbal"])
    return labelled.agg(["label"], n=count_rows(), mean=(F.avg("c_acctbal"), ["c_acctbal"]))


@query(f"SELECT 'customer' AS ds, c_custkey::varchar AS rid FROM customer WHERE c_nationkey = 7 AND {BRACKET_SQL} = '>65'")
def traced_brackets(t: Tables) -> DataFrame:
    return rids(brackets(t), F.col("label") == ">65")


def class_means(t: Tables) -> LineageFrame:
    trips = t.tagged("lineitem").derive("speed", speed(), ["l_extendedprice", "l_quantity"])
    trips = trips.derive("class", S.speed_class("speed"), ["speed"])
    return trips.agg(["class"], mean=(F.avg("speed"), ["speed"]))


@query(f"SELECT 'lineitem' AS ds, {LI_RID} AS rid FROM lineitem WHERE {CLASS_SQL} = 'onfoot'")
def traced_class_means(t: Tables) -> DataFrame:
    return rids(class_means(t), F.col("mean") < 15)


def delays(t: Tables) -> LineageFrame:
    orders = t.tagged("orders").select("o_orderkey", "o_orderdate")
    lines = t.tagged("lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    bucket = S.delay_bucket(F.datediff("l_shipdate", "o_orderdate"), 30)
    joined = orders.join(lines, [("o_orderkey", "l_orderkey")]).derive("bucket", bucket, ["l_shipdate", "o_orderdate"])
    return joined.filter(F.col("bucket") > 2).agg(["l_returnflag"], n=count_rows())


@query(traced_sql(
    """SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE date_diff('day', o_orderdate, l_shipdate) // 30 > 2 AND l_returnflag = 'A'""",
    orders="o_orderkey::varchar", lineitem=LI_RID))
def traced_delays(t: Tables) -> DataFrame:
    return rids(delays(t), F.col("l_returnflag") == "A")


@query(f"""SELECT 'lineitem' AS ds, {LI_RID} AS rid FROM lineitem WHERE l_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2 AND avg(l_quantity) < 12)""")
def traced_low_means(t: Tables) -> DataFrame:
    orders = t.tagged("lineitem").agg(["l_orderkey"], n=count_rows(), mean=(F.avg("l_quantity"), ["l_quantity"]))
    return rids(orders, (F.col("n") > 2) & (F.col("mean") < 12))


def word_counts(t: Tables) -> LineageFrame:
    lines = t.tagged("documents").flat_map("line", F.split("text", "\n"), ["text"]).select("line")
    words = lines.flat_map("word", S.line_words("line"), ["line"])
    return words.agg(["word"], n=count_rows())


@query(f"""SELECT 'documents' AS ds, doc_id::varchar AS rid FROM {WORDS_SQL} WHERE word IN
  (SELECT word FROM {WORDS_SQL} GROUP BY word HAVING count(*) = 11) GROUP BY doc_id""")
def traced_words(t: Tables) -> DataFrame:
    return rids(word_counts(t), F.col("n") == 11)


@query("SELECT 'orders' AS ds, o_orderkey::varchar AS rid FROM orders WHERE trunc(o_totalprice) < 30000")
def traced_currency_sum(t: Tables) -> DataFrame:
    whole = F.col("o_totalprice").cast("bigint").cast("string")
    amounts = t.tagged("orders").map(v=(S.parse_currency(whole), ["o_totalprice"]))
    return rids(amounts.filter(F.col("v") < 30_000).agg([], total=(F.sum("v"), ["v"])), F.col("total") > 0)


@query(f"""SELECT 'lineitem' AS ds, {LI_RID} AS rid FROM lineitem WHERE l_quantity > 4 AND l_partkey IN
  (SELECT l_partkey FROM lineitem WHERE l_quantity > 4 GROUP BY l_partkey HAVING sum(l_quantity) > 1100)""")
def traced_filtered_sum(t: Tables) -> DataFrame:
    rated = t.tagged("lineitem").filter(F.col("l_quantity") > 4)
    return rids(rated.agg(["l_partkey"], total=(F.sum("l_quantity"), ["l_quantity"])), F.col("total") > 1100)


@query("SELECT 'part' AS ds, p_partkey::varchar AS rid FROM part WHERE p_brand = 'Brand#3' AND p_size * 2 > 40")
def traced_pass_fail(t: Tables) -> DataFrame:
    passed = F.when(F.col("p_size") * 2 > 40, " Pass").otherwise(" Fail")
    graded = t.tagged("part").derive("outcome", F.concat("p_brand", passed), ["p_brand", "p_size"])
    return rids(graded.agg(["outcome"], n=count_rows()), F.col("outcome") == "Brand#3 Pass")


def tracked_boxes(t: Tables, role: str, moved: bool) -> LineageFrame:
    x = F.col("l_partkey") * 37 % 1920
    if moved:
        x = x + F.when(F.col("l_returnflag") == "R", 7).otherwise(0)
    reads = ["l_partkey", "l_orderkey", "l_quantity", "l_linenumber", "l_returnflag"]
    box = S.box(x, F.col("l_orderkey") * 13 % 1080, "l_quantity", F.col("l_linenumber") * 20)
    return t.tagged("lineitem", role).map(**{
        f"{role}_site": (F.col("l_suppkey"), ["l_suppkey"]),
        f"{role}_id": (F.col("l_orderkey") * 8 + F.col("l_linenumber"), ["l_orderkey", "l_linenumber"]),
        f"{role}_kind": (F.col("l_returnflag"), ["l_returnflag"]),
        f"{role}_box": (box, reads),
    })


def _tiles(frame: LineageFrame, role: str) -> LineageFrame:
    b = F.col(f"{role}_box")
    across = F.sequence(S.floor_div(b["x"], F.lit(TILE)), S.floor_div(b["x"] + b["w"], F.lit(TILE)))
    up = F.sequence(S.floor_div(b["y"], F.lit(TILE)), S.floor_div(b["y"] + b["h"], F.lit(TILE)))
    return frame.flat_map(f"{role}_tx", across, [f"{role}_box"]).flat_map(f"{role}_ty", up, [f"{role}_box"])


def box_overlaps(t: Tables) -> LineageFrame:
    """Changed boxes meeting the boxes of their site, with three lineage legs."""
    old, new = tracked_boxes(t, "old", False), tracked_boxes(t, "new", True)
    same = [("new_site", "old_site"), ("new_id", "old_id"), ("new_kind", "old_kind")]
    changed = new.join(old, same).filter(~F.col("new_box").eqNullSafe(F.col("old_box")))
    meets = _tiles(changed, "new").join(
        _tiles(tracked_boxes(t, "other", True), "other"),
        [("new_site", "other_site"), ("new_tx", "other_tx"), ("new_ty", "other_ty")],
    )
    # Touching is asked for first, on plain numbers: most pairs of a tile end there.
    met = meets.filter(S.boxes_touch(F.col("other_box"), F.col("new_box")))
    met = met.derive("cut", S.common_box(F.col("other_box"), F.col("new_box")), ["other_box", "new_box"])
    corner = (S.floor_div(F.col("cut.x"), F.lit(TILE)) == F.col("new_tx")) & (
        S.floor_div(F.col("cut.y"), F.lit(TILE)) == F.col("new_ty")
    )
    return met.filter(corner)


_BOX = """(SELECT *, l_orderkey * 8 + l_linenumber AS box_id, l_orderkey * 13 % 1080 AS y, l_quantity::bigint AS h, l_linenumber * 20 AS w,
  l_partkey * 37 % 1920 AS x0, l_partkey * 37 % 1920 + CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END AS x FROM lineitem)"""


@query(f"""WITH b AS {_BOX}, c AS (SELECT a.*, {LI_RID.replace('l_', 'o.l_')} AS old_rid, {LI_RID.replace('l_', 'a.l_')} AS new_rid
    FROM b a JOIN b o ON a.l_suppkey = o.l_suppkey AND a.box_id = o.box_id AND a.l_returnflag = o.l_returnflag
    WHERE (a.x, a.y, a.h, a.w) <> (o.x0, o.y, o.h, o.w)),
  m AS (SELECT c.old_rid, c.new_rid, {LI_RID.replace('l_', 'o.l_')} AS other_rid, greatest(c.x, o.x) AS cx FROM c JOIN b o
    ON c.l_suppkey = o.l_suppkey AND c.x + c.w >= o.x AND o.x + o.w >= c.x AND c.y + c.h >= o.y AND o.y + o.h >= c.y)
  SELECT DISTINCT 'lineitem' AS ds, unnest([old_rid, new_rid, other_rid]) AS rid FROM m WHERE cx > 1915""")
def traced_boxes(t: Tables) -> DataFrame:
    return rids(box_overlaps(t), F.col("cut.x") > 1915)


# -- decision support ------------------------------------------------------------------


def sales(t: Tables, *columns: str) -> LineageFrame:
    lines = t.tagged("lineitem").select("l_orderkey", *[c for c in columns if c.startswith("l_")])
    orders = t.tagged("orders").select("o_orderkey", *[c for c in columns if c.startswith("o_")])
    return lines.join(orders, [("l_orderkey", "o_orderkey")])


@query(traced_sql(
    """SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       WHERE month(o_orderdate) = 11 AND year(o_orderdate) = 1998 AND p_type = 'ECONOMY' AND p_brand = 'Brand#2'""",
    lineitem=LI_RID, orders="o_orderkey::varchar", part="p_partkey::varchar"))
def traced_q3(t: Tables) -> DataFrame:
    parts = t.tagged("part").filter(F.col("p_type") == "ECONOMY").select("p_partkey", "p_brand")
    rows = sales(t, "l_partkey", "l_extendedprice", "l_discount", "o_orderdate").filter(F.month("o_orderdate") == 11)
    rows = rows.join(parts, [("l_partkey", "p_partkey")]).derive("year", F.year("o_orderdate"), ["o_orderdate"])
    revenue = rows.agg(["year", "p_brand"], revenue=(F.sum(net()), ["l_extendedprice", "l_discount"]))
    return rids(revenue, (F.col("year") == 1998) & (F.col("p_brand") == "Brand#2"))


@query(traced_sql(
    """SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
       WHERE p_size < 20 AND month(o_orderdate) = 11 AND year(o_orderdate) = 1998 AND c_nationkey <> s_nationkey
       AND p_type = 'PROMO'""",
    lineitem=LI_RID, orders="o_orderkey::varchar", customer="c_custkey::varchar", supplier="s_suppkey::varchar",
    part="p_partkey::varchar"))
def traced_q19(t: Tables) -> DataFrame:
    month = (F.month("o_orderdate") == 11) & (F.year("o_orderdate") == 1998)
    rows = (
        sales(t, "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "o_custkey", "o_orderdate")
        .filter(month)
        .join(t.tagged("part").filter(F.col("p_size") < 20).select("p_partkey", "p_type"), [("l_partkey", "p_partkey")])
        .join(t.tagged("customer").select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
        .join(t.tagged("supplier").select("s_suppkey", "s_nationkey"), [("l_suppkey", "s_suppkey")])
        .filter(F.col("c_nationkey") != F.col("s_nationkey"))
    )
    revenue = rows.agg(["p_type"], revenue=(F.sum(net()), ["l_extendedprice", "l_discount"]))
    return rids(revenue, F.col("p_type") == "PROMO")


_WEB_ROWS_SQL = f"""SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')
  AND l_linestatus = '{WEB[3]}' AND l_shipdate BETWEEN TIMESTAMP '{WEB[1]}' AND TIMESTAMP '{WEB[2]}'"""


@query(traced_sql(
    f"""SELECT * FROM ({_WEB_ROWS_SQL}) WHERE p_brand IN (SELECT p_brand FROM (SELECT p_brand,
        sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand) AS share
        FROM ({_WEB_ROWS_SQL}) GROUP BY p_brand, p_partkey) WHERE share > 1)""",
    lineitem=LI_RID, part="p_partkey::varchar"))
def traced_share(t: Tables) -> DataFrame:
    """A share of a total rests on every row of its class: a join of two aggregates."""
    types, low, high, status = WEB
    inside = F.col("l_shipdate").between(ts(low), ts(high)) & (F.col("l_linestatus") == status)
    lines = t.tagged("lineitem").filter(inside).select("l_partkey", "l_extendedprice")
    parts = t.tagged("part").filter(F.col("p_type").isin(*types)).select("p_partkey", "p_brand")
    revenue = lines.join(parts, [("l_partkey", "p_partkey")]).agg(
        ["p_partkey", "p_brand"], total=(F.sum("l_extendedprice"), ["l_extendedprice"])
    )
    classes = revenue.agg(["p_brand"], of_class=(F.sum("total"), ["total"])).rename({"p_brand": "brand"})
    shared = revenue.join(classes, [("p_brand", "brand")]).derive(
        "share", F.col("total") * 100 / F.col("of_class"), ["total", "of_class"]
    )
    return rids(shared, F.col("share") > 1)


_RETURNS_SQL = f"""SELECT o_custkey, l_suppkey, sum({NET_SQL}) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' GROUP BY o_custkey, l_suppkey"""


@query(traced_sql(
    f"""SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_suppkey IN
      (SELECT l_suppkey FROM (SELECT *, avg(total) OVER (PARTITION BY l_suppkey) AS mean FROM ({_RETURNS_SQL}))
       WHERE total > 4 * mean)""",
    lineitem=LI_RID, orders="o_orderkey::varchar"))
def traced_returns(t: Tables) -> DataFrame:
    rows = sales(t, "l_suppkey", "l_returnflag", "l_extendedprice", "l_discount", "o_custkey")
    returned = rows.filter(F.col("l_returnflag") == "R").agg(
        ["o_custkey", "l_suppkey"], total=(F.sum(net()), ["l_extendedprice", "l_discount"])
    )
    means = returned.agg(["l_suppkey"], mean=(F.avg("total"), ["total"])).rename({"l_suppkey": "supplier"})
    high = returned.join(means, [("l_suppkey", "supplier")])
    return rids(high, F.col("total") > 4 * F.col("mean"))
