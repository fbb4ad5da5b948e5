"""Decision-support queries: star joins, shares, disjunctive filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions.scalars import between_exclusive
from whence.plans.registry import LI_RID, query
from whence.plans.skew import with_group_stats
from whence.session import durable
from whence.sources.tables import ROW_KEYS, Tables

NET_SQL = "l_extendedprice * (1 - l_discount)"


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def sales(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"""WITH ctr AS (SELECT o_custkey, l_suppkey, sum({NET_SQL}) AS total FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_returnflag = 'R' AND s_nationkey < 5 GROUP BY o_custkey, l_suppkey)
  SELECT DISTINCT c_custkey, c_name FROM ctr c1 JOIN customer ON o_custkey = c_custkey
  WHERE total > 1.2 * (SELECT avg(total) FROM ctr c2 WHERE c1.l_suppkey = c2.l_suppkey)
  ORDER BY c_custkey LIMIT 100""")
def tpcds_q1(t: Tables) -> DataFrame:
    returned = sales(t).where("l_returnflag = 'R'")
    stores = t.supplier.where("s_nationkey < 5")
    totals = (
        returned.join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.sum(net()).alias("total"))
    )
    # Written: the means join back to it, and its hot keys are looked for.
    totals = durable(totals)
    compared = with_group_stats(totals, ["l_suppkey"], [F.avg("total").alias("mean")], ["o_custkey", "l_suppkey"])
    above = compared.where("total > 1.2 * mean").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(above, "c_custkey", "left_semi").select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


@query(f"""SELECT year(o_orderdate) AS year, p_brand, round(sum({NET_SQL}), 4) AS revenue FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE month(o_orderdate) = 11 AND p_type = 'ECONOMY' GROUP BY year(o_orderdate), p_brand
  ORDER BY year, revenue DESC, p_brand LIMIT 100""")
def tpcds_q3(t: Tables) -> DataFrame:
    rows = sales(t).where(F.month("o_orderdate") == 11).join(
        t.part.where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey")
    )
    return (
        rows.groupBy(F.year("o_orderdate").alias("year"), "p_brand")
        .agg(F.round(F.sum(net()), 4).alias("revenue"))
        .orderBy("year", F.desc("revenue"), "p_brand")
        .limit(100)
    )


@query("""SELECT n_name, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part p ON l_partkey = p_partkey
  WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 3
    AND p_retailprice > 1.03 * (SELECT avg(p_retailprice) FROM part j WHERE j.p_type = p.p_type)
  GROUP BY n_name HAVING count(*) >= 10 ORDER BY cnt, n_name LIMIT 100""")
def tpcds_q6(t: Tables) -> DataFrame:
    month = (F.year("o_orderdate") == 1998) & (F.month("o_orderdate") == 3)
    dear = with_group_stats(
        t.part.select("p_partkey", "p_type", "p_retailprice"),
        ["p_type"],
        [F.avg("p_retailprice").alias("mean")],
        ["p_partkey"],
    ).where("p_retailprice > 1.03 * mean")
    rows = (
        sales(t).where(month)
        .join(dear, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return (
        rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("cnt"))
        .where("cnt >= 10").orderBy("cnt", "n_name").limit(100)
    )


@query("""SELECT p_partkey, round(avg(l_quantity), 8) AS agg1, round(avg(l_extendedprice), 8) AS agg2,
  round(avg(l_discount), 8) AS agg3, round(avg(l_tax), 8) AS agg4 FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  WHERE c_mktsegment = 'BUILDING' AND year(o_orderdate) = 1997
    AND (o_orderpriority = '1-URGENT' OR l_returnflag = 'N')
  GROUP BY p_partkey ORDER BY p_partkey LIMIT 100""")
def tpcds_q7(t: Tables) -> DataFrame:
    promoted = (F.col("o_orderpriority") == "1-URGENT") | (F.col("l_returnflag") == "N")
    rows = (
        sales(t).where((F.year("o_orderdate") == 1997) & promoted)
        .join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    )
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    means = [F.round(F.avg(m), 8).alias(f"agg{i}") for i, m in enumerate(measures, 1)]
    return rows.groupBy("p_partkey").agg(*means).orderBy("p_partkey").limit(100)


def class_share(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Revenue per part and its share, in percent, of the class (brand) revenue."""
    revenue = (
        rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_partkey", "p_type", "p_brand")
        .agg(F.sum("l_extendedprice").alias("total"))
    )
    shared = with_group_stats(durable(revenue), ["p_brand"], [F.sum("total").alias("of_class")], ["p_partkey"])
    return (
        shared.select(
            "p_partkey", "p_type", "p_brand",
            F.round("total", 2).alias("revenue"),
            F.round(F.col("total") * 100 / F.col("of_class"), 4).alias("share"),
        )
        .orderBy("p_type", "p_brand", "p_partkey")
        .limit(100)
    )


def _share_sql(types: Sequence[str], low: str, high: str, status: str) -> str:
    listed = ", ".join(f"'{x}'" for x in types)
    return f"""SELECT p_partkey, p_type, p_brand, round(total, 2) AS revenue,
      round(total * 100 / sum(total) OVER (PARTITION BY p_brand), 4) AS share FROM
      (SELECT p_partkey, p_type, p_brand, sum(l_extendedprice) AS total FROM lineitem
       JOIN part ON l_partkey = p_partkey WHERE p_type IN ({listed}) AND l_linestatus = '{status}'
       AND l_shipdate BETWEEN TIMESTAMP '{low}' AND TIMESTAMP '{high}' GROUP BY p_partkey, p_type, p_brand)
      ORDER BY p_type, p_brand, p_partkey LIMIT 100"""


WEB = (["ECONOMY", "STANDARD", "PROMO"], "1998-02-01", "1998-03-03", "O")
CATALOG = (["MEDIUM", "SMALL", "LARGE"], "1997-05-01", "1997-05-31", "F")


def _share(t: Tables, types: Sequence[str], low: str, high: str, status: str) -> DataFrame:
    inside = F.col("l_shipdate").between(ts(low), ts(high)) & (F.col("l_linestatus") == status)
    return class_share(t.lineitem.where(inside), t.part.where(F.col("p_type").isin(*types)))


@query(_share_sql(*WEB))
def tpcds_q12(t: Tables) -> DataFrame:
    return _share(t, *WEB)


@query(_share_sql(*CATALOG))
def tpcds_q20(t: Tables) -> DataFrame:
    return _share(t, *CATALOG)


@query("""SELECT round(avg(l_quantity), 4) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price,
  round(avg(l_discount), 6) AS mean_discount, round(sum(l_extendedprice), 2) AS total, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE year(o_orderdate) = 1999 AND (
    (c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW' AND l_extendedprice BETWEEN 10000 AND 15000)
    OR (c_mktsegment = 'HOUSEHOLD' AND o_orderpriority = '1-URGENT' AND l_extendedprice BETWEEN 5000 AND 10000)
    OR (c_mktsegment = 'BUILDING' AND o_orderpriority = '2-HIGH' AND l_extendedprice BETWEEN 15000 AND 20000))
  AND ((c_nationkey IN (1, 2, 3, 4, 5) AND l_quantity BETWEEN 10 AND 20)
    OR (c_nationkey IN (6, 7, 8, 9, 10) AND l_quantity BETWEEN 15 AND 30)
    OR (c_nationkey IN (11, 12, 13, 14, 15, 16, 17, 18) AND l_quantity BETWEEN 5 AND 25))""")
def tpcds_q13(t: Tables) -> DataFrame:
    def buyer(segment: str, priority: str, low: int, high: int) -> Column:
        return (
            (F.col("c_mktsegment") == segment)
            & (F.col("o_orderpriority") == priority)
            & F.col("l_extendedprice").between(low, high)
        )

    def place(first: int, last: int, low: int, high: int) -> Column:
        return F.col("c_nationkey").isin(*range(first, last + 1)) & F.col("l_quantity").between(low, high)

    wanted = (
        buyer("MACHINERY", "5-LOW", 10000, 15000)
        | buyer("HOUSEHOLD", "1-URGENT", 5000, 10000)
        | buyer("BUILDING", "2-HIGH", 15000, 20000)
    ) & (place(1, 5, 10, 20) | place(6, 10, 15, 30) | place(11, 18, 5, 25))
    rows = sales(t).where(F.year("o_orderdate") == 1999).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where(wanted).agg(
        F.round(F.avg("l_quantity"), 4).alias("mean_quantity"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.count(F.lit(1)).alias("n"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE quarter(o_orderdate) = 2 AND year(o_orderdate) = 1998
    AND (c_nationkey IN (1, 4, 9, 16) OR n_regionkey IN (2, 3) OR l_extendedprice > 90000)
  GROUP BY n_name ORDER BY n_name LIMIT 100""")
def tpcds_q15(t: Tables) -> DataFrame:
    wanted = (
        F.col("c_nationkey").isin(1, 4, 9, 16) | F.col("n_regionkey").isin(2, 3) | (F.col("l_extendedprice") > 90000)
    )
    rows = (
        sales(t).where((F.quarter("o_orderdate") == 2) & (F.year("o_orderdate") == 1998))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .where(wanted)
    )
    return rows.groupBy("n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy("n_name").limit(100)


@query(f"""SELECT p_brand, p_type, round(sum({NET_SQL}), 4) AS revenue FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE p_size < 20 AND month(o_orderdate) = 11 AND year(o_orderdate) = 1998 AND c_nationkey <> s_nationkey
  GROUP BY p_brand, p_type ORDER BY revenue DESC, p_brand, p_type LIMIT 100""")
def tpcds_q19(t: Tables) -> DataFrame:
    rows = (
        sales(t).where((F.month("o_orderdate") == 11) & (F.year("o_orderdate") == 1998))
        .join(t.part.where("p_size < 20"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
    )
    return (
        rows.groupBy("p_brand", "p_type").agg(F.round(F.sum(net()), 4).alias("revenue"))
        .orderBy(F.desc("revenue"), "p_brand", "p_type").limit(100)
    )


@query(f"""SELECT {LI_RID} AS rid, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE
  (p_size > 1 AND p_size < 15 AND l_quantity > 1 AND l_quantity < 11 AND l_returnflag = 'A')
  OR (p_size > 10 AND p_size < 30 AND l_quantity > 10 AND l_quantity < 20 AND l_returnflag IN ('N', 'R'))
  OR (p_size > 40 AND l_quantity > 20 AND l_quantity < 30)""")
def disjunctive_filter(t: Tables) -> DataFrame:
    size, quantity, flag = F.col("p_size"), F.col("l_quantity"), F.col("l_returnflag")
    wanted = (
        (between_exclusive(size, 1, 15) & between_exclusive(quantity, 1, 11) & (flag == "A"))
        | (between_exclusive(size, 10, 30) & between_exclusive(quantity, 10, 20) & flag.isin("N", "R"))
        | ((size > 40) & between_exclusive(quantity, 20, 30))
    )
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).where(wanted)
    key = ROW_KEYS["lineitem"]
    rid = F.concat_ws("-", *key[:-1], F.col("l_shipdate").cast("date").cast("string"))
    return rows.select(rid.alias("rid"), "p_partkey")
