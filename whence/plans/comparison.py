"""Queries of the comparison, fault and coverage operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import scalars as S
from whence.operators import compare as D
from whence.plans.apps import CLASS_SQL, LI_KEY, SPEED_SQL, li_rid, speed
from whence.plans.registry import LI_RID, query
from whence.plans.skew import with_group_stats
from whence.sources.tables import Tables

INT_MAX = 2**31 - 1

CLASS_MUTANT_SQL = CLASS_SQL.replace("> 40", ">= 40").replace("> 15", ">= 15")


def classes(t: Tables, mutant: bool) -> DataFrame:
    s = F.col("speed")
    fast, quick = (s >= 40, s >= 15) if mutant else (s > 40, s > 15)
    label = S.bracket(s, [(fast, "car"), (quick, "public")], "onfoot")
    return t.lineitem.select("l_partkey", speed().alias("speed")).select("l_partkey", "speed", label.alias("class"))


@query(f"""WITH a AS (SELECT l_partkey, {SPEED_SQL} AS speed, {CLASS_SQL} AS class, count(*) AS n FROM lineitem GROUP BY ALL),
  b AS (SELECT l_partkey, {SPEED_SQL} AS speed, {CLASS_MUTANT_SQL} AS class, count(*) AS n FROM lineitem GROUP BY ALL),
  d AS (SELECT l_partkey, speed, class, coalesce(a.n, 0) - coalesce(b.n, 0) AS net
    FROM a FULL JOIN b USING (l_partkey, speed, class))
  SELECT l_partkey, speed, class, CASE WHEN net > 0 THEN 'a' ELSE 'b' END AS side, abs(net)::bigint AS n FROM d WHERE net <> 0""")
def diff_outputs(t: Tables) -> DataFrame:
    """A program against its mutant (``>`` turned into ``>=``)."""
    return D.diff_outputs(classes(t, False), classes(t, True))


@query(f"""SELECT unnest(['class', 'speed']) AS col,
  unnest([count(*) FILTER ({CLASS_SQL} <> {CLASS_MUTANT_SQL}), 0]) AS n FROM lineitem""")
def diff_columns(t: Tables) -> DataFrame:
    def labelled(mutant: bool) -> DataFrame:
        s = F.col("speed")
        fast, quick = (s >= 40, s >= 15) if mutant else (s > 40, s > 15)
        label = S.bracket(s, [(fast, "car"), (quick, "public")], "onfoot").alias("class")
        return t.lineitem.select(*LI_KEY, speed().alias("speed")).select(*LI_KEY, label, "speed")

    return D.diff_columns(labelled(False), labelled(True), LI_KEY)


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders, and a run of which some rows are missing, some changed and some new."""
    a = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    b = a.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", price)
    return a, b.unionByName(a.where("o_orderkey % 101 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))


_RUNS_SQL = """a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders),
  b AS (SELECT k, CASE WHEN k % 89 = 0 THEN p + 1 ELSE p END AS p FROM a WHERE k % 97 <> 0
    UNION ALL SELECT -k, p FROM a WHERE k % 101 = 0),
  d AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b'
    WHEN a.p <> b.p THEN 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k)"""


@query(f"""WITH {_RUNS_SQL} SELECT 'rows' AS status, '' AS columns, (SELECT count(*) FROM a) AS rows_a,
  (SELECT count(*) FROM b) AS rows_b, count(*) FILTER (status = 'only_a') AS only_a,
  count(*) FILTER (status = 'only_b') AS only_b, count(*) FILTER (status = 'changed') AS changed FROM d""")
def compare_runs(t: Tables) -> DataFrame:
    a, b = _runs(t)
    return D.compare_runs(t.spark, a, lambda: b, ["o_orderkey"])


@query(f"""WITH {_RUNS_SQL} SELECT k AS o_orderkey, status, (status <> 'only_b')::int::bigint AS n_a,
  (status <> 'only_a')::int::bigint AS n_b FROM d WHERE status IS NOT NULL""")
def diff_rows(t: Tables) -> DataFrame:
    return D.diff_rows(*_runs(t), ["o_orderkey"])


def rules() -> dict[str, Column]:
    """Conditions under which a row would break the programs."""
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return {
        "group size": F.col("order_lines") > 9,
        "not a number": F.isnan(F.sqrt(F.lit(0.05) - tax)),
        # Compared in 64 bits: a failing 32-bit product costs an exception per row.
        "overflow": price.cast("bigint") * (F.col("l_quantity") * 1000).cast("bigint") > INT_MAX,
        "prefix": F.concat("l_returnflag", "l_linestatus").startswith("NO") & (F.col("l_quantity") > 49),
        "price range": S.between_exclusive(price, 20_000, 20_500),
        "zero divisor": F.col("l_discount") == 0,
    }


RULES_SQL = {
    "group size": "order_lines > 9",
    "not a number": "l_tax > 0.05::double",
    "overflow": "trunc(l_extendedprice) * trunc(l_quantity * 1000) > 2147483647",
    "prefix": "l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 49",
    "price range": "l_extendedprice > 20000 AND l_extendedprice < 20500",
    "zero divisor": "l_discount = 0",
}
_MARKS_SQL = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in RULES_SQL.items())
MARKED_SQL = f"""(SELECT *, list_filter([{_MARKS_SQL}], lambda x: x IS NOT NULL) AS rules FROM
  (SELECT *, {LI_RID} AS rid, count(*) OVER (PARTITION BY l_orderkey) AS order_lines FROM lineitem))"""


def checked_lines(t: Tables) -> DataFrame:
    return with_group_stats(t.lineitem, ["l_orderkey"], [F.count(F.lit(1)).alias("order_lines")], LI_KEY)


@query(f"SELECT rule, count(*) AS n, min(rid) AS first_rid FROM (SELECT rid, unnest(rules) AS rule FROM {MARKED_SQL}) GROUP BY rule")
def fault_rules(t: Tables) -> DataFrame:
    return D.fault_counts(checked_lines(t), rules(), li_rid())


@query(f"SELECT rid, array_to_string(rules, ',') AS rules FROM {MARKED_SQL} WHERE len(rules) > 0")
def quarantine(t: Tables) -> DataFrame:
    _, bad = D.split_faulty(checked_lines(t), rules())
    return bad.select(li_rid().alias("rid"), F.array_join("rules", ",").alias("rules"))


@query(f"SELECT rid FROM {MARKED_SQL} WHERE len(rules) = 0")
def fault_free(t: Tables) -> DataFrame:
    good, _ = D.split_faulty(checked_lines(t), rules())
    return good.select(li_rid().alias("rid"))


@query(f"""WITH f AS (SELECT unnest(rules) AS rule, l_returnflag AS message, strftime(l_shipdate, '%Y-%m') AS batch FROM {MARKED_SQL}),
  d AS (SELECT rule, message, count(*) AS n, min(batch) AS first_batch FROM f GROUP BY rule, message)
  SELECT first_batch, rule, message, n,
    (SELECT count(*) FROM d e WHERE e.first_batch <= d.first_batch) AS known FROM d""")
def failure_summary(t: Tables) -> DataFrame:
    marked = checked_lines(t).select(
        F.explode(D.fault_labels(rules())).alias("rule"),
        F.col("l_returnflag").alias("message"),
        F.date_format("l_shipdate", "yyyy-MM").alias("batch"),
    )
    return D.failure_summary(marked, ["rule", "message"], "batch")


def branches() -> dict[str, Column]:
    s = speed()
    return {
        "car": s > 40,
        "public": (s <= 40) & (s > 15),
        "onfoot": s <= 15,
        "stopped": s == 0,
        "record": s > 900,
        "free returns": (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0) & (F.col("l_discount") == 0),
        "never": F.col("l_quantity") > 50,
    }


BATCH_SQL = f"""(SELECT strftime(l_shipdate, '%Y-%m') AS batch, list_transform([bool_or({SPEED_SQL} > 40),
    bool_or({SPEED_SQL} <= 40 AND {SPEED_SQL} > 15), bool_or({SPEED_SQL} <= 15), bool_or({SPEED_SQL} = 0),
    bool_or({SPEED_SQL} > 900), bool_or(l_returnflag = 'R' AND l_tax = 0 AND l_discount = 0), bool_or(l_quantity > 50)],
    lambda x: x::int) AS hits FROM lineitem GROUP BY batch)"""
PROGRESS_SQL = f"""(SELECT b.batch, list_sum(b.hits)::int AS covered,
    round(({' + '.join(f'max(e.hits[{i}])' for i in range(1, 8))}) / 7.0::double, 6) AS running_share
  FROM {BATCH_SQL} b JOIN {BATCH_SQL} e ON e.batch <= b.batch GROUP BY b.batch, b.hits)"""


@query(f"SELECT batch, covered, running_share FROM {PROGRESS_SQL}")
def branch_coverage(t: Tables) -> DataFrame:
    return D.coverage_progress(t.lineitem, branches(), F.date_format("l_shipdate", "yyyy-MM"))


@query(f"""WITH f AS (SELECT unnest(rules) AS rule, l_returnflag AS message, strftime(l_shipdate, '%Y-%m') AS batch FROM {MARKED_SQL}),
  b AS (SELECT batch, count(*) AS n, count(DISTINCT (rule, message)) AS d FROM f GROUP BY batch),
  s AS (SELECT batch, count(*) AS n FROM (SELECT min(batch) AS batch FROM f GROUP BY rule, message) GROUP BY batch)
  SELECT p.batch, coalesce(b.n, 0)::bigint AS failures, coalesce(b.d, 0)::bigint AS distinct_failures,
    coalesce(s.n, 0)::bigint AS new_failures, (sum(coalesce(s.n, 0)) OVER (ORDER BY p.batch))::bigint AS known_failures,
    covered, running_share FROM {PROGRESS_SQL} p LEFT JOIN b USING (batch) LEFT JOIN s USING (batch)""")
def run_report(t: Tables) -> DataFrame:
    """Failures and coverage of a run, month by month."""
    failures = checked_lines(t).select(
        F.explode(D.fault_labels(rules())).alias("rule"), F.col("l_returnflag").alias("message"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    )
    return D.run_report(failures, ["rule", "message"], "month", branch_coverage(t))


@query(f"""SELECT batch, covered, running_share FROM {PROGRESS_SQL}
  QUALIFY running_share > coalesce(lag(running_share) OVER (ORDER BY batch), -1)""")
def coverage_points(t: Tables) -> DataFrame:
    return D.progress_points(branch_coverage(t))
