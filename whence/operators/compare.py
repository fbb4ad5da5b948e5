"""Comparing outputs, finding faulty rows, and coverage of branches by data."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whence.session import durable


def diff_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference of two results: their columns, side (a or b) and n.

    Copies are counted map side and reported as a count, so a row repeated
    without end stays one row here.
    """
    if a.schema.names != b.schema.names:
        raise ValueError(f"outputs differ in columns: {a.columns} and {b.columns}")
    both = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("__w").alias("__w")).where("__w <> 0")
    return net.select(
        *a.columns, F.when(F.col("__w") > 0, "a").otherwise("b").alias("side"), F.abs("__w").alias("n")
    )


def same_output(a: DataFrame, b: DataFrame) -> bool:
    """Equal names, types and rows: the integer 1 is not the text '1'."""
    return a.dtypes == b.dtypes and diff_outputs(a, b).isEmpty()


def diff_columns(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per column, how many keys disagree: col, n. A key on one side alone disagrees in every column."""
    cols = [c for c in a.columns if c not in key]
    here, there = [f"__a_{c}" for c in cols], [f"__b_{c}" for c in cols]
    one = a.select(*key, *[F.col(c).alias(h) for c, h in zip(cols, here)], F.lit(True).alias("__in_a"))
    two = b.select(*key, *[F.col(c).alias(h) for c, h in zip(cols, there)], F.lit(True).alias("__in_b"))
    both = one.join(two, list(key), "full")
    alone = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    counts = both.agg(*[F.count_if(alone | ~F.col(x).eqNullSafe(F.col(y))).alias(c) for c, x, y in zip(cols, here, there)])
    return counts.unpivot([], cols, "col", "n")


#: Ranges of the key hash that have a digest of their own, and how many of them make a branch.
LEAVES, BRANCH = 1 << 14, 1 << 7


def digests(df: DataFrame, key: Sequence[str], side: str) -> DataFrame:
    """leaf, n_<side>, sum_<side>, mix_<side>: number and digest of the rows in each range of the key hash."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    nulls = [F.col(c).isNull() for c in df.columns]
    return df.groupBy(leaf_of(key)).agg(
        F.count(F.lit(1)).alias(f"n_{side}"),
        F.sum(F.xxhash64(*row, *nulls).cast("decimal(38,0)")).alias(f"sum_{side}"),
        F.bit_xor(F.xxhash64(F.lit("mix"), *nulls, *row)).alias(f"mix_{side}"),
    )


def leaf_of(key: Sequence[str]) -> Column:
    """Range of the key hash; printed, so that equal keys of different types share one."""
    printed = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.pmod(F.xxhash64(*printed), F.lit(LEAVES)).cast("int").alias("leaf")


def differing_leaves(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """leaf, branch: the ranges of the key hash whose rows are not all the same on both sides.

    One pass over each side and a table of ``LEAVES`` rows at most. Branches that agree in their
    summed digests are left out before their leaves are looked at.
    """
    both = digests(a, key, "a").join(digests(b, key, "b"), "leaf", "full")
    differs = reduce(Column.__or__, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in ("n", "sum", "mix")])
    return durable(both.withColumn("branch", F.expr(f"leaf div {BRANCH}")).where(differs).select("leaf", "branch"))


def diff_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: key, status (only_a, only_b, changed), n_a and n_b (rows without a like on the other side).

    Only rows in ranges whose digests differ are compared, by counts of equal rows, so repeated
    rows and repeated keys are handled; nothing is paired within a key.
    """
    leaves = differing_leaves(a, b, key).select("leaf")
    sides = []
    for df, side in ((a, 1), (b, 0)):
        open_ = df.withColumn("__leaf", leaf_of(key)).join(leaves.withColumnRenamed("leaf", "__leaf"), "__leaf", "left_semi")
        sides.append(open_.drop("__leaf").withColumns({"__a": F.lit(side), "__b": F.lit(1 - side)}))
    rows = sides[0].unionByName(sides[1]).groupBy(*a.columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    more = [F.greatest(F.col(x) - F.col(y), F.lit(0)) for x, y in (("__a", "__b"), ("__b", "__a"))]
    keyed = rows.groupBy(*key).agg(
        F.sum(more[0]).alias("n_a"), F.sum(more[1]).alias("n_b"), F.sum("__a").alias("__in_a"), F.sum("__b").alias("__in_b")
    )
    status = F.when(F.col("__in_b") == 0, "only_a").when(F.col("__in_a") == 0, "only_b").otherwise("changed")
    return keyed.where("n_a > 0 OR n_b > 0").select(*key, status.alias("status"), "n_a", "n_b")


Run = DataFrame | Callable[[], DataFrame]


def compare_runs(spark: SparkSession, a: Run, b: Run, key: Sequence[str]) -> DataFrame:
    """One row on two runs of a program: status, columns, rows_a, rows_b, only_a, only_b, changed.

    A run is a result or a function that gives one; it counts as failed if it raises, while it is
    built or while it is computed. ``status`` is ``failed a``, ``failed b``, ``failed both``,
    ``schema`` (``columns`` lists names whose types differ or that one side lacks), ``rows`` or
    ``equal``. Results with different columns are not compared row by row.
    """
    found, failed = [], []
    for run, side in ((a, "a"), (b, "b")):
        try:
            found.append(durable(run() if callable(run) else run))
        except PySparkException:
            failed.append(side)
    empty = dict.fromkeys(("rows_a", "rows_b", "only_a", "only_b", "changed"))
    if failed:
        status = "failed both" if len(failed) == 2 else f"failed {failed[0]}"
        return spark.createDataFrame([(status, "", *empty.values())], RUNS)
    kinds = [dict(df.dtypes) for df in found]
    odd = sorted(c for c in kinds[0] | kinds[1] if kinds[0].get(c) != kinds[1].get(c))
    sizes = _beside(*[df.agg(F.count(F.lit(1)).alias(f"rows_{side}")) for df, side in zip(found, "ab")])
    if odd:
        none = [F.lit(None).cast("bigint").alias(c) for c in ("only_a", "only_b", "changed")]
        return sizes.select(F.lit("schema").alias("status"), F.lit(",".join(odd)).alias("columns"), "rows_a", "rows_b", *none)
    rows = diff_rows(found[0], found[1].select(*found[0].columns), key)
    counts = [F.count_if(F.col("status") == c).alias(c) for c in ("only_a", "only_b", "changed")]
    counted = _beside(sizes, rows.agg(*counts))
    status = F.when(F.col("only_a") + F.col("only_b") + F.col("changed") > 0, "rows").otherwise("equal")
    return counted.select(status.alias("status"), F.lit("").alias("columns"), "rows_a", "rows_b", "only_a", "only_b", "changed")


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two relations of one row."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


RUNS = "status string, columns string, rows_a bigint, rows_b bigint, only_a bigint, only_b bigint, changed bigint"


def fault_labels(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks. A rule that is NULL counts as kept."""
    marks = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    return F.array_compact(F.array(*marks))


def split_faulty(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their ``rules``)."""
    marked = df.withColumn("rules", fault_labels(rules))
    return marked.where(F.size("rules") == 0).drop("rules"), marked.where(F.size("rules") > 0)


def fault_counts(df: DataFrame, rules: Mapping[str, Column], rid: Column) -> DataFrame:
    """Per broken rule: rule, n, first_rid."""
    rows = df.select(F.explode(fault_labels(rules)).alias("rule"), rid.alias("rid"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid"))


def failure_summary(failures: DataFrame, key: Sequence[str], batch: str) -> DataFrame:
    """Distinct failures with their count, first batch, and how many distinct
    failures were known by then."""
    # Written: it is read for the counts per batch and again for the failures.
    distinct = durable(failures.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(batch).alias("first_batch")))
    # Runs over one row per batch, not over the failures.
    per_batch = distinct.groupBy("first_batch").agg(F.count(F.lit(1)).alias("new"))
    known = F.sum("new").over(Window.orderBy("first_batch")).alias("known")
    return distinct.join(per_batch.select("first_batch", known), "first_batch")


def coverage(df: DataFrame, branches: Mapping[str, Column]) -> DataFrame:
    """One row: n_rows, covered (branches met by some row), branches."""
    hits = [F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias(f"b{i}") for i, cond in enumerate(branches.values())]
    met = sum((F.coalesce(F.col(f"b{i}"), F.lit(0)) for i in range(len(hits))), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *hits).select(
        "n_rows", met.alias("covered"), F.lit(len(hits)).alias("branches")
    )


def coverage_progress(df: DataFrame, branches: Mapping[str, Column], batch: Column) -> DataFrame:
    """Per batch: branches met in it, and the share met so far.

    The data is reduced to one row per batch first; the running maximum then
    reads only those.
    """
    names = [f"b{i}" for i in range(len(branches))]
    hits = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in zip(names, branches.values())]
    per_batch = df.groupBy(batch.alias("batch")).agg(*hits)
    so_far = Window.orderBy("batch")
    covered = sum((F.col(n) for n in names), F.lit(0))
    running = sum((F.max(n).over(so_far) for n in names), F.lit(0))
    return per_batch.select(
        "batch", covered.alias("covered"), F.round(running / len(names), 6).alias("running_share")
    )


def run_report(failures: DataFrame, key: Sequence[str], batch: str, progress: DataFrame) -> DataFrame:
    """Per batch of a run: failures, distinct ones, those first seen in it, those known by then, and coverage so far.

    ``failures`` has ``key`` and ``batch``; ``progress`` is what ``coverage_progress`` gives. A batch
    without failures stands with zeros.
    """
    seen = durable(failures.groupBy(*key, F.col(batch).alias("batch")).agg(F.count(F.lit(1)).alias("n")))
    per_batch = seen.groupBy("batch").agg(F.sum("n").alias("failures"), F.count(F.lit(1)).alias("distinct_failures"))
    first = seen.groupBy(*key).agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("new_failures"))
    names = ["failures", "distinct_failures", "new_failures"]
    wide = progress.join(per_batch, "batch", "left").join(first, "batch", "left").fillna(0, names)
    # One row per batch.
    known = F.sum("new_failures").over(Window.orderBy("batch"))
    return wide.select("batch", *names, known.alias("known_failures"), "covered", "running_share")


def progress_points(progress: DataFrame) -> DataFrame:
    """Only the batches at which the running share rose."""
    before = F.lag("running_share", 1, -1.0).over(Window.orderBy("batch"))
    return progress.withColumn("__before", before).where("running_share > __before").drop("__before")
