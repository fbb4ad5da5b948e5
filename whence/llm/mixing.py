"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

Documents belong to leaves of a tree root - domain - language - source. A leaf can give
its tokens ``epochs`` times. The budget flows down the tree: the children of a node share
what it gets by their weights, but none gets more than the leaves below it can give, and
what a child cannot use goes to its siblings by their weights. A node passes on all it
gets, since it never gets more than it can give; so a shortage is made up by siblings
first and reaches the siblings of an ancestor only if they are exhausted too. Shares are
whole tokens, rounded down.

A leaf takes its documents in the order of a seeded hash of (seed, epoch, doc_id): whole
epochs first, then of the next epoch every document before which fewer tokens than the
rest stand. The place of that cut is found from sums over 4096 ranges of the hash and a
look into one range, so no task sees a whole leaf; what leaves the search is one row per
leaf.

NULL languages, sources and texts count as empty strings; a NULL doc_id hashes as an
empty string. Rows that share an id within a leaf are taken together. Leaves without
tokens and children without weight give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.session import durable

LEAF = ["domain", "lang_", "source_"]


def token_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def key_of(seed: int, epoch: Column) -> Column:
    """The seeded order of documents in an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def filled(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``share``: what each child gets of its parent's ``budget``, by ``weight`` up to ``cap``.

    In the order of cap / weight a child is full if the budget that is left after the fuller
    ones, split by weight among the rest, would exceed its cap.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("cap") / F.col("weight")).asc(), *[F.col(c) for c in LEAF if c in children.columns])
    upto = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.coalesce(F.sum("weight").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    full = upto * F.col("weight") + F.col("cap") * after <= F.col("budget") * F.col("weight")
    found = children.withColumn("full", full)
    given = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    found = found.withColumn("given", given).withColumn("rest", rest)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("weight * (budget - given) div rest"))
    return found.withColumn("share", share.cast("bigint")).drop("full", "given", "rest", "budget")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, Column], epochs: int) -> DataFrame:
    """Share of each leaf (domain, lang_, source_, tokens); ``budget`` is an expression on ``total``."""
    weight = [weights[c].cast("bigint") for c in LEAF]
    open_ = (F.col("tokens") > 0) & (weight[0] > 0) & (weight[1] > 0) & (weight[2] > 0)
    tree = leaves.withColumns({f"w_{c}": F.greatest(w, F.lit(1)) for c, w in zip(LEAF, weight)})
    tree = tree.withColumn("cap", F.when(open_, F.col("tokens") * F.lit(epochs).cast("bigint")).otherwise(F.lit(0)))
    # Nodes of the upper levels: few rows, whatever the number of documents.
    got = None
    for depth, level in enumerate(LEAF):
        sums = [F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight"), F.sum("tokens").alias("own")]
        nodes = tree.groupBy(*LEAF[: depth + 1]).agg(*sums)
        if got is None:
            every = Window.partitionBy("root")
            nodes = nodes.withColumn("root", F.lit(1)).withColumn("total", F.sum("own").over(every))
            nodes = nodes.withColumn("budget", F.least(budget.cast("bigint"), F.sum("cap").over(every)))
        else:
            nodes = nodes.join(got, LEAF[:depth])
        shares = filled(nodes, LEAF[:depth] or ["root"])
        got = shares.select(*LEAF[: depth + 1], F.col("share").alias("budget"))
    return tree.filter("tokens > 0").select(*LEAF, "tokens").join(got.withColumnRenamed("budget", "share"), LEAF)


def mixed(
    docs: DataFrame, domain: Column, budget: Column, weights: dict[str, Column], epochs: int = 2, seed: int = 7
) -> DataFrame:
    """``docs`` with a row for every epoch that takes the document, and the columns ``mix_domain`` and ``epoch``.

    Columns of ``docs`` that have these two names give way to them; all others are kept as they are.

    ``domain`` is an expression on the columns of ``docs``; ``weights`` holds expressions on
    the columns domain, lang_ and source_ for each of these levels, whole and not negative.
    """
    empty = F.lit("")
    leaf = {
        "domain": F.coalesce(domain, empty),
        "lang_": F.coalesce(F.col("lang"), empty),
        "source_": F.coalesce(F.col("source"), empty),
    }
    slim = durable(docs.select("doc_id", *[c.alias(n) for n, c in leaf.items()], token_count(F.col("text")).alias("n")))
    leaves = slim.groupBy(*LEAF).agg(F.sum("n").alias("tokens"))
    shares = budgets(leaves, budget, weights, epochs)
    shares = shares.select(*LEAF, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("rest"))
    shares = durable(shares)

    # The cut: the last key of the epoch after the whole ones before which fewer tokens than the rest stand.
    keyed = slim.join(shares.filter("rest > 0"), LEAF).withColumn("key", key_of(seed, F.col("whole")))
    keyed = keyed.withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "range").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    by = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).filter("before < rest")
    last = sums.groupBy(*LEAF).agg(F.max(F.struct("range", "before")).alias("last")).select(*LEAF, "last.range", "last.before")
    within = keyed.join(last, [*LEAF, "range"]).groupBy(*LEAF, "key").agg(
        F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before")
    )
    by = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(by), F.lit(0)))
    cuts = within.filter("before < rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))

    # One row per leaf; as a written table its size is known, so Spark broadcasts it below its own threshold only.
    plan = durable(shares.join(cuts, LEAF, "left"))
    plan = plan.select(*[F.col(c).alias(f"of_{c}") for c in LEAF], "whole", "cut")
    # The rows travel as one column, so that no name of theirs can meet one of these.
    kept = [c for c in docs.columns if c not in ("mix_domain", "epoch")]
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), "doc_id", *[c.alias(n) for n, c in leaf.items()])
    extra = F.when(key_of(seed, F.col("whole")) <= F.col("cut"), 1).otherwise(0)
    on = [F.col(c) == F.col(f"of_{c}") for c in LEAF]
    taken = rows.join(plan, on).withColumn("copies", F.col("whole") + extra).filter("copies > 0")
    epoch = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    return taken.select("row", "domain", epoch.alias("epoch")).select("row.*", F.col("domain").alias("mix_domain"), "epoch")


#: Production parameters: sources ending in an even digit form one domain, the others another.
DOMAIN_WEIGHTS = {"even": 3, "odd": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
EPOCHS = 2
SEED = 7


def production(docs: DataFrame) -> DataFrame:
    """The mix that the registered query and the pipeline use: as many tokens as there are."""
    domain = F.when(F.col("source").rlike("[02468]$"), "even").otherwise("odd")

    def weight(column: str, known: dict[str, int]) -> Column:
        found = F.lit(1)
        for name, w in known.items():
            found = F.when(F.col(column) == name, w).otherwise(found)
        return found

    weights = {"domain": weight("domain", DOMAIN_WEIGHTS), "lang_": weight("lang_", LANGUAGE_WEIGHTS), "source_": F.lit(1)}
    return mixed(docs, domain, F.col("total"), weights, EPOCHS, SEED)
