"""Exact Jaccard join of documents on word n-grams by blocked sparse products.

The documents times n-grams incidence matrix is multiplied with its transpose in blocks:
for a few rows at a time the overlap counts with a block of columns add up in a dense
array, n-gram by n-gram. Size-derived bounds decide what is multiplied at all; with
similarity t, two sets of m <= n items link only if they share at least t * n items:

* A document of which fewer than t * n n-grams occur anywhere else is out.
* Items are put in one order (rarest first). Linked documents share one of the first
  n - ceil(t * n) + 1 items of either, so documents meet through these alone.
* m must be at least t * n.

Equal sets are one row of the matrix. Of the documents that meet under an item, first all
are multiplied with the least one (a product linear in the items), and links found so unite
classes. Where documents that met, directly or through others, are still in several
classes, those outside the largest class are multiplied with all of them in blocks. So
pairs inside a class are never enumerated, and no pair across classes is missed.

NULL, empty and wordless texts have no n-grams and link with nothing. Rows that share an
id count as one document with several sets. A NULL id counts as the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.kernels import Prefix, Words, buffers, distinct, mix, ranges, window_starts
from whence.llm.components import connected_components
from whence.llm.rounds import Group, Rounds, split
from whence.session import durable

SHINGLE = 5
PERCENT = 75
#: Rows and columns of a block of the product.
ROWS = 256
COLUMNS = 1024


def shingles(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text (ascending per text) and their offsets."""
    data, offsets = buffers(texts)
    words = Words(data, offsets)
    prefix = Prefix(words.digests(data, lower=True)[:, 0])
    at = np.flatnonzero(window_starts(words.firsts, size))
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    hashes = np.r_[prefix.hashes(at, at + size), prefix.hashes(words.firsts[short], words.firsts[short + 1])]
    doc = np.r_[np.searchsorted(words.firsts, at, side="right") - 1, short]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    opens = np.ones(len(hashes), bool)
    opens[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[opens], doc[opens]
    return hashes, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def count_groups(sent: list[bytes]) -> list[bytes]:
    """A byte per hash: the number of groups that send it, 255 for more."""
    hashes = np.frombuffer(b"".join(sent), "<u4")
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    counts = np.minimum(count, 255).astype(np.uint8)[back]
    ends = np.cumsum([len(b) // 4 for b in sent])
    return [counts[e - len(b) // 4 : e].tobytes() for b, e in zip(sent, ends)]


def sets_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, id, n, k1, k2 (name of the set), and for those that may link: items, first.

    ``items`` holds the hashes that occur elsewhere, ``first`` those among the leading
    n - ceil(t * n) + 1 in the common order.
    """
    rounds = Rounds(docs)
    parts = rounds.parts

    def ask(group: Group) -> list[tuple[int, bytes]]:
        unique = distinct(shingles(group.own(), size)[0])
        return [(p, unique[a:b].astype("<u4").tobytes()) for p, a, b in split(unique, parts)]

    rounds.round(ask, count_groups)

    def work(group: Group) -> dict:
        hashes, offsets = shingles(group.own(), size)
        unique, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        asked = sum(b - a for _, a, b in split(unique, parts))
        groups = np.frombuffer(b"".join(group.answers.get(1, [])), np.uint8)
        assert len(groups) == asked
        # Ranks follow (groups, hash), the same order for all documents.
        groups, shared = groups[back], ((groups > 1) | (count > 1))[back]
        all_hashes, all_offsets = (hashes, offsets) if not group.copy.any() else shingles(group.texts, size)
        n = np.diff(all_offsets)
        sums = [np.zeros(len(all_hashes) + 1, np.uint64) for _ in range(2)]
        np.cumsum(all_hashes, out=sums[0][1:])
        np.cumsum(mix(all_hashes ^ np.uint64(0xA0761D6478BD642F)), out=sums[1][1:])
        k1, k2 = ((s[all_offsets[1:]] - s[all_offsets[:-1]]).view(np.int64) for s in sums)
        items, first = [None] * len(n), [None] * len(n)
        of = np.r_[0, np.cumsum(shared)]
        enough = (of[offsets[1:]] - of[offsets[:-1]]) * 100 >= percent * np.diff(offsets)
        for i in np.flatnonzero(enough & (np.diff(offsets) > 0)).tolist():
            a, b = offsets[i], offsets[i + 1]
            lead = np.lexsort((hashes[a:b], groups[a:b]))[: b - a - -(-percent * (b - a) // 100) + 1]
            items[i] = hashes[a:b][shared[a:b]].tobytes()
            first[i] = hashes[a:b][lead[shared[a:b][lead]]].view(np.int64)
        ids = (group.ids + np.uint64(base)).view(np.int64)
        return {"doc_id": group.doc_ids, "id": ids, "n": n, "k1": k1, "k2": k2, "items": items, "first": first}

    base = rounds.base % 2**64
    return rounds.each(work, "doc_id bigint, id bigint, n bigint, k1 bigint, k2 bigint, items binary, first array<bigint>")


def product(key, rows, columns, percent: int):
    """Links of a block: pairs of classes with a row and a column that link."""
    empty = np.zeros(0, np.int64)
    found_a, found_b = [empty], [empty]
    if len(rows) and len(columns):
        items = [np.frombuffer(b, np.uint64) for b in columns.column("items").to_pylist()]
        order = np.argsort(flat := np.concatenate(items), kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(items)), [len(x) for x in items])[order]
        n, label = columns.column("n").to_numpy(), columns.column("label").to_numpy()
        own_n, own_label = rows.column("n").to_numpy(), rows.column("label").to_numpy()
        for i, b in enumerate(rows.column("items").to_pylist()):
            near = (n * 100 >= percent * own_n[i]) & (own_n[i] * 100 >= percent * n) & (label != own_label[i])
            if not near.any():
                continue
            own = np.frombuffer(b, np.uint64)
            low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
            overlap = np.bincount(owner[ranges(low, high - low)], minlength=len(n))
            to = distinct(label[near & (overlap * 100 >= percent * (n + own_n[i] - overlap))])
            found_a.append(np.maximum(to, own_label[i]))
            found_b.append(np.minimum(to, own_label[i]))
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def blocks(rows: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """Product of rows and columns (c, id, n, label, items) of one c, dealt over blocks by hash."""
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("r")).join(columns.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "c")
    sizes = sizes.select("c", F.ceil(F.col("r") / ROWS).alias("r"), F.ceil(F.col("m") / COLUMNS).alias("m"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col("r" if own == "i" else "m")).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m" if own == "i" else "r") - 1)).alias(other)
        cols = [F.col(x).alias(x) for x in ("c", "n", "label", "items")]
        return side.join(sizes, "c").select(*cols, block, every)

    left, right = dealt(rows, "i", "j"), dealt(columns, "j", "i")
    keys = ["c", "i", "j"]
    work = lambda key, a, b: product(key, a, b, percent)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "a bigint, b bigint").distinct()


def heads_of(sets: DataFrame) -> DataFrame:
    """k1, k2, head: the least id of each set. Written, so that joins with a set that very many rows have are split."""
    return durable(sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("head")))


def classes(sets: DataFrame, named: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, root): the least id of the class of each id whose class has another id that links."""
    nodes = durable(
        sets.filter("items is not null").join(named, ["k1", "k2"]).filter("id = head").select("id", "n", "items", "first")
    )
    lists = nodes.select("id", "n", F.explode("first").alias("h"))
    heads = lists.groupBy("h").agg(F.min(F.struct("id", "n")).alias("head")).select("h", "head.id", "head.n")
    heads = heads.withColumnsRenamed({"id": "b", "n": "m"})
    met = durable(lists.join(heads, "h").filter("id > b").select(F.col("id").alias("a"), "b", "n", "m").distinct())

    # Every document with the least one under each of its first items.
    fit = met.filter(F.least("n", "m") * 100 >= percent * F.greatest("n", "m"))
    body = nodes.select("id", "n", F.col("id").alias("label"), "items")
    columns = fit.select(F.col("b").alias("c"), F.col("a").alias("id")).join(body, "id")
    rows = fit.select(F.col("b").alias("id")).distinct().join(body, "id").withColumn("c", F.col("id"))
    links = durable(blocks(rows, columns, percent))
    roots = connected_components(links)

    # Documents that met but are in several classes.
    groups = connected_components(met.select("a", "b"))
    members = groups.select(F.col("a").alias("id"), F.col("b").alias("c"))
    members = members.unionByName(members.select(F.col("c").alias("id"), "c").distinct())
    members = members.join(roots.withColumnsRenamed({"a": "id", "b": "root"}), "id", "left")
    members = members.select("id", "c", F.coalesce("root", "id").alias("label"))
    sizes = members.groupBy("c", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("c").agg(F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("k"))
    largest = largest.filter("k > 1").select("c", F.col("most.label").alias("largest"))
    open_ = durable(members.join(largest, "c").join(nodes.select("id", "n", "items"), "id"))
    more = blocks(open_.filter("label <> largest"), open_, percent)

    # Rows that share an id tie their sets together.
    tied = sets.filter("n > 0").join(named, ["k1", "k2"]).groupBy("id").agg(F.min("head").alias("b"), F.max("head").alias("a"))
    every = roots.unionByName(more).unionByName(tied.filter("a > b").select("a", "b"))
    return connected_components(every).withColumnRenamed("b", "root")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id reachable by links from the document."""
    sets = durable(sets_of(docs, size, percent))
    named = heads_of(sets)
    roots = classes(sets, named, percent)
    slim = sets.select("doc_id", "id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    slim = slim.select("doc_id", "n", F.coalesce("head", "id").alias("a")).join(roots, "a", "left")
    # Only a NULL id stands for the least value; it is given back as NULL.
    root = F.coalesce("root", "a")
    return slim.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(root > F.lit(-(2**63)), root).alias("component_id")
    )
