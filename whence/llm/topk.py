"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: component x becomes floor(scale * x). The
rows to search are dealt over blocks by a hash of their id and kept in each block as
postings, term by term; queries form blocks in the same way. For a pair of blocks every
term of the queries scatters its weighted postings into a dense array of scores, one
row per query; the k best of a row are selected by partition, and the bests of all
blocks merge by a window per query. Every query meets every row exactly once, so the
result is exact; memory in a task is that of two blocks and their scores.

Vectors that are NULL, hold NULL, NaN or infinite components, or have a NULL id take no
part. Shorter vectors count as ending in zeros. Rows that share an id count as one, the
one with the greatest vector. A score that does not fit 64 bits raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors to a block of queries and to a block of rows.
QUERIES = 512
ROWS = 4096


def packed(vectors: DataFrame, block: str, count: int) -> DataFrame:
    """One row per block: its ids, ascending, and the weights as a matrix, both as bytes."""

    def pack(key, rows):
        rows = rows.sort_by("id")
        found = rows.column("w").combine_chunks()
        lengths = np.diff(found.offsets.to_numpy())
        matrix = np.zeros((len(rows), int(lengths.max(initial=0))), np.int64)
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = found.flatten().to_numpy(zero_copy_only=False)
        return pa.table({block: [key[0].as_py()], "ids": [rows.column("id").to_numpy().tobytes()], "weights": [matrix.tobytes()]})

    dealt = vectors.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(count)))
    return dealt.groupBy(block).applyInArrow(pack, f"{block} bigint, ids binary, weights binary")


def matrix_of(ids: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(weights, np.int64).reshape(len(ids), -1)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, term by term: the postings of a term scatter into the rows' scores."""
    terms = min(queries.shape[1], rows.shape[1])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(terms, 1)
    if most >= 2**62:
        raise OverflowError("scores of these vectors may not fit 64 bits")
    narrow = np.int32 if most < 2**31 else np.int64
    total = np.zeros((len(queries), len(rows)), narrow)
    for term in range(terms):
        posting = np.flatnonzero(rows[:, term])
        asking = np.flatnonzero(queries[:, term])
        if not len(posting) or not len(asking):
            continue
        weights, own = rows[posting, term].astype(narrow), queries[asking, term].astype(narrow)
        if len(posting) == len(rows):
            for q, w in zip(asking.tolist(), own.tolist()):
                total[q] += narrow(w) * weights
        else:
            for q, w in zip(asking.tolist(), own.tolist()):
                total[q, posting] += narrow(w) * weights
    return total.astype(np.int64)


def best(batches, k: int):
    """The k best of every pair of blocks, by score and then by the smaller id."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("q_ids", "q_weights", "ids", "weights")}
            own, queries = matrix_of(row["q_ids"], row["q_weights"])
            ids, rows = matrix_of(row["ids"], row["weights"])
            found = scores(queries, rows)
            same = np.searchsorted(ids, own).clip(max=len(ids) - 1)
            mine = ids[same] == own
            for q in range(len(own)):
                line = found[q]
                left = np.arange(len(ids)) if not mine[q] else np.delete(np.arange(len(ids)), same[q])
                if len(left) > k:
                    # All that reach the k-th score; ids ascend, so a stable sort keeps the smaller ones first.
                    least = np.partition(line[left], len(left) - k)[len(left) - k]
                    left = left[line[left] >= least]
                left = left[np.argsort(-line[left], kind="stable")][:k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(left), own[q])), pa.array(ids[left]), pa.array(line[left])], schema=schema
                )


def top_k(vectors: DataFrame, chosen, k: int, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row with ``chosen``.

    ``chosen`` is a condition on the column ``id`` that marks the queries.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    usable = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector)).filter(usable & F.col("id").isNotNull())
    found = found.groupBy("id").agg(F.max(whole).alias("w"))
    n, asked = found.agg(F.count(F.lit(1)), F.count_if(chosen)).first()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-asked // QUERIES))

    rows = packed(found, "r", row_blocks)
    queries = packed(found.filter(chosen), "q", query_blocks)
    queries = queries.select(F.col("q").alias("q"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"))
    # Every block of queries goes to every block of rows, as the equal keys of a join.
    left = queries.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))))
    right = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))))
    met = left.join(right.hint("shuffle_hash"), ["q", "r"])
    bests = met.select("q_ids", "q_weights", "ids", "weights").mapInArrow(
        lambda batches: best(batches, k), "query_id bigint, vec_id bigint, score bigint"
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return bests.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
