"""A corpus pipeline: five stages from raw documents to piece ids.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of ``documents``; the last returns doc_id and ids. ``run`` writes what a stage
returns as Parquet in the shared folder and reads it again as the next one's input, so a
lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.llm.jaccard import components
from whence.llm.mixing import production
from whence.llm.pieces import sampled_pieces
from whence.llm.quality import fit, scored
from whence.llm.queries import documents, labels, prepared, vocabulary
from whence.llm.suffixes import kept_bytes
from whence.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone: others are not carried, whatever their names.

    All stages take NULLs in any column and an empty table: a NULL text counts as empty, a NULL id
    as the smallest one (as a key of its own where it seeds a draw), a NULL language or source as ''.
    Repeated rows are rows of their own, except that near copies of one id stay or go together.
    """
    prepared(spark)
    return docs.select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (a score of at least 0.7); an empty text is scored like any other.

    Without labelled rows to learn from, as in an empty table, nothing is kept.
    """
    docs = own_columns(spark, docs)
    return scored(docs, fit(docs, labels(spark, sf_dir)), COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; rows of that id all stay.

    Documents without words are near copies of nothing.
    """
    docs = own_columns(spark, docs)
    found = components(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier; documents of which nothing is left go.

    A text that was empty before stays; n_chars is counted anew.
    """
    docs = own_columns(spark, docs)
    found = kept_bytes(docs, carry=("lang", "source")).filter("n_removed = 0 or kept <> ''")
    return found.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars")
    )


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every epoch in which a document is taken; sources without words give nothing."""
    docs = own_columns(spark, docs)
    return production(docs).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of a sampled segmentation; equal rows have equal ids."""
    docs = own_columns(spark, docs)
    return sampled_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed_to_weights),
    ("pieces", piece_ids),
]

#: SQL cannot express the classifier or the sampled segmentation; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` in ``sf_dir``."""
    docs = documents(spark, sf_dir.rstrip("/"))
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
