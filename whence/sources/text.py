"""Delimited text: readers, writers and line numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whence.operators.frame import LineageFrame, tag
from whence.session import durable
from whence.sources.numbering import close_gaps, dense_index  # noqa: F401  (dense_index is used from here)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line below ``path`` (a file, or a folder of parts): column value."""
    return spark.read.text(path)


def read_part(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Lines of one part file of a dataset folder."""
    return spark.read.option("pathGlobFilter", f"part-{number:05d}*").text(path)


def fields(line: Column | str, delimiter: str = ",", quotes: bool = False) -> Column:
    """Split a line at each delimiter; ``quotes`` removes double quotes first.

    Trailing empty fields are not kept.
    """
    line = F.col(line) if isinstance(line, str) else line
    if quotes:
        line = F.translate(line, '"', "")
    cut = F.regexp_replace(line, f"[{delimiter}]+$", "")
    return F.split(cut, f"[{delimiter}]")


def parse(
    lines: DataFrame, schema: T.StructType | str, delimiter: str = ",", quotes: bool = False, strict: bool = False
) -> DataFrame:
    """Typed columns from ``value``. A bad field is NULL, or an error if ``strict``."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = lines.select("*", fields("value", delimiter, quotes).alias("__f"))
    out = []
    for i, field in enumerate(schema):
        raw = F.get("__f", F.lit(i))
        typed = raw.cast(field.dataType) if strict else raw.try_cast(field.dataType)
        out.append(typed.alias(field.name, metadata=field.metadata))
    rest = [c for c in lines.columns if c != "value"]
    return parts.select(*rest, *out)


def number_lines(lines: DataFrame, name: str = "row") -> DataFrame:
    """Number the lines of a text source 0..n-1, once and for all.

    The numbers are written to the shared folder, so later branches and retried
    tasks see the same ones.
    """
    return close_gaps(durable(lines.withColumn("__at", F.monotonically_increasing_id())), name)


def read_numbered(spark: SparkSession, path: str, name: str = "row") -> DataFrame:
    """Every line below ``path`` with its number 0..n-1 in the order of files and of lines in them.

    A line's place in its block is known from the scan; one row per block (its number of lines)
    gives the numbers before it. So nothing is written, and the numbers are the same however the
    files are cut into splits. The text is scanned twice, the first time for counts alone.
    """
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    lines = read_lines(spark, path).select("value", *at, F.monotonically_increasing_id().alias("__at"))
    blocks = lines.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # Files are few beside lines: their sums first, then blocks within each.
    files = blocks.groupBy("__file").agg(F.sum("__n").alias("__n"))
    before_file = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("__file", F.coalesce(before_file, F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(files, "__file")
    start = F.col("__before") + F.col("__inside") - F.col("__first")
    starts = blocks.select("__file", "__block", start.alias("__start"))
    return lines.join(starts, ["__file", "__block"]).select("value", (F.col("__start") + F.col("__at")).alias(name))


def tag_lines(spark: SparkSession, path: str, name: str) -> LineageFrame:
    """A text source tracked by line number."""
    return tag(read_numbered(spark, path), name, ["row"])


def write_lines(df: DataFrame, path: str, delimiter: str = ",") -> str:
    """Save the columns as delimited text, one part file per task."""
    line = F.concat_ws(delimiter, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_datasets(datasets: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Save several datasets below one folder, each in its own."""
    return {name: write_lines(df, f"{path}/{name}") for name, df in datasets.items()}
