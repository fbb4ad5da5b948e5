"""Text sources, sinks and line numbers."""

from pyspark.sql import functions as F

from tests.conftest import as_set
from whence.sources import text as X
from whence.sources.schemas import datasets, schema


def lines(rows, *values):
    return rows([(v,) for v in values], "value string")


def test_parse_fixture_rows(rows):
    df = X.parse(lines(rows, "90024,41,10990", "90024,x,900"), schema("ages"))
    assert as_set(df) == {("90024", 41, 10990), ("90024", None, 900)}


def test_trailing_empty_fields_are_null(rows):
    line = '1185,PG0134,"2017-09-10 02:50:00.000","2017-09-10 07:55:00.000",DME,BTK,Scheduled,319,,'
    row = X.parse(lines(rows, line), schema("flights"), quotes=True).first()
    assert row["flight_id"] == 1185 and row["dep_airport"] == "DME"
    assert row["sched_dep"] == "2017-09-10 02:50:00.000"
    assert row["actual_dep"] is None and row["actual_arr"] is None


def test_every_declared_schema_has_categories():
    for name in datasets():
        assert all(f.metadata["category"] in {"numerical", "categorical", "other"} for f in schema(name))


def test_roundtrip_and_parts(spark, rows, tmp_path):
    df = rows([(i, f"n{i}") for i in range(20)], "id long, name string").repartition(4)
    paths = X.write_datasets({"a": df, "b": df.limit(3)}, str(tmp_path))
    back = X.parse(X.read_lines(spark, paths["a"]), "id long, name string")
    assert as_set(back) == as_set(df)
    counts = [X.read_part(spark, paths["a"], p).count() for p in range(4)]
    assert sum(counts) == 20 and all(c < 20 for c in counts)


def test_line_numbers_are_dense_and_stable(spark, rows, tmp_path):
    path = X.write_lines(rows([(i,) for i in range(50)], "id long").repartition(5), str(tmp_path / "d"))
    numbered = X.number_lines(X.read_lines(spark, path))
    first = as_set(numbered)
    assert {r[-1] for r in first} == set(range(50))
    assert as_set(numbered) == first


def test_dense_index_follows_the_order(rows):
    df = rows([(i * 7 % 100,) for i in range(100)], "k long").repartition(6)
    out = X.dense_index(df, ["k"])
    assert as_set(out) == {(k, k) for k in range(100)}


def test_tag_lines_traces_to_line_numbers(spark, rows, tmp_path):
    path = X.write_lines(rows([("a",), ("b",), ("a",)], "w string").coalesce(1), str(tmp_path / "w"))
    counts = X.tag_lines(spark, path, "lines").agg(["value"], n=(F.count(F.lit(1)), []))
    assert as_set(counts.trace_ids(F.col("value") == "a")["lines"]) == {(0,), (2,)}
