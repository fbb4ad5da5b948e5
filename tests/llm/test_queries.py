"""The registered queries against their SQL, and the pipeline's stages on the smallest table."""

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from tests.oracle import compare, connect
from whence.llm.queries import QUERIES, SQL
from whence.session import durable

PATH = "/root/testdata/sf0.001"


def test_names():
    known = queries()
    assert "pipeline" in known and all(any(n.startswith(f"op{i}_") for n in known) for i in range(1, 14))


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    found = compare(spark, con, name, PATH, QUERIES[name], SQL[name])
    assert found["ok"], found["why"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    whole = docs.count()
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, PATH))
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert 0 < counts[2] <= counts[1] <= counts[0] <= whole
    assert corpus_pipeline.run(spark, PATH).count() == counts[3]
