"""Rows that share an id but not the text, and tables of very short texts."""

import random

import pytest

from whence.llm import jaccard, rounds, suffixes, windows
from whence.llm.queries import prepared

SCHEMA = "doc_id bigint, text string"


def made(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(4, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def shared_id(spark):
    """A copied and a unique text under id 7, and a near copy of the unique one."""
    a, b = made(1, 60), made(2, 60)
    near = b + " " + made(3, 2)
    return prepared(spark).createDataFrame([(5, a), (7, a), (7, b), (9, near)], SCHEMA), a, b, near


def test_a_copy_is_a_row_not_an_id(shared_id):
    docs, a, b, near = shared_id
    n = [len(t.encode()) for t in (a, b, near)]
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept) for r in suffixes.kept_bytes(docs).collect()}
    assert found == {(5, n[0]): (0, a), (7, n[0]): (n[0], ""), (7, n[1]): (0, b), (9, n[2]): (n[1], near[len(b) :])}
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in windows.kept_words(docs).collect())
    assert found == [(5, 60, 0), (7, 60, 0), (7, 60, 60), (9, 62, 60)]
    found = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert found == {5: 5, 7: 5, 9: 5}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 8, 13])
def test_one_short_document(spark, n):
    docs = prepared(spark).createDataFrame([(1, made(n, n))], SCHEMA)
    assert [tuple(r) for r in windows.kept_words(docs, texts=False).select("n_words", "n_removed").collect()] == [(n, 0)]


def test_short_texts_beside_copies(spark, monkeypatch):
    monkeypatch.setattr(rounds, "GROUP_BYTES", 200)
    monkeypatch.setattr(rounds, "PART_BYTES", 200)
    copied = made(50, 40)
    rows = [(i, made(i, i)) for i in range(14)] + [(i, copied) for i in range(20, 60)]
    docs = prepared(spark).createDataFrame(rows, SCHEMA)
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in windows.kept_words(docs).collect())
    assert found == [(i, i, 0) for i in range(14)] + [(i, 40, 40 if i > 20 else 0) for i in range(20, 60)]
