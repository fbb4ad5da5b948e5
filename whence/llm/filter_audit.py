"""Interaction of document filters, from a sparse document-term matrix.

Texts are dealt over groups (``rounds``). A group finds its distinct words and sends each
once to the part that holds it; the parts number the words they hold, and with its number
every word of the group becomes a column of the one matrix. So a group is a shard of it in
compressed sparse rows, a word costs one entry per shard however frequent it is, and equal
words have equal columns in all shards. Row sums (words) and numbers of nonzero entries
(distinct words) decide the first two filters; the others are flags that come along with a
row: capitals, signs, and whether a document with a smaller id has the same text.

Filters, in the order of their bits:

A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * ``[A-Z]`` characters >
5 * code points. D: holds one of ``#$%&*|``. E: a copy of a smaller id's text.

``audit`` counts the documents of each part by the set of filters that they fail, 32 sets at
most, and reads from these counts what each step of each of the 120 orders keeps and removes.

NULL texts count as empty, a NULL id as the smallest; NULL sources are the part ''. Rows with
equal ids and texts are no copies of each other. Where labels repeat an id, one label of 1
suffices. An empty table gives no rows. Only doc_id, text and source are read. A text is held
whole in one task, with some twenty times its bytes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.llm.kernels import IS_SEPARATOR, Words, buffers
from whence.llm.rounds import Group, Rounds, part_of
from whence.session import durable

LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SIGNS = b"#$%&*|"
IS_SIGN = np.isin(np.arange(256), list(SIGNS))

ROW = "doc_id bigint, part string, n_words bigint, n_distinct bigint, n_points bigint, n_capitals bigint, has_sign boolean, copy boolean"
SHARD = "shard bigint, doc_ids array<bigint>, starts array<bigint>, columns array<bigint>, counts array<bigint>"


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked bytes lie in each text."""
    upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


class Terms:
    """The distinct words of a group, in the order of the parts that hold them, and where they occur."""

    def __init__(self, group: Group, parts: int):
        self.data, self.offsets = buffers(group.texts)
        words = Words(self.data, self.offsets)
        ends = np.concatenate([[0], np.cumsum(words.ends - words.starts, dtype=np.int64)])
        letters = pa.py_buffer(self.data[~IS_SEPARATOR[self.data]])
        found = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(ends), letters])
        coded = found.dictionary_encode()
        code = coded.indices.to_numpy()
        # Codes count up, so a word stands first where the largest code so far grows.
        first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0) if len(code) else code
        order, self.stretches = by_part(words.values(self.data)[first], parts)
        self.words = coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code, self.counts = place[code], words.counts

    def ask(self) -> list[tuple[int, bytes]]:
        """Per part, the lengths and the bytes of its words."""
        data, ends = buffers_of(self.words)
        sizes = np.diff(ends).astype("<u4")
        return [
            (part, np.uint32(b - a).tobytes() + sizes[a:b].tobytes() + data[ends[a] : ends[b]]) for part, a, b in self.stretches
        ]

    def numbers(self, group: Group) -> np.ndarray:
        """The number of each word in the common dictionary: its part and its place there."""
        places = [np.frombuffer(b, "<u4").astype(np.int64) for b in group.answers.get(1, [])]
        assert [len(p) for p in places] == [b - a for _, a, b in self.stretches], "answers that do not fit the questions"
        found = [(part << 32) + p for (part, _, _), p in zip(self.stretches, places)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def rows(self, group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compressed sparse rows over the common dictionary: starts, columns, counts."""
        size = max(1, len(self.words))
        cells = np.repeat(np.arange(len(self.counts)), self.counts) * size + self.code
        cells.sort()
        opens = np.flatnonzero(np.diff(cells, prepend=-1))
        counts = np.diff(np.append(opens, len(cells)))
        cells = cells[opens]
        starts = np.searchsorted(cells, np.arange(len(self.counts) + 1) * size)
        return starts, self.numbers(group)[cells % size], counts


def by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the hashes by part, and (part, from, to) of each part's stretch."""
    part = part_of(hashes, parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = (np.flatnonzero(np.diff(part)) + 1).tolist()
    return order, list(zip(part[[0, *at]].tolist(), [0, *at], [*at, len(part)])) if len(part) else []


def buffers_of(words: pa.Array) -> tuple[memoryview, np.ndarray]:
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), ends


def numbered(sent: list[bytes]) -> list[bytes]:
    """The number of each word that a part is sent: its place among the part's distinct words."""
    sizes = [int(np.frombuffer(b, "<u4", 1)[0]) for b in sent]
    lengths = np.concatenate([np.frombuffer(b, "<u4", n, 4) for b, n in zip(sent, sizes)])
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    letters = b"".join(memoryview(b)[4 + 4 * n :] for b, n in zip(sent, sizes))
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    found = words.dictionary_encode().indices.to_numpy().astype("<u4")
    upto = np.cumsum(sizes)
    return [found[e - n : e].tobytes() for n, e in zip(sizes, upto)]


class Matrix:
    """The document-term matrix of ``docs``, its words numbered in one round."""

    def __init__(self, docs: DataFrame):
        self.rounds = Rounds(docs, ("source",))
        parts = self.parts = self.rounds.parts
        self.rounds.round(lambda group: Terms(group, parts).ask(), numbered)

    def shards(self) -> DataFrame:
        """The matrix: a row per shard, with the ids of its documents and their compressed sparse rows."""
        parts = self.parts

        def work(group: Group) -> dict:
            starts, columns, counts = Terms(group, parts).rows(group)
            found = {"doc_ids": group.doc_ids.combine_chunks(), "starts": starts, "columns": columns, "counts": counts}
            return {"shard": [group.number]} | {k: [v] for k, v in found.items()}

        return self.rounds.each(work, SHARD)

    def dictionary(self) -> DataFrame:
        """word, number: the columns of the matrix."""
        parts = self.parts

        def work(group: Group) -> dict:
            terms = Terms(group, parts)
            return {"word": terms.words.cast(pa.large_string()), "number": terms.numbers(group)}

        return self.rounds.each(work, "word string, number bigint").distinct()

    def facts(self) -> DataFrame:
        """A row per document: its source, row sum, nonzero entries, and what the other filters ask."""
        parts = self.parts

        def work(group: Group) -> dict:
            terms = Terms(group, parts)
            n_words, n_distinct = row_sums(*terms.rows(group))
            data, offsets = terms.data, terms.offsets
            return {
                "doc_id": group.doc_ids, "part": group.carried["source"].fill_null(""),
                "n_words": n_words, "n_distinct": n_distinct,
                "n_points": per_text((data & 0xC0) != 0x80, offsets),
                "n_capitals": per_text((data >= 65) & (data <= 90), offsets),
                "has_sign": per_text(IS_SIGN[data], offsets) > 0, "copy": group.copy,
            }

        return self.rounds.each(work, ROW)


def row_sums(starts: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of nonzero entries of every compressed sparse row; a column stands once in a row."""
    assert len(columns) == len(counts)
    sums, nonzero = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (counts, counts > 0))
    return sums[starts[1:]] - sums[starts[:-1]], nonzero[starts[1:]] - nonzero[starts[:-1]]


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails: the set of filters that each document fails, as bits in the order of ``LETTERS``."""
    facts = Matrix(docs).facts()
    tests = [
        F.col("n_words") < LEAST_WORDS,
        F.col("n_distinct") * 100 < F.col("n_words") * LEAST_DISTINCT,
        F.col("n_capitals") * 100 > F.col("n_points") * MOST_CAPITALS,
        F.col("has_sign"),
        F.col("copy"),
    ]
    bits = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)]
    return facts.select("doc_id", "part", sum(bits[1:], bits[0]).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the counts of every step of every order of the filters."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    # Both sides are written, so that rows which share an id are split in the join.
    marked = durable(failures(docs)).join(durable(marks), F.col("doc_id") == F.col("id"), "left")
    sets = marked.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    # 32 sets a part at most.
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(LETTERS)])
    steps = parts.select("part", "sets", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    before = " + ".join(
        f"if(instr(substring(filter_order, 1, step - 1), '{c}') > 0, {1 << i}, 0)" for i, c in enumerate(LETTERS)
    )
    own = "substring(filter_order, step, 1)"
    steps = steps.selectExpr("*", f"{own} as filter", f"shiftleft(1, ascii({own}) - {ord('A')}) as own", f"{before} as before")

    def total(which: str, what: str = "n") -> Column:
        return F.expr(f"aggregate(sets, 0L, (sum, s) -> sum + if({which}, s.{what}, 0L))")

    here = "s.fails & own <> 0 and s.fails & before = 0"
    counted = steps.select(
        "part", "filter_order", "step", "filter",
        total("s.fails & (before | own) = 0").alias("kept"),
        total(here).alias("removed"),
        total("s.fails & own <> 0 and s.fails & before <> 0").alias("redundant"),
        total("s.fails = own").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
