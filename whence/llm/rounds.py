"""Rounds between texts and the holders of their hashes.

The duplicate operators ask the same kind of question again and again: which of the
stretches of my texts are known elsewhere? Texts are dealt once over groups of about
``GROUP_BYTES`` by a hash of their id. A round sends, for each group, its distinct
hashes to the parts that hold them (a part owns a range of hash values); a part answers
with a bit per hash and the group goes on from its own texts and the answers. As a group
sends a hash once however often it has it, a hash that is everywhere costs a part no more
rows than there are groups.

The dealt texts are written once as a bucketed table in the shared folder, so a round reads
them where they lie and exchanges nothing but messages; its answers are written too. So every
round is a plan of its own, as small as the first, and a lost executor never costs more than
the round at hand. Questions and answers are binary columns, and what asks and what answers
are pure functions of their input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from whence.session import cleaned, durable, scratch_dir

#: Text bytes of a group, and text bytes for which there is one part.
GROUP_BYTES = 2 << 20
PART_BYTES = 4 << 20
#: Text bytes for which there is one task, unless the session asks for more tasks, and most buckets of a table.
TASK_BYTES = 64 << 20
BUCKETS = 100_000
#: Order value of a NULL id: it counts as the smallest.
LEAST = -(2**63)

NOTE = "g bigint, round int, part bigint, id bigint, data binary"


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; does not fall as the hash grows."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the stretches of ascending ``hashes`` that share a part."""
    if not len(hashes):
        return []
    part = part_of(hashes, parts)
    at = (np.flatnonzero(np.diff(part)) + 1).tolist()
    return list(zip(part[[0, *at]].tolist(), [0, *at], [*at, len(part)]))


@dataclass
class Group:
    """The texts of a group in order of their ids, and the answers it has had so far.

    ``ids`` are order values of the ids (the differences from the smallest of all),
    ``copy`` marks the rows whose text a row with a smaller id has as well; another text
    under the same id is none.
    """

    number: int
    doc_ids: pa.ChunkedArray
    ids: np.ndarray
    texts: pa.Array
    copy: np.ndarray
    carried: dict[str, pa.ChunkedArray]
    answers: dict[int, list[bytes]] = field(default_factory=dict)

    def own(self) -> pa.Array:
        """The texts, with empty ones for the copies."""
        return pc.if_else(pa.array(self.copy), pa.scalar("", self.texts.type), self.texts) if self.copy.any() else self.texts

    def bits(self, round_: int, sizes: list[int]) -> np.ndarray:
        """The answers of a round, a bit per hash sent, in ascending order of the hashes."""
        got = self.answers.get(round_, [])
        assert len(got) == len(sizes), "answers that do not fit the questions"
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(got, sizes)]
        return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


class Rounds:
    """Texts dealt over groups. ``docs`` has ``doc_id`` and ``text``; beside these, only the
    columns ``carry`` are read, which go with the texts.

    A NULL text counts as empty and a NULL id as the smallest. Where rows share a text,
    those with the smallest id take part and the others are marked as copies.
    """

    def __init__(self, docs: DataFrame, carry: tuple[str, ...] = ()):
        self.carry = {c: docs.schema[c].dataType.simpleString() for c in carry}
        carried = {c: f"carried_{i}" for i, c in enumerate(carry)}
        docs = docs.select(
            *[F.col(c).alias(a) for c, a in carried.items()],
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("id"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("id").alias("least"), F.max("id").alias("most")).first()
        self.bytes, self.base = size["bytes"] or 0, size["least"] or 0
        #: Order values travel in as few bytes as hold them.
        self.id_type = "<u4" if (size["most"] or 0) - self.base < 2**32 else "<u8"
        self.groups = max(1, -(-self.bytes // GROUP_BYTES))
        self.parts = max(1, -(-self.bytes // PART_BYTES))
        group = F.pmod(F.xxhash64("id"), F.lit(self.groups)).alias("g")
        spark = docs.sparkSession
        self.width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-self.bytes // TASK_BYTES), BUCKETS))
        table = f"texts_{uuid.uuid4().hex}"
        dealt = docs.select(group, "doc_id", "id", "text", *carried.values()).repartition(self.width, "g")
        with cleaned(spark):
            dealt.write.bucketBy(self.width, "g").option("path", scratch_dir(spark, table)).saveAsTable(table)
        self.docs = spark.table(table)
        self.number = 0
        copies = _copies(self.docs).select(
            "g", F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("part"), "id", F.col("sha").alias("data")
        )
        self.notes = durable(copies)

    def each(self, work: Callable[[Group], dict], schema: str) -> DataFrame:
        """The rows of ``work`` (columns by name) for every group with the answers so far."""
        names = {c: f"carried_{i}" for i, c in enumerate(self.carry)}
        base, arrow = np.uint64(self.base % 2**64), to_arrow_schema(StructType.fromDDL(schema))

        def run(key, texts, notes):
            texts = texts.sort_by([("id", "ascending"), ("text", "ascending")])
            ids = texts.column("id").to_numpy()
            rounds = notes.column("round").to_numpy()
            group = Group(
                int(key[0].as_py()), texts.column("doc_id"), ids.astype(np.int64).view(np.uint64) - base,
                texts.column("text").combine_chunks(), marked(ids, texts.column("text"), notes.filter(pa.array(rounds == 0))),
                {c: texts.column(a) for c, a in names.items()},
            )
            later = notes.filter(pa.array(rounds > 0)).sort_by([("round", "ascending"), ("part", "ascending")])
            for number, data in zip(later.column("round").to_pylist(), later.column("data").to_pylist()):
                group.answers.setdefault(number, []).append(data)
            return pa.table(work(group), schema=arrow)

        return self.docs.groupBy("g").cogroup(self.notes.groupBy("g")).applyInArrow(run, schema)

    def round(self, ask: Callable[[Group], list[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]]) -> None:
        """One more round: what ``ask`` gives for each group goes to the parts, the answers come back."""
        self.number += 1
        number = self.number

        def questions(group: Group) -> dict:
            asked = ask(group)
            return {"g": [group.number] * len(asked), "part": [p for p, _ in asked], "data": [d for _, d in asked]}

        def answers(key, rows):
            rows = rows.sort_by("g")
            n = len(rows)
            return pa.table(
                {
                    "g": rows.column("g"),
                    "round": pa.array([number] * n, pa.int32()),
                    "part": rows.column("part"),
                    "id": pa.nulls(n, pa.int64()),
                    "data": pa.array(answer(rows.column("data").to_pylist()), pa.binary()),
                }
            )

        asked = self.each(questions, "g bigint, part bigint, data binary")
        answered = asked.repartition(self.width, "part").groupBy("part").applyInArrow(answers, NOTE)
        self.notes = self.notes.unionByName(durable(answered))


def _copies(docs: DataFrame) -> DataFrame:
    """g, id, sha: the rows whose text a row with a smaller id has too."""
    keyed = durable(docs.select("g", "id", F.unhex(F.sha2("text", 256)).alias("sha")).distinct())
    shared = keyed.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    # Both sides are written, so a text that very many rows share is split in the join.
    return keyed.join(durable(shared.select("sha", "first")), "sha").filter(F.col("id") > F.col("first")).select("g", "id", "sha")


def marked(ids: np.ndarray, texts: pa.ChunkedArray, copies: pa.Table) -> np.ndarray:
    """Which rows are among the copies? Both the id and the text count; texts under other ids are not hashed."""
    known = set(zip(copies.column("id").to_pylist(), copies.column("data").to_pylist()))
    copy = np.isin(ids, copies.column("id").to_numpy())
    for i in np.flatnonzero(copy).tolist():
        copy[i] = (int(ids[i]), hashlib.sha256(texts[i].as_buffer()).digest()) in known
    return copy


def repeated(sent: list[bytes], kind: str) -> list[bytes]:
    """A bit per hash: does another group send it too? Groups send a hash once."""
    hashes = np.frombuffer(b"".join(sent), kind)
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return packed(count[back] > 1, [len(b) // np.dtype(kind).itemsize for b in sent])


def packed(bits: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
