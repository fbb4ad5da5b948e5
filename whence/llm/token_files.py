"""Token ids of documents in Parquet files that can be read in part.

Documents are range-partitioned by id and sorted, tokenized in that order and written as
one list column beside narrow metadata columns. Ids are dictionary-encoded (a dictionary
page per column chunk, so about two bytes an id at 50 thousand tokens), the metadata
columns are delta-encoded; row groups and pages have set sizes and the writer adds page
indexes, so a reader can fetch the metadata alone, or a range of ids by their doc_id.

The tokenizer works on chunks: a text is cut before every space that follows a character
which is not white space. No pre-token of a byte-level tokenizer crosses such a place, so
the ids of a text are those of its chunks, and each distinct chunk of a batch is encoded
once. ``start`` counts the ids of all documents before: files keep counts within their
partition, and the sums of the partitions (one row each) are added when reading.

NULL and empty texts hold the end id only. A NULL id comes first; rows with equal ids
stand in the order of their texts.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whence.llm.kernels import BYTE_VALUES, IS_SEPARATOR, Prefix, buffers, mix, ranges
from whence.session import durable

#: Settings of the Parquet writer: sizes in bytes, encodings, version 2 for delta encoding.
WRITER = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}
#: Bytes of text that are tokenized together.
BATCH_BYTES = 8 << 20
#: Text bytes for which there is one partition.
PARTITION_BYTES = 12 << 20
END_ID = 0

#: Chunks whose ids a worker keeps, and bytes of the longest of them; beyond that number it starts
#: anew. Only speed depends on both.
KNOWN_CHUNKS = 2_000_000
LONGEST_KNOWN = 64

#: Other values of the bytes than those of the first hash.
_SECOND = mix(BYTE_VALUES ^ np.uint64(0x5851F42D4C957F2D))
_CACHES: dict = {}


class Known:
    """Ids of chunks by two independent 64-bit hashes, some thirty bytes a chunk.

    The hashes are sums over bytes, which tell stretches of up to ``LONGEST_KNOWN`` bytes apart;
    longer chunks are not kept. Keys stand in order, so a batch is looked up by one search.
    """

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each chunk, -1 for those that are not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(self.keys) + len(keys) > KNOWN_CHUNKS:
            self.__init__()
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, np.diff(keys[order]) != 0]] if len(order) else order
        to = np.searchsorted(self.keys, keys[order])
        # Of two chunks with one key the first stays; the other is encoded whenever it comes.
        new = (to == len(self.keys)) | (self.keys[np.minimum(to, max(len(self.keys) - 1, 0))] != keys[order]) if len(self.keys) else np.ones(len(to), bool)
        order, to = order[new], to[new]
        self.keys, self.checks = np.insert(self.keys, to, keys[order]), np.insert(self.checks, to, checks[order])
        self.at, self.sizes = np.insert(self.at, to, at[order]), np.insert(self.sizes, to, lengths[order])


class Chunks:
    """A tokenizer and the ids of the chunks it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A token of a byte-level vocabulary is spelt with one character per byte.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.known = Known()

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: an array of ids, and where each chunk's start and how many they are."""
        data, offsets = buffers(chunks)
        lengths = np.diff(offsets)
        keys = Prefix(BYTE_VALUES[data]).hashes(offsets[:-1], offsets[1:])
        checks = Prefix(_SECOND[data]).hashes(offsets[:-1], offsets[1:])
        place = np.where(lengths <= LONGEST_KNOWN, self.known.find(keys, checks), -1)
        hit, miss = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        at, sizes = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        sizes[hit] = self.known.sizes[place[hit]]
        old = self.known.flat[ranges(self.known.at[place[hit]].astype(np.int64), sizes[hit])]
        at[hit] = np.cumsum(sizes[hit]) - sizes[hit]
        found, base = [old], len(old)
        # Those that start with a space and end with a visible ASCII character can stand in a row.
        last = data[np.maximum(offsets[1:][miss] - 1, 0)] if len(data) else data
        can = (data[np.minimum(offsets[:-1][miss], len(data) - 1)] == 0x20) & (last >= 0x21) & (last <= 0x7E) if len(data) else miss > 0
        for some, work in ((miss[can], self.in_rows), (miss[~can], self.alone)):
            ids, counts = work(chunks.take(pa.array(some)).to_pylist())
            sizes[some], at[some] = counts, base + np.cumsum(counts) - counts
            keep = lengths[some] <= LONGEST_KNOWN
            kept = ids if keep.all() else ids[np.repeat(keep, counts)]
            self.known.add(keys[some][keep], checks[some][keep], kept, counts[keep])
            found.append(ids)
            base += len(ids)
        return np.concatenate(found), at, sizes

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoded(chunks)

    def in_rows(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``alone``, with many chunks to a text; tokens are told apart by their bytes."""
        ids, _ = self.encoded(["".join(chunks[i : i + 500]) for i in range(0, len(chunks), 500)])
        ends = np.cumsum([len(c.encode()) for c in chunks], dtype=np.int64)
        token_ends = np.cumsum(self.bytes[ids])
        last = np.searchsorted(token_ends, ends)
        if len(chunks) and (last[-1] >= len(ids) or not np.array_equal(token_ends[last], ends)):
            return self.alone(chunks)
        return ids, np.diff(last, prepend=-1)


def chunks_at(path: str) -> Chunks:
    if path not in _CACHES:
        _CACHES[path] = Chunks(path)
    return _CACHES[path]


def chunk_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start, and the end: at texts and at spaces after what cannot be white space.

    Characters that start with the bytes C2, E1 80..9A, E2 80, E2 81 or E3 80 may be white
    space; a chunk goes on after them.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        space = (data[1:] == 0x20) & ~IS_SEPARATOR[data[:-1]] & (data[:-1] > 0x20)
        cut[1:n] = space
        at = np.flatnonzero(cut)
        one, two = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        cut[at[(one == 0xC2) | (two == 0xE1) | (two == 0xE2) | (two == 0xE3)]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


def encode(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and the offsets of the texts in them."""
    data, offsets = buffers(texts)
    cuts = chunk_offsets(data, offsets)
    chunks = pa.Array.from_buffers(
        pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    flat, at, lengths = chunks_at(path).of(chunks.dictionary)
    code = chunks.indices.to_numpy()
    ids = flat[ranges(at[code], lengths[code])]
    before = np.r_[0, np.cumsum(lengths[code])][np.searchsorted(cuts, offsets)]
    sizes = np.diff(before) + 1
    ends = np.cumsum(sizes)
    out = np.empty(len(ids) + len(sizes), np.uint32)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep], out[ends - 1] = ids, end
    return out, np.r_[0, ends]


def slices(batch: pa.RecordBatch, most: int):
    """Stretches of a batch with at most ``most`` bytes of text, or a single row."""
    sizes = np.diff(buffers(batch.column("text"))[1])
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        start = total[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(total, start + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID) -> None:
    """Writes doc_id, part, place (ids before it in its part), n_tokens and ids to ``path``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())

    def work(batches):
        place = 0
        for whole in batches:
            for batch in slices(whole, BATCH_BYTES):
                ids, offsets = encode(batch.column("text"), tokenizer, end)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), pa.array(place + offsets[:-1]), pa.array(np.diff(offsets)), lists],
                    ["doc_id", "part", "place", "n_tokens", "ids"],
                )
                place += int(offsets[-1])

    schema = "doc_id bigint, part int, place bigint, n_tokens bigint, ids array<int>"
    dealt.mapInArrow(work, schema).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files at ``path``; reads only the columns asked for."""
    schema = "doc_id bigint, part int, place bigint, n_tokens bigint, ids array<int>"
    files = spark.read.schema(schema).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    # One row per partition of the writer; as a written table its size is known, so Spark
    # broadcasts it below its own threshold only.
    before = F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = durable(sums.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before")))
    joined = files.join(sums, F.col("part") == F.col("p"))
    return joined.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers)."""

    def work(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            ids = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
