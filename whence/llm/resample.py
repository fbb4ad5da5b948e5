"""Importance resampling of documents towards a target distribution.

Features are the words and pairs of neighbouring words of a text; CRC-32 deals them over
``BUCKETS``. A bucket's gain is the logarithm of how much more often the target has it than
the documents, a document's weight the mean gain of its features, and the documents with the
highest weights after a Gumbel draw by a hash of the id are taken.

CRC-32 is affine: the checksum of a span is the XOR of what each byte contributes, which
depends on the byte and its distance from the end alone, and of a constant of the length.
Contributions of up to ``DISTANCE`` bytes stand in a table, so spans of a batch are gathered
and folded by ``bitwise_xor.reduceat``. A longer span is folded in blocks of that length,
counted from the end; neighbouring blocks are joined pairwise, the front one shifted by the
bytes behind it, so that a span of n blocks takes log2(n) joins.

The features of a document are written as 16-bit buckets once. Bucket counts are sums per
task and then per bucket, a table of ``BUCKETS`` rows whatever the input; only this table
goes through the driver. Ranks come from range-partitioned rows with one offset per partition.

NULL and wordless texts have no features and weight 0; a NULL id hashes as an empty string
and counts as the smallest. Rows with equal ids are ranked one after the other. An empty table
gives no rows; an empty target has counts of 0. A text is held whole in one task, with some
forty times its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.kernels import buffers, ranges
from whence.llm.token_files import slices
from whence.session import durable
from whence.sources.text import dense_index

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Distances from the end of a span in the table.
DISTANCE = 64
SLICE_BYTES = 1 << 20
#: Bytes of spans that are gathered at once.
GATHER_BYTES = 1 << 20
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, values >> 1 ^ np.uint32(POLYNOMIAL), values >> 1).astype(np.uint32)
    return values


_BYTES = _byte_table()


def _advance(crc: np.ndarray) -> np.ndarray:
    """The effect of one zero byte behind."""
    return crc >> np.uint32(8) ^ _BYTES[crc & np.uint32(0xFF)]


def _positions() -> np.ndarray:
    """What byte b contributes at distance d from the end: row d, column b."""
    found = np.empty((DISTANCE, 256), np.uint32)
    found[0] = _BYTES
    for d in range(1, DISTANCE):
        found[d] = _advance(found[d - 1])
    return found


POSITIONS = _positions()


class Shift:
    """The linear effect of so many zero bytes on a 32-bit value, by the values of its four bytes."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, length: int) -> "Shift":
        units = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        for _ in range(length):
            units = _advance(units)
        return cls(_spread(units))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        found = self.table[0][values & np.uint32(0xFF)]
        for i in range(1, 4):
            found = found ^ self.table[i][values >> np.uint32(8 * i) & np.uint32(0xFF)]
        return found

    def twice(self) -> "Shift":
        units = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        return Shift(_spread(self(self(units))))


def _spread(units: np.ndarray) -> np.ndarray:
    """Tables of the four bytes of a value from the images of its 32 bits."""
    table = np.zeros((4, 256), np.uint32)
    for i in range(32):
        has = (np.arange(256) >> (i % 8) & 1).astype(bool)
        table[i // 8][has] ^= units[i]
    return table


#: Shifts by DISTANCE, 2 * DISTANCE, 4 * DISTANCE, ... bytes, as far as spans have asked for them.
_SHIFTS = [Shift.of(DISTANCE)]


def shift(doublings: int) -> Shift:
    while len(_SHIFTS) <= doublings:
        _SHIFTS.append(_SHIFTS[-1].twice())
    return _SHIFTS[doublings]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What start value and final complement of CRC-32 add to spans of these lengths."""
    found = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    rest, left = lengths // DISTANCE, lengths % DISTANCE
    near = np.empty(DISTANCE, np.uint32)
    near[0] = 0xFFFFFFFF
    for d in range(1, DISTANCE):
        near[d] = _advance(near[d - 1 : d])[0]
    found = near[left]
    doublings = 0
    while rest.any():
        odd = (rest & 1).astype(bool)
        found[odd] = shift(doublings)(found[odd])
        rest, doublings = rest >> 1, doublings + 1
    return found ^ np.uint32(0xFFFFFFFF)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span (not empty; spans may overlap), worked on in stretches of ``GATHER_BYTES``."""
    found = np.empty(len(starts), np.uint32)
    upto = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + GATHER_BYTES, side="right")))
        found[at:to] = _folded(data, starts[at:to], ends[at:to])
        at = to
    return found


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    # Blocks from the end: the first of a span has what is left over.
    blocks = -(-lengths // DISTANCE)
    last = np.cumsum(blocks)
    first = last - blocks
    size = np.full(int(last[-1]), DISTANCE, np.int64)
    size[first] = lengths - (blocks - 1) * DISTANCE
    at = np.cumsum(size) - size
    bytes_ = data[ranges(starts, lengths)]
    distance = np.repeat(at + size - 1, size) - np.arange(len(bytes_))
    folded = np.bitwise_xor.reduceat(POSITIONS[distance, bytes_], at)
    found = folded[last - 1]
    long = np.flatnonzero(blocks > 1)
    if len(long):
        found[long] = _joined(folded, first[long], blocks[long])
    return found ^ length_constants(lengths)


def _joined(folded: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The blocks of each span as one value: neighbours are joined from the end until one is left."""
    values = folded[ranges(first, blocks)]
    doublings = 0
    while (blocks > 1).any():
        # An odd span gets an empty block in front.
        even = blocks + (blocks & 1)
        padded = np.zeros(int(even.sum()), np.uint32)
        ends = np.cumsum(even)
        padded[ranges(ends - blocks, blocks)] = values
        pairs = padded.reshape(-1, 2)
        values = shift(doublings)(pairs[:, 0]) ^ pairs[:, 1]
        blocks, doublings = even // 2, doublings + 1
    return values


def _word_bytes() -> np.ndarray:
    """What a byte of a word becomes (``[0-9A-Za-z]`` and all beyond ASCII, A-Z lower-cased); 0 for others."""
    found = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        found[low : high + 1] = np.arange(low, high + 1)
    found[ord("A") : ord("Z") + 1] = found[ord("a") : ord("z") + 1]
    return found


WORD_BYTES = _word_bytes()


def features(texts: pa.Array | pa.ChunkedArray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, where each text's features start (and the last end), and their buckets."""
    data, offsets = buffers(texts)
    data = WORD_BYTES[data]
    inside = data > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside & edge[:-1], inside & edge[1:]
    if len(data):
        opens[1:] |= inside[1:] & ~inside[:-1]
        closes[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = np.diff(np.searchsorted(starts, offsets))
    # The words of all texts with one space behind each, so that a run of words is one span.
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    joined[ranges(begin, lengths)] = data[inside]
    end = begin + lengths
    place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    left = np.repeat(words, words) - place
    text = np.repeat(np.arange(len(words)), words)
    found, of = [], []
    for n in range(1, LONGEST + 1):
        from_ = np.flatnonzero(left >= n)
        found.append(span_crcs(joined, begin[from_], end[from_ + n - 1]) % np.uint32(buckets))
        of.append(text[from_])
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(words))
    return words, np.concatenate([[0], np.cumsum(counts)]), found[order].astype(np.uint16)


def hashed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets (16-bit, little-endian) of every document."""
    assert buckets <= 1 << 16

    def work(batches):
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                words, starts, found = features(batch.column("text"), buckets)
                data = pa.py_buffer(found.astype("<u2").tobytes())
                packed = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(2 * starts.astype(np.int64)), data])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(np.diff(starts), pa.int64()), packed.cast(pa.binary())],
                    ["doc_id", "n_words", "n_features", "buckets"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, buckets binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a batch, and where those of each row start."""
    column = column.cast(pa.large_binary())
    data, offsets = buffers_of(column)
    return np.frombuffer(data, "<u2"), offsets // 2


def buffers_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    _, offsets, data = column.buffers()
    if not len(column):
        return b"", np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (data[int(at[0]) : int(at[-1])] if data is not None else b""), at - at[0]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; one row per bucket leaves each task."""

    def work(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(unpacked(batch.column("buckets"))[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for row in sums.collect():  # ``buckets`` rows at most
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, from its counts among the documents and in the target."""
    size = len(source)
    above = (target + 1.0) * (float(source.sum()) + size)
    below = (source + 1.0) * (float(target.sum()) + size)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of the features."""

    def work(batches):
        for batch in batches:
            found, starts = unpacked(batch.column("buckets"))
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            n = np.diff(starts)
            weight = np.where(n > 0, (upto[starts[1:]] - upto[starts[:-1]]) // np.maximum(n, 1), 0)
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is NULL for those not drawn.

    Drawn are ``percent`` of the documents with at least ``LEAST_WORDS`` words (rounded down),
    by the highest scores, ties to the smaller id. ``target`` has the column ``text``.
    """
    rows = durable(hashed(docs, buckets))
    wanted = durable(hashed(target.select(F.lit(0).alias("doc_id"), "text"), buckets))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = durable(weighted(rows, gain).withColumn("score", score))
    long = scored.filter(F.col("n_words") >= LEAST_WORDS).withColumn("order", -F.col("score"))
    size = long.count() * percent // 100
    ranked = dense_index(long, ["order", "doc_id", "n_features", "weight"], "place")
    rank = F.when(F.col("place") < size, F.col("place") + 1)
    kept = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*kept, rank.cast("bigint").alias("rank")).unionByName(
        scored.filter(F.col("n_words") < LEAST_WORDS).select(*kept, F.lit(None).cast("bigint").alias("rank"))
    )
