"""Sampled segmentations over the piece lattice of a SentencePiece model, and decoding.

The lattice of a text has a node between any two bytes and an edge for every piece that
spells the bytes between two nodes; byte pieces link neighbours, so there is always a path.
The weight of a piece is its rank in the model to the power -``sharpness`` (ranks follow
Zipf's law as frequencies do), that of a byte piece is far less. Forward filtering sums the
weights of all paths to each node; backward sampling draws the last piece of a path by its
share of the sum, then the one before it, to the start. The draw at byte p of a document
hashes (seed, doc_id, p), so segmentations do not depend on how rows are dealt or retried.

No piece of a model with leading spaces reaches over a space that follows another
character, so the lattice falls into chunks there, and sums are worked out once for each
distinct chunk of a batch; the draws are made for every occurrence. Where a text has over
``LONGEST`` bytes without such a place, all paths are made to meet after every so many, at the
start of a character; so neither time nor memory depends on how long a text or a word is,
beyond some twenty bytes for each byte of the text.

As SentencePiece does, encoding puts one space before the text and decoding takes it off.
Pieces spell their bytes, and the mark U+2581 in a text is spelt in byte pieces, so decoding
gives back every text. NULL texts count as empty; an empty text is a single space, one or
more pieces. A NULL id is a key of its own; rows with equal ids and texts get equal pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.kernels import BYTE_VALUES, Prefix, buffers, mix, ranges
from whence.llm.token_files import slices

MARK = "▁"
SLICE_BYTES = 3 << 18
#: Bytes of text whose lattice is held at once, and bytes of the longest chunk.
WINDOW_BYTES = 1 << 20
LONGEST = 4096
#: Log weight of a byte piece; below any way through whole pieces of a few bytes.
BYTE_WEIGHT = -30.0
SHARPNESS = 1.5
SEED = 1
_BITS = 20
_MODELS: dict = {}


class Pieces:
    """The pieces of a model by the hash of their bytes."""

    def __init__(self, path: str, sharpness: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.spelt: list[bytes] = [b""] * size
        self.byte = np.zeros(256, np.int32)
        weights = np.full(size, BYTE_WEIGHT)
        plain = []
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.spelt[i], self.byte[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = model.id_to_piece(i).replace(MARK, " ")
                if " " in text.lstrip(" "):
                    raise ValueError("pieces with a space after another character are not supported")
                self.spelt[i] = text.encode()
                weights[i] = -sharpness * np.log(min(max(-model.get_score(i), 0), size) + 10)
                plain.append(i)
        self.weights = weights
        self.lengths = np.array([len(b) for b in self.spelt], np.int64)
        self.bytes = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths
        plain = np.array(plain, np.int64)
        values = Prefix(BYTE_VALUES[self.bytes])
        hashes = values.hashes(self.at[plain], self.at[plain] + self.lengths[plain])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], plain[order].astype(np.int32)
        self.first = np.searchsorted(self.hashes >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max())
        self.sizes = np.unique(self.lengths[plain])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``hashes`` that are pieces, and the ids of these."""
        slot = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        low, high = self.first[slot], self.first[slot + 1]
        where, ids = [], []
        for k in range(self.deepest):
            some = np.flatnonzero(low + k < high)
            at = low[some] + k
            hit = self.hashes[at] == hashes[some]
            where.append(some[hit])
            ids.append(self.ids[at[hit]])
        return np.concatenate(where), np.concatenate(ids)


def pieces_at(path: str, sharpness: float) -> Pieces:
    if (path, sharpness) not in _MODELS:
        _MODELS[path, sharpness] = Pieces(path, sharpness)
    return _MODELS[path, sharpness]


class Lattice:
    """Edges of distinct chunks laid end to end, by the node they end at.

    Chunk c has its nodes from ``base[c]`` on. Edges into node v are ``first[v]`` ..
    ``first[v + 1]``; ``share`` is the chance that a path to v came by one of the edges up
    to this one.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray):
        n, count = len(data), len(offsets) - 1
        chunk = np.repeat(np.arange(count), np.diff(offsets))
        self.base = offsets[:-1] + np.arange(count)
        prefix = Prefix(BYTE_VALUES[data])
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
        starts, sizes, ids = [np.arange(n)], [np.ones(n, np.int64)], [pieces.byte[data]]
        some = np.arange(n)
        for size in pieces.sizes.tolist():
            some = some[left[some] >= size]
            if not len(some):
                break
            where, found = pieces.find(prefix.hashes(some, some + size))
            starts.append(some[where])
            sizes.append(np.full(len(where), size, np.int64))
            ids.append(found)
        starts, sizes, ids = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)
        to = starts + sizes + chunk[starts]
        order = np.argsort(to, kind="stable")
        self.to, self.size, self.id = to[order], sizes[order], ids[order]
        self.first = np.searchsorted(self.to, np.arange(n + count + 1))
        self.share = self.filtered(pieces.weights[self.id])

    def filtered(self, weights: np.ndarray) -> np.ndarray:
        """Forward filtering, a node of every chunk at a time; the shares of the edges."""
        nodes = len(self.first) - 1
        depth = np.arange(nodes) - np.repeat(self.base, np.diff(np.r_[self.base, nodes]))
        total = np.zeros(nodes)
        by_depth = np.argsort(depth, kind="stable")
        at = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=0)) + 2))
        share = np.empty(len(self.to))
        for d in range(1, len(at) - 1):
            own = by_depth[at[d] : at[d + 1]]
            counts = self.first[own + 1] - self.first[own]
            edges = ranges(self.first[own], counts)
            logs = total[self.to[edges] - self.size[edges]] + weights[edges]
            opens = np.cumsum(counts) - counts
            most = np.maximum.reduceat(logs, opens)
            part = np.exp(logs - np.repeat(most, counts))
            upto = np.cumsum(part)
            upto -= np.repeat(upto[opens] - part[opens], counts)
            sums = upto[opens + counts - 1]
            total[own] = most + np.log(sums)
            share[edges] = upto / np.repeat(sums, counts)
        share[self.first[1:][np.diff(self.first) > 0] - 1] = 1.0
        return share


def encode(pieces: Pieces, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts and the offsets of the texts in them; a 64-bit key per text."""
    raw, raw_offsets = buffers(texts)
    sizes = np.diff(raw_offsets) + 1
    offsets = np.r_[0, np.cumsum(sizes)]
    data = np.full(int(offsets[-1]), 0x20, np.uint8)
    keep = np.ones(len(data), bool)
    keep[offsets[:-1]] = False
    data[keep] = raw
    cut = np.zeros(len(data) + 1, bool)
    cut[1 : len(data)] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    cut[offsets] = True
    cuts = shorter(data, np.flatnonzero(cut))
    out = np.full(len(data), -1, np.int32)
    first = 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + WINDOW_BYTES, side="right")) - 1)
        sample(pieces, data, cuts[first : last + 1], offsets, keys, out)
        first = last
    chosen = out >= 0
    # Every text has its leading space, so none is empty here.
    counts = np.add.reduceat(chosen, offsets[:-1], dtype=np.int64) if len(sizes) else sizes
    return out[chosen], np.r_[0, np.cumsum(counts)]


def shorter(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """``cuts`` and more inside chunks of over ``LONGEST`` bytes, at starts of characters."""
    lengths = np.diff(cuts)
    long = np.flatnonzero(lengths > LONGEST)
    if not len(long):
        return cuts
    more = ranges(np.zeros(len(long), np.int64), (lengths[long] - 1) // LONGEST) + 1
    more = np.repeat(cuts[long], (lengths[long] - 1) // LONGEST) + more * LONGEST
    for _ in range(3):
        more = more + ((data[np.minimum(more, len(data) - 1)] & 0xC0) == 0x80)
    return np.unique(np.concatenate([cuts, np.minimum(more, len(data))]))


def sample(pieces: Pieces, data: np.ndarray, cuts: np.ndarray, offsets: np.ndarray, keys: np.ndarray, out: np.ndarray) -> None:
    """Puts the drawn piece ids of the chunks between ``cuts`` at their starts in ``out``."""
    begin_, end_ = int(cuts[0]), int(cuts[-1])
    chunks = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts - begin_).astype(np.int64)), pa.py_buffer(data[begin_:end_])]
    ).dictionary_encode()
    known, spots = buffers_of(chunks.dictionary)
    lattice = Lattice(pieces, known, spots)
    code = chunks.indices.to_numpy()
    # Backward sampling: every chunk from its last node to its first.
    text = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    start, base, key = cuts[:-1], lattice.base[code], keys[text]
    node = base + np.diff(cuts)
    begin = offsets[text]
    while len(node):
        here = (start + node - base - begin).astype(np.uint64)
        draw = (mix(key + here * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = lattice.first[node]
        late = np.flatnonzero(draw >= lattice.share[edge])
        while len(late):
            edge[late] += 1
            late = late[draw[late] >= lattice.share[edge[late]]]
        node = node - lattice.size[edge]
        out[start + node - base] = lattice.id[edge]
        left = node > base
        if not left.all():
            start, base, key, node, begin = start[left], base[left], key[left], node[left], begin[left]


def buffers_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array without NULLs."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def decode(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of piece ids, and the offsets of the texts in them."""
    lengths = pieces.lengths[ids]
    data = pieces.bytes[ranges(pieces.at[ids], lengths)]
    ends = np.r_[0, np.cumsum(lengths)][offsets]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    return data[keep], np.r_[0, np.cumsum(np.diff(ends) - (np.diff(ends) > 0))]


def keys_of(doc_ids: pa.Array, seed: int) -> np.ndarray:
    missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(ids ^ mix(np.full(len(ids), seed, np.uint64)) ^ np.where(missing, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0)))


def _each(docs: DataFrame, model: str, sharpness: float, seed: int, result, schema: str) -> DataFrame:
    def work(batches):
        pieces = pieces_at(model, sharpness)
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                ids, offsets = encode(pieces, batch.column("text"), keys_of(batch.column("doc_id"), seed))
                yield result(pieces, batch, ids, offsets)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(work, schema)


def sampled_pieces(docs: DataFrame, model: str, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """doc_id and ids, a sampled segmentation of the whole text."""

    def result(pieces, batch, ids, offsets):
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return _each(docs, model, sharpness, seed, result, "doc_id bigint, ids array<int>")


def decoded_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text, from doc_id and ids. NULL ids give the empty text."""

    def work(batches):
        pieces = pieces_at(model, SHARPNESS)
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy().astype(np.int64)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            data, ends = decode(pieces, ids, np.r_[0, np.cumsum(lengths)])
            text = pa.Array.from_buffers(
                pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def round_trips(docs: DataFrame, model: str, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids) and whether decoding gives the text back."""

    def result(pieces, batch, ids, offsets):
        raw, raw_offsets = buffers(batch.column("text"))
        data, ends = decode(pieces, ids.astype(np.int64), offsets)
        view, own = memoryview(ids.astype("<u4")).cast("B"), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        before, after = raw.tobytes(), data.tobytes()
        spans = zip(raw_offsets[:-1].tolist(), raw_offsets[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in own], pa.int64()),
                pa.array([before[a:b] == after[c:d] for a, b, c, d in spans], pa.bool_()),
            ],
            ["doc_id", "n_pieces", "ids_crc32", "lossless"],
        )

    return _each(docs, model, sharpness, seed, result, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean")
