"""Quality scores from random-indexing word vectors and a small network.

Every word gets a sparse random index vector by its hash. Over the training sample a word's
context vector adds up the index vectors of its neighbours (two to each side); scaled to
length one and added to the index vector it is the word's vector. So words that occur in
like company come out alike, and unseen words still have their index vector. The shape of
a word (runs of upper case, lower case, digits, and each kind of sign) is indexed as well.
A document is the mean of its words' vectors beside the mean of its shapes', the lengths
of both (a mean of like vectors is long), the logarithm of its number of words, the share
of words that repeat the one before, and that of distinct ones; a network of two layers gives a logit, and a temperature fitted on
a part of the sample that the network has not seen makes it a probability.

Fitting takes at most ``sample`` labelled rows, those with the least hash of their id; it
runs in one task. Scoring reads whole texts. NULL, empty and wordless texts have zero
vectors and get the network's answer to these. Rows without a label are not learnt from.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.llm.kernels import BYTE_VALUES, LOWER_VALUES, Prefix, Words, buffers, distinct
from whence.llm.token_files import slices
from whence.session import durable

#: At most so many labelled rows are learnt from.
SAMPLE = 6000
#: Word and shape hashes fall into so many rows of the tables.
WORD_ROWS = 1 << 15
SHAPE_ROWS = 1 << 10
SIZE = 32
#: Entries of an index vector that are not zero.
SPARSE = 4
REACH = 2
HIDDEN = 24
#: Numbers of a document beside its two mean vectors.
POOLED = 5
SLICE_BYTES = 1 << 20
THRESHOLD = 0.7

#: Kinds of bytes in a shape: 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, signs as themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1] = 1, 2
_KIND[ord("0") : ord("9") + 1], _KIND[128:] = 3, 1


def index_vectors(rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = np.zeros((rows, SIZE), np.float32)
    at = rng.permuted(np.tile(np.arange(SIZE), (rows, 1)), axis=1)[:, :SPARSE]
    found[np.arange(rows)[:, None], at] = rng.choice([-1, 1], (rows, SPARSE))
    return found / np.float32(np.sqrt(SPARSE))


def rows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the words and of their shapes, and the offsets of the texts in them."""
    data, offsets = buffers(texts)
    words = Words(data, offsets)
    row = words.values(data, LOWER_VALUES) >> np.uint64(64 - 15)
    kind = _KIND[data]
    changes = np.ones(len(kind), bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes[words.starts] = True
    before = np.r_[0, np.cumsum(changes)]
    shape = Prefix(BYTE_VALUES[kind[changes]]).hashes(before[words.starts], before[words.ends]) >> np.uint64(64 - 10)
    return row.astype(np.int64), shape.astype(np.int64), words.firsts


def means(table: np.ndarray, rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Mean vector of each text, zero for those without words."""
    counts = np.diff(firsts)
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(table[rows], firsts[:-1][full], axis=0) / counts[full][:, None]
    return out


def features(texts: pa.Array, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    row, shape, firsts = rows_of(texts)
    pooled = [means(words, row, firsts), means(shapes, shape, firsts)]
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    some = np.maximum(counts, 1)
    again = np.bincount(text[1:][(row[1:] == row[:-1]) & (text[1:] == text[:-1])], minlength=len(counts)) / some
    distinct_words = np.bincount((distinct((text * WORD_ROWS + row).astype(np.uint64)) // np.uint64(WORD_ROWS)).astype(np.int64), minlength=len(counts))
    sums = [np.log1p(counts), again, distinct_words / some, np.linalg.norm(pooled[0], axis=1), np.linalg.norm(pooled[1], axis=1)]
    return np.concatenate([*pooled, np.stack(sums, axis=1).astype(np.float32)], axis=1)


def stretches(texts: pa.Array) -> list[pa.Array]:
    """The texts in stretches of bounded bytes."""
    return [b.column(0) for b in slices(pa.RecordBatch.from_arrays([texts], ["text"]), SLICE_BYTES)]


def word_vectors(texts: pa.Array, index: np.ndarray) -> np.ndarray:
    """Index vectors plus the directions of the context vectors, scaled to length one."""
    context = np.zeros(index.shape, np.float64)
    for some in stretches(texts):
        row, _, firsts = rows_of(some)
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        for step in range(1, REACH + 1):
            near = text[step:] == text[:-step]
            left, right = row[:-step][near], row[step:][near]
            for dim in range(SIZE):
                for own, other in ((left, right), (right, left)):
                    context[:, dim] += np.bincount(own, index[other, dim], len(index))
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + (context / np.where(norm == 0, 1, norm)).astype(np.float32)


def fitted(texts: pa.Array, labels: np.ndarray, order: np.ndarray) -> dict:
    """A model: tables, scaling, weights and temperature. ``order`` picks every fifth row for calibration."""
    index, shapes = index_vectors(WORD_ROWS, 1), index_vectors(SHAPE_ROWS, 2)
    held = order % 5 == 0 if len(order) >= 50 else np.zeros(len(order), bool)
    words = word_vectors(texts, index)
    parts = [features(some, words, shapes) for some in stretches(texts)]
    x = np.concatenate(parts) if parts else np.zeros((0, 2 * SIZE + POOLED), np.float32)
    y = labels.astype(np.float64)
    mean, scale = x[~held].mean(axis=0) if len(x) else 0.0, x[~held].std(axis=0) + 1e-3 if len(x) else 1.0
    x = (x - mean) / scale
    rng = np.random.default_rng(3)
    w = [rng.normal(0, 0.3, (2 * SIZE + POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    a, b = x[~held], y[~held]
    for step in range(1, 401 if len(a) else 1):
        hidden = np.tanh(a @ w[0] + w[1])
        error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - b) / len(b)
        back = np.outer(error, w[2]) * (1 - hidden**2)
        slopes = [a.T @ back + 2e-4 * w[0], back.sum(axis=0), hidden.T @ error + 2e-4 * w[2], error.sum(keepdims=True)]
        for p, g, m, v in zip(w, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    logits = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    own, target = (logits[held], y[held]) if held.any() else (logits, y)
    losses = [np.mean(np.logaddexp(0, -np.where(target == 1, own, -own) / t)) if len(own) else 0.0 for t in temperatures]
    return {"words": words, "shapes": shapes, "mean": mean, "scale": scale, "w": w, "t": float(temperatures[int(np.argmin(losses))])}


def probabilities(model: dict, texts: pa.Array) -> np.ndarray:
    x = (features(texts, model["words"], model["shapes"]) - model["mean"]) / model["scale"]
    w = model["w"]
    logits = (np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]) / model["t"]
    # Rounded, as the last digits of a matrix product depend on what else is in the batch.
    return np.round(1 / (1 + np.exp(-np.clip(logits, -500, 500))), 9)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from at most ``sample`` labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = durable(known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(chosen, "doc_id").select("doc_id", "text", "label", "order")

    def train(batches):
        whole = pa.Table.from_batches(list(batches), schema=None).sort_by([("order", "ascending"), ("text", "ascending")])
        order = whole.column("order").to_numpy().view(np.uint64) % np.uint64(1_000_003)
        model = fitted(whole.column("text").combine_chunks(), whole.column("label").to_numpy(), order.astype(np.int64))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    def guarded(batches):
        first = next(batches, None)
        if first is not None:
            yield from train([first, *batches])

    found = rows.repartition(1).mapInArrow(guarded, "model binary").first()
    if found:
        return pickle.loads(found["model"])
    return fitted(pa.array([], pa.string()), np.zeros(0), np.zeros(0, np.int64))


def scored(docs: DataFrame, model: dict, passes: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``passes``, held_out, score and predicted (1 for a score of at least 0.7)."""
    passes = passes or []
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: dict = {}

    def work(batches):
        if not loaded:
            loaded.update(pickle.loads(sent.value))
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                score = probabilities(loaded, batch.column("text"))
                kept = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(score, pa.float64())], [*names, "score"])

    names = [c for c in dict.fromkeys(["doc_id", *passes])]
    inner = [c for c in dict.fromkeys([*names, "text"])]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    # NULL texts stay NULL in what passes; the kernels read them as empty.
    found = docs.select(*inner).mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return found.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": predicted})
