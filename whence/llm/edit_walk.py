"""Document fingerprints by a randomised edit embedding.

All texts are walked with the same random bits: at step j with the pointer on character x,
a shared random function of (j, x) says whether the pointer moves on. The characters under
the pointer, step by step, are the embedding of the text. Walks that meet after an edit
tend to go on together, so the edit distance of texts becomes a Hamming distance of
embeddings. How long the pointer stays on a character is drawn as one number, so a walk
takes a step per character.

The fingerprint samples the embedding at positions shared by all texts: level L keeps the
positions whose hash ends in L zero bits, and a text takes the least level that leaves it
256 samples on average at most. Levels are nested, so fingerprints of different levels
compare at the higher one. A sample is four bits of a hash of its position and the three
characters from the pointer on. Likeness is the share of equal samples of the longer list,
less what unequal texts reach by chance (one in 16).

Bands of neighbouring samples bring similar documents together, and likeness verifies them.

NULL texts count as empty; two empty texts are alike (1). A NULL id counts as the smallest,
and rows with equal ids stand in the order of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whence.llm.kernels import mix

#: The random function repeats after so many steps; characters fall into 256 classes.
PERIOD = 4096
CLASSES = 256
LONGEST_STAY = 8
SAMPLES = 256
#: Bytes of text of one group of neighbouring documents.
GROUP_BYTES = 4 << 20
BAND = 6
#: Active texts below which a walk goes text by text.
FEW = 12
LEAST = -(2**63)

_STAY = np.minimum(np.random.default_rng(11).geometric(0.5, PERIOD * CLASSES), LONGEST_STAY).astype(np.int32)
_ZEROS: dict[str, np.ndarray] = {"all": np.zeros(0, np.uint8)}


def zero_bits(n: int) -> np.ndarray:
    """Zero bits at the end of the hash of each of at least ``n`` positions."""
    known = _ZEROS["all"]
    if len(known) < n:
        h = mix(np.arange(max(n, 1 << 18), dtype=np.uint64) + np.uint64(1))
        low = h & (~h + np.uint64(1))
        known = np.where(h == 0, 64, np.log2(low.astype(np.float64))).astype(np.uint8)
        _ZEROS.clear()
        _ZEROS["all"] = known
    return known


def positions(level: int, n: int) -> np.ndarray:
    """Sampled positions below ``n`` at a level, ascending."""
    zeros = zero_bits(n)
    if level not in _ZEROS:
        _ZEROS[level] = np.flatnonzero(zeros >= level)
    found = _ZEROS[level]
    return found[: np.searchsorted(found, n)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walks(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the step at which its pointer reaches each character, and the last step.

    Texts go side by side, the longest first, a character of all per round.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    out: list = [None] * len(texts)
    if not len(order):
        return out
    rounds = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(rounds), side="left")
    at = np.r_[0, np.cumsum(active)]
    together = int(np.searchsorted(-active, -FEW, side="right"))
    chars = np.empty(int(at[together]), np.int32)
    classes = [(texts[i] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int32) for i in order]
    for d, c in enumerate(classes):
        n = min(len(c), together)
        chars[at[:n] + d] = c[:n]
    steps = np.empty(len(chars), np.int32)
    here = np.zeros(len(order), np.int32)
    index, stay = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    for r in range(together):
        a, low = active[r], at[r]
        t, i, s = here[:a], index[:a], stay[:a]
        steps[low : low + a] = t
        np.bitwise_and(t, PERIOD - 1, out=i)
        np.left_shift(i, 8, out=i)
        np.bitwise_or(i, chars[low : low + a], out=i)
        np.take(_STAY, i, out=s)
        np.add(t, s, out=t)
    table = None
    for d, (i, c) in enumerate(zip(order, classes)):
        n = min(len(c), together)
        own = np.empty(len(c) + 1, np.int64)
        own[:n] = steps[at[:n] + d]
        t = int(here[d])
        if len(c) > n:
            table = table or _STAY.tobytes()[::4]
            tail = []
            for x in c[n:].tolist():
                tail.append(t)
                t += table[((t & (PERIOD - 1)) << 8) | x]
            own[n:-1] = tail
        own[-1] = t
        out[i] = own
    return out


def fingerprint(points: np.ndarray, steps: np.ndarray) -> str:
    """Two hexadecimal digits of the level and one per sample."""
    size = int(steps[-1])
    level = max(0, int(np.ceil(np.log2(size / SAMPLES)))) if size > SAMPLES else 0
    sampled = positions(level, size)
    i = np.searchsorted(steps[:-1], sampled, side="right") - 1
    last = len(points)
    code = np.zeros(len(sampled), np.uint64)
    for k in range(3):
        code = code * np.uint64(0x100000001B3) + np.where(i + k < last, points[np.minimum(i + k, last - 1)] + np.uint64(1), 0)
    nibbles = mix(code ^ (sampled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(60)
    return f"{level:02x}" + "".join(np.array(list("0123456789abcdef"))[nibbles.astype(np.int64)].tolist())


def fingerprints(texts: list[str]) -> list[str]:
    points = [code_points(t) for t in texts]
    return [fingerprint(p, w) for p, w in zip(points, walks(points))]


def likeness(one: str, two: str) -> float:
    """Share of equal samples, from 0 (as between unrelated texts) to 1."""
    if one == two:
        return 1.0
    level = max(int(one[:2], 16), int(two[:2], 16))

    def at(print_: str) -> np.ndarray:
        own = int(print_[:2], 16)
        values = np.frombuffer(print_[2:].encode(), np.uint8)
        if own == level:
            return values
        # The positions of its own level that belong to the higher one as well.
        reach = max(1 << 18, len(values) << (own + 2))
        found = positions(own, reach)
        while len(found) < len(values):
            reach *= 2
            zero_bits(reach)
            found = positions(own, reach)
        return values[zero_bits(reach)[found[: len(values)]] >= level]

    a, b = at(one), at(two)
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if not most:
        return 0.0
    equal = np.count_nonzero(a[:least] == b[:least]) / most
    return float(max(0.0, (equal - 1 / 16) / (15 / 16)))


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame) -> DataFrame:
    """part, tail, doc_id, id, text: groups of neighbours by id, each with the document that follows it.

    Ranges of ids are bounded by ids that occur, so the first document of a range is known
    by its id and is sent to the range before as well (``tail``).
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size, first = docs.agg(F.sum(F.octet_length("text")), F.min("id")).first()
    parts = max(1, -(-(size or 0) // GROUP_BYTES))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = docs.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 10 * parts)))).first()[0] if parts > 1 else []
    bounds = np.array(sorted(set(bounds or []) - {first}), np.int64)
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy()
        own = np.searchsorted(bounds, ids, side="right")
        opens = np.isin(ids, bounds)
        # Part p as p; the copy for part p as -p - 1.
        return pd.Series(
            [[p, -p] if o else [p, -last - 1] if i == first else [p] for p, o, i in zip(own.tolist(), opens.tolist(), ids.tolist())]
        )

    dealt = docs.withColumn("place", F.explode(places("id")))
    tail = F.col("place") < 0
    return dealt.select(F.when(tail, -F.col("place") - 1).otherwise(F.col("place")).alias("part"), tail.alias("tail"), "doc_id", "id", "text")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def work(rows):
        rows = rows.sort_by([("tail", "ascending"), ("id", "ascending"), ("text", "ascending")])
        tail = rows.column("tail").to_numpy(zero_copy_only=False)
        own = int((~tail).sum())
        # Of the rows that follow, the first counts.
        texts = rows.column("text").slice(0, own + 1).to_pylist()
        changed = [edited(a, b) for a, b in zip(texts[:own], texts[1:])]
        prints = fingerprints(texts + changed)
        after = prints[len(texts) :]
        return pa.table(
            {
                "doc_id": rows.column("doc_id").slice(0, own),
                "n_chars": pa.array([len(t) for t in texts[:own]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                "fingerprint": prints[:own],
                "edited_fingerprint": after,
                "near_edited": pa.array([likeness(a, b) for a, b in zip(prints[:own], after)], pa.float64()),
                "near_next": pa.array([likeness(a, b) for a, b in zip(prints[:own], prints[1 : own + 1])], pa.float64()),
            }
        )

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return neighbours(docs).groupBy("part").applyInArrow(work, schema)


def near_documents(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, near_id, likeness: documents alike by at least ``least``, from (doc_id, fingerprint).

    Every band of ``BAND`` neighbouring samples is a key, over the whole length of the text;
    under a key each document meets the least id, so a key costs as many pairs as it has
    documents. Equal fingerprints are one row.
    """
    same = Window.partitionBy("fingerprint")
    named = prints.filter("doc_id is not null and length(fingerprint) > 2").withColumn("head", F.min("doc_id").over(same))
    heads = named.filter("doc_id = head").select("doc_id", "fingerprint").distinct()
    count = F.greatest(F.floor((F.length("fingerprint") - 2) / BAND), F.lit(1)).cast("int")
    bands = heads.withColumn("b", F.explode(F.sequence(F.lit(0), count - 1)))
    value = F.expr(f"substring(fingerprint, 3 + {BAND} * b, {BAND})")
    bands = bands.select("doc_id", F.substring("fingerprint", 1, 2).alias("level"), "b", value.alias("value"))
    keys = ["level", "b", "value"]
    met = bands.groupBy(*keys).agg(F.min("doc_id").alias("near_id"), F.max("doc_id").alias("most")).filter("near_id < most")
    pairs = bands.join(met, keys).filter("doc_id > near_id").select("doc_id", "near_id").distinct()
    other = heads.select(F.col("doc_id").alias("near_id"), F.col("fingerprint").alias("other"))

    @F.pandas_udf("double")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(one, two)], dtype="float64")

    found = pairs.join(heads, "doc_id").join(other, "near_id").withColumn("likeness", alike("fingerprint", "other"))
    found = found.filter(F.col("likeness") >= least).select("doc_id", "near_id", "likeness")
    copies = named.filter("doc_id > head").select("doc_id", F.col("head").alias("near_id"), F.lit(1.0).alias("likeness"))
    return found.unionByName(copies.distinct())
