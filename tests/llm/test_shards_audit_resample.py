"""Sharding, filter audit and resampling against brute force, over rows that are hard to handle."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from whence.llm import filter_audit, kd_shards, resample, rounds
from whence.llm.queries import prepared
from whence.session import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that clash with columns of the results and of the operators' own tables.
CLASHES = "shard int, slot bigint, size string, first int, node int, part string, fails int, rank int, weight double, place int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
LEAST = -(2**63)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéß日XYZ", k=rng.randint(1, 7))) for _ in range(200)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    texts = [make(rng.randint(0, 160)) for _ in range(80)]
    texts += ["same text " * 30] * 60 + [None, None, "", " \n\t", "A", "cost: 5 %", "a|b", "x" * 70_000, "日本" * 9000, make(6000), "AB " * 60]
    rows = []
    for i, t in enumerate(texts):
        rows.append((3 * i + 1, t, rng.choice(["en", "de", None]), rng.choice(["web", "news", None, ""]), rng.choice([None, -5, 10, 2**50, len(t or "")])))
    rows += [rows[4], rows[4], (rows[7][0], "another text", "en", "web", 3), (None, texts[2], "fr", "web", 7), (2**62, "far", "en", "web", 1), (-9, texts[2], "en", "web", 1)]
    return rows


def frame(spark, rows):
    return prepared(spark).createDataFrame([(*r, 7, 7, "7", 7, 7, "p", 7, 7, 7.0, 7) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def order(i):
    return LEAST if i is None else i


# -- sharding ------------------------------------------------------------------------


def size_of(text):
    return len((text or "").encode()) + 1


def kd(rows, leaves):
    """Shard of every row, by sorting whole nodes."""
    codes = [sorted({(r[c] or "") for r in rows}) for c in (2, 3)]
    points = [
        (codes[0].index(r[2] or ""), codes[1].index(r[3] or ""), min(max(r[4] or 0, 0), 1 << 40), order(r[0]), size_of(r[1]))
        for r in rows
    ]
    extent = [max(p[d] for p in points) - min(p[d] for p in points) or 1 for d in range(3)]
    shard = [0] * len(rows)

    def split(members, first, leaves):
        if leaves == 1 or not members:
            for m in members:
                shard[m] = first
            return
        wide = [(max(points[m][d] for m in members) - min(points[m][d] for m in members)) / extent[d] for d in range(3)]
        d = wide.index(max(wide))
        total = sum(points[m][4] for m in members)
        target = total * (leaves // 2) // leaves
        sides, before = ([], []), 0
        key = lambda m: (points[m][d], points[m][3])
        for _, same in itertools.groupby(sorted(members, key=key), key=key):
            same = list(same)
            own = sum(points[m][4] for m in same)
            sides[2 * before + own > 2 * target].extend(same)
            before += own
        split(sides[0], first, leaves // 2)
        split(sides[1], first + leaves // 2, leaves - leaves // 2)

    split(range(len(rows)), 0, leaves)
    return shard


@pytest.mark.parametrize("leaves", [1, 5, 16])
def test_tree_against_sorting(docs, leaves):
    rows = corpus()
    placed = kd_shards.Tree(docs, kd_shards.DIMENSIONS, leaves).place(docs)
    # A column of that name gives way to the shard.
    assert sorted(placed.columns) == sorted(docs.columns)
    got = Counter((r["doc_id"], r["text"], r["shard"]) for r in placed.collect())
    assert got == Counter((r[0], r[1], s) for r, s in zip(rows, kd(rows, leaves)))


def test_document_shards(docs):
    got = kd_shards.document_shards(docs).collect()
    want = Counter((r[0], size_of(r[1]), zlib.crc32((r[1] or "").encode()), s) for r, s in zip(corpus(), kd(corpus(), 16)))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_leaves_reach_the_target_bytes(spark):
    rows = [(i, "x" * (i % 50 + 50), "en", f"s{i % 40}", i % 9) for i in range(2000)]
    docs = frame(spark, rows)
    tree = kd_shards.Tree(docs, kd_shards.DIMENSIONS, target_bytes=20_000)
    sizes = Counter()
    for r in tree.place(docs).select("text", "shard").collect():
        sizes[r["shard"]] += size_of(r["text"])
    assert tree.leaves == -(-sum(sizes.values()) // 20_000) and set(sizes) == set(range(tree.leaves))
    assert max(sizes.values()) - min(sizes.values()) < 1000


def test_one_hot_source_and_one_text(spark):
    rows = [(i, "same", "en", "hot", 4) for i in range(900)] + [(1000 + i, "other text", "de", f"s{i}", 10) for i in range(50)]
    got = kd_shards.document_shards(frame(spark, rows)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * 11


def test_slots_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 40)
    rows = prepared(spark).range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard"))
    got = kd_shards.numbered(rows).collect()
    for shard in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(1000))


def test_shard_files(spark, docs):
    tree = kd_shards.Tree(docs, kd_shards.DIMENSIONS, 4)
    path = scratch_dir(spark, "shards")
    kd_shards.write_shards(docs, tree, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count()
    assert back.groupBy("shard").count().count() == tree.place(docs).select("shard").distinct().count()


def test_no_documents(nothing):
    assert kd_shards.document_shards(nothing).count() == 0
    assert filter_audit.audit(nothing, nothing.selectExpr("doc_id", "1 as quality", "0 as toxic")).count() == 0
    assert resample.resampled(nothing, nothing).count() == 0


# -- filter audit --------------------------------------------------------------------


def fails_of(rows):
    least = {}
    for r in rows:
        least[r[1] or ""] = min(least.get(r[1] or "", 2**63), order(r[0]))
    found = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        tests = [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text),
            order(r[0]) > least[text],
        ]
        found.append(sum(1 << i for i, t in enumerate(tests) if t))
    return found


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(rounds, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(rounds, "PART_BYTES", 30_000)


def test_flags(docs, small_groups):
    got = Counter((r["doc_id"], r["part"], r["fails"]) for r in filter_audit.failures(docs).collect())
    assert got == Counter((r[0], r[3] or "", f) for r, f in zip(corpus(), fails_of(corpus())))


def test_audit(spark, docs):
    rows = corpus()
    marks = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows) if i % 4] + [(rows[1][0], 0, 0), (None, 1, 1), (10**9, 1, 1)]
    labels = spark.createDataFrame([(i, q, int(x)) for i, q, x in marks], "doc_id bigint, quality int, toxic int")
    good = {i for i, q, _ in marks if q and i is not None}
    toxic = {i for i, _, x in marks if x and i is not None}
    want = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, fails_of(rows)) if (r[3] or "") == part]
        removed = Counter()
        steps = []
        for perm in itertools.permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(perm, 1):
                own = 1 << "ABCDE".index(letter)
                gone = [r for r, f in mine if f & own and not f & before]
                removed[letter] += len(gone)
                steps.append(("".join(perm), step, letter, (
                    sum(not f & (before | own) for _, f in mine), len(gone), sum(bool(f & own and f & before) for _, f in mine),
                    sum(f == own for _, f in mine), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                )))
                before |= own
        want |= {(part, o, s, c): (*values, removed[c]) for o, s, c, values in steps}
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"], r["filter"]): tuple(r[n] for n in names) for r in got} == want


def test_matrix_over_one_dictionary(docs, small_groups):
    matrix = filter_audit.Matrix(docs)
    number = {r["word"]: r["number"] for r in matrix.dictionary().collect()}
    counted = [Counter(WORD.findall(r[1] or "")) for r in corpus()]
    assert set(number) == {w for c in counted for w in c} and len(set(number.values())) == len(number)
    assert matrix.dictionary().count() == len(number)
    got = Counter()
    shards = matrix.shards().collect()
    assert len(shards) > 5
    for s in shards:
        for i, (a, b) in zip(s["doc_ids"], zip(s["starts"], s["starts"][1:])):
            got[i, frozenset(zip(s["columns"][a:b], s["counts"][a:b]))] += 1
    assert got == Counter((r[0], frozenset((number[w], n) for w, n in c.items())) for r, c in zip(corpus(), counted))


# -- resampling ----------------------------------------------------------------------

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = TOKEN.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(words), words + [a + b" " + b for a, b in zip(words, words[1:])]


def drawn(rows, target):
    found = [(r[0], *features(r[1])) for r in rows]
    bucket = lambda x: zlib.crc32(x) % 10_000
    s = Counter(bucket(x) for _, _, own in found for x in own)
    t = Counter(bucket(x) for text in target for x in features(text)[1])
    size, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, own in found:
        weight = sum(gain[bucket(x)] for x in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], order(r[0]), r[1], r[2]))
    for place, r in enumerate(long[: 25 * len(long) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


def test_resampling(spark, docs):
    target = ["abc deé Xyz " * 40, None, "", "Eins 2 drei"]
    texts = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = Counter(tuple(r[n] for n in names) for r in resample.resampled(docs, texts).collect())
    assert got == drawn(corpus(), target)


def test_empty_target(spark, docs):
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    empty = spark.createDataFrame([], "text string")
    got = Counter(tuple(r[n] for n in names) for r in resample.resampled(docs, empty).collect())
    assert got == drawn(corpus(), [])


def test_crcs_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8)
    lengths = np.r_[np.arange(1, 400), [64 * 7, 64 * 8 + 1, 4096, 100_001, 250_000], rng.integers(1, 3000, 300)]
    starts = rng.integers(0, len(data) - lengths + 1)
    got = resample.span_crcs(data, starts, starts + lengths)
    assert [zlib.crc32(data[a : a + n]) for a, n in zip(starts, lengths)] == got.tolist()
    assert len(resample.span_crcs(data, starts[:0], starts[:0])) == 0


# -- mixing: names that clash ----------------------------------------------------------


def test_mixing_keeps_columns_of_any_name(docs):
    from whence.llm import mixing

    names = ["mix_domain", "epoch", "domain", "lang_", "source_", "whole", "cut", "row", "copies", "n", "key", "share", "__whole", "__cut"]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = mixing.production(more)
    kept = [n for n in names if n not in ("mix_domain", "epoch")]
    assert got.columns == [*plain.columns, *kept, "mix_domain", "epoch"]
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["mix_domain"], r["epoch"])
    assert sorted(map(key, got.collect())) == sorted(map(key, mixing.production(plain).collect()))
    assert all(got.select(n).distinct().first()[0] == names.index(n) for n in kept)
