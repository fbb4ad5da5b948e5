"""Each operator against a brute-force version, over rows that are hard to handle."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from whence.llm import edit_walk, jaccard, mixing, page_text, pieces, quality, rounds, suffixes, token_files, topk, windows
from whence.llm.queries import prepared, vocabulary
from whence.session import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, part int, id string, round int"


def corpus():
    rng = random.Random(4)
    vocabulary_ = ["".join(rng.choices("abcdeéß日", k=rng.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(vocabulary_, k=n))
    passage = make(60)
    base = make(120).split(" ")
    texts = [make(rng.randint(1, 80)) for _ in range(30)]
    texts += [f"{make(20)}\n{passage} {make(9)}" for _ in range(6)]
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = make(1)
        texts.append(" ".join(words))
    texts += [texts[0], texts[40], texts[40], None, "", "  \n", "one", "One", "a b c d", "A  b\tc d", "x" * 3000, "x" * 3000 + "y", make(4000)]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return [*rows, (7, texts[6]), (None, texts[41])]


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    more = [(i, t, "en", "src1", None, "g", 3, "id", 9) for i, t in corpus()]
    return spark.createDataFrame(more, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return prepared(spark).createDataFrame([], SCHEMA)


def order(i):
    return -(2**63) if i is None else i


def results(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (order(r[0]), str(r)))


def expected(found):
    return sorted(found, key=lambda r: (order(r[0]), str(r)))


def test_windows(docs):
    rows = [(i, WORD.findall(t or "")) for i, t in corpus()]
    least = {}
    for i, w in rows:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            least[k] = min(least.get(k, 2**63), order(i))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if least[tuple(w[j : j + 13])] < order(i):
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert results(windows.kept_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == expected(want)
    assert windows.levels(4, 13) == [4, 8, 13] and windows.levels(20, 13) == [13]


@pytest.mark.parametrize("hot_names, group_bytes", [(suffixes.HOT_NAMES, 2 << 20), (1, 2 << 20), (1, 2000), (2, 2000)])
def test_suffixes(docs, monkeypatch, hot_names, group_bytes):
    least = {}
    rows = [(i, (t or "").encode()) for i, t in corpus()]
    for i, b in rows:
        for p in range(len(b) - 99):
            k = b[p : p + 100]
            least[k] = min(least.get(k, (2**63, 0)), (order(i), p))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if least[b[p : p + 100]] < (order(i), p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    monkeypatch.setattr(rounds, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(rounds, "PART_BYTES", group_bytes)
    found = suffixes.kept_bytes(docs, carry=("lang",), hot_names=hot_names)
    assert results(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept") == expected(want)
    assert {r.lang for r in found.collect()} == {"en"}


def test_jaccard(docs):
    sets = {}
    rows = []
    for i, t in corpus():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        rows.append((i, len(s)))
        sets.setdefault(order(i), []).append(s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for x in keys:
        for y in keys:
            links = any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[x] for b in sets[y])
            if x < y and links:
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    want = [(i, n, None if root(order(i)) == order(None) else root(order(i))) for i, n in rows]
    assert results(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == expected(want)


def test_product_across_classes():
    """Documents that only link with others than the least one are found by the blocks."""
    items = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 14, 28, 400)]
    table = pa.table({"n": [100] * 4, "label": [0, 1, 2, 3], "items": [x.tobytes() for x in items]})
    links = jaccard.product(None, table, table, 75).to_pydict()
    assert set(zip(links["a"], links["b"])) == {(1, 0), (2, 1)}


def test_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(edit_walk, "GROUP_BYTES", 4096)
    rows = sorted(((order(i), t or "", i) for i, t in corpus()))
    want = []
    for k, (_, t, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    found = edit_walk.document_fingerprints(docs).cache()
    assert results(found, "doc_id", "n_chars", "edited_sha256") == expected(want)
    prints, texts = {}, dict((order(i), t or "") for i, t in corpus())
    for r in found.collect():
        assert prints.setdefault(texts[order(r.doc_id)], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    near = {(r.doc_id, r.near_id) for r in edit_walk.near_documents(found).collect()}
    assert (62, 1) in near and not any({a, b} <= set(range(2, 30)) for a, b in near)


def test_walks_match_one_by_one():
    texts = ["abc" * 40, "", "a", "zebra " * 30, "q" * 500]
    points = [edit_walk.code_points(t) for t in texts]
    for p, steps in zip(points, edit_walk.walks(points)):
        t, want = 0, []
        for x in p.tolist():
            want.append(t)
            t += int(edit_walk._STAY[((t & 4095) << 8) | (x * 0x9E3779B1 % 2**32 >> 24)])
        assert steps.tolist() == [*want, t]
    same = edit_walk.fingerprints(["w " * 5000 + "tail " * 2000, "w " * 5000 + "tail " * 2000 + "more words at the end " * 400])
    assert edit_walk.likeness(*same) > 0.5


def test_quality(spark, docs, nothing):
    rng = random.Random(1)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of", "the"], k=40)) + "." for _ in range(300)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    many = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    model = quality.fit(many, known)
    held = quality.scored(many, model).filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held) and len(held) > 100
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in held]) > 0.95
    scores = quality.scored(docs, model, ["source", "text"]).collect()
    assert len(scores) == len(corpus()) and all(0 <= r.score <= 1 for r in scores)
    by_text = {}
    for r in scores:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert quality.fit(nothing, known.limit(0))["t"] > 0


def test_mixing_redistributes_among_siblings_first(spark):
    rows = [(i, "w " * 10, "en" if i < 60 else "de", f"s{i % 2}" if i < 40 else "s4", 0) for i in range(100)]
    rows += [(None, None, None, None, None), (200, "", "en", "s1", 0)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one = F.lit(1)
    domain = F.when(F.col("lang") == "en", "e").otherwise("d")
    found = mixing.mixed(many, domain, F.lit(900), {"domain": one, "lang_": one, "source_": one}, epochs=1, seed=3)
    counts = {(r.lang, r.source): r.n for r in found.filter("text <> ''").groupBy("lang", "source").agg(F.count("*").alias("n")).collect()}
    # Domain d can give 400 tokens of its 450, so e gets 500: three sources of 200 each share it.
    assert counts == {("de", "s4"): 40, ("en", "s0"): 17, ("en", "s1"): 17, ("en", "s4"): 17}
    again = mixing.mixed(many, domain, F.lit(2000), {"domain": one, "lang_": one, "source_": one}, epochs=2, seed=3)
    again = again.filter("text <> ''")
    assert again.filter("epoch = 1").count() == 100 and again.count() == 200


def test_pieces(docs, nothing):
    path = vocabulary("piece_bpe_32k.model")
    encoded = pieces.sampled_pieces(docs, path).cache()
    back = results(pieces.decoded_pieces(encoded, path), "doc_id", "text")
    assert back == expected([(i, t or "") for i, t in corpus()])
    assert results(encoded, "doc_id", "ids") == results(pieces.sampled_pieces(docs.repartition(7), path), "doc_id", "ids")
    assert all(r.lossless for r in pieces.round_trips(docs, path).collect())
    assert pieces.round_trips(nothing, path).count() == 0
    odd = pa.array(["▁a ▁", "  x", "\x00\n\t ", "日本 語", "", "🙂" * 3])
    model = pieces.pieces_at(path, 1.5)
    ids, offsets = pieces.encode(model, odd, pieces.keys_of(pa.array([1, 2, 3, 4, None, 6]), 1))
    data, _ = pieces.decode(model, ids.astype(np.int64), offsets)
    assert data.tobytes() == "".join(odd.to_pylist()).encode()


def test_pieces_follow_the_lattice():
    model = pieces.pieces_at(vocabulary("piece_bpe_32k.model"), 1.5)

    def paths(left):
        if not left:
            return {(): 0.0}
        return {
            (i, *rest): w + model.weights[i]
            for i, b in enumerate(model.spelt) if b and left.startswith(b)
            for rest, w in paths(left[len(b) :]).items()
        }

    known = paths(b" the")
    total = np.logaddexp.reduce(list(known.values()))
    n = 50_000
    ids, at = pieces.encode(model, pa.array(["the"] * n), pieces.keys_of(pa.array(range(n)), 5))
    seen: dict = {}
    for a, b in zip(at[:-1], at[1:]):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    assert max(abs(np.exp(w - total) - seen.get(p, 0) / n) for p, w in known.items()) < 0.01


def test_pages(spark, nothing):
    frame = "<div>Site of all</div>"
    rows = [
        (1, "http://h/a/1", f"<body>{frame}<p>One &amp; two<br>three</p><p>Four</p></body>"),
        (2, "http://h/a/2.html?x=1", f"<body>{frame}<p>Other</p><span class=ad>Buy</span><p>text"),
        (3, "http://g/x", "<nav>menu</nav><article><h1>Title</h1><p>A  b<p>c<aside>no</aside><div class='comments'><p>hi</p></div></article>tail"),
        (4, "http://g/y", "<script>var t='</p>';</script><form>f</form><main><p>M &lt;b&gt;</p></main><footer>f</footer>"),
        (5, None, None), (6, "", ""), (6, "", ""), (7, "http://k/z", "<p>unclosed <b>bold"),
    ]
    pages = prepared(spark).createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in page_text.main_text(pages).collect()}
    want = {1: "One & two three\n\nFour", 2: "Other\n\ntext", 3: "Title\n\nA b\n\nc", 4: "M <b>", 5: "", 6: "", 7: "unclosed bold"}
    assert found == want
    assert page_text.main_text(pages).count() == len(rows) and page_text.main_text(pages.limit(0)).count() == 0
    assert page_text.shared([1, 2, 3, 4], [2, 9, 4]) == {1, 3}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(130)]
    vectors += [(130 + i, vectors[3][1]) for i in range(4)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [0.0]), (None, [1.0] * 8)]
    rows = prepared(spark).createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    found = topk.top_k(rows, F.col("id") % 50 == 0, 5)
    whole = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in vectors if i is not None and i not in (200, 201, 202)}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert topk.top_k(rows.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_token_files(spark, docs, nothing, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PARTITION_BYTES", 8192)
    path = vocabulary("byte_bpe_50k.json")
    out = scratch_dir(spark, "tokens")
    token_files.write_tokens(docs, out, path)
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for _, t, i in sorted((order(i), t or "", i) for i, t in corpus()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    tokens = token_files.read_tokens(spark, out)
    assert results(token_files.checksums(tokens), "doc_id", "start", "n_tokens", "ids_crc32") == expected(want)
    plan = tokens.select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    token_files.write_tokens(nothing, empty := scratch_dir(spark, "tokens"), path)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_chunks_keep_the_ids_of_texts():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["a  b\n\n c", "  x", "x  ", "a 　 b", "it's we'll  'x  ’s", "é è  à \t \n z", "", "\x1c a \x85 b", " " * 50 + "a", "12 34  5,6 !?"]
    ids, at = token_files.encode(pa.array(odd), path, 0)
    for k, t in enumerate(odd):
        assert ids[at[k] : at[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("run", [windows.kept_words, suffixes.kept_bytes, jaccard.components, edit_walk.document_fingerprints, mixing.production])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


@pytest.mark.parametrize("slice_", [1, 300, 1 << 20])
def test_open_windows_in_slices(monkeypatch, slice_):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    rng = np.random.default_rng(3)
    counts, ids = rng.integers(1, 6, 60), rng.integers(0, 9, 60).astype("<u4")
    place, text = rng.integers(0, 50, 60).astype("<u4"), rng.integers(0, 2, int(counts.sum()) + 60 * 3).astype(np.uint8)
    rows, at = [], 0
    for i, p, n in zip(ids.tolist(), place.tolist(), counts.tolist()):
        rows += [(text[at + j : at + j + 4].tobytes(), (i, p + j)) for j in range(n)]
        at += n + 3
    least = {k: min(w for x, w in rows if x == k) for k, _ in rows}
    found = suffixes.open_windows(ids, place, counts, text, 4)
    assert found.tolist() == [least[k] < w for k, w in rows]
    none = np.zeros(0, np.int64)
    assert len(suffixes.open_windows(none, none, none, text[:0], 4)) == 0
