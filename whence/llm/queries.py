"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ROOT = str(Path(__file__).resolve().parents[2])


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session find this package wherever they start."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    return spark


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, path: build(prepared(spark), path.rstrip("/"))
        if sql:
            SQL[name] = sql
        return build

    return register


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


#: Words of a text, as a DuckDB expression.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    f"""
    WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)
    ),
    least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
      FROM win JOIN least USING (k) WHERE m < doc_id
    ),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
      FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
      sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """
)
def op8_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Words left of every document once 13-word windows of smaller ids are removed."""
    from whence.llm.windows import kept_words

    return kept_words(documents(spark, path), texts=False)


@query()
def op2_suffix_array_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Bytes left of every document once 100-byte strings that start earlier are removed."""
    from whence.llm.suffixes import kept_bytes

    return kept_bytes(documents(spark, path), texts=False)


@query(
    f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ),
    s AS (
      SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
        ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
      FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ),
    link AS (
      SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * o >= 75 * (x.n + y.n - o)
    ),
    reach(doc_id, r) AS (
      SELECT doc_id, doc_id FROM documents
      UNION
      SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r
    )
    SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
    FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id
    """
)
def op6_ngram_jaccard_join(spark: SparkSession, path: str) -> DataFrame:
    """Shingles and component of every document; links at a similarity of 0.75."""
    from whence.llm.jaccard import components

    return components(documents(spark, path))


@query(
    """
    WITH v AS (
      SELECT vec_id, max(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS w
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      GROUP BY vec_id
    ),
    s AS (
      SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 5
    """
)
def op9_exact_top_k_search(spark: SparkSession, path: str) -> DataFrame:
    """The 5 nearest other vectors of every 50th vector."""
    from pyspark.sql import functions as F

    from whence.llm.topk import top_k

    return top_k(spark.read.parquet(f"{path}/embeddings.parquet"), F.col("id") % 50 == 0, 5)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op10_token_id_output(spark: SparkSession, path: str) -> DataFrame:
    """Position, number and checksum of the token ids of every document, from the files."""
    from whence.llm.token_files import checksums, read_tokens, write_tokens
    from whence.session import scratch_dir

    out = scratch_dir(spark, "tokens")
    write_tokens(documents(spark, path), out, vocabulary("byte_bpe_50k.json"))
    return checksums(read_tokens(spark, out))


def mix_sql(docs: str = "documents") -> str:
    """DuckDB SQL of the production mix: the columns of ``docs``, mix_domain, n_tokens and epoch."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

    def level(name: str, keys: list[str], above: str, before: str, weight: str) -> str:
        key, by = ", ".join(keys), ", ".join(keys[:-1]) or "1"
        join = f"USING ({', '.join(keys[:-1])})" if keys[:-1] else "ON true"
        return f"""
    {name}_n AS (
      SELECT n.*, {before} AS budget FROM (
        SELECT {key}, sum(tokens * 2)::BIGINT AS cap, {weight} AS weight FROM leaf WHERE tokens > 0 GROUP BY {key}
      ) n JOIN {above} a {join}
    ),
    {name}_f AS (
      SELECT *, sum(cap) OVER o * weight + cap * coalesce(sum(weight) OVER r, 0) <= budget * weight AS is_full FROM {name}_n
      WINDOW o AS (PARTITION BY {by} ORDER BY cap / weight, {key} ROWS UNBOUNDED PRECEDING),
        r AS (PARTITION BY {by} ORDER BY cap / weight, {key} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    ),
    {name} AS (
      SELECT {key}, CASE WHEN is_full THEN cap ELSE weight * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER w, 0))
        // sum(CASE WHEN NOT is_full THEN weight END) OVER w END AS share
      FROM {name}_f WINDOW w AS (PARTITION BY {by})
    )"""

    return f"""
    WITH d AS (
      SELECT *, CASE WHEN regexp_matches(source, '[02468]$') THEN 'even' ELSE 'odd' END AS mix_domain,
        coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source, {words}::BIGINT AS n_tokens FROM {docs}
    ),
    leaf AS (SELECT mix_domain, mix_lang, mix_source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
    top AS (SELECT sum(tokens)::BIGINT AS share FROM leaf),
    {level("lv1", ["mix_domain"], "top", "least(a.share, sum(cap) OVER ())", "CASE mix_domain WHEN 'even' THEN 3 ELSE 2 END")},
    {level("lv2", ["mix_domain", "mix_lang"], "lv1", "a.share",
           "CASE mix_lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
    {level("lv3", ["mix_domain", "mix_lang", "mix_source"], "lv2", "a.share", "1")},
    k AS (
      SELECT d.*, (share // tokens)::BIGINT AS whole, (share % tokens)::BIGINT AS rest,
        md5('7|' || (share // tokens)::BIGINT || '|' || coalesce(doc_id::VARCHAR, '')) AS k
      FROM d JOIN leaf USING (mix_domain, mix_lang, mix_source) JOIN lv3 USING (mix_domain, mix_lang, mix_source)
      WHERE tokens > 0
    ),
    c AS (
      SELECT *, whole + CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY k
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) < rest THEN 1 ELSE 0 END AS copies FROM k
    )
    SELECT doc_id, text, lang, source, n_chars, mix_domain, n_tokens, unnest(range(copies)) AS epoch FROM c
    """


@query(f"SELECT doc_id, mix_domain, lang, source, n_tokens, epoch FROM ({mix_sql()})")
def op7_mixing_to_weights(spark: SparkSession, path: str) -> DataFrame:
    """The epochs in which each document is taken, by weights of domains and languages."""
    from pyspark.sql import functions as F

    from whence.llm.mixing import production, token_count

    found = production(documents(spark, path))
    return found.select("doc_id", "mix_domain", "lang", "source", token_count(F.col("text")).alias("n_tokens"), "epoch")


@query()
def op1_document_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    from whence.llm.edit_walk import document_fingerprints

    return document_fingerprints(documents(spark, path))


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/labels.parquet")


@query()
def op3_quality_classifier(spark: SparkSession, path: str) -> DataFrame:
    """Score and prediction of the quality of every document."""
    from whence.llm.quality import fit, scored

    docs = documents(spark, path)
    return scored(docs, fit(docs, labels(spark, path))).select("doc_id", "held_out", "score", "predicted")


@query()
def op4_sentencepiece_sampling(spark: SparkSession, path: str) -> DataFrame:
    """Number and checksum of the sampled pieces of every document, and the round trip."""
    from whence.llm.pieces import round_trips

    return round_trips(documents(spark, path), vocabulary("piece_bpe_32k.model"))


@query()
def op5_html_extraction(spark: SparkSession, path: str) -> DataFrame:
    """Main text of every page."""
    from whence.llm.page_text import main_text

    return main_text(spark.read.parquet(f"{path}/pages.parquet"))


def crc_sql(digits: str) -> str:
    """DuckDB expression: the unsigned CRC-32 of bytes given as hex digits, a byte after the other."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return f"""xor(list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(
            range(1, length({digits}) + 1, 2), lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)),
          lambda acc, b: xor(acc >> 8, ({table}::BIGINT[])[xor(acc & 255, b) + 1])
        ), 4294967295)"""


def kd_sql() -> str:
    """DuckDB SQL of the shards: a k-d tree of 16 leaves by windows over whole nodes."""
    axes = ["x0", "x1", "x2"]
    extent = ", ".join(f"(max({x}) - min({x}))::DOUBLE AS e_{x}" for x in axes)
    parts = [f"""
    WITH h AS (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (
      SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS id, (length(h) // 2 + 1)::BIGINT AS size,
        {crc_sql("h")} AS text_crc32,
        dense_rank() OVER (ORDER BY coalesce(lang, '')) - 1 AS x0, dense_rank() OVER (ORDER BY coalesce(source, '')) - 1 AS x1,
        least(greatest(coalesce(n_chars, 0), 0), 1099511627776) AS x2
      FROM h
    ),
    e AS (SELECT {extent} FROM p),
    l0 AS (SELECT *, 0 AS shard FROM p)"""]
    leaves = 16
    for i in range(4):
        widths = [f"coalesce((max({x}) - min({x})) / nullif(any_value(e_{x}), 0), 0)" for x in axes]
        parts.append(f"""
    w{i} AS (SELECT shard, {", ".join(f"{w} AS w_{x}" for w, x in zip(widths, axes))} FROM l{i}, e GROUP BY shard),
    k{i} AS (
      SELECT l{i}.*, CASE greatest(w_x0, w_x1, w_x2) WHEN w_x0 THEN x0 WHEN w_x1 THEN x1 ELSE x2 END AS k
      FROM l{i} JOIN w{i} USING (shard)
    ),
    l{i + 1} AS (
      SELECT doc_id, id, size, text_crc32, x0, x1, x2, shard + CASE WHEN
        2 * sum(size) OVER (PARTITION BY shard ORDER BY k, id) - sum(size) OVER (PARTITION BY shard, k, id)
        <= 2 * (sum(size) OVER (PARTITION BY shard) // 2) THEN 0 ELSE {leaves // 2} END AS shard
      FROM k{i}
    )""")
        leaves //= 2
    return ",".join(parts) + """
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (
        PARTITION BY shard ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT, doc_id, size, text_crc32
      ) - 1 AS slot, NULL::INTEGER AS grown_shard
    FROM l4"""


@query(kd_sql())
def op11_sharding(spark: SparkSession, path: str) -> DataFrame:
    """Shard and slot of every document in a k-d tree of 16 leaves."""
    from whence.llm.kd_shards import document_shards

    return document_shards(documents(spark, path))


@query(
    f"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents
    ),
    f AS (
      SELECT doc_id, part,
        CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
      FROM d
    ),
    l AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id
    ),
    n AS (
      SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
    ),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (
      SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM c a, c b, c x, c y, c z
      WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5
    ),
    s AS (
      SELECT filter_order, step, filter_order[step] AS filter, 1 << (ascii(filter_order[step]) - 65) AS own,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before_
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)
    ),
    t AS (SELECT part, n, good, toxic, fails, filter_order, step, filter, own, coalesce(before_, 0)::INTEGER AS before FROM n, s),
    r AS (
      SELECT part, filter_order, step::INTEGER AS step, filter,
        coalesce(sum(n) FILTER (fails & (before | own) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
      FROM t GROUP BY part, filter_order, step, filter
    )
    SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
    """
)
def op12_filter_interaction_audit(spark: SparkSession, path: str) -> DataFrame:
    """What five filters keep and remove, in every order, for every source."""
    from whence.llm.filter_audit import audit

    return audit(documents(spark, path), labels(spark, path))


def resample_sql() -> str:
    """DuckDB SQL of the draw: buckets of distinct features, their gains, and ranks by scores."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    f AS (SELECT doc_id, unnest({runs}) AS f FROM d),
    g AS (SELECT unnest({runs}) AS f FROM (SELECT {words} AS w FROM benchmark)),
    x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM g)),
    b AS (SELECT f, {crc_sql("h")} % 10000 AS b FROM x),
    s AS (SELECT b, count(*) AS n FROM f JOIN b USING (f) GROUP BY b),
    t AS (SELECT b, count(*) AS n FROM g JOIN b USING (f) GROUP BY b),
    gain AS (
      SELECT b, floor(1000 * ln(
        ((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)
      ))::BIGINT AS gain
      FROM s FULL JOIN t USING (b)
    ),
    w AS (SELECT doc_id, sum(gain)::BIGINT AS sum, count(*) AS n FROM f JOIN b USING (f) JOIN gain USING (b) GROUP BY doc_id),
    v AS (
      SELECT doc_id, len(d.w) AS words, coalesce(n, 0)::BIGINT AS n_features,
        coalesce((sum - (sum % n + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN w USING (doc_id)
    ),
    o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
    r AS (
      SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place,
        25 * count(*) FILTER (words >= 20) OVER () // 100 AS size
      FROM o
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= size THEN place END AS rank FROM r
    """


@query(resample_sql())
def op13_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's texts."""
    from whence.llm.resample import resampled

    return resampled(documents(spark, path), spark.read.parquet(f"{path}/benchmark.parquet"))
