"""The registered queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lm, merkle, mixing, neardup, oracles, packing, prefixes, quality, sharding, tokenfile, topk, variants, warc

BYTE_BPE, WORD_BPE, RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op2_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_chats(table(spark, sf_dir, "conversations"))


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op10_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_search_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(table(spark, sf_dir, "documents"))


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op13_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ring_shards, op2_norm_sorted_topk, op3_attention_lm, op4_chosen_path, op5_role_repair, op6_binary_packing,
        op7_rule_cascade, op8_weighted_mix, op9_warc_ranges, op10_repair_tokens, op11_search_schemes, op12_prefix_counts,
        op13_merkle_descent,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_search_schemes": oracles.VARIANTS,
    "op13_merkle_descent": oracles.MERKLE,
    "op2_norm_sorted_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_chosen_path": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (
              SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
              UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM d WHERE len(w) BETWEEN 1 AND 4)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
              JOIN n i ON i.doc_id = p.a JOIN n j ON j.doc_id = p.b WHERE 100 * c >= 75 * (i.n + j.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
        l AS (SELECT a, min(c) AS c FROM r GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN l ON l.a = d.doc_id""",
    "op7_rule_cascade": rf"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        g AS (SELECT id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
        twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) WHERE n > 1),
        rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY id),
        f AS (SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
                     CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (id)),
        b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 100 * n_symbols > {quality.SYMBOL_PERCENT} * length(text)
                    OR (len(lines) >= {quality.MIN_LINES} AND 100 * n_dup_lines > {quality.DUPLICATE_LINE_PERCENT} * len(lines))
                    OR (n_words > 0 AND word_chars > {quality.MAX_WORD_CHARS} * n_words)) AS kept FROM b""",
    "op8_weighted_mix": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
                     (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '#' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
                     CASE WHEN length(coalesce(text, '')) = 0 THEN 0.05::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE *
                       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS DOUBLE) / CAST(length(text) AS DOUBLE)) END AS weight FROM documents),
        k AS (SELECT *, -ln(u) / weight AS key FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM k GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n FROM s),
        p AS (SELECT *, (SELECT sum(source_size) FROM o)::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over,
                     sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o),
        c AS (SELECT min(n) AS n FROM p WHERE left_over * w / left_weight <= 3 * source_size),
        t AS (SELECT p.source, p.source_size, CASE WHEN p.n < c.n THEN 3.0::DOUBLE * p.source_size ELSE e.left_over * p.w / e.left_weight END AS target
              FROM p, c, p e WHERE e.n = c.n),
        m AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, CAST(floor(target / source_size + 1e-12) AS INT)) END AS epochs FROM t),
        x AS (SELECT k.*, m.source_size, m.target, m.epochs, greatest(0.0::DOUBLE, m.target - m.epochs * m.source_size) AS budget,
                     sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
              FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source)
        SELECT doc_id, size, source_size, target, CAST((epochs + CAST(before + size / 2.0::DOUBLE <= budget AS INT)) * size AS BIGINT) AS taken FROM x""",
    "op9_warc_ranges": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
