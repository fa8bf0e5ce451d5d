"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, html_wrappers, jaccard_join, pii, prefix_trie, quality, quality_rules,
               sentencepiece_sampler, substring_dedup, suffix_dedup, url_filter, whitening)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    out = jaccard_join.jaccard_classes(_t(spark, sf_dir, "documents"))
    return out.withColumnRenamed("_id", "doc_id")


def op2_quality(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    out = quality.judged_by_both(docs.select("doc_id", "text", "lang"), labels)
    every = [F.col(f"_quality_every.{c}").alias(f"every_{c}") for c in ("perplexity", "threshold", "kept")]
    return out.select("doc_id", "lang", "_quality.*", *every)


def op3_decontaminate(spark, sf_dir):
    out = decontaminate.contaminated(_t(spark, sf_dir, "documents").select("doc_id", "text"),
                                     _t(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("_leak.items") > 0).alias("contaminated"), "_leak.*")


def op4_pii(spark, sf_dir):
    out = pii.with_surrogates(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_surrogates").alias("text"), F.col("_n_entities").alias("n_entities"))


def op5_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.repeated_passages(_t(spark, sf_dir, "documents"))
    return out.withColumnRenamed("_id", "doc_id")


def op6_html(spark, sf_dir):
    out = html_wrappers.extract(_t(spark, sf_dir, "pages"))
    return out.withColumnsRenamed({"_page": "page_id", "_url": "url"})


def op7_exact_dedup(spark, sf_dir):
    g = exact_dedup.exact_groups(_t(spark, sf_dir, "documents"))
    return g.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"),
                    F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
                    F.col("_digest").alias("text_sha256"))


def op8_url_filter(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "_judged.*")


def op9_substring_dedup(spark, sf_dir):
    out = substring_dedup.substring_dedup(_t(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_sentencepiece(spark, sf_dir):
    out = sentencepiece_sampler.encode(_t(spark, sf_dir, "documents"), check=True)
    return out.select(F.col("_id").alias("doc_id"), "n_tokens", "ids", "lossless")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_whitening(spark, sf_dir):
    out = whitening.whitening(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumnRenamed("_id", "vec_id")


def op13_quality_rules(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, _t(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model).withColumnRenamed("_id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_quality, op3_decontaminate, op4_pii, op5_suffix_dedup, op6_html, op7_exact_dedup,
    op8_url_filter, op9_substring_dedup, op10_sentencepiece, op11_prefix_trie, op12_whitening, op13_quality_rules)}

ORACLE_SQL = {
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
               text_sha256
        FROM d""",
    "op8_url_filter": r"""
        WITH u AS (
            SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS h,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path
              FROM u),
        w AS (SELECT page_id, host, path, CASE
                  WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
              FROM v)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM w""",
    "op11_prefix_trie": r"""
        WITH crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
                   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)),
        said AS (
            SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        digest AS (
            SELECT c, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS g,
                   octet_length(encode(text)) AS bytes
            FROM said),
        turns AS (
            SELECT c, g, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM digest),
        convs AS (
            SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b:
                   xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 9 AS h
            FROM (SELECT DISTINCT c FROM turns), crc),
        seams AS (
            SELECT c, base, h, least(h, (SELECT count(*) FROM turns t WHERE t.c = v.base)) AS hb FROM convs v),
        rebuilt AS (
            SELECT s.c, t.pos + 1 AS depth, g, bytes FROM seams s JOIN turns t ON t.c = s.base AND t.pos < s.h
            UNION ALL
            SELECT s.c, hb + t.pos - h + 1, g, bytes FROM seams s JOIN turns t ON t.c = s.c AND t.pos >= s.h
            UNION ALL
            SELECT c, 0, '', 0 FROM seams),
        paths AS (
            SELECT c, depth, bytes, sha256(string_agg(g, ',' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth)) AS k,
                   depth = max(depth) OVER (PARTITION BY c) AS ends
            FROM rebuilt),
        linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up FROM paths),
        nodes AS (
            SELECT k, any_value(up) AS up, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
                   (count(*) - 1) * any_value(bytes) AS saved,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM linked GROUP BY k),
        kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
        sums AS (
            SELECT p.k, sum(n.saved) AS saved_tokens, count(*) FILTER (d.n IS NULL) AS n_leaves
            FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.depth <= n.depth LEFT JOIN kids d ON d.k = n.k
            GROUP BY p.k)
        SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs,
               coalesce(d.n, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON s.k = n.k LEFT JOIN kids d ON d.k = n.k LEFT JOIN nodes u ON u.k = n.up""",
}
