"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import (
    decontamination,
    html_text,
    packing,
    quality,
    simhash,
    substring,
    token_counts,
    token_store,
    url_reputation,
    warc,
)
from lumenframe.llm.common import fresh_path, table
from lumenframe.llm.encoding import default_tokenizer


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A run over texts with a digest below 0x20 stands for an earlier one: all rows are
    # then counted, those texts by the join to stored counts and the others as misses.
    docs, cache = table(spark, sf_dir, "documents"), fresh_path(spark, "token-counts")
    earlier = token_counts.content_digest(F.col("text")) < F.lit(b"\x20")
    token_counts.fill_cache(docs.where(earlier), default_tokenizer(), cache)
    counts = token_counts.count_tokens(docs, default_tokenizer(), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)


def op5_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op7_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The label of document k is taken as the outcome of page k: no table labels pages.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands, op2_digest_cache, op3_block_anchors, op4_harmonic_packing, op5_gzip_normaliser,
        op6_positional_index, op7_bk_trees, op8_host_reputation, op9_boosted_trees, op10_content_store, pipeline,
    )
}

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL_SUFFIXES = ", ".join(f"'{x}'" for x in url_reputation.Reputation().suffixes)
SQL_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES = {
    "op3_block_anchors": f"""
        WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM p),
        m AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM m WHERE r > 1),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_gzip_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS s FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM q)
        SELECT page_id, n AS payload_bytes, s AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
    "op6_positional_index": f"""
        WITH d AS (SELECT doc_id, {SQL_TERMS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {SQL_TERMS} AS w FROM benchmark),
        t AS (SELECT DISTINCT item_id, least(len(w), 13) AS k,
                     unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS s
              FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT k FROM t),
        g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
        h AS (SELECT doc_id, k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM g) JOIN t USING (k, s)),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id),
        r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
                     CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256
              FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id))
        SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r""",
    "op8_host_reputation": rf"""
        WITH u AS (SELECT page_id,
                     translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        nm AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u),
        lb AS (SELECT *, string_split(name, '.') AS x, starts_with(name, '[') OR regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') AS ip FROM nm),
        tw AS (SELECT *, array_to_string(x[-2:], '.') AS two FROM lb),
        p AS (SELECT page_id, host, path,
                     CASE WHEN ip THEN name WHEN two IN ({SQL_SUFFIXES}) THEN array_to_string(x[-3:], '.') ELSE two END AS domain,
                     CASE WHEN ip THEN 'address' WHEN two IN ({SQL_SUFFIXES}) THEN two ELSE x[-1] END AS suffix FROM tw),
        h AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS g
              FROM (SELECT DISTINCT page_id, host, domain, suffix FROM p) JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY ALL),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM h GROUP BY ALL),
        s AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d GROUP BY ALL),
        m AS (SELECT lvl, sum(n) AS bn, sum(g) AS bg, count(*) AS k, sum(n * n) AS nn, sum(g * g / n) AS gg
              FROM (SELECT 's' AS lvl, n, g FROM s UNION ALL SELECT 'd', n, g FROM d UNION ALL SELECT 'h', n, g FROM h) GROUP BY lvl),
        v AS (SELECT lvl, k, bg / bn AS p, (gg - bg * bg / bn) / nullif(k - 1, 0) AS between_, (bn - nn / bn) / nullif(k - 1, 0) AS size FROM m),
        w AS (SELECT lvl, p, k, size, (between_ / nullif(p * (1 - p), 0) - 1) / nullif(size - 1, 0) AS excess FROM v),
        st AS (SELECT lvl, CASE WHEN k > 1 AND p > 0 AND p < 1 AND size > 1 AND excess > 0
                                THEN least(greatest(1 / excess - 1, 2.0), 200.0) ELSE 200.0 END AS q FROM w),
        q AS (SELECT coalesce(max(q) FILTER (lvl = 's'), 200.0) AS qs, coalesce(max(q) FILTER (lvl = 'd'), 200.0) AS qd,
                     coalesce(max(q) FILTER (lvl = 'h'), 200.0) AS qh FROM st),
        a AS (SELECT coalesce(sum(g) / sum(n), 0.5) AS share FROM s),
        s2 AS (SELECT suffix, (g + qs * a.share) / (n + qs) AS share FROM s, a, q),
        d2 AS (SELECT d.domain, d.suffix, (d.g + qd * s2.share) / (d.n + qd) AS share FROM d JOIN s2 USING (suffix), q),
        h2 AS (SELECT host, h.g + qh * d2.share AS x, h.n - h.g + qh * (1 - d2.share) AS y FROM h JOIN d2 USING (domain), q),
        n0 AS (SELECT DISTINCT host, domain, suffix FROM p ANTI JOIN h USING (host)),
        n1 AS (SELECT host, coalesce(d2.share, s2.share, a.share) AS share,
                      qh / (qh + 1) * CASE WHEN d2.share IS NULL THEN qd / (qd + 1) ELSE 1 END
                      * CASE WHEN d2.share IS NULL AND s2.share IS NULL THEN qs / (qs + 1) ELSE 1 END AS stays
               FROM n0 LEFT JOIN d2 ON n0.domain = d2.domain LEFT JOIN s2 ON n0.suffix = s2.suffix, a, q),
        n2 AS (SELECT host, stays / (1 - stays) * share AS x, stays / (1 - stays) * (1 - share) AS y FROM n1),
        b AS (SELECT host, x / (x + y) - 1.645 * sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))) AS bound FROM (SELECT * FROM h2 UNION ALL SELECT * FROM n2)),
        r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
        f AS (SELECT page_id, host, path, r.rule, r.verdict,
                     row_number() OVER (PARTITION BY host, path ORDER BY length(r.rule) DESC, r.rule DESC) AS place
              FROM (SELECT DISTINCT host, path, min(page_id) AS page_id FROM p GROUP BY ALL)
                   JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                           AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1)))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN bound >= 0.75 THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN b USING (host) LEFT JOIN (SELECT * FROM f WHERE place = 1) f ON p.host = f.host AND p.path = f.path""",
}
