"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, decontaminate, filter_audit, html_crf, langid, maxent_lm, minhash, packing, source_audit, suffix_dedup, token_counts, topk
from . import quality as quality_rules
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_automaton.encode(_table(spark, sf_dir, "documents"), path, ids=False, digests=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op5_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(spark, vectors.where("vec_id % 50 = 0"), vectors, k=5, scale=256)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(spark, _table(spark, sf_dir, "documents"), path, capacity=4096, end_id=1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, train=held_out(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (held_out(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.train(pages))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(spark, _table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = maxent_lm.score(spark, _table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5) != 1)
    return out.withColumn("held_out", held_out(F.col("doc_id"), 5) == 1)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spark, _table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


QUERIES = (
    op1_minhash_dedup,
    op2_bpe_automaton,
    op3_token_counts,
    op4_quality_rules,
    op5_topk_histogram,
    op6_best_fit_packing,
    op7_language_id,
    op8_html_extraction,
    op9_suffix_dedup,
    op10_maxent_lm,
    op11_filter_audit,
    op12_source_audit,
    op13_decontamination,
)

#: DuckDB SQL for the same rows, where SQL can say it.
ORACLES = {
    "op1_minhash_dedup": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
        ), n AS (
            SELECT doc_id, len(sh)::BIGINT AS n FROM s
        ), u AS (
            SELECT doc_id, unnest(sh) AS x FROM s
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
        ), e AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op5_topk_histogram": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), w AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS p FROM d)
        ), m AS (
            SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS low FROM w
        ), g AS (
            SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM m WHERE low < doc_id
        ), i AS (
            SELECT doc_id, p, sum((reach IS NULL OR p > reach)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g
        ), r AS (
            SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k
        ), e AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r
        ), k AS (
            SELECT e.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans
            FROM e JOIN d USING (doc_id) GROUP BY e.doc_id
        )
        SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op11_filter_audit": """
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), firsts AS (
            SELECT t, min(doc_id) AS low FROM d GROUP BY t
        ), b AS (
            SELECT d.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(low < d.doc_id, false)] AS f
            FROM d JOIN firsts USING (t)
        ), l AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
        ), c AS (
            SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, f
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
            JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
        ), s AS (
            SELECT filter_order, k::INTEGER AS step, filter_order[k] AS x, list_transform(range(1, k), lambda j: ascii(filter_order[j]) - 64) AS before, ascii(filter_order[k]) - 64 AS i
            FROM o, (SELECT unnest(range(1, 6)) AS k)
        ), m AS (
            SELECT part, filter_order, step, x, n, good, toxic, f[i] AS fails, NOT list_bool_or(list_concat([false], list_transform(before, lambda j: f[j]))) AS comes,
                f[i] AND len(list_filter(f, lambda y: y)) = 1 AS alone FROM c, s
        ), r AS (
            SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (comes AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (comes AND fails), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (fails AND NOT comes), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (comes AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (comes AND fails), 0)::BIGINT AS toxic_lost
            FROM m GROUP BY part, filter_order, step, x
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
    "op12_source_audit": """
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), v AS (
            SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30
        ), u AS (
            SELECT lang, source, unnest(w) AS term FROM d
        ), n AS (
            SELECT lang, source, term, count(*) AS n FROM u JOIN v USING (lang, term) GROUP BY lang, source, term
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), gv AS (
            SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
        ), p AS (
            SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM gv
        ), ln AS (
            SELECT lang, term, sum(n)::HUGEINT AS n FROM gv GROUP BY lang, term
        ), q AS (
            SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM ln
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        ), term AS (
            SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), r AS (
            SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
            UNION ALL
            SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM term
        )
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_decontamination": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
        ), i AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark
        ), g AS (
            SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
        ), sizes AS (
            SELECT DISTINCT k FROM g
        ), x AS (
            SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN sizes ON len(w) >= k)
        ), m AS (
            SELECT r, p, k, item_id FROM x JOIN g USING (k, s)
        ), h AS (
            SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS j FROM m) GROUP BY r
        ), e AS (
            SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS t FROM m WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN e USING (r)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
