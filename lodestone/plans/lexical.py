"""Lexical search through a stored positional index: documents with their first line as heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import positional
from lodestone.session import new_folder, table

from .catalog import query

#: Candidates of a query.
CANDIDATES = 40


def headed(docs: DataFrame) -> DataFrame:
    """unit, heading, body: the first line of a document of several lines stands for its heading."""
    cut = F.locate("\n", F.col("text"))
    first = F.when(cut > 0, F.substring(F.col("text"), F.lit(1), cut - 1))
    return docs.select(F.col("doc_id").alias("unit"), first.alias("heading"), F.when(cut > 0, F.substring(F.col("text"), cut + 1, F.length("text"))).otherwise(F.col("text")).alias("body"))


def unheaded(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("unit"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("body"))


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
HEADED = f"""h AS (SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN len({WORDS.format("split_part(text, chr(10), 1)")}) ELSE 0 END AS n, {WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
    o AS (SELECT doc_id, w[i] AS term, i AS place, CASE WHEN i <= n THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM (SELECT doc_id, n, w, unnest(range(1, len(w) + 1)) AS i FROM h))"""
STRICT = f"""{HEADED}, q AS (SELECT item_id, list_distinct({WORDS.format("text")}) AS terms FROM benchmark),
    qt AS (SELECT item_id, len(terms) AS n, unnest(terms) AS term FROM q),
    m AS (SELECT item_id, doc_id, n FROM qt JOIN (SELECT DISTINCT doc_id, term FROM o) USING (term) GROUP BY ALL HAVING count(*) = n),
    occ AS (SELECT item_id, doc_id, n, place, term, weight FROM m JOIN qt USING (item_id, n) JOIN o USING (doc_id, term)),
    ends AS (SELECT item_id, doc_id, n, e, min(last) AS b FROM (
        SELECT x.item_id, x.doc_id, x.n, x.place AS e, y.term, max(y.place) AS last FROM occ x JOIN occ y ON x.item_id = y.item_id AND x.doc_id = y.doc_id AND y.place <= x.place GROUP BY ALL)
        GROUP BY item_id, doc_id, n, e HAVING count(*) = n),
    covers AS (SELECT item_id, doc_id, b, min(e) AS e FROM ends GROUP BY ALL),
    worth AS (SELECT c.item_id, c.doc_id, c.b, count(*) / sum(1 / weight) / (1 + c.e - c.b - (count(*) - 1)) AS s
        FROM covers c JOIN occ ON c.item_id = occ.item_id AND c.doc_id = occ.doc_id AND occ.place BETWEEN c.b AND c.e GROUP BY c.item_id, c.doc_id, c.b, c.e),
    strict AS (SELECT item_id, doc_id, round(sum(s), 9) AS s FROM worth GROUP BY ALL),
    r AS (SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)::INTEGER AS rank FROM strict)"""


@query(f"WITH {STRICT} SELECT item_id, doc_id, round(s / (s + 1), 9) AS score, rank FROM r WHERE rank <= {CANDIDATES}")
def lexical_rank_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents with all words of a benchmark item, by cover density with heading over body."""
    index = positional.build(headed(table(spark, sf_dir, "documents")), new_folder(spark))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.array_distinct(T.words(F.col("text"))).alias("terms"))
    found = positional.top(spark, index, q, CANDIDATES, every=True)
    return found.select(F.col("q").alias("item_id"), F.col("unit").alias("doc_id"), F.round(F.col("s") / (F.col("s") + 1), 9).alias("score"), "rank")


@query(f"""WITH {STRICT}, few AS (SELECT item_id, CASE WHEN len(g) > 0 THEN g ELSE t END AS g FROM (SELECT item_id, {WORDS.format("text")} AS t, list_filter(t, lambda w: length(w) >= 3) AS g FROM benchmark)),
    missed AS (SELECT DISTINCT item_id, unnest(list_filter(g, lambda w, i: list_position(g, w) = i)[1:12]) AS term FROM few WHERE item_id NOT IN (SELECT item_id FROM strict)),
    f AS (SELECT item_id, doc_id, round(sum(weight), 9) AS s FROM missed JOIN o USING (term) GROUP BY ALL),
    fr AS (SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)::INTEGER AS rank FROM f)
    SELECT item_id, doc_id, rank, round(s / (s + 1), 9) AS score, strategy FROM (SELECT *, 'strict' AS strategy FROM r UNION ALL SELECT *, 'or_fallback' FROM fr) WHERE rank <= {CANDIDATES}""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict search for all words of a benchmark item, else for any of its first 12: from the stored index alone."""
    index = positional.build(headed(table(spark, sf_dir, "documents")), new_folder(spark))
    return positional.search(spark, index, table(spark, sf_dir, "benchmark"), "item_id", "text", CANDIDATES).withColumnRenamed("unit", "doc_id")


@query(f"""SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf, count(*) FILTER (heading)::BIGINT AS in_headings FROM (
    SELECT doc_id, w[i] AS term, i <= n AS heading FROM (SELECT doc_id, n, w, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN len({WORDS.format("split_part(text, chr(10), 1)")}) ELSE 0 END AS n, {WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL))) GROUP BY term""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of each word and its places in headings, read from the stored index."""
    index = positional.build(headed(table(spark, sf_dir, "documents")), new_folder(spark))
    return positional.frequencies(spark, index)


@query("""WITH q AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 6)))[1] AS term FROM benchmark),
    t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, round(0.4 * tf / (0.4 * tf + 1), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, doc_id)::INTEGER AS rank FROM q JOIN t USING (term))
    SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 40""")
def lexical_strict_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a query's one term, by cover density: each place counts 0.4, then s / (s + 1)."""
    long = F.sort_array(F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 6)))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.slice(long, 1, 1).alias("terms")).where("size(terms) > 0")
    index = positional.build(unheaded(table(spark, sf_dir, "documents")), new_folder(spark))
    found = positional.top(spark, index, q, CANDIDATES, every=False)
    return found.select(F.col("q").alias("item_id"), F.col("unit").alias("doc_id"), F.round(F.col("s") / (F.col("s") + 1), 6).alias("score"), "rank")
