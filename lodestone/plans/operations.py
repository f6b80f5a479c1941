"""Overviews, completeness, outcomes, identifiers and keys: the smaller queries of daily operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import table
from lodestone.sources import library

from .catalog import query


@query("""SELECT count(*)::BIGINT AS runs, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS queued, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS failed,
    min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)::BIGINT AS oldest_queued, count(DISTINCT o_custkey)::BIGINT AS submitters FROM orders""")
def overview_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several aggregates in one pass."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("runs"),
        F.count_if(s == "O").alias("queued"),
        F.count_if(s == "F").alias("failed"),
        F.min(F.when(s == "O", F.col("o_orderkey"))).alias("oldest_queued"),
        F.countDistinct("o_custkey").alias("submitters"),
    )


@query("""WITH a AS (SELECT l_orderkey AS o_orderkey, count(*) AS parts, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(parts, 0)::BIGINT AS parts, coalesce(done, 0)::BIGINT AS done, coalesce(parts = done AND parts > 0, false) AS complete FROM orders LEFT JOIN a USING (o_orderkey)""")
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all parts of a run are done; a run without parts isn't complete."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("parts"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey").join(a, "o_orderkey", "left")
    parts, done = F.coalesce("parts", F.lit(0)), F.coalesce("done", F.lit(0))
    return runs.select("o_orderkey", parts.alias("parts"), done.alias("done"), ((parts == done) & (parts > 0)).alias("complete"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'with_warnings' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'with_warnings' ELSE 'clean' END AS outcome
    FROM orders GROUP BY 1""")
def success_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With warnings if any run has one, or any override is set."""
    worst = F.bool_or((F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "1-URGENT"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(worst, "with_warnings").otherwise("clean").alias("outcome"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-06-01'")
def requeue_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued runs without a sign of life since a stated moment: the filter reaches the scan."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderdate < timestamp_ntz '1997-06-01'").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '2-HIGH' AND contains(c_name, '7') ORDER BY o_orderkey DESC LIMIT 25""")
def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of runs by priority and a part of the submitter's name."""
    names = table(spark, sf_dir, "customer").where(F.col("c_name").contains("7")).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    runs = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_orderstatus", "o_custkey")
    return runs.join(names, "o_custkey").select("o_orderkey", "o_orderstatus", "c_name").orderBy(F.desc("o_orderkey")).limit(25)


@query("""SELECT 'isbn' AS scheme, '978' || lpad((p_partkey // 3)::VARCHAR, 10, '0') AS value, min(p_partkey) AS owner, count(*)::BIGINT AS claims FROM part GROUP BY ALL""")
def identifier_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner of each identifier: the first that claims it, however often it is claimed."""
    value = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") / 3).cast("long").cast("string"), 10, "0"))
    return table(spark, sf_dir, "part").groupBy(F.lit("isbn").alias("scheme"), value.alias("value")).agg(F.min("p_partkey").alias("owner"), F.count("*").alias("claims"))


@query("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')::BIGINT AS accepted, max(struct_pack(k := l_linenumber * 1000000 + l_partkey, d := l_shipdate)).d AS version FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1""")
def parser_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the latest finished attempt of a run carries, with the number of accepted ones."""
    lines = table(spark, sf_dir, "lineitem")
    done = F.when(F.col("l_linestatus") == "F", F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("k"), "l_shipdate"))
    a = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("accepted"), F.max(done).alias("last")).where("last is not null")
    return a.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "accepted", F.col("last.l_shipdate").alias("version"))


@query("""SELECT page_id, CASE WHEN len(s) >= 3 THEN s[1] END AS author_hint, CASE WHEN len(s) >= 3 THEN s[2] END AS title_hint FROM (
    SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages)""")
def path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and title as a path of three segments names them."""
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", *library.path_hints(path))


@query("SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path FROM documents")
def content_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the content of each document is stored."""
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), library.shard_path(sha).alias("path"))


@query("""SELECT s_suppkey, lower(trim(regexp_replace(s_name, '\\s+', ' ', 'g'))) AS name_key FROM supplier""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.name_key(F.col("s_name")).alias("name_key"))


@query("""WITH u AS (SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 1000) AS q, length(trim(text)) AS n FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, q AS query, (q <> '' AND n <= 1000) AS accepted FROM u""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as search takes them, and whether their length is allowed."""
    q = F.substring(T.collapse(F.col("text")), 1, 1000)
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", q.alias("query"), ((q != "") & (F.length(F.trim("text")) <= 1000)).alias("accepted"))


@query("""WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r, event_type FROM events)
    SELECT user_id, event_type, event_id AS promoted FROM m WHERE r = 2""")
def waiter_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those parked behind the first of a kind, the oldest is next."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return e.where("r = 2").select("user_id", "event_type", F.col("event_id").alias("promoted"))
