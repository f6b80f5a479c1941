"""Access, readiness and backfill joins; duplicates and reconciliation of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence, reconcile
from lodestone.session import table

from .catalog import query


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def acl_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a grant: here an urgent order."""
    grants = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(grants, "c_custkey", "left_semi")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    g AS (SELECT l_orderkey, count(*) AS asked, count(*) FILTER (p_size <= 40) AS granted FROM r LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT l_orderkey, asked::BIGINT AS asked, CASE WHEN asked = granted THEN granted END::BIGINT AS scope_size FROM g""")
def scope_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of a request is null unless every part it asks for is granted."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    granted = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("ok"))
    g = asked.join(granted, "l_partkey", "left").groupBy("l_orderkey").agg(F.count("*").alias("asked"), F.count("ok").alias("granted"))
    return g.select("l_orderkey", "asked", F.when(F.col("asked") == F.col("granted"), F.col("granted")).alias("scope_size"))


@query("SELECT source, count(*)::BIGINT AS skipped FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def skipped_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't ready, by source."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("skipped"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 100")
def embed_missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of documents without a label."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AND doc_id > 100 ORDER BY doc_id LIMIT 200")
def backfill_anti_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyset page of what a backfill still has to do: the filter on the key reaches the scan."""
    ready = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").where("doc_id > 100").join(ready, "doc_id", "left_anti").orderBy("doc_id").limit(200)


@query("""WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := (l_orderkey IS NOT NULL)::INT, k := o_orderkey)) AS producer FROM orders LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def producer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished run of a customer, preferring those with a returned item."""
    marked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("p", F.lit(1))
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey").join(marked, "o_orderkey", "left")
    return runs.groupBy("o_custkey").agg(F.max(F.struct(F.coalesce("p", F.lit(0)).alias("p"), "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("producer"))


@query("""SELECT p_partkey, coalesce(s_name, p_name, p_brand) AS title FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey
    LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def eager_title_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title by fallback along a chain of to-one links."""
    edition = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").join(edition, "p_partkey", "left")
    return parts.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left").select("p_partkey", F.coalesce("s_name", "p_name", "p_brand").alias("title"))


@query("""SELECT l_partkey, string_agg(s_name, '; ' ORDER BY first, s_suppkey) AS contributors FROM (SELECT l_partkey, l_suppkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def contributors_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors of each part in order of first appearance."""
    link = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_orderkey").alias("first"))
    named = link.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    ordered = F.sort_array(F.collect_list(F.struct("first", "s_suppkey", "s_name")))
    return named.groupBy("l_partkey").agg(F.array_join(F.transform(ordered, lambda x: x["s_name"]), "; ").alias("contributors"))


TWINS = """t AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), g AS (SELECT h, min(doc_id) AS low, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1)"""


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and low, the smallest id with the same text, of each document that is a later copy.

    Copies are paired with the first, not with one another, so that a group of n gives n - 1 pairs.
    """
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = t.groupBy("h").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    return t.join(groups, "h").select("doc_id", "low", "n")


@query(f"WITH {TWINS} SELECT low, doc_id AS high, 'content_twin' AS reason FROM t JOIN g USING (h) WHERE doc_id > low")
def content_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins(spark, sf_dir).where("doc_id > low").select("low", F.col("doc_id").alias("high"), F.lit("content_twin").alias("reason"))


@query(f"WITH {TWINS}, p AS (SELECT low, doc_id AS high FROM t JOIN g USING (h) WHERE doc_id > low) SELECT low AS doc_id, high AS other FROM p UNION ALL SELECT high, low FROM p")
def other_side_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate pairs seen from either side."""
    p = content_twins(spark, sf_dir)
    return p.select(F.col("low").alias("doc_id"), F.col("high").alias("other")).unionByName(p.select(F.col("high").alias("doc_id"), F.col("low").alias("other")))


@query("""WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, quality FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT h, min(doc_id) AS first, bool_or(quality = 1) AS ready FROM t GROUP BY 1)
    SELECT doc_id, CASE WHEN doc_id = first THEN 'new' WHEN coalesce(ready, false) THEN 'ready' ELSE 'waiting' END AS disposition FROM t JOIN g USING (h)""")
def exact_dedup_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrival of each file means: new, a copy of a ready one, or waiting for its producer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.max(F.col("quality") == 1).alias("ready"))
    state = F.when(F.col("doc_id") == F.col("first"), "new").when(F.coalesce("ready", F.lit(False)), "ready").otherwise("waiting")
    return docs.join(g, "h").select("doc_id", state.alias("disposition"))


DIMS = """k AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM part),
    l AS (SELECT title, arg_min(struct_pack(i := p_partkey, b := p_brand, t := p_type, s := p_size), p_partkey) AS w FROM k GROUP BY 1),
    d AS (SELECT p_partkey, w.i AS work, 'agree' AS d_title, CASE WHEN p_brand = w.b THEN 'agree' ELSE 'conflict' END AS d_publisher, CASE WHEN p_type = w.t THEN 'agree' ELSE 'conflict' END AS d_creator,
        CASE WHEN p_size > 45 OR w.s > 45 THEN 'absent' WHEN p_size = w.s THEN 'agree' ELSE 'conflict' END AS d_year FROM k JOIN l USING (title) WHERE p_partkey <> w.i)"""


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the first part of the same title key, by title, publisher, creator and year."""
    k = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", T.title_key(F.col("p_name")).alias("title"))
    works = k.groupBy("title").agg(F.min(F.struct("p_partkey", "p_brand", "p_type", "p_size")).alias("w"))
    known = lambda c: F.when(c <= 45, c)  # noqa: E731  larger sizes stand for a missing year
    pairs = k.join(works, "title").where("p_partkey <> w.p_partkey")
    return pairs.select(
        "p_partkey",
        F.col("w.p_partkey").alias("work"),
        F.lit(evidence.AGREE).alias("d_title"),
        evidence.equal_dimension(F.col("p_brand"), F.col("w.p_brand")).alias("d_publisher"),
        evidence.equal_dimension(F.col("p_type"), F.col("w.p_type")).alias("d_creator"),
        evidence.equal_dimension(known(F.col("p_size")), known(F.col("w.p_size"))).alias("d_year"),
    )


@query(f"WITH {DIMS} SELECT *, 'conflict' IN (d_title, d_publisher, d_creator, d_year) AS any_conflict FROM d")
def evidence_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimensions(spark, sf_dir)
    return d.withColumn("any_conflict", evidence.any_conflict(*[F.col(x) for x in d.columns if x.startswith("d_")]))


@query(f"WITH {DIMS} SELECT p_partkey, CASE WHEN 'conflict' IN (d_publisher, d_creator, d_year) THEN NULL ELSE work END AS linked_to, CASE WHEN 'conflict' IN (d_publisher, d_creator, d_year) THEN 'bibliographic_conflict' ELSE 'linked' END AS outcome FROM d")
def path_a_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link to the matching record if the title agrees and nothing conflicts; else flag and stop."""
    d = dimensions(spark, sf_dir)
    bad = evidence.any_conflict(*[F.col(x) for x in d.columns if x.startswith("d_")])
    return d.select("p_partkey", F.when(~bad, F.col("work")).alias("linked_to"), F.when(bad, "bibliographic_conflict").otherwise("linked").alias("outcome"))


@query(f"WITH {TWINS}, m AS (SELECT t.doc_id, low, a.lang = b.lang AS same_lang, a.source = b.source AS same_source FROM t JOIN g USING (h) JOIN documents a ON a.doc_id = t.doc_id JOIN documents b ON b.doc_id = low WHERE t.doc_id > low) SELECT doc_id, low AS twin, same_lang AND same_source AS adopted FROM m")
def path_b_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin's edition is adopted only if language and source agree as well."""
    t = twins(spark, sf_dir).where("doc_id > low").select("doc_id", "low")
    meta = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    other = meta.select(F.col("doc_id").alias("low"), F.col("lang").alias("lang_b"), F.col("source").alias("source_b"))
    agree = (F.col("lang") == F.col("lang_b")) & (F.col("source") == F.col("source_b"))
    return t.join(meta, "doc_id").join(other, "low").select("doc_id", F.col("low").alias("twin"), agree.alias("adopted"))


@query("""WITH k AS (SELECT DISTINCT p_partkey, p_name, p_brand, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey),
    w AS (SELECT p_name, p_brand, min(p_partkey) AS work FROM k GROUP BY 1, 2),
    n AS (SELECT p_name, p_brand, l_suppkey, count(*) AS n FROM k GROUP BY ALL)
    SELECT p_partkey, work, bool_or(n > 1) AS shared FROM k JOIN w USING (p_name, p_brand) JOIN n USING (p_name, p_brand, l_suppkey) WHERE p_partkey <> work GROUP BY ALL""")
def sibling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name and brand, and whether a contributor is shared with any other of them."""
    suppliers = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    c = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").join(suppliers, "p_partkey")
    keys = ["p_name", "p_brand"]
    work = c.groupBy(keys).agg(F.min("p_partkey").alias("work"))
    n = c.groupBy(*keys, "l_suppkey").agg(F.count("*").alias("n"))
    both = c.join(n, [*keys, "l_suppkey"]).groupBy(*keys, "p_partkey").agg(F.bool_or(F.col("n") > 1).alias("shared"))
    return both.join(work, keys).where("p_partkey <> work").select("p_partkey", "work", "shared")


@query("""WITH k AS (SELECT DISTINCT p_partkey, p_name, p_brand, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey),
    w AS (SELECT p_name, p_brand, l_suppkey, min(p_partkey) AS sibling FROM k GROUP BY ALL)
    SELECT DISTINCT p_partkey, sibling FROM k JOIN w USING (p_name, p_brand, l_suppkey) WHERE p_partkey <> sibling""")
def sibling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name and brand that share any contributor, each linked with the smallest of a contributor's.

    All that share one are linked through it, so n parts of a contributor give n - 1 links.
    """
    suppliers = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    c = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").join(suppliers, "p_partkey")
    keys = ["p_name", "p_brand", "l_suppkey"]
    low = c.groupBy(keys).agg(F.min("p_partkey").alias("sibling"))
    return c.join(low, keys).where("p_partkey <> sibling").select("p_partkey", "sibling").distinct()


def arriving(docs: DataFrame) -> DataFrame:
    """Documents as assets: the first line is the title, the source the creator, the number of characters an identifier."""
    title = T.title_key(F.split_part("text", F.lit("\n"), F.lit(1)))
    return docs.select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content"), title.alias("title"), F.array("source").alias("creators"), F.col("lang").alias("language"),
        F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("int").alias("year"), F.array(F.col("n_chars").cast("string")).alias("identifiers"),
    )


@query()
def reconcile_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in order of arrival: the edition it adopts, joins or founds."""
    return reconcile.reconcile(arriving(table(spark, sf_dir, "documents")))[0]
