"""Where artifacts come from and what becomes of them: manifests, imports, orphans, gates, tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import table

from .catalog import query
from .control import STAGES, stage
from .documents import page_links

KEPT_STAGE = "CASE l_linenumber % 5 WHEN 0 THEN 'hash' WHEN 1 THEN 'validate' WHEN 2 THEN 'parse' WHEN 3 THEN 'normalize' ELSE 'structure' END"


@query("""WITH o AS (SELECT l_orderkey, l_suppkey % 3 AS out, max(struct_pack(n := l_linenumber, p := l_partkey, f := l_returnflag)) AS x FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, 'out/' || out AS path, x.n AS written_by, sha256(x.p::VARCHAR || '/' || x.f) AS sha256 FROM o""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs of each order's manifest: of every path the last that was written, the others stay as they are.

    An aggregate with map-side combining; a manifest is rows by path, never one list in a task.
    """
    last = F.max(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"))).alias("x")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("out")).agg(last)
    sha = F.sha2(F.concat_ws("/", F.col("x.p").cast("string"), "x.f"), 256)
    return o.select("l_orderkey", F.concat(F.lit("out/"), F.col("out").cast("string")).alias("path"), F.col("x.n").alias("written_by"), sha.alias("sha256"))


@query("""WITH l AS (SELECT doc_id, bool_or(quality = 1) AS ok, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1)
    SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'discovered' WHEN ok THEN 'imported' WHEN toxic THEN 'blocked' ELSE 'requeued' END AS state FROM documents LEFT JOIN l USING (doc_id)""")
def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next import does with each file: new ones and failures are taken, failures of security never again.

    Labels stand for what earlier imports wrote: good for imported, bad for failed, toxic for a failure of security.
    """
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("ok"), F.bool_or(F.col("toxic") == 1).alias("toxic"), F.lit(True).alias("seen"))
    state = F.when(F.col("seen").isNull(), "discovered").when(F.col("ok"), "imported").when(F.col("toxic"), "blocked").otherwise("requeued")
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", state.alias("state"))


@query("""SELECT c_custkey, max(o_orderdate) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    HAVING count(*) FILTER (o_orderstatus = 'O') = 0 AND coalesce(max(o_orderdate) <= TIMESTAMP '2001-01-01', true)""")
def orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that nothing live points into and whose newest file is older than a moment; empty ones too. A report only."""
    files = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("newest"), F.count_if(F.col("o_orderstatus") == "O").alias("live"))
    dirs = table(spark, sf_dir, "customer").select("c_custkey").join(files, "c_custkey", "left")
    return dirs.where("coalesce(live, 0) = 0 and coalesce(newest <= timestamp_ntz '2001-01-01', true)").select("c_custkey", "newest")


@query("""SELECT doc_id, sha256(text) AS expected, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) AS found,
    CASE WHEN text IS NULL THEN 'MISSING' WHEN sha256(text) = sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) THEN 'VERIFIED' ELSE 'MISMATCH' END AS verdict FROM documents""")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the canonical text (lines that hold anything) still has the hash that its source was registered with."""
    found = F.sha2(F.array_join(F.filter(F.split("text", "\n", -1), lambda x: x != ""), "\n"), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("expected"), found.alias("found"))
    verdict = F.when(F.col("expected").isNull(), "MISSING").when(F.col("expected") == F.col("found"), "VERIFIED").otherwise("MISMATCH")
    return d.withColumn("verdict", verdict)


@query("""WITH m AS (SELECT page_id, any_value(regexp_extract(url, '^https?://[^/]*/([a-z]+)', 1)) AS lang, max(length(html)) AS n FROM pages GROUP BY 1)
    SELECT doc_id, CASE WHEN page_id IS NULL THEN 'SPINE_ARTIFACTS_MISSING' WHEN m.lang IS DISTINCT FROM d.lang THEN 'STALE_ARTIFACTS' WHEN n % 5 = 0 THEN 'ARTIFACTS_VERSION_MISMATCH' ELSE 'ok' END AS verdict
    FROM documents d LEFT JOIN m ON page_id = doc_id""")
def provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether artifacts may be used again: there, of the same source, of the current version, asked in that order.

    Pages stand for manifests, the language for the source, the length for the version.
    """
    m = table(spark, sf_dir, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.min(F.regexp_extract("url", "^https?://[^/]*/([a-z]+)", 1)).alias("source"), F.max(F.length("html")).alias("n"), F.lit(True).alias("there"))
    verdict = F.when(F.col("there").isNull(), "SPINE_ARTIFACTS_MISSING").when(~F.col("source").eqNullSafe(F.col("lang")), "STALE_ARTIFACTS").when(F.col("n") % 5 == 0, "ARTIFACTS_VERSION_MISMATCH").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(m, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query(f"""WITH a AS (SELECT l_orderkey, {KEPT_STAGE} AS stage, l_linenumber % 5 AS i, l_linestatus FROM lineitem), c AS (SELECT l_orderkey, max(i) AS i FROM a GROUP BY 1)
    SELECT o_orderkey, ['hash', 'validate', 'parse', 'normalize', 'structure'][least(coalesce(c.i, 0) + CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = o_orderkey AND a.i = c.i AND l_linestatus = 'F') THEN 1 ELSE 0 END, 4) + 1] AS next_stage
    FROM orders LEFT JOIN c ON c.l_orderkey = o_orderkey""")
def next_dispatch_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run goes on: at the stage after its current one if that has succeeded, else at it again."""
    i = (F.col("l_linenumber") % 5).alias("i")
    current = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct(i, (F.col("l_linestatus") == "F").alias("done"))).alias("c"))
    at = F.least(F.coalesce("c.i", F.lit(0)) + F.coalesce(F.col("c.done").cast("int"), F.lit(0)), F.lit(len(STAGES) - 1))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(current, "o_orderkey", "left").select("o_orderkey", stage(at).alias("next_stage"))


SPINE = """l AS (SELECT page_id, i - 1 AS ordinal, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages))),
    s AS (SELECT href, min(page_id) AS spine_index FROM l WHERE ordinal = 0 GROUP BY 1),
    t AS (SELECT page_id, ordinal::INTEGER AS ordinal, href, len(href) - len(replace(href, '/', '')) AS depth, spine_index FROM l LEFT JOIN s USING (href))"""


@query(f"WITH {SPINE} SELECT page_id, ordinal, href, depth::INTEGER AS depth, spine_index FROM t")
def toc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of tables of contents with the document that each leads to, null where there is none.

    Links stand for entries, the first link of a page for its own name, slashes for depth.
    """
    links = page_links(spark, sf_dir).drop("verdict")
    spine = links.where("ordinal = 0").groupBy("href").agg(F.min("page_id").alias("spine_index"))
    depth = F.length("href") - F.length(F.replace("href", F.lit("/"), F.lit("")))
    return links.withColumn("depth", depth).join(spine, "href", "left").select("page_id", "ordinal", "href", "depth", "spine_index")


@query(f"WITH {SPINE} SELECT page_id, count(*)::BIGINT AS entries, count(spine_index)::BIGINT AS resolved, max(depth)::INTEGER AS max_depth FROM t GROUP BY 1")
def toc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc_map(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("entries"), F.count("spine_index").alias("resolved"), F.max("depth").alias("max_depth"))


@query("""WITH b AS (SELECT conv_id, turn, i - 1 AS place, l[i] AS line FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL)))
    SELECT conv_id, turn, place::INTEGER AS place, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1)::BIGINT AS ordinal, length(line)::BIGINT AS chars FROM b""")
def book_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents of a book, numbered in reading order; conversations stand for books, turns for documents.

    Only the numbers of blocks are summed up over a book, so the blocks themselves aren't shuffled or sorted.
    """
    docs = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", "\n", -1).alias("blocks"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = docs.withColumn("lengths", F.transform("blocks", F.length)).drop("blocks").withColumn("before", F.coalesce(F.sum(F.size("lengths")).over(w), F.lit(0)))
    out = before.select("conv_id", "turn", "before", F.posexplode("lengths").alias("place", "chars"))
    return out.select("conv_id", "turn", "place", (F.col("before") + F.col("place")).alias("ordinal"), F.col("chars").cast("long").alias("chars"))


@query("""SELECT conv_id, count(*)::BIGINT AS spine_documents, sum(CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END)::BIGINT AS nodes,
    sum(coalesce(length(replace(text, chr(10), '')), 0))::BIGINT AS chars, count(*) FILTER (text IS NULL OR trim(text) = '')::BIGINT AS reviewable FROM conversations GROUP BY 1""")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, nodes and characters of each book, and how many documents hold no text."""
    bare = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("spine_documents"),
        F.sum(F.coalesce(F.length("text") - bare + 1, F.lit(0))).alias("nodes"),
        F.sum(F.coalesce(bare, F.lit(0))).alias("chars"),
        F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("reviewable"),
    )


@query("""SELECT l_orderkey, l_linenumber, abs(epoch(l_shipdate) - epoch(o_orderdate))::BIGINT AS seconds FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def attempt_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between the start of a run and each attempt's end."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(runs, "l_orderkey", "left")
    return a.select("l_orderkey", "l_linenumber", T.duration_seconds(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))


@query("""SELECT p_partkey, sha256('["1.0",{"brand":"' || p_brand || '","size":' || p_size || ',"type":"' || p_type || '"}]') AS config_hash,
    (p_size % 3) || '.' || (p_size % 4) || '.' || p_size AS version, [p_size % 3, p_size % 4, p_size] < [1, 1, 0] AS fallback FROM part""")
def generation_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a configuration, keys in order, and whether its version asks for the simpler search."""
    config = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    version = F.concat_ws(".", *[x.cast("string") for x in (F.col("p_size") % 3, F.col("p_size") % 4, F.col("p_size"))])
    hashed = F.sha2(F.concat(F.lit('["1.0",'), config, F.lit("]")), 256)
    return table(spark, sf_dir, "part").select("p_partkey", hashed.alias("config_hash"), version.alias("version"), T.version_before(version, "1.1.0").alias("fallback"))
