"""Identifiers, titles and the reconciliation of records with editions that share an identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.functions import text as T
from lodestone.operators import evidence
from lodestone.session import table

from .catalog import query

#: Parts carry no identifiers: these forms, made of their keys, stand in.
RAW = """i AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '978-' || lpad(p_partkey::VARCHAR, 9, '0') || '-' || (p_partkey % 10) WHEN 1 THEN lpad(p_partkey::VARCHAR, 9, '0') || 'x'
        WHEN 2 THEN 'urn:uuid:' || upper(md5(p_partkey::VARCHAR)) WHEN 3 THEN 'doi:10.' || (1000 + p_partkey % 9000) || '/p' || p_partkey WHEN 4 THEN 'https://doi.org/10.1234/' || p_partkey
        WHEN 5 THEN 'https://example.org/' || p_partkey WHEN 6 THEN 'urn:isbn:' || lpad(p_partkey::VARCHAR, 10, '0') ELSE p_name || ' ' || p_partkey END AS raw FROM part)"""


def raw_identifier() -> Column:
    key = F.col("p_partkey").cast("string")
    forms = [
        F.concat(F.lit("978-"), F.lpad(key, 9, "0"), F.lit("-"), (F.col("p_partkey") % 10).cast("string")),
        F.concat(F.lpad(key, 9, "0"), F.lit("x")),
        F.concat(F.lit("urn:uuid:"), F.upper(F.md5(key))),
        F.concat(F.lit("doi:10."), (1000 + F.col("p_partkey") % 9000).cast("string"), F.lit("/p"), key),
        F.concat(F.lit("https://doi.org/10.1234/"), key),
        F.concat(F.lit("https://example.org/"), key),
        F.concat(F.lit("urn:isbn:"), F.lpad(key, 10, "0")),
        F.concat("p_name", F.lit(" "), key),
    ]
    return F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))


FORMS = (
    RAW
    + """, d AS (SELECT *, upper(regexp_replace(regexp_replace(raw, '^urn:isbn:', ''), '[\\s-]', '', 'g')) AS d FROM i),
    s AS (SELECT *, list_sum(list_transform(range(1, 14), lambda n: TRY_CAST(substr(d, n, 1) AS INT) * CASE WHEN n % 2 = 1 THEN 1 ELSE 3 END)) % 10 AS s13,
        list_sum(list_transform(range(1, 11), lambda n: (11 - n) * CASE WHEN substr(d, n, 1) = 'X' THEN 10 ELSE TRY_CAST(substr(d, n, 1) AS INT) END)) % 11 AS s10,
        list_sum(list_transform(range(1, 13), lambda n: TRY_CAST(substr('978' || d, n, 1) AS INT) * CASE WHEN n % 2 = 1 THEN 1 ELSE 3 END)) % 10 AS c10,
        CASE WHEN p_partkey % 8 = 2 THEN lower(substr(raw, 10)) END AS u FROM d),
    f AS (SELECT p_partkey, raw, CASE WHEN u IS NOT NULL THEN 'uuid' WHEN p_partkey % 8 IN (3, 4) THEN 'doi' WHEN regexp_full_match(d, '\\d{13}') AND s13 = 0 THEN 'isbn13'
            WHEN regexp_full_match(d, '\\d{9}[\\dX]') AND s10 = 0 THEN 'isbn10' WHEN p_partkey % 8 = 5 THEN 'uri' ELSE 'other' END AS scheme, d, u, c10 FROM s),
    o AS (SELECT p_partkey, raw, scheme, CASE scheme WHEN 'uuid' THEN substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21)
            WHEN 'doi' THEN regexp_extract(raw, '(10\\.\\d{4,9}/\\S+)', 1) WHEN 'uri' THEN raw WHEN 'other' THEN NULL ELSE d END AS value,
        CASE scheme WHEN 'isbn13' THEN d WHEN 'isbn10' THEN '978' || substr(d, 1, 9) || ((10 - c10) % 10)::BIGINT END AS isbn13,
        CASE WHEN scheme <> 'other' THEN true WHEN p_partkey % 8 IN (0, 6) THEN false END AS valid FROM f)"""
)


@query(f"WITH {FORMS} SELECT * FROM o")
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every scheme, classified and checked."""
    found = table(spark, sf_dir, "part").select("p_partkey", raw_identifier().alias("raw"))
    return found.withColumn("i", identity.normalize_identifier(F.col("raw"))).select("p_partkey", "raw", "i.*")


@query(f"""WITH {FORMS} SELECT p_partkey, CASE WHEN isbn13 IS NOT NULL THEN 'isbn13' WHEN scheme IN ('doi', 'uuid') THEN scheme END AS canonical_scheme,
    CASE WHEN isbn13 IS NOT NULL THEN isbn13 WHEN scheme IN ('doi', 'uuid') THEN value END AS canonical_value FROM o""")
def identifier_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What identifiers are compared by."""
    c = identity.canonical(F.struct("scheme", "value", "isbn13"))
    return identifier_forms(spark, sf_dir).withColumn("c", c).select("p_partkey", F.col("c.scheme").alias("canonical_scheme"), F.col("c.value").alias("canonical_value"))


#: Of three parts with one ISBN the first two stand for editions, with a canonical form or an older one, the third for an asset.
LOOKUP = """n AS (SELECT p_partkey AS edition, '978' || lpad((p_partkey // 3)::VARCHAR, 10, '0') AS isbn FROM part WHERE p_partkey % 3 < 2),
    a AS (SELECT p_partkey, '978' || lpad((p_partkey // 3)::VARCHAR, 10, '0') AS isbn FROM part WHERE p_partkey % 3 = 2),
    m AS (SELECT p_partkey, any_value(isbn) AS isbn, min(edition) AS edition FROM a JOIN n USING (isbn) GROUP BY 1)"""


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edition with an asset's ISBN, in the canonical column or, where that is empty, in the older one.

    Two equi-joins, as a join with OR would compare all pairs.
    """
    isbn = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") / 3).cast("long").cast("string"), 10, "0"))
    parts = table(spark, sf_dir, "part").select("p_partkey", isbn.alias("isbn"))
    assets = parts.where("p_partkey % 3 = 2")
    held = parts.where("p_partkey % 3 < 2").withColumnRenamed("p_partkey", "edition")
    held = held.select("edition", F.lit("isbn13").alias("scheme"), F.col("isbn").alias("value"), F.when(F.col("edition") % 2 == 0, F.col("isbn")).alias("canonical_value"))
    by = lambda c: assets.join(held.where(F.col("scheme") == "isbn13").select("edition", F.col(c).alias("isbn")), "isbn")
    return by("canonical_value").unionByName(by("value")).groupBy("p_partkey", "isbn").agg(F.min("edition").alias("edition"))


@query(f"WITH {LOOKUP} SELECT p_partkey, isbn, edition FROM m")
def identifier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir)


SIX = (
    LOOKUP
    + """, k AS (SELECT p_partkey AS id, nullif(substr(trim(regexp_replace(regexp_replace(lower(trim(nfc_normalize(p_name))), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 1000), '') AS title, p_size % 7 <> 0 AS named,
        nullif(p_type, 'ECONOMY') AS lang, nullif(lower(trim(regexp_replace(p_brand, '\\s+', ' ', 'g'))), '') AS publisher, CASE WHEN p_size <= 45 THEN p_size END AS year FROM part),
    c AS (SELECT DISTINCT l_partkey AS id, l_suppkey FROM lineitem),
    e AS (SELECT m.p_partkey, m.edition, CASE WHEN a.named AND b.named AND a.title IS NOT NULL AND b.title IS NOT NULL THEN CASE WHEN a.title = b.title THEN 'agree' ELSE 'conflict' END ELSE 'absent' END AS d_title,
        CASE WHEN m.p_partkey NOT IN (SELECT id FROM c) OR m.edition NOT IN (SELECT id FROM c) THEN 'absent'
            WHEN EXISTS (SELECT 1 FROM c x JOIN c y USING (l_suppkey) WHERE x.id = m.p_partkey AND y.id = m.edition) THEN 'agree' ELSE 'conflict' END AS d_creator,
        CASE WHEN a.lang IS NULL OR b.lang IS NULL THEN 'absent' WHEN a.lang = b.lang THEN 'agree' ELSE 'conflict' END AS d_language, 'agree' AS d_identifier,
        CASE WHEN a.publisher IS NULL OR b.publisher IS NULL THEN 'absent' WHEN a.publisher = b.publisher THEN 'agree' ELSE 'conflict' END AS d_publisher,
        CASE WHEN a.year IS NULL OR b.year IS NULL THEN 'absent' WHEN a.year = b.year THEN 'agree' ELSE 'conflict' END AS d_year
        FROM m JOIN k a ON a.id = m.p_partkey JOIN k b ON b.id = m.edition)"""
)


def six_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset against the edition with its ISBN: title, creator, language, identifier, publisher, year.

    Creators meet by a join, so that no list of them is held. Sizes stand for years, types for
    languages, suppliers for creators; a size divisible by 7 for a title that is only a file's name.
    """
    k = table(spark, sf_dir, "part").select(
        "p_partkey",
        T.title_key(F.col("p_name")).alias("title"),
        (F.col("p_size") % 7 != 0).alias("named"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("lang"),
        T.publisher_key(F.col("p_brand")).alias("publisher"),
        F.when(F.col("p_size") <= 45, F.col("p_size")).alias("year"),
        raw_identifier().alias("raw"),
    )
    pairs = lookup(spark, sf_dir)
    credits = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    named = lambda key, n: pairs.join(credits, pairs[key] == credits["l_partkey"]).select("p_partkey", "l_suppkey", F.lit(n).alias("side"))
    shared = named("p_partkey", 1).unionByName(named("edition", 2)).groupBy("p_partkey", "l_suppkey").agg(F.bit_or("side").alias("side"))
    shared = shared.groupBy("p_partkey").agg(F.bit_or("side").alias("sides"), F.bool_or(F.col("side") == 3).alias("common"))
    creator = F.when(F.coalesce("sides", F.lit(0)) != 3, evidence.ABSENT).when(F.col("common"), evidence.AGREE).otherwise(evidence.CONFLICT)

    both = pairs.join(k.withColumnRenamed("p_partkey", "id").select(F.col("id").alias("p_partkey"), F.struct(*k.columns[1:]).alias("a")), "p_partkey")
    both = both.join(k.select(F.col("p_partkey").alias("edition"), F.struct(*k.columns[1:]).alias("b")), "edition").join(shared, "p_partkey", "left")
    same = lambda x: evidence.equal_dimension(F.col(f"a.{x}"), F.col(f"b.{x}"))
    isbn = F.struct(F.lit("isbn13").alias("scheme"), F.col("isbn").alias("value"), F.col("isbn").alias("isbn13"), F.lit(True).alias("valid"))
    tokens = lambda s: identity.tokens(F.array(isbn, identity.normalize_identifier(F.col(f"{s}.raw"))))
    return both.select(
        "p_partkey",
        "edition",
        evidence.title_dimension(F.col("a.title"), F.col("b.title"), F.col("a.named"), F.col("b.named")).alias("d_title"),
        creator.alias("d_creator"),
        same("lang").alias("d_language"),
        evidence.overlap_dimension(tokens("a"), tokens("b")).alias("d_identifier"),
        same("publisher").alias("d_publisher"),
        same("year").alias("d_year"),
    )


@query(f"""WITH {SIX} SELECT *, CASE WHEN d_title = 'agree' AND 'conflict' NOT IN (d_title, d_creator, d_language, d_identifier, d_publisher, d_year) THEN 'identifier_and_title' ELSE 'provisional_creation' END AS outcome FROM e""")
def reconcile_by_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked where the title agrees and nothing conflicts; else a provisional edition is to be made."""
    d = six_dimensions(spark, sf_dir)
    clear = (F.col("d_title") == evidence.AGREE) & ~evidence.any_conflict(*[F.col(x) for x in d.columns if x.startswith("d_")])
    return d.withColumn("outcome", F.when(clear, "identifier_and_title").otherwise("provisional_creation"))


@query(f"""WITH {SIX}, p AS (SELECT p_partkey FROM e WHERE NOT (d_title = 'agree' AND 'conflict' NOT IN (d_title, d_creator, d_language, d_identifier, d_publisher, d_year))
        UNION ALL SELECT p_partkey FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM m))
    SELECT p_partkey, l_suppkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY l_suppkey) - 1)::INTEGER AS position FROM p JOIN c ON c.id = p_partkey""")
def provisional_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credits of each provisional edition in order: of assets that weren't linked, a row for each creator."""
    linked = reconcile_by_identifier(spark, sf_dir).where("outcome = 'identifier_and_title'").select("p_partkey")
    left = table(spark, sf_dir, "part").where("p_partkey % 3 = 2").select("p_partkey").join(linked, "p_partkey", "left_anti")
    credits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    w = Window.partitionBy("p_partkey").orderBy("l_suppkey")
    return left.join(credits, "p_partkey").select("p_partkey", "l_suppkey", (F.row_number().over(w) - 1).alias("position"))


@query("""WITH t AS (SELECT conv_id, min(struct_pack(turn := turn, text := text)) AS first, min(struct_pack(turn := turn, text := text)) FILTER (role = 'assistant') AS main,
        min(struct_pack(turn := turn, text := text)) FILTER (role = 'system') AS sub FROM conversations GROUP BY 1)
    SELECT conv_id, coalesce(main.text, first.text) AS title, sub.text AS subtitle FROM t""")
def title_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first main title, else the first of any type, and the first subtitle; roles stand for types."""
    t = F.struct("turn", "text")
    first = lambda role: F.min(F.when(F.col("role") == role, t))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(t).alias("first"), first("assistant").alias("main"), first("system").alias("sub"))
    return c.select("conv_id", F.coalesce("main.text", "first.text").alias("title"), F.col("sub.text").alias("subtitle"))


@query("""WITH b AS (SELECT doc_id, encode(trim(coalesce(text, ''))) AS b FROM documents),
    c AS (SELECT doc_id, octet_length(b) AS n, coalesce(try(decode(b[1:2000])), try(decode(b[1:1999])), try(decode(b[1:1998])), try(decode(b[1:1997]))) AS t FROM b)
    SELECT doc_id, strlen(t)::INTEGER AS n_bytes, sha256(t) AS kept_sha256, n > 2000 AS truncated FROM c""")
def metadata_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a metadata field of 2000 bytes holds them: cut between characters."""
    kept = T.cap_bytes(F.col("text"), 2000)
    whole = F.octet_length(F.trim(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(kept).alias("n_bytes"), F.sha2(kept, 256).alias("kept_sha256"), (whole > 2000).alias("truncated"))


@query("""WITH d AS (SELECT doc_id, text, nullif(concat_ws(' › ', source, lang), '') AS heading_text, strpos(text, chr(10))::BIGINT AS overlap FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, heading_text, sha256(coalesce(heading_text || chr(10) || chr(10), '') || text) AS embedding_sha256, substr(text, overlap + 1, 700) AS excerpt, length(text) - overlap > 700 AS truncated FROM d""")
def result_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, embedding text and excerpt of each text, its first line standing for what it repeats."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    d = d.withColumn("heading_text", T.heading_text(F.filter(F.array("source", "lang"), lambda x: x.isNotNull())))
    shown, cut = T.excerpt(F.col("text"), F.instr("text", "\n"))
    return d.select("doc_id", "heading_text", F.sha2(T.embedding_text(F.col("heading_text"), F.col("text")), 256).alias("embedding_sha256"), shown.alias("excerpt"), cut.alias("truncated"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '../' WHEN 2 THEN 'C:' || chr(92) ELSE 'a' || chr(92) || '..' || chr(92) END || regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages)
    SELECT page_id, path, replace(path, chr(92), '/') LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') AS unsafe,
        base64(encode(path)) AS stored, true AS restored, regexp_replace(path, '([\\\\%_])', '\\\\\\1', 'g') AS literal FROM p""")
def member_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of archive members: whether they are unsafe, how they are stored, and as a literal for LIKE."""
    start = F.element_at(F.array(F.lit(""), F.lit("../"), F.lit("C:\\"), F.lit("a\\..\\")), (F.col("page_id") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(start, F.regexp_replace("url", "^https?://[^/]*/", "")).alias("path"))
    stored = T.encode_path(F.encode("path", "UTF-8"))
    restored = T.display(T.decode_path(F.col("stored")), 1 << 30) == F.col("path")
    return p.withColumn("stored", stored).select("page_id", "path", T.unsafe_path(F.col("path")).alias("unsafe"), "stored", restored.alias("restored"), T.like_escape(F.col("path")).alias("literal"))
