"""Documents as nodes: places, hashes, headings, sections, chunks, postings, page links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import outline
from lodestone.operators.chunking import chunk_documents
from lodestone.sources import pages as page_source
from lodestone.session import table, written

from .catalog import query


def nodes(docs: DataFrame) -> DataFrame:
    """A row for each line: doc_id, ordinal, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))


#: A node is a heading where ordinal % 4 = 0, of level 1 to 3 in turn.
def headed(docs: DataFrame) -> DataFrame:
    level = F.when(F.col("ordinal") % 4 == 0, (F.col("ordinal") / 4).cast("int") % 3 + 1)
    return nodes(docs).select("doc_id", "ordinal", F.length("line").cast("long").alias("chars"), level.alias("level"))


NODES = """n AS (
    SELECT doc_id, i - 1 AS ordinal, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
)"""
HEADED = (
    NODES
    + """, h AS (
    SELECT doc_id, ordinal, length(line)::BIGINT AS chars, CASE WHEN ordinal % 4 = 0 THEN (ordinal // 4) % 3 + 1 END AS level FROM n
)"""
)


@query(f"""WITH {NODES} SELECT doc_id, ordinal::INTEGER AS ordinal, length(line)::BIGINT AS chars,
    coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT AS start_at, coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT + length(line) AS end_at
    FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def nodes_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    n = nodes(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.length("line").cast("long").alias("chars"))
    start = F.coalesce(F.sum(F.col("chars") + 1).over(before), F.lit(0))
    return n.withColumn("start_at", start).withColumn("end_at", F.col("start_at") + F.col("chars"))


@query("""SELECT doc_id, length(text)::BIGINT AS chars, (length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')))::BIGINT AS utf16_units
    FROM documents""")
def canonical_utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), T.utf16_length(F.col("text")).alias("utf16_units"))


@query("""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) AS fingerprint FROM documents""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(kept, "\n"), 256).alias("fingerprint"))


@query(f"""WITH {NODES} SELECT doc_id, ordinal::INTEGER AS ordinal,
    sha256(concat('doc', doc_id, '.xhtml', chr(0), 'n', ordinal, chr(0), 'paragraph', chr(0), line)) AS source_hash FROM n""")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".xhtml"), T.nul(), F.lit("n"), F.col("ordinal").cast("string"), T.nul(), F.lit("paragraph"), T.nul(), F.col("line"))
    return nodes(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.sha2(parts, 256).alias("source_hash"))


@query(f"""WITH {HEADED}, p AS (
    SELECT doc_id, ordinal, max(CASE WHEN level = 1 THEN ordinal END) OVER w AS l1, max(CASE WHEN level = 2 THEN ordinal END) OVER w AS l2,
        max(CASE WHEN level = 3 THEN ordinal END) OVER w AS l3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)
), q AS (
    SELECT doc_id, ordinal, l1, CASE WHEN l2 > coalesce(l1, -1) THEN l2 END AS l2, CASE WHEN l3 > greatest(coalesce(l1, -1), coalesce(l2, -1)) THEN l3 END AS l3 FROM p
) SELECT doc_id, ordinal::INTEGER AS ordinal, concat_ws('/', l1, l2, l3) AS heading_path FROM q""")
def heading_path_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings a node stands under, its own included: a heading ends those of its level and below."""
    so_far = Window.partitionBy("doc_id").orderBy("ordinal")
    last = [F.max(F.when(F.col("level") == k, F.col("ordinal"))).over(so_far).alias(f"l{k}") for k in (1, 2, 3)]
    p = headed(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", *last)
    known = lambda *k: F.greatest(*[F.coalesce(f"l{i}", F.lit(-1)) for i in k], F.lit(-1))
    path = F.concat_ws("/", "l1", F.when(F.col("l2") > known(1), F.col("l2")), F.when(F.col("l3") > known(1, 2), F.col("l3")))
    return p.select("doc_id", "ordinal", path.alias("heading_path"))


@query(f"""WITH {HEADED}, s AS (
    SELECT *, CASE level WHEN 1 THEN min(CASE WHEN level <= 1 THEN ordinal END) OVER w WHEN 2 THEN min(CASE WHEN level <= 2 THEN ordinal END) OVER w
        WHEN 3 THEN min(CASE WHEN level <= 3 THEN ordinal END) OVER w END AS stop FROM h
    WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
) SELECT s.doc_id, s.ordinal::INTEGER AS start_ordinal, s.level::INTEGER AS level, count(*)::BIGINT AS n_nodes, sum(h.chars)::BIGINT AS n_chars
    FROM s JOIN h ON h.doc_id = s.doc_id AND h.ordinal >= s.ordinal AND h.ordinal < coalesce(s.stop, 1000000000) WHERE s.level IS NOT NULL
    GROUP BY ALL""")
def sections_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and characters of each section, sub-sections included: by differences of running sums, without a range join."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    after, so_far, whole = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id")
    upto = lambda k: F.min(F.when(F.col("level") <= k, F.struct("ordinal", "sum_before"))).over(after)
    h = headed(table(spark, sf_dir, "documents")).withColumn("sum_before", F.coalesce(F.sum("chars").over(so_far), F.lit(0)))
    h = h.withColumn("nodes", F.count("*").over(whole)).withColumn("all_chars", F.sum("chars").over(whole))
    stop = F.when(F.col("level") == 1, upto(1)).when(F.col("level") == 2, upto(2)).when(F.col("level") == 3, upto(3))
    s = h.withColumn("stop", stop).where("level is not null")
    return s.select(
        "doc_id",
        F.col("ordinal").alias("start_ordinal"),
        "level",
        (F.coalesce("stop.ordinal", "nodes") - F.col("ordinal")).cast("long").alias("n_nodes"),
        (F.coalesce("stop.sum_before", "all_chars") - F.col("sum_before")).cast("long").alias("n_chars"),
    )


@query("""SELECT doc_id, true AS slices_exact, true AS spans_exact,
    list_sum(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS content_chars FROM documents WHERE text <> ''""")
def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks are slices of their document, spans lead back to it, and their content is the whole document once."""
    docs = table(spark, sf_dir, "documents")
    c = chunk_documents(docs).join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    whole = F.expr("substring(body, int(start) + 1, int(end - start)) = text")
    spans = F.forall("spans", lambda s: F.substring(F.col("text"), s["at"] + 1, (s["end"] - s["start"]).cast("int")) == F.substring(F.col("body"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))
    return c.groupBy("doc_id").agg(F.bool_and(whole).alias("slices_exact"), F.bool_and(spans).alias("spans_exact"), F.sum("content_chars").cast("long").alias("content_chars"))


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document, with the rough number of tokens (a quarter of the characters)."""
    c = chunk_documents(table(spark, sf_dir, "documents"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.ceil(F.length("text") / 4)).alias("token_estimate"), F.max("content_chars").alias("largest"))


@query("""SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term""")
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of each word: one shuffle of terms, added up before it.

    A row is a document, so what is distinct within it needs no shuffle by document.
    """
    words = T.words(F.col("text"))
    every = F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t")))
    once = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t")))
    rows = table(spark, sf_dir, "documents").select(F.explode(F.concat(every, once)).alias("x")).select("x.*")
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("tf"))


EMBED = """e AS (
    SELECT doc_id, list_transform(range(0, 32), lambda b: len(list_filter(t, lambda x: x = b))::DOUBLE) AS v FROM (
        SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: ('0x' || substr(sha256(w), 1, 6))::BIGINT % 32) AS t
        FROM documents)
)"""


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1)
        n = np.asarray(words.value_lengths().fill_null(0))
        coded = words.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.sha256(w.encode()).hexdigest()[:6], 16) % 32 for w in coded.dictionary.to_pylist()], np.int64)
        at = np.repeat(np.arange(batch.num_rows), n) * 32 + bucket[coded.indices.to_numpy()]
        counts = np.bincount(at, minlength=32 * batch.num_rows).astype(np.float64)
        v = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * 32, pa.int32()), pa.array(counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), v], names=["doc_id", "v"])


def embedded(docs: DataFrame) -> DataFrame:
    """doc_id and vector of whole texts: 32 unit-length counts of hashed words, in thousandths."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    v = docs.select("doc_id", T.words(F.col("text")).alias("t")).mapInArrow(_bucket_counts, f"doc_id {kind}, v array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    v = v.withColumn("norm", F.when(norm == 0, 1.0).otherwise(norm))
    return v.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(1000 * x / F.col("norm")).cast("long").cast("string")), ",").alias("vector"))


EMBEDDED = f"""WITH {EMBED}, u AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
    SELECT doc_id, array_to_string(list_transform(v, lambda x: round(1000 * x / CASE WHEN norm = 0 THEN 1 ELSE norm END)::BIGINT), ',') AS vector FROM u"""


@query(EMBEDDED)
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of hashed words as 32 unit-length counts (thousandths), of whole texts: the default embedding model."""
    return embedded(table(spark, sf_dir, "documents"))


@query(EMBEDDED)
def hashed_embedding_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hashed_embedding, under the name that its form for texts of any length had."""
    return hashed_embedding(spark, sf_dir)


@query("""SELECT page_id, length(html)::BIGINT AS n_chars, (length(html) < 200 AND html ILIKE '%<img%') AS image_only FROM pages""")
def image_only_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.length("html").cast("long").alias("n_chars"), ((F.length("html") < 200) & F.lower("html").contains("<img")).alias("image_only"))


#: The same windows over tags as in lodestone.sources.pages; the tables hold four named character references.
TAGS = f"""t AS (SELECT page_id, n, x AS t, lower(regexp_extract(x, '{page_source.NAME}', 1)) AS tag, starts_with(x, '</') AS shut FROM (
        SELECT page_id, unnest(toks) AS x, unnest(range(1, len(toks) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(html, '{page_source.TOKEN.replace("'", "''")}') AS toks FROM pages))),
    a AS (SELECT *, CASE WHEN tag <> '' AND NOT shut THEN regexp_extract_all(t, '{page_source.ATTRIBUTE.replace("'", "''")}', 2) END AS vs,
        CASE WHEN tag <> '' AND NOT shut THEN list_transform(regexp_extract_all(t, '{page_source.ATTRIBUTE.replace("'", "''")}', 1), lambda y: lower(y)) END AS ks FROM t),
    b AS (SELECT page_id, n, t, tag, shut, tag = '' AND NOT regexp_matches(t, '^<[/!?]') AS is_text, nullif(regexp_replace(vs[list_position(ks, 'id')], '^["'']|["'']$', '', 'g'), '') AS id_attr,
        regexp_replace(vs[list_position(ks, 'alt')], '^["'']|["'']$', '', 'g') AS alt, tag IN {(*page_source.HOLDERS, *page_source.HIDDEN)} AS paired, tag IN {page_source.HOLDERS} AS holds, tag IN {page_source.LISTS} AS lists FROM a),
    s AS (SELECT *, sum(CASE WHEN paired THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY n) AS total FROM b),
    d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id, tag ORDER BY n)) AS deep FROM s),
    l AS (SELECT *, CASE WHEN paired AND shut THEN coalesce(lag(deep) OVER (PARTITION BY page_id, tag ORDER BY n), 0) ELSE deep END AS level FROM d),
    m AS (SELECT *, CASE WHEN paired AND shut THEN lag(id_attr) OVER p ELSE id_attr END AS open_id, lag(n) OVER p AS open_at, CASE WHEN paired AND NOT shut AND coalesce(lead(shut) OVER p, false) THEN 1 WHEN paired AND shut AND level > 0 THEN -1 ELSE 0 END AS turn
        FROM l WINDOW p AS (PARTITION BY page_id, tag, level ORDER BY n)),
    z AS (SELECT *, sum(CASE WHEN tag IN {page_source.HIDDEN} THEN turn ELSE 0 END) OVER o AS hid, sum(CASE WHEN tag = 'blockquote' THEN turn ELSE 0 END) OVER o AS quo, sum(CASE WHEN tag = 'table' THEN turn ELSE 0 END) OVER o AS tab,
        sum(CASE WHEN lists THEN turn ELSE 0 END) OVER o AS lis, sum(CASE WHEN holds THEN turn ELSE 0 END) OVER o AS hol,
        sum((tag IN {page_source.PARTS})::INTEGER) OVER o AS run, last_value(CASE WHEN tag IN {page_source.PARTS} THEN CASE WHEN NOT shut AND tag IN {tuple(page_source.KINDS)} THEN tag ELSE '' END END IGNORE NULLS) OVER o AS head_,
        last_value(CASE WHEN regexp_matches(tag, '^h[1-6]$') AND NOT shut THEN id_attr END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_id
        FROM m WINDOW o AS (PARTITION BY page_id ORDER BY n)),
    y AS (SELECT *, coalesce(head_, '') AS head, CASE WHEN tab > 0 THEN last_value(CASE WHEN tag = 'table' AND turn = 1 AND tab = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n) END AS outer_at,
        CASE WHEN lis > 0 THEN last_value(CASE WHEN lists AND turn = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY page_id, lis ORDER BY n) END AS list_at,
        CASE WHEN hol > 0 THEN last_value(CASE WHEN holds AND turn = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY page_id, hol ORDER BY n) END AS hold_at FROM z),
    w AS (SELECT *, last_value(CASE WHEN tab = 1 AND tag = 'tr' AND NOT shut THEN n END IGNORE NULLS) OVER (PARTITION BY page_id, outer_at ORDER BY n) AS tr,
        last_value(CASE WHEN tab = 1 AND tag IN ('td', 'th', 'tr') THEN {{'n': CASE WHEN tag <> 'tr' AND NOT shut THEN n END}} END IGNORE NULLS) OVER (PARTITION BY page_id, outer_at ORDER BY n) AS cell,
        CASE WHEN list_at IS NOT NULL THEN last_value(CASE WHEN tag IN {page_source.ITEMS} THEN {{'n': CASE WHEN NOT shut THEN n END, 'id': id_attr}} END IGNORE NULLS) OVER (PARTITION BY page_id, list_at ORDER BY n) END AS item, CASE WHEN lists AND turn = -1 THEN open_at ELSE list_at END AS of_list FROM y),
    x AS (SELECT *, CASE WHEN of_list IS NOT NULL THEN last_value(CASE WHEN tag IN {page_source.ITEMS} THEN {{'n': CASE WHEN NOT shut THEN n END, 'id': id_attr}} END IGNORE NULLS) OVER (PARTITION BY page_id, of_list ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prior,
        tag IN {page_source.ITEMS} AND NOT shut AND id_attr IS NOT NULL AND list_at IS NOT NULL AS begun FROM w),
    g AS (SELECT *, sum(CASE WHEN holds AND open_id IS NOT NULL THEN turn ELSE 0 END + begun::INTEGER
        - ((tag IN {page_source.ITEMS} OR lists AND turn = -1) AND prior.n IS NOT NULL AND prior.id IS NOT NULL)::INTEGER) OVER (PARTITION BY page_id ORDER BY n) AS nam FROM x),
    k AS (SELECT *, CASE WHEN nam > 0 THEN last_value(CASE WHEN begun OR holds AND open_id IS NOT NULL AND turn = 1 THEN id_attr END IGNORE NULLS) OVER (PARTITION BY page_id, nam ORDER BY n) END AS above_id FROM g),
    v AS (SELECT *, CASE WHEN outer_at IS NOT NULL AND head <> 'caption' THEN 'table' WHEN item.n IS NOT NULL AND hold_at = list_at AND head IN {("", "p", *page_source.ITEMS)} THEN 'item' ELSE 'run' END AS kind FROM k),
    u AS (SELECT page_id, n, kind, CASE kind WHEN 'table' THEN outer_at WHEN 'item' THEN item.n ELSE run END AS place, CASE WHEN kind = 'table' THEN coalesce(tr, -1) END AS tr, CASE WHEN kind = 'table' THEN cell.n END AS td, head, quo, above_id, heading_id, id_attr, tag,
        CASE WHEN is_text THEN t WHEN tag = 'br' THEN ' ' ELSE '' END AS part, CASE WHEN tag = 'img' THEN ' ' || coalesce(alt, '') ELSE '' END AS alt FROM v
        WHERE hid = 0 AND (is_text OR tag IN ('br', 'img') OR (tag <> '' AND NOT shut AND (kind <> 'run' OR tag NOT IN {(*page_source.HOLDERS, "hr")}) AND (id_attr IS NOT NULL OR tag IN {("td", "th", "tr", *page_source.KINDS)})))),
    c AS (SELECT page_id, kind, place, tr, td, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(string_agg(part, '' ORDER BY n), '&amp([^;a-z]|$)', '&amp;\\1', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text,
        trim(regexp_replace(string_agg(alt, '' ORDER BY n), '\\s+', ' ', 'g')) AS alts, bool_or(tag = 'img') AS image, arg_min(id_attr, n) FILTER (id_attr IS NOT NULL) AS own, min(n) FILTER (id_attr IS NOT NULL) AS own_n,
        arg_min({{'head': head, 'quo': quo, 'above': above_id, 'heading': heading_id}}, n) AS first, min(n) AS n FROM u GROUP BY ALL),
    r AS (SELECT page_id, kind, place, tr, string_agg(text, chr(9) ORDER BY td) FILTER (kind <> 'table' OR td IS NOT NULL) AS line, list(text ORDER BY td) FILTER (td IS NOT NULL) AS cells, bool_or(image) AS image,
        string_agg(alts, ' ' ORDER BY td) FILTER (alts <> '' AND (kind <> 'table' OR td IS NOT NULL)) AS alts, arg_min(own, own_n) AS own, min(own_n) AS own_n, arg_min(first, n) AS first, min(n) AS n FROM c GROUP BY page_id, kind, place, tr),
    e AS (SELECT page_id, kind, place, coalesce(string_agg(line, chr(10) ORDER BY tr) FILTER (trim(replace(line, chr(9), ' ')) <> ''), '') AS body, list(cells ORDER BY tr) FILTER (cells IS NOT NULL) AS cells, bool_or(image) AS image,
        coalesce(string_agg(alts, ' ' ORDER BY tr), '') AS alts, arg_min(own, own_n) AS own, arg_min(first, n) AS first, min(n) AS n FROM r GROUP BY page_id, kind, place)"""
KIND_OF = " ".join(f"WHEN first.head = '{k}' THEN '{v}'" for k, v in page_source.KINDS.items() if k != "p")


BLOCKS = f"""{TAGS}, blocks AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN kind = 'run' THEN n ELSE place END, kind, place) - 1)::INTEGER AS ordinal,
    CASE WHEN body = '' THEN 'figure' WHEN kind = 'table' THEN 'table' WHEN kind = 'item' THEN 'list_item' {KIND_OF} WHEN first.quo > 0 THEN 'blockquote' WHEN first.head = 'p' THEN 'paragraph' ELSE 'other' END AS type,
    CASE WHEN body <> '' AND kind = 'run' AND regexp_matches(first.head, '^h[1-6]$') THEN first.head[2]::INTEGER END AS level, coalesce(own, first.above, first.heading) AS fragment,
    nfc_normalize(CASE WHEN body = '' THEN alts ELSE body END) AS text, CASE WHEN kind = 'table' THEN coalesce(len(cells), 0) END::INTEGER AS n_rows FROM e WHERE body <> '' OR image)"""


@query(f"WITH {BLOCKS} SELECT * FROM blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of all pages, from their tags as rows."""
    return page_source.page_blocks(table(spark, sf_dir, "pages")).withColumn("n_rows", F.size("rows")).drop("rows")


@query()
def chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each chunk's provenance and text: equal source and sizes give equal hashes."""
    span = F.transform("spans", lambda s: F.format_string("n%06d:%d-%d", s["node"], s["start"], s["end"]))
    c = chunk_documents(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "ordinal", F.sha2(F.concat(F.array_join(span, "\n"), T.nul(), F.col("text")), 256).alias("fingerprint"))


LINKS = "regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)"


@query(f"""SELECT page_id, (i - 1)::INTEGER AS ordinal, l[i] AS href,
    CASE WHEN v LIKE '//%' OR regexp_matches(v, '^(https?|ftp):') THEN 'remote' WHEN regexp_matches(v, '^[a-z][a-z0-9+.-]*:') THEN 'blocked' ELSE 'ok' END AS verdict
    FROM (SELECT page_id, l, i, lower(regexp_replace(l[i], '[\\x00-\\x20]', '', 'g')) AS v FROM (
        SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {LINKS} AS l FROM pages)))""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages in order, each with its verdict."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ordinal", "href")).withColumn("verdict", T.url_verdict(F.col("href")))


@query("""SELECT page_id, CASE WHEN v LIKE '//%' OR regexp_matches(v, '^(https?|ftp):') THEN 'remote' WHEN regexp_matches(v, '^[a-z][a-z0-9+.-]*:') THEN 'blocked' ELSE 'ok' END AS verdict
    FROM (SELECT page_id, lower(regexp_replace(url, '[\\x00-\\x20]', '', 'g')) AS v FROM pages)""")
def url_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_verdict(F.col("url")).alias("verdict"))


@query(f"""WITH l AS (SELECT page_id, url, unnest({LINKS}) AS href FROM pages)
    SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS target, count(*)::BIGINT AS n
    FROM l WHERE href LIKE '/%' AND href NOT LIKE '//%' GROUP BY ALL""")
def href_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of absolute-path links, fragments dropped, with how often a page has them."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(found).alias("href")).where("href like '/%' and href not like '//%'")
    target = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1), F.regexp_replace("href", "#.*$", ""))
    return links.select("page_id", target.alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, code, (CASE WHEN s % 10 = 0 THEN true ELSE false END) AS valid FROM (
    SELECT p_partkey, code, list_sum(list_transform(range(1, 14), lambda i: substr(code, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS s
    FROM (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') || (p_partkey % 10)::VARCHAR AS code FROM part))""")
def isbn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which 13-digit numbers made of part keys carry the right check digit."""
    code = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("valid", T.isbn13_valid(F.col("code")))


@query(f"""WITH {BLOCKS} SELECT n.page_id, n.ordinal::BIGINT AS ordinal, n.type, coalesce(string_agg(h.text, ' > ' ORDER BY h.ordinal), '') AS path FROM blocks n
    LEFT JOIN blocks h ON h.page_id = n.page_id AND h.level IS NOT NULL AND h.ordinal <= n.ordinal
        AND NOT EXISTS (SELECT 1 FROM blocks g WHERE g.page_id = n.page_id AND g.level <= h.level AND g.ordinal > h.ordinal AND g.ordinal <= n.ordinal)
    GROUP BY ALL""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings that each block of a page stands under, from the page's own headings."""
    blocks = written(page_source.page_blocks(table(spark, sf_dir, "pages")).drop("rows").withColumn("chars", F.length("text")))
    paths = outline.heading_paths(blocks, "page_id", "ordinal", "level", "text", "chars")
    typed = blocks.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "type")
    return typed.join(paths, ["page_id", "ordinal"]).select("page_id", "ordinal", "type", F.array_join("titles", " > ").alias("path"))


#: Lines of documents; a short one is a heading, of one of nine levels by its length.
SHORT, LEVELS = 60, 9
LINED = f"""n AS (SELECT doc_id, i - 1 AS ordinal, l[i] AS line, length(l[i]) AS chars, CASE WHEN length(l[i]) < {SHORT} THEN length(l[i]) % {LEVELS} + 1 END AS level
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def lined(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line")).withColumn("chars", F.length("line"))
    return rows.withColumn("level", F.when(F.col("chars") < SHORT, F.col("chars") % LEVELS + 1))


@query(f"""WITH {LINED}, s AS (SELECT doc_id, ordinal, level, (SELECT min(g.ordinal) FROM n g WHERE g.doc_id = h.doc_id AND g.ordinal > h.ordinal AND g.level <= h.level) AS stop FROM n h WHERE level IS NOT NULL)
    SELECT s.doc_id, s.ordinal::BIGINT AS start, s.level::INTEGER AS level, count(*)::BIGINT AS n_nodes, sum(n.chars)::BIGINT AS n_chars FROM s JOIN n ON n.doc_id = s.doc_id AND n.ordinal >= s.ordinal AND (s.stop IS NULL OR n.ordinal < s.stop) GROUP BY ALL""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and characters of each section under headings of nine levels, sub-sections included."""
    return outline.sections(lined(table(spark, sf_dir, "documents")), "doc_id", "ordinal", "level", "line", "chars").drop("title")


@query(f"""WITH {LINED} SELECT n.doc_id, n.ordinal::BIGINT AS ordinal, coalesce(string_agg(h.ordinal::VARCHAR, '/' ORDER BY h.ordinal), '') AS path FROM n
    LEFT JOIN n h ON h.doc_id = n.doc_id AND h.level IS NOT NULL AND h.ordinal <= n.ordinal AND NOT EXISTS (SELECT 1 FROM n g WHERE g.doc_id = n.doc_id AND g.level <= h.level AND g.ordinal > h.ordinal AND g.ordinal <= n.ordinal)
    GROUP BY ALL""")
def outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of nine levels that each line stands under, as their ordinals."""
    paths = outline.heading_paths(lined(table(spark, sf_dir, "documents")), "doc_id", "ordinal", "level", "line", "chars")
    return paths.select("doc_id", "ordinal", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))
