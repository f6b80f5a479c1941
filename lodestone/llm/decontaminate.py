"""Removal of benchmark passages from documents, by DataFrame functions alone.

A benchmark item is cut into windows of n words; an item of fewer words is one window. The
hashes of the windows are broadcast as a set, each document's windows are hashed word by
word and looked up in it, and what is found is verified against the window's words. The
verified places give spans to cut out, or documents to drop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters between words, after A-Z are lower-cased: all of ASCII but digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hashes that one broadcast set holds at most (some 30 bytes each); more take further passes.
SET_SIZE = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), SEPARATOR), "")


def _chained(array: str, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(array, at + i) for i in range(length)))


def windows(items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Every window of every item: item (its id), size (number of words), hash, gram (the words).

    Items without words have none. Rows of one id add up to one item. A null id is an item
    that can hit words but is not named among the items.
    """
    cut = items.select(items[item_id].alias("item"), words(items[text]).alias("w")).where("size(w) > 0")
    cut = cut.withColumn("size", F.least(F.lit(n), F.size("w")))
    cut = cut.select("item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    hashed = reduce(lambda out, k: out.when(F.col("size") == k, _chained("w", F.col("at"), k)), range(2, n + 1), F.when(F.col("size") == 1, _chained("w", F.col("at"), 1)))
    return cut.select("item", "size", hashed.alias("hash"), F.slice("w", F.col("at") + 1, F.col("size")).alias("gram")).distinct()


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def occurrences(spark: SparkSession, docs: DataFrame, grams: DataFrame, n: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Verified places of windows in documents: id, text_key (md5 of the text), at (word, from 0), size, gram.

    `grams` is what windows() gives. Equal rows of documents give their places once. The set
    of hashes goes to every executor, in as many parts as its measured size asks for, each
    with a scan of its own; the windows' words meet only what was found, by an equi-join
    whose larger side adaptive execution may split where one passage is everywhere.
    """
    stats = grams.agg(F.approx_count_distinct("hash", 0.02).alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(stats["sizes"])  # at most n numbers
    passes = max(1, -(-int(stats["n"] * 1.1) // SET_SIZE))
    hashes = grams.select("hash").distinct()
    cut = docs.select(docs[id_col].alias("id"), docs[text].alias("text"), words(docs[text]).alias("w")).where("size(w) > 0")
    found = []
    placed = cut.select("id", "text", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at")) if sizes else None
    if len(sizes) == 1:
        placed = placed.select("*", F.lit(sizes[0]).alias("size"), _chained("w", F.col("at"), sizes[0]).alias("hash"))
    elif sizes:
        each = F.array(*(F.struct(F.lit(k).alias("size"), _chained("w", F.col("at"), k).alias("hash")) for k in sizes))
        placed = placed.select("id", "text", "w", "at", F.inline(each))
    for k in range(passes if sizes else 0):
        part = hashes if passes == 1 else hashes.where(F.pmod("hash", F.lit(passes)) == k)
        hit = placed.where("at + size <= size(w)").join(F.broadcast(part), "hash", "left_semi")
        found.append(hit.select("id", _text_key(F.col("text")).alias("text_key"), "at", "size", "hash", F.slice("w", F.col("at") + 1, F.col("size")).alias("gram")))
    if not found:
        return cut.where("false").select("id", F.lit("").alias("text_key"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.col("w").alias("gram"))
    unique = grams.select("hash", "gram").distinct()
    verified = reduce(DataFrame.unionAll, found).join(unique, ["hash", "gram"], "left_semi")
    return verified.select("id", "text_key", "at", "size", "gram").distinct()


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Each document with what it shares with the items: id_col, n_words, n_hit, spans, items, clean, contaminated.

    spans are the maximal runs of hit words as (start, end), end excluded; items the ids, as
    sorted strings, of items with a window in the document; clean is the text without the
    words of spans and what stands before each within its span (null stays null).
    contaminated means that a word is hit: drop such documents, or take clean.

    A null or empty text, or one without words, has no words and is clean. Null ids and
    repeated rows stay as they are, one row each. Without items every document is clean. An
    empty table gives an empty table; other columns are not carried and may have any name. A
    text may be of any length: its windows are rows of a stream, only its places are grouped.
    """
    grams = windows(items, n, item_text, item_id)
    places = stored(occurrences(spark, docs, grams, n, text, id_col))
    key = ["id", "text_key"]
    runs = _runs(places.select(*key, "at", (F.col("at") + F.col("size")).alias("end")), key)
    named = grams.where("item IS NOT NULL").select("gram", F.col("item").cast("string").alias("item")).distinct()
    met = places.select(*key, "gram").distinct().join(named, "gram").select(*key, "item").distinct()
    both = runs.unionByName(met, allowMissingColumns=True)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    marks = both.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(span)).alias("spans"), F.array_sort(F.collect_list("item")).alias("items"))
    marks = marks.select(F.col("id").alias("id_"), F.col("text_key").alias("key_"), "n_hit", "spans", "items")
    base = docs.select(docs[id_col].alias("id"), docs[text].alias("text"), words(docs[text]).alias("w"))
    base = base.select("id", "text", _text_key(F.col("text")).alias("text_key"), F.size("w").cast("long").alias("n_words"))
    base = base.join(marks, (F.col("text_key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    out = base.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    out = out.withColumn("spans", F.coalesce("spans", empty)).withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("clean", F.when(F.col("contaminated"), _without("text", "spans")).otherwise(F.col("text"))).drop("text")


def _runs(places: DataFrame, key: list[str]) -> DataFrame:
    """Places that overlap or touch, as one run each."""
    order = Window.partitionBy(*key).orderBy("at", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = places.distinct().withColumn("first", F.coalesce((F.col("at") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("run", F.sum("first").over(order))
    return numbered.groupBy(*key, "run").agg(F.min("at").alias("start"), F.max("end").alias("end")).drop("run")


def _without(text: str, spans: str) -> Column:
    """The text less the words of spans: a piece is a word with what stands before it, or what stands last."""
    apart = r"\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
    pieces = f"regexp_extract_all({text}, '[{apart}]*[^{apart}]+|[{apart}]+', 0)"
    start, end = f"if(k = 0, 0, {spans}[k - 1].end)", f"if(k = size({spans}), size(p), {spans}[k].start)"
    # the pieces are bound to p, so that they are found once
    return F.expr(f"transform(array({pieces}), p -> array_join(flatten(transform(sequence(0, size({spans})), k -> slice(p, {start} + 1, {end} - {start}))), ''))[0]")
