"""A stored positional inverted index, and ranked search that reads nothing but it.

A block is a run of units (chunks, documents) in the order of their ids. For each term of a
block there is one row: the units that have it and their places in them, both as gaps, with
the weight of a place's field (A for headings, B for the body), the score that the term
gives each unit, and the largest of these. Rows lie in folders by a hash of the term, sorted by term
within files, so that a search reads the folders and row groups of its terms. A frequent
term has many rows, in several files: Spark deals out anew what is too much for one task.

Search bounds each block's best score from the rows' small columns, ranks a few blocks of
each query, and then reads only blocks whose bound reaches the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import written

#: Units and words of a block, at most (a longer unit is a block of its own).
BLOCK_UNITS, BLOCK_WORDS = 1024, 2_000_000
#: Weights of fields A and B, in tenths, so that sums are whole numbers.
A, B = 10, 4
#: Blocks of each query that are ranked first, and queries that a task ranks together.
FIRST, TOGETHER = 4, 256
#: Terms of a query that a unit has to have before any places are read.
RAREST = 4
#: Rows of query terms that are sent to all executors; more are dealt out with the index.
BROADCAST = 1_000_000
#: So many terms are looked for in the files' statistics, beside the folders that all terms name.
LOOKED_UP = 1000
#: From this version on, a search without strict hits falls back to any of the words.
FALLBACK_FROM = "1.1.0"

ROW = "term string, block bigint, n_units int, best bigint, most int, strong int, units array<bigint>, scores array<int>, counts array<int>, places array<int>"


@dataclass(frozen=True)
class Index:
    """An index in a folder: rows in `path`/rows, its size and version in `path`/about."""

    path: str
    buckets: int
    version: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{ROW}, bucket int").parquet(f"{self.path}/rows")

    def rows_of(self, spark: SparkSession, terms: DataFrame) -> DataFrame:
        """Rows that may be of some terms (term, bucket): of their folders, and of their row groups if the terms are few."""
        rows = self.rows(spark)
        buckets = [x[0] for x in terms.select("bucket").distinct().collect()]  # at most 4096 numbers
        if len(buckets) < self.buckets:
            rows = rows.where(F.col("bucket").isin(buckets))
        few = terms.select("term").distinct().limit(LOOKED_UP + 1).collect()
        return rows.where(F.col("term").isin([x[0] for x in few])) if len(few) <= LOOKED_UP else rows

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def _sorted_starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys changes."""
    change = np.ones(len(keys[0]), bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def invert(units: np.ndarray, words: pa.Array, n_words: np.ndarray, n_heading: np.ndarray, block: int) -> pa.RecordBatch | None:
    """Rows of one block: words are those of all units, one after another."""
    if not len(words):
        return None
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    unit = np.repeat(np.arange(len(units)), n_words)
    place = np.arange(len(code)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    heading = place < n_heading[unit]
    order = np.argsort(code, kind="stable")  # within a term by unit and place, as they came
    code, unit, place, heading = code[order], unit[order], place[order] + 1, heading[order]
    each = _sorted_starts(code, unit)  # a term in a unit
    gap = place - np.concatenate(([0], place[:-1]))
    gap[each] = place[each]
    count = np.diff(np.append(each, len(code)))
    score = np.add.reduceat(np.where(heading, A, B), each)
    term = _sorted_starts(code[each])
    owner = units[unit[each]]
    unit_gap = owner - np.concatenate(([0], owner[:-1]))
    unit_gap[term] = owner[term]
    ends = np.append(term, len(each)).astype(np.int32)
    place_ends = np.append(each[term], len(code)).astype(np.int32)
    n = len(term)
    columns = [
        coded.dictionary.take(pa.array(code[each][term])),
        pa.array(np.full(n, block)),
        pa.array(np.diff(ends).astype(np.int32)),
        pa.array(np.maximum.reduceat(score, term).astype(np.int64)),
        pa.array(np.maximum.reduceat(count, term).astype(np.int32)),
        pa.array(np.where(np.logical_or.reduceat(heading, each[term]), A, B).astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(unit_gap)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(score.astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(place_ends), pa.array((gap * 2 + heading).astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROW.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], most_units: int, most_words: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    units = words = 0
    number = TaskContext.get().partitionId() << 32

    def out():
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["words"].combine_chunks() if table.num_rows else None
        if lists is not None:
            yield invert(table["unit"].to_numpy(), lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64), table["n_heading"].to_numpy(), number)

    for batch in batches:
        start = 0
        sizes = np.asarray(batch.column(1).value_lengths())
        for i, size in enumerate(sizes):
            if units and (units == most_units or words + size > most_words):
                held.append(batch.slice(start, i - start))
                yield from (x for x in out() if x is not None)
                held, start, units, words, number = [], i, 0, 0, number + 1
            units, words = units + 1, words + int(size)
        held.append(batch.slice(start))
    if units:
        yield from (x for x in out() if x is not None)


def build(units: DataFrame, path: str, version: str = FALLBACK_FROM, unit: str = "unit", heading: str = "heading", body: str = "body", block_units: int = BLOCK_UNITS, block_words: int = BLOCK_WORDS) -> Index:
    """Writes the index of units (a whole-number id each, no two alike, null ids left out) into a new folder.

    Units are numbered by nothing: their ids are sorted within the partitions they come in,
    so that a task that is run again makes the same blocks.
    """
    spark = units.sparkSession
    of = units.where(units[unit].isNotNull()).select(units[unit].cast("long").alias("unit"), F.coalesce(units[heading], F.lit("")).alias("heading"), F.coalesce(units[body], F.lit("")).alias("body"))
    n = of.count()
    index = Index(path, min(4096, max(8, n // 20_000)), version)
    cut = of.sortWithinPartitions("unit").select("unit", F.concat(T.words(F.col("heading")), T.words(F.col("body"))).alias("words"), F.size(T.words(F.col("heading"))).alias("n_heading"))
    rows = cut.mapInArrow(lambda batches: _blocks(batches, block_units, block_words), ROW).withColumn("bucket", index.bucket(F.col("term")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(index.buckets, version, n)], "buckets int, version string, units long").coalesce(1).write.parquet(f"{path}/about")
    return index


def load(spark: SparkSession, path: str) -> Index:
    """The index that build() wrote into a folder."""
    about = spark.read.parquet(f"{path}/about").first()
    return Index(path, about["buckets"], about["version"])


def frequencies(spark: SparkSession, index: Index) -> DataFrame:
    """term, df, tf, in_headings: from the index, without the documents."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = index.rows(spark).select("term", "n_units", total.alias("n"), F.size(F.filter("places", lambda x: x % 2 == 1)).alias("headed"))
    return rows.groupBy("term").agg(F.sum("n_units").alias("df"), F.sum("n").alias("tf"), F.sum("headed").alias("in_headings"))


def _meet(rows: DataFrame, terms: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Rows of the index with what asks for them; many askers of one term are met block by block."""
    if small:
        return rows.join(F.broadcast(terms), on)
    salt = F.explode(F.sequence(F.lit(0), F.lit(15)))
    return rows.withColumn("salt", F.pmod("block", F.lit(16)).cast("int")).join(terms.withColumn("salt", salt), [*on, "salt"]).drop("salt")


def _places(gaps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 1) and their weights, for units one after another."""
    step, weight = gaps >> 1, np.where(gaps & 1, A, B)
    run = np.cumsum(step)
    starts = np.cumsum(counts) - counts
    return run - np.repeat(run[starts] - step[starts], counts), weight


def cover_density(at: np.ndarray, weight: np.ndarray, term: np.ndarray, n_terms: int) -> float:
    """Sum over the minimal covers of all terms: the harmonic mean of the weights in one, by its other words and 1."""
    order = np.argsort(at, kind="stable")
    at, weight, term = at[order].tolist(), weight[order].tolist(), term[order].tolist()
    last: dict[int, int] = {}
    total, before = 0.0, -1
    for end, t in enumerate(term):
        last[t] = end
        if len(last) == n_terms and (begin := min(last.values())) > before:
            inside = end - begin + 1
            noise = at[end] - at[begin] - (end - begin)
            total += inside / sum(10 / w for w in weight[begin : end + 1]) / (1 + noise)
            before = begin
    return total


#: Columns that a search for all terms, or for any, reads.
_NEEDED = {True: ("units", "counts", "places"), False: ("units", "scores")}


def _ranker(k: int, every: bool):
    """Ranks the units of a block for some queries: those with every term by cover density, or with any by summed weights."""

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        postings = {}
        for term, units, *rest in zip(rows["term"].to_pylist(), rows["units"], *(rows[c] for c in _NEEDED[every][1:]), strict=True):
            postings[term] = (np.cumsum(np.asarray(units.values)), *(np.asarray(x.values) for x in rest))
        wanted: dict = {}
        for q, term in zip(asked["q"].to_pylist(), asked["term"].to_pylist(), strict=True):
            wanted.setdefault(q, []).append(term)
        out_q, out_unit, out_score = [], [], []
        for q, terms in wanted.items():
            have = [postings[t] for t in terms if t in postings]
            if not have or (every and len(have) < len(terms)):
                continue
            if every:
                common = have[0][0]
                for units, _, _ in have[1:]:
                    common = common[np.isin(common, units, assume_unique=True)]
                if not len(common):
                    continue
                parts = []
                for t, (units, counts, gaps) in enumerate(have):
                    at, weight = _places(gaps, counts)
                    owner = np.repeat(units, counts)
                    keep = np.isin(owner, common)
                    parts.append((owner[keep], at[keep], weight[keep], np.full(int(keep.sum()), t)))
                owner, at, weight, term = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], common)
                found = common
                score = np.array([cover_density(at[s], weight[s], term[s], len(terms)) for s in np.split(order, cuts[1:])])
            else:
                owner = np.concatenate([units for units, _ in have])
                weight = np.concatenate([scores for _, scores in have])
                found, at = np.unique(owner, return_inverse=True)
                score = np.bincount(at, weight) / 10
            score = np.round(score, 9)
            first = np.lexsort((found, -score))[:k]
            out_q += [q] * len(first)
            out_unit.append(found[first])
            out_score.append(score[first])
        units = np.concatenate(out_unit) if out_unit else np.zeros(0, np.int64)
        scores = np.concatenate(out_score) if out_score else np.zeros(0)
        return pa.table({"q": pa.array(out_q, asked["q"].type), "unit": pa.array(units, pa.int64()), "s": pa.array(scores, pa.float64())})

    return run


def _meeting(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Queries of a block for which one of its units has all the terms asked for."""
    units = {t: np.cumsum(np.asarray(u.values)) for t, u in zip(rows["term"].to_pylist(), rows["units"], strict=True)}
    wanted: dict = {}
    for q, term in zip(asked["q"].to_pylist(), asked["term"].to_pylist(), strict=True):
        wanted.setdefault(q, []).append(units.get(term, np.zeros(0, np.int64)))
    out = []
    for q, lists in wanted.items():
        common = lists[0]
        for other in lists[1:]:
            common = common[np.isin(common, other, assume_unique=True)]
        if len(common):
            out.append(q)
    return pa.table({"q": pa.array(out, asked["q"].type), "block": pa.array([key[0].as_py()] * len(out), pa.int64())})


def _tasks(spark: SparkSession, index: Index, blocks: DataFrame, terms: DataFrame, columns: tuple[str, ...]):
    """The index's rows for each (q, block) asked for, grouped with the queries that ask: a block and up to TOGETHER queries a task."""
    share = F.pmod(F.xxhash64("q"), F.lit(-(-terms.select("q").distinct().count() // TOGETHER) or 1)).cast("int")
    asked = blocks.join(terms, "q").select("q", "term", "bucket", "block", share.alias("share"))
    needed = written(asked.select("bucket", "term", "block", "share").distinct())
    needed = F.broadcast(needed) if needed.count() <= BROADCAST // 4 else needed
    rows = index.rows_of(spark, terms).select("bucket", "term", "block", *columns).join(needed, ["bucket", "term", "block"])
    asks = asked.select("q", "term", F.col("block").alias("block_"), F.col("share").alias("share_"))
    return rows.groupBy("block", "share").cogroup(asks.groupBy("block_", "share_"))


def _rank(spark: SparkSession, index: Index, blocks: DataFrame, terms: DataFrame, k: int, every: bool) -> DataFrame:
    """The first k units of each (q, block) asked for: q, unit, s."""
    return _tasks(spark, index, blocks, terms, _NEEDED[every]).applyInArrow(_ranker(k, every), f"q {dict(terms.dtypes)['q']}, unit bigint, s double")


def _with_rarest(spark: SparkSession, index: Index, bounds: DataFrame, terms: DataFrame, about: DataFrame) -> DataFrame:
    """Blocks in which some unit has the RAREST terms of the query: units are compared, places aren't read."""
    n = about.groupBy("term").agg(F.sum("n_units").alias("n"))
    rare = Window.partitionBy("q").orderBy("n", "term")
    few = written(terms.join(n, "term").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= RAREST).select("q", "term", "bucket"))
    met = _tasks(spark, index, bounds.select("q", "block"), few, ("units",)).applyInArrow(_meeting, f"q {dict(terms.dtypes)['q']}, block bigint")
    return bounds.join(met, ["q", "block"], "left_semi")


def top(spark: SparkSession, index: Index, queries: DataFrame, k: int, every: bool) -> DataFrame:
    """The k best units of each query (q, terms: distinct words) with every term, or with any: q, unit, s, rank.

    s is the cover density, or the sum of the weights of the terms' places; ties to the
    smaller unit. A block is read if the bound of its best score, from the largest score
    (or number of places) of each term in it, reaches the k-th score of the blocks with the
    highest bounds; where every term is asked for, if one of its units has the rarest of them.
    Both forms are exact.
    """
    terms = written(queries.select("q", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).withColumn("bucket", index.bucket(F.col("term"))))
    small = terms.count() <= BROADCAST
    about = index.rows_of(spark, terms).select("bucket", "term", "block", "n_units", "best", "most", "strong")
    met = _meet(about, terms, ["bucket", "term"], small)
    if every:
        met = met.groupBy("q", "block", "n_terms").agg(F.count("*").alias("n"), (F.sum("most") * F.max("strong") / 10).alias("bound")).where("n = n_terms")
    else:
        met = met.groupBy("q", "block").agg((F.sum("best") / 10).alias("bound"))
    bounds = written(met.select("q", "block", "bound"))
    if every:
        bounds = written(_with_rarest(spark, index, bounds, terms, about))
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= FIRST).select("q", "block")
    ranks = Window.partitionBy("q").orderBy(F.desc("s"), "unit")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    begun = written(ranked(_rank(spark, index, first, terms, k, every)))
    least = begun.where(F.col("rank") == k).select("q", F.col("s").alias("least"))
    rest = bounds.join(first, ["q", "block"], "left_anti").join(least, "q", "left").where("least IS NULL OR bound >= least - 1e-9")
    more = _rank(spark, index, rest.select("q", "block"), terms, k, every)
    return ranked(begun.drop("rank").unionByName(more))


def search(spark: SparkSession, index: Index, queries: DataFrame, query_id: str, text: str, k: int = 40) -> DataFrame:
    """Units with all words of a query; where none has, with any of its first 12 longer words.

    query_id, unit, rank, score (in 0 to 1: s / (s + 1)), strategy (strict or or_fallback).
    The second search is left out for an index of a version before FALLBACK_FROM. A query
    without words finds nothing. Everything comes from the index.
    """
    asked = written(queries.select(F.col(query_id).alias("q"), F.array_distinct(T.words(F.col(text))).alias("terms"), T.any_terms(F.col(text)).alias("few")).where("size(terms) > 0"))
    strict = written(top(spark, index, asked.select("q", "terms"), k, every=True))
    found = strict.withColumn("strategy", F.lit("strict"))
    early = spark.range(1).select(T.version_before(F.lit(index.version), FALLBACK_FROM)).first()[0]
    if not early:
        missed = asked.join(strict.select("q").distinct(), "q", "left_anti").select("q", F.col("few").alias("terms"))
        found = found.unionByName(top(spark, index, missed, k, every=False).withColumn("strategy", F.lit("or_fallback")))
    return found.select(F.col("q").alias(query_id), "unit", "rank", F.round(F.col("s") / (F.col("s") + 1), 9).alias("score"), "strategy")
