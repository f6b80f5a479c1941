"""How far the sources of a language are apart in their words, by whole-number arithmetic.

Every source of a language is a sorted array of (term id, count), cut into blocks of terms.
A task holds a block of two stripes of sources and merges each unordered pair of arrays: a
galloping intersection prices what both have, the rest of either is priced against the
other's absent term, and what neither has is priced once for the pair.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: A term counts in a language if so many of its documents have it.
LEAST_DOCS = 30
#: Shares are whole parts of SCALE; SMOOTH is added to each count.
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms of a block and sources of a stripe, about: what one task holds at a time.
BLOCK, STRIPE = 8192, 64
#: Counts that a counting task holds before it gives them out.
HELD = 400_000
#: A-Z become a-z, all other ASCII but letters becomes a space, the rest stays.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_LETTERS).split()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents of the group that have it).

    Every group has one more row, of a null term with n 0. Tasks add up what they read.
    """
    base = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out():
            for (of_lang, of_source), (n, d) in held.items():
                terms = list(n)
                columns = [pa.array([of_lang] * len(terms)), pa.array([of_source] * len(terms)), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for of_lang, of_source, body in zip(langs, sources, texts, strict=True):
                if (of := held.get((of_lang, of_source))) is None:
                    of = held[of_lang, of_source] = (Counter({None: 0}), Counter())
                terms = terms_of(body.as_py())
                size -= len(of[0])
                of[0].update(terms)
                of[1].update(set(terms))
                size += len(of[0])
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return base.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counted: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts of terms that least_docs documents of their language have: lang, source, term, n, lang_n, id.

    lang_n is the term's count in the language. Terms are numbered by their place in the
    sorted rows of a task: one number for all rows of a term, no two terms share one.
    """
    term = Window.partitionBy("lang", "term")
    summed = counted.where("term IS NOT NULL").withColumn("in_lang", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
    placed = summed.withColumn("place", F.monotonically_increasing_id())
    return placed.withColumn("id", F.min("place").over(term)).where(F.col("in_lang") >= least_docs).select("lang", "source", "term", "n", "lang_n", "id")


def share(count, size):
    """1 + floor(SCALE * (count + SMOOTH) / size) of int64 arrays, exact for size below 9e15."""
    digits, rest = np.zeros_like(count), count + SMOOTH
    for _ in range(3):  # SCALE is 1000 three times
        rest = rest * 1000
        digits = digits * 1000 + rest // size
        rest = rest % size
    return digits + 1


def meet(few: np.ndarray, many: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in few and in many of what both sorted arrays have, galloping through many.

    For each run of `step` of the few, strides through the many double until they pass the
    run; the run is then searched for in the last stretch alone.
    """
    at_few, at_many, low = [], [], 0
    for start in range(0, len(few), step):
        run = few[start : start + step]
        stride, high = step, low
        while high < len(many) and many[high] <= run[-1]:
            high += stride
            stride *= 2
        stretch = many[low:high]
        place = np.searchsorted(stretch, run)
        same = place < len(stretch)
        same[same] = stretch[place[same]] == run[same]
        at_few.append(start + np.flatnonzero(same))
        at_many.append(low + place[same])
        low += int(place[-1])
    return (np.concatenate(at_few), np.concatenate(at_many)) if at_few else (np.zeros(0, int), np.zeros(0, int))


def priced(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int]:
    """Sum of |p - q| over the terms that a or b has, and how many; both are (ids, shares, share of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    i, j = meet(a[0], b[0])
    both = int(np.abs(a[1][i] - b[1][j]).sum())
    one_sided = 0
    for (_, own, _), (_, _, absent), hit in ((a, b, i), (b, a, j)):
        apart = np.abs(own - absent)
        one_sided += int(apart.sum()) - int(apart[hit].sum())
    return both + one_sided, len(a[0]) + len(b[0]) - len(i)


def _pair_task(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Unordered pairs of a source of the left stripe with one of the right: value and number of terms either has, in this block."""

    def arrays(side: pa.Table):
        out = []
        for source, size, terms in zip(side["source"].to_pylist(), side["size"].to_pylist(), side["terms"], strict=True):
            flat = terms.values
            ids, n = np.asarray(flat.field("id")), np.asarray(flat.field("n"))
            absent = int(share(np.zeros(1, np.int64), size)[0]) if size else 0
            out.append((source, (ids, share(n, size), absent)))
        return out

    lang, _, first, second = (x.as_py() for x in key)
    rows = [(lang, x, y, *priced(a, b)) for x, a in arrays(left) for y, b in arrays(right) if first != second or x < y]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("lang", "x", "y", "value", "terms"), columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)})


def _scalars(kept: DataFrame, counted: DataFrame) -> DataFrame:
    """Every group that occurs: lang, source, size (N + 5 V; 0 without kept terms), lang_size, vocabulary, number, stripes."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("vocabulary"))
    groups = counted.where("term IS NULL").select("lang", "source")
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "vocabulary"])
    lang = Window.partitionBy("lang")
    groups = groups.withColumn("lang_size", F.sum("total").over(lang) + SMOOTH * F.col("vocabulary")).withColumn("size", F.col("total") + SMOOTH * F.col("vocabulary"))
    groups = groups.withColumn("stripe", F.floor((F.row_number().over(lang.orderBy("source")) - 1) / STRIPE).cast("int"))
    return groups.withColumn("stripes", F.max("stripe").over(lang) + 1)


def _share(count: str, size: str):
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(38, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(28, 0)) div CAST({size} AS DECIMAL(38, 0))")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, x, y, value for every unordered pair of sources of a language (x < y)."""
    blocks = max(1, -(-(kept.select("id").distinct().count()) // BLOCK))
    entries = kept.select("lang", "source", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.struct("id", "n").alias("term"))
    # each group has a row in each block, so that no pair is missing from any
    roster = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "size", "stripe", "stripes")
    arrays = entries.unionByName(roster, allowMissingColumns=True).groupBy("lang", "source", "block").agg(
        F.array_sort(F.collect_list("term")).alias("terms"), F.max("size").alias("size"), F.max("stripe").alias("stripe"), F.max("stripes").alias("stripes")
    )
    common = ("lang", "block", "source", "size", "terms")
    left = arrays.withColumn("second", F.explode(F.sequence(F.col("stripe"), F.col("stripes") - 1))).select(*common, F.col("stripe").alias("first"), "second")
    right = arrays.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("stripe")))).select(*common, "first", F.col("stripe").alias("second"))
    task = ("lang", "block", "first", "second")
    merged = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_pair_task, "lang string, x string, y string, value bigint, terms bigint")
    merged = merged.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    for name in ("x", "y"):
        absent = F.when(F.col("size") > 0, _absent("size")).otherwise(0)
        side = groups.select("lang", F.col("source").alias(name), absent.cast("long").alias(f"absent_{name}"), *(["vocabulary"] if name == "x" else []))
        merged = merged.join(side, ["lang", name])
    value = F.col("value") + (F.col("vocabulary") - F.col("terms")) * F.abs(F.col("absent_x") - F.col("absent_y"))
    return merged.select("lang", "x", "y", F.when(F.col("vocabulary") > 0, value).otherwise(0).cast("long").alias("value"))


def _absent(size: str):
    return F.expr(f"1 + {SCALE * SMOOTH} div {size}")


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source of the language is
    (part pair), and the terms that a source has more of than its language (part term, up to rank `top`).

    Null text, lang or source is an empty string; a language without kept terms has pairs of
    value 0. Ranks go by value, then by the item's UTF-8. Repeated rows count each. An empty
    table gives an empty table; other columns may have any name. Of a text of any length its
    unlike terms are held, of a pair of stripes a block of terms. Exact for languages of
    fewer than 9e15 terms.
    """
    counted = stored(counts(docs, text, lang, source))
    kept = stored(kept_terms(counted, least_docs))
    groups = stored(_scalars(kept, counted))
    unordered = pairs(kept, groups)
    both = unordered.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("way"), "value")
    both = both.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(of_group))
    # the sizes of groups are bounded by what is broadcast only where Spark finds them small
    terms = kept.join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
    terms = terms.withColumn("p", _share("n", "size")).withColumn("q", _share("lang_n", "lang_size")).where("p > q AND n > 0")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(of_group)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
