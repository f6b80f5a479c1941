"""How filters over documents interact: what each removes, alone, in every order, and on average.

A row's failures are a number with a bit for each filter. Four filters judge a text alone;
the fifth fails a copy of an earlier document's text, which a left-semi join finds. Rows are
counted by their bits, and everything asked for follows from those few counts.
"""

from __future__ import annotations

import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Short texts, texts of repeated words, of capitals, with symbols, copies of earlier ones.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_UNLIKE, MOST_CAPITALS = 200, 50, 3
_SYMBOL = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
#: Bytes of UTF-8 that begin no code point.
_CONTINUED = bytes(range(0x80, 0xC0))
#: Up to so many hashes of repeated texts (some 30 bytes each) are sent to all executors.
BROADCAST_HASHES = 1_000_000
#: Copies of one hash that meet in a task, more where over MOST_LARGE hashes would have to be dealt out.
COPIES_A_TASK, MOST_LARGE = 256, 100_000


def failures_of(text: bytes) -> int:
    """Bits of A to D for one text in UTF-8."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_UNLIKE * len(words)) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (_SYMBOL.search(text) is not None) << 3


def copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, text_key) whose whole text a row of smaller id has too; null texts count as empty.

    A row meets one row for each unlike text of its hash: the smallest id that has the text,
    found before the shuffle in part. So a group of n copies gives n rows. A large one is
    dealt to several tasks, each of which gets that smallest id. Texts whose hash no other id
    shares are left out before they are shuffled, if the hashes that are shared are few
    enough to be sent to all. Null ids are no copies and have none.
    """
    keyed = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    shared = keyed.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("hash", "n")
    shared = stored(shared)
    hashes, rows = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if hashes <= BROADCAST_HASHES:
        keyed = keyed.join(F.broadcast(shared), "hash", "left_semi")
    each = max(COPIES_A_TASK, -(-rows // MOST_LARGE))
    large = shared.where(F.col("n") > each).select("hash", F.ceil(F.col("n") / each).cast("int").alias("shares"))  # at most MOST_LARGE rows
    keyed = keyed.join(F.broadcast(large), "hash", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    first = keyed.groupBy("hash", "text").agg(F.min("id").alias("low"), F.first("shares").alias("shares"))
    first = first.select(F.col("hash").alias("hash_"), F.col("text").alias("text_"), "low", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share_"))
    keyed = keyed.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    same = (F.col("hash") == F.col("hash_")) & (F.col("share") == F.col("share_")) & (F.col("text") == F.col("text_"))
    return keyed.join(first, same & (F.col("low") < F.col("id")), "left_semi").select("id", _text_key("text").alias("text_key"))


def _text_key(text: str):
    return F.md5(F.col(text).cast("binary"))


def failures(docs: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """Rows of documents counted by id, part and bits: id, part, bits, n.

    Ids of copies are put beside the rows that each text's own failures give, and the two
    are summed by row: equal rows count as often as they occur.
    """
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text"))
    base = base.select("id", "part", _text_key("text").alias("text_key"), "text")

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "part": batch.column(1), "text_key": batch.column(2), "bits": [failures_of(x) for x in batch.column(3).cast(pa.binary()).to_pylist()]}

    kind = dict(base.dtypes)["id"]
    own = map_rows(base, run, f"id {kind}, part string, text_key string, bits int")
    own = own.groupBy("id", "text_key", "part").agg(F.first("bits").alias("bits"), F.count("*").alias("n"))
    # a copy has no part of its own: it marks all rows of its id and text
    marks = copies(docs, text, id_col).distinct().select("id", "text_key", F.lit(None).cast("string").alias("part"), F.lit(1 << 4).alias("bits"), F.lit(0).cast("long").alias("n"))
    rows = own.unionByName(marks).groupBy("id", "text_key").agg(F.bit_or("bits").alias("bits"), F.collect_list(F.when(F.col("n") > 0, F.struct("part", "n"))).alias("rows"))
    return rows.select("id", "bits", F.inline("rows"))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley; zeros included.

    labels has doc_id, quality, toxic; a document is good (toxic) if any of its labels says so.

    A null text is an empty one, a null part an empty string. Repeated rows count each; a
    row is no copy of one with its own id. Null ids take no part in copies and have no labels.
    An empty table gives an empty table. Columns not named here may have any name.
    """
    counted = failures(docs, text, id_col, part)
    marked = labels.groupBy(labels["doc_id"].alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = counted.join(marked, F.col("id") == F.col("label_id"), "left")
    by_bits = rows.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    # a filter after a set of others, whichever their order: 5 x 16 states
    states = by_bits.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(4))))
    bit = F.expr("shiftleft(1, filter)")
    states = states.where(F.col("before").bitwiseAND(bit) == 0)
    fails = F.col("bits").bitwiseAND(bit) != 0
    comes = F.col("bits").bitwiseAND(F.col("before")) == 0
    total = lambda which, what="n": F.sum(F.when(which, F.col(what)).otherwise(0))
    states = states.groupBy("part", "before", "filter").agg(
        total(comes & ~fails).alias("kept"), total(comes & fails).alias("removed"), total(~comes & fails).alias("redundant"), total(F.col("bits") == bit).alias("unique_fails"),
        total(comes & fails, "good").alias("good_lost"), total(comes & fails, "toxic").alias("toxic_lost"),
    )
    steps = [("".join(order), k + 1, FILTERS.index(x), sum(1 << FILTERS.index(y) for y in order[:k])) for order in permutations(FILTERS) for k, x in enumerate(order)]
    table = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    out = states.join(F.broadcast(table), ["filter", "before"])  # 600 rows, whatever the input
    shapley = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))
