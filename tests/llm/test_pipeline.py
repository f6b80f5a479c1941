"""The pipeline's stages against brute force on the smallest tables."""

from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from lodestone.llm import common, quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_operators import brute_groups, brute_repeats

DATA = "/root/testdata/sf0.001"
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    want = {r["doc_id"]: r for r in docs.collect() if quality.measure(r["text"], compress)[6]}
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["quality rules"](spark, docs, DATA).cache()
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: r["text"] for i, r in want.items()}

    docs = stages["language ID"](spark, docs, DATA).cache()
    assert {r["doc_id"] for r in docs.collect()} == set(want)  # all of them are prose in one of four languages

    docs = stages["MinHash near-dedup"](spark, docs, DATA).cache()
    groups = brute_groups([(i, r["text"]) for i, r in want.items()])
    want = {i: r for i, r in want.items() if groups[i] == i}
    assert {r["doc_id"] for r in docs.collect()} == set(want)

    docs = stages["suffix-array dedup"](spark, docs, DATA).cache()
    left = {i: x[3].decode("utf-8", "ignore") for i, x in brute_repeats([(i, r["text"].encode()) for i, r in want.items()], 50).items()}
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == left
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == want[r["doc_id"]]["source"] for r in got)

    pieces = stages["best-fit packing"](spark, docs, DATA).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    sums: dict = {}
    for p in pieces:
        sums[p["doc_id"]] = sums.get(p["doc_id"], 0) + p["length"]
    assert sums == tokens
    ends: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= np.ceil(sum(tokens.values()) / 4096) + 1


def test_replacement_characters_of_the_input_stay(spark):
    shared = "passage that both of the documents have, é and all of it, é"
    rows = [(1, "\ufffd first \ufffd" + shared + "€"), (2, "a \ufffd b\ufffd" + shared + "₭ \ufffd end"), (3, "alone \ufffd")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, DATA).collect()}
    # the run takes the last bytes before it and the first of the sign after it, which are equal in both
    assert {i: r["text"] for i, r in got.items()} == {1: rows[0][1], 2: "a \ufffd b \ufffd end", 3: rows[2][1]}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_oracle_only_where_sql_can():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5 and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_stages_send_small_batches(spark):
    """Also where texts are long: Spark's own limits let 3,000 of these, 24 MB, go to Python at once."""
    spark.conf.unset(LIMIT)
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1600).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(8000).cast("long").alias("n_chars"))
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            spark.conf.unset(LIMIT)
            stage(spark, docs, DATA)
            sizes = docs.select("text").mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([x.nbytes])}) for x in batches), "n long").collect()
            assert len(sizes) > 4 and max(r["n"] for r in sizes) < 2 * common.BATCH_BYTES
        # a limit that the session names stays
        spark.conf.set(LIMIT, "1000000")
        common.in_small_batches(spark)
        assert spark.conf.get(LIMIT) == "1000000"
    finally:
        spark.conf.unset(LIMIT)
