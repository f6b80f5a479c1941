"""Outlines against a plain stack, whatever the parts that documents are cut into."""

import random

import pytest
from lodestone.operators import outline
from pyspark.sql import functions as F

SCHEMA = "doc string, ordinal int, level int, title string, chars int"


def nodes(seed=3):
    r = random.Random(seed)
    rows = []
    for d in range(12):
        n = r.choice([0, 1, 2, 40, 200])
        rows += [(f"d{d}" if d else None, i * r.choice([1, 1, 1]), r.choice([None, None, 1, 2, 3, 7, 9, -2]) if d % 4 else None, f"t{i}", r.choice([0, 5, 9, None])) for i in range(n)]
    return rows


def walked(rows):
    paths, done, docs = set(), set(), {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    for doc, own in docs.items():
        stack, own = [], sorted(own, key=lambda r: r[1])
        for i, (_, ordinal, level, title, _) in enumerate(own):
            if level is not None:
                stack = [h for h in stack if h[1] < level] + [(ordinal, level, title)]
                stop = next((j for j in range(i + 1, len(own)) if own[j][2] is not None and own[j][2] <= level), len(own))
                done.add((doc, ordinal, level, title, stop - i, sum(r[4] or 0 for r in own[i:stop])))
            paths.add((doc, ordinal, tuple(h[0] for h in stack), tuple(h[2] for h in stack)))
    return paths, done


@pytest.mark.parametrize("part", [1, 3, 17, 20_000])
def test_against_a_stack(spark, part):
    rows = nodes()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("opened", F.lit("clash")).repartition(5)
    paths, done = walked(rows)
    got = outline.heading_paths(df, "doc", "ordinal", "level", "title", "chars", part).collect()
    assert len(got) == len(rows) and {(r["doc"], r["ordinal"], tuple(r["path"]), tuple(r["titles"])) for r in got} == paths
    found = outline.sections(df, "doc", "ordinal", "level", "title", "chars", part).collect()
    assert len(found) == len(done) and {tuple(r) for r in found} == done


def test_no_nodes(spark):
    df = spark.createDataFrame([("a", None, 1, "x", 1)], SCHEMA)
    assert outline.heading_paths(df, "doc", "ordinal", "level", "title", "chars").collect() == []
    assert outline.sections(df, "doc", "ordinal", "level", "title", "chars").collect() == []


def test_a_long_book_is_many_tasks(spark):
    df = spark.range(100_000).select(F.lit("book").alias("doc"), F.col("id").cast("int").alias("ordinal"), F.when(F.col("id") % 1000 == 0, F.when(F.col("id") == 0, 1).otherwise(2)).alias("level"), F.lit("t").alias("title"), F.lit(1).alias("chars"))
    got = outline.sections(df, "doc", "ordinal", "level", "title", "chars", 5000).collect()
    assert sorted((r["start"], r["n_nodes"]) for r in got) == [(0, 100_000), *((i, 1000) for i in range(1000, 100_000, 1000))]
