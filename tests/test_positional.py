"""The stored positional index: search through it against a plain scan, what it reads, what it keeps."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from lodestone.operators import positional as P
from lodestone.session import new_folder
from pyspark.sql import functions as F

VOCABULARY = [f"w{i}" for i in range(12)] + ["É", "ß2", "日本"]


def units(n, seed):
    r = random.Random(seed)
    text = lambda most: " ".join(r.choice(VOCABULARY[: r.randint(1, len(VOCABULARY))]) for _ in range(r.randint(0, most)))
    rows = [(7 * i - 50, text(4) if r.random() < 0.5 else None, text(25)) for i in range(n)]
    return rows + [(10_000, None, None), (10_001, "", "... "), (None, "w1", "w2 w3"), (2**62, "w1 w2", "w1, W2; w3!")]


def placed(row):
    heading, body = (((x or "").lower().replace(",", " ").replace(";", " ").replace("!", " ").replace(".", " ")).split() for x in row[1:])
    return [(i + 1, w, 1.0 if i < len(heading) else 0.4) for i, w in enumerate(heading + body)]


def density(places, terms):
    """Every window that has all terms and no smaller one within."""
    held = [p for p in places if p[1] in terms]
    windows = [(i, j) for i in range(len(held)) for j in range(i, len(held)) if {x[1] for x in held[i : j + 1]} == set(terms)]
    least = [(i, j) for i, j in windows if not any((a, b) != (i, j) and i <= a and b <= j for a, b in windows)]
    return sum((j - i + 1) / sum(1 / x[2] for x in held[i : j + 1]) / (1 + held[j][0] - held[i][0] - (j - i)) for i, j in least)


def scanned(rows, queries, k, every):
    out = {}
    for q, terms in queries:
        scores = []
        for row in rows:
            places = placed(row)
            have = {w for _, w, _ in places} & set(terms)
            if row[0] is not None and (have == set(terms) if every else have):
                s = density(places, terms) if every else sum(w for _, t, w in places if t in terms)
                scores.append((-round(s, 9), row[0]))
        out.update({(q, i + 1): (unit, -s) for i, (s, unit) in enumerate(sorted(scores)[:k])})
    return out


def queries():
    r = random.Random(4)
    return [(i, sorted({r.choice([*VOCABULARY, "absent"]).lower() for _ in range(r.choice([1, 1, 2, 3, 5]))})) for i in range(25)]


@pytest.fixture(scope="module")
def table(spark):
    rows = units(300, 1)
    df = spark.createDataFrame(rows, "unit long, heading string, body string").withColumn("block", F.lit("clash")).withColumn("term", F.lit("clash"))
    return rows, df.repartition(3)


@pytest.mark.parametrize("block, k, few", [(5, 3, 10**6), (5, 1000, 10**6), (1024, 4, 10**6), (3, 2, 0)])
def test_search_equals_a_scan(spark, table, monkeypatch, block, k, few):
    monkeypatch.setattr(P, "BROADCAST", few)
    rows, df = table
    index = P.build(df, new_folder(spark), block_units=block)
    asked = queries()
    q = spark.createDataFrame(asked, "q long, terms array<string>")
    for every in (True, False):
        got = {(x["q"], x["rank"]): (x["unit"], x["s"]) for x in P.top(spark, index, q, k, every).collect()}
        want = scanned(rows, asked, k, every)
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)


def test_index_is_kept_whole(spark, table):
    rows, df = table
    index = P.build(df, new_folder(spark), block_units=7, block_words=40)
    assert P.load(spark, index.path) == index
    df_, tf, headed = Counter(), Counter(), Counter()
    for row in rows:
        if row[0] is not None:
            tf.update(w for _, w, _ in placed(row))
            df_.update({w for _, w, _ in placed(row)})
            headed.update(w for _, w, x in placed(row) if x == 1.0)
    assert {tuple(x) for x in P.frequencies(spark, index).collect()} == {(w, df_[w], tf[w], headed[w]) for w in tf}
    stored = {}
    for x in index.rows(spark).collect():
        at, weight = P._places(np.array(x["places"]), np.array(x["counts"]))
        unit = np.repeat(np.cumsum(x["units"]), x["counts"])
        for u, a, w in zip(unit.tolist(), at.tolist(), weight.tolist(), strict=True):
            stored.setdefault(u, []).append((a, x["term"], w / 10))
    assert {u: sorted(x) for u, x in stored.items()} == {row[0]: placed(row) for row in rows if row[0] is not None and placed(row)}


def test_blocks_below_the_kth_score_are_not_read(spark, monkeypatch):
    rows = [(i, None, "common " * (1 + i // 380 * 9) + f"w{i}") for i in range(400)]
    index = P.build(spark.createDataFrame(rows, "unit long, heading string, body string").coalesce(1), new_folder(spark), block_units=4)
    read, rank = [], P._rank

    def counted(spark, index, blocks, *rest):
        read.append(blocks.count())
        return rank(spark, index, blocks, *rest)

    monkeypatch.setattr(P, "_rank", counted)
    q = spark.createDataFrame([(1, ["common"])], "q long, terms array<string>")
    for every in (True, False):
        assert [x["unit"] for x in P.top(spark, index, q, 5, every).orderBy("rank").collect()] == [380, 381, 382, 383, 384]
    assert index.rows(spark).where("term = 'common'").count() == 100 and read == [4, 1, 4, 1]


def test_only_folders_of_the_terms_are_read(spark, table):
    index = P.build(table[1], new_folder(spark))
    terms = spark.createDataFrame([("w1",)], "term string").withColumn("bucket", index.bucket(F.col("term")))
    some, every = index.rows_of(spark, terms), index.rows(spark)
    assert some.where("term = 'w1'").count() == every.where("term = 'w1'").count() > 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "w1" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_strict_then_fallback(spark):
    rows = [(1, None, "red fox runs"), (2, "Red", "fox"), (3, None, "a fox"), (4, None, "is it so")]
    df = spark.createDataFrame(rows, "unit long, heading string, body string")
    q = spark.createDataFrame([(1, "Red fox"), (2, "fox absent"), (3, "!"), (4, None), (5, "it is no"), (6, "absent")], "id long, text string")
    index = P.build(df, new_folder(spark))
    got = {(x["id"], x["rank"]): (x["unit"], x["score"], x["strategy"]) for x in P.search(spark, index, q, "id", "text").collect()}
    two = round(2 / (1 + 2.5), 9)
    assert got == {
        (1, 1): (2, round(two / (two + 1), 9), "strict"), (1, 2): (1, round(0.4 / 1.4, 9), "strict"),
        (2, 1): (1, round(0.4 / 1.4, 9), "or_fallback"), (2, 2): (2, round(0.4 / 1.4, 9), "or_fallback"), (2, 3): (3, round(0.4 / 1.4, 9), "or_fallback"),
        (5, 1): (4, round(0.8 / 1.8, 9), "or_fallback"),
    }
    old = P.build(df, new_folder(spark), version="1.0.9")
    assert {x["id"] for x in P.search(spark, P.load(spark, old.path), q, "id", "text").collect()} == {1}


def test_nothing_indexed(spark):
    df = spark.createDataFrame([], "unit long, heading string, body string")
    index = P.build(df, new_folder(spark))
    q = spark.createDataFrame([(1, "Red fox")], "id long, text string")
    assert P.load(spark, index.path) == index
    assert P.search(spark, index, q, "id", "text").collect() == []


def test_covers_against_windows():
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(1, 3)
        terms = [f"t{i}" for i in range(n)]
        places = [(p, r.choice(terms), r.choice([1.0, 0.4])) for p in sorted(r.sample(range(1, 60), r.randint(n, 12)))]
        if {x[1] for x in places} != set(terms):
            continue
        at, term, weight = (np.array(x) for x in zip(*[(p, terms.index(t), round(w * 10)) for p, t, w in places], strict=True))
        assert abs(P.cover_density(at, weight, term, n) - density(places, terms)) < 1e-9


def test_product_of_salts(spark):
    rows = spark.createDataFrame([(b, "x") for b in range(40)], "block long, term string")
    terms = spark.createDataFrame([("x", q) for q in range(3)], "term string, q long")
    assert {(x["block"], x["q"]) for x in P._meet(rows, terms, ["term"], False).collect()} == set(product(range(40), range(3)))
