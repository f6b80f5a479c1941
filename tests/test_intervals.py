"""Overlapping intervals against all pairs."""

import random

import duckdb
import pytest
from lodestone.operators.intervals import overlapping
from lodestone.plans import registry

A, B = "doc long, s long, e long, a long", "doc long, t long, u long, b long"


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.choice([r.randrange(-3000, 3000), 256 * r.randrange(-5, 5), r.randrange(10**12)])
        size = r.choice([0, 1, r.randrange(300), 256, 257, 1024, r.randrange(10**4), 10**6, 10**12])
        rows.append((r.choice([1, 2, None]), start, start + size, i))
    return rows + [(1, 5, 3, n), (1, None, 4, n + 1), (1, 4, None, n + 2)] + rows[:3]


def pairs(left, right):
    ok = lambda x: None not in x and x[1] < x[2]
    return sorted((x[3], y[3]) for x in left for y in right if ok(x) and ok(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_pairs(spark, seed):
    left, right = made(150, seed), made(150, seed + 50)
    got = overlapping(spark.createDataFrame(left, A), spark.createDataFrame(right, B), ["doc"], ("s", "e"), ("t", "u"))
    assert got.columns == ["doc", "s", "e", "a", "t", "u", "b"]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == pairs(left, right)


def test_empty_tables_and_the_longest_intervals(spark):
    left, right = spark.createDataFrame([(1, 0, 2**62, 0)], A), spark.createDataFrame([(1, 2**61, 2**61 + 1, 0), (1, 2**62, 2**62 + 5, 1)], B)
    assert [(r["a"], r["b"]) for r in overlapping(left, right, ["doc"], ("s", "e"), ("t", "u")).collect()] == [(0, 0)]
    assert overlapping(left.where("false"), right, ["doc"], ("s", "e"), ("t", "u")).collect() == []
    assert overlapping(left, right.where("false"), ["doc"], ("s", "e"), ("t", "u")).collect() == []


def test_provenance_of_passages_over_several_lines(spark, tmp_path):
    docs = [
        (1, "\nHead 😀 one\nsecond line 😀\n\nthird"),
        (2, "one\nsecond line 😀\none\nsecond line 😀"),
        (3, None),
        (4, ""),
        (5, "aaaa"),
    ]
    items = [(7, "one\nsecond line 😀"), (8, "😀\n\nth"), (9, "aa"), (10, None), (11, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["evidence_provenance"]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in registry.queries()["evidence_provenance"](spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r["item_id"], r["doc_id"], r["hit_start"], r["canonical_start"]))
    assert order(got) == order(want) and len(got) == 11
    texts = dict(docs)
    for r in got:
        part = texts[r["doc_id"]][r["canonical_start"] : r["canonical_end"]]
        assert dict(items)[r["item_id"]][r["chunk_start"] : r["chunk_end"]] == part
        assert texts[r["doc_id"]].encode("utf-16-le")[2 * r["utf16_start"] : 2 * r["utf16_end"]].decode("utf-16-le") == part
