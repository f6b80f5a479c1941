"""Counts and ranks of documents by query: as SQL or loops give them where ids repeat, words are short and queries lie in several blocks."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import exact, hits
from lodestone.plans import registry

DOCS, TURNS = "doc_id long, text string", "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["lexical_strategy", "lexical_strategy_all"])
def test_odd_rows_as_in_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(hits, "QUERY_WORDS", 40)
    r = random.Random(5)
    words = [*(f"w{i}" for i in range(20)), "ab", "straße", "日本語"]
    text = lambda most: r.choice([None, "", "a b ab"]) if r.random() < 0.2 else " ".join(r.choices(words, k=r.randint(1, most)))
    docs = [(100 + i if i % 3 else r.choice([None, 1, 2, 3]), text(40)) for i in range(200)]
    turns = [(r.choice([None, 0, 20, 40, -20, 7]), r.choice([None, 1, 2]), r.choice(["user", "user", "assistant", None]), text(r.choice([5, 30]))) for _ in range(60)]
    con = duckdb.connect()
    for table, rows, schema in (("documents", docs, DOCS), ("conversations", turns, TURNS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    columns = "conv_id, turn, strict_hits, any_hits, strategy"
    want = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert want and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_words_of_documents_are_shuffled(spark, tmp_path):
    """One row a query and task, where each pair of a document and a shared word was one before."""
    docs = [(i, "alpha beta gamma") for i in range(300)]
    turns = [(20 * i, 1, "user", "alpha beta gamma delta") for i in range(50)]
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = registry.queries()["lexical_strategy"](spark, str(tmp_path))
    assert {(r["strict_hits"], r["any_hits"]) for r in out.collect()} == {(0, 300)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "explode" not in plan


@pytest.mark.parametrize(("most_docs", "most_words"), [(4096, 10**6), (7, 10**6), (4096, 11), (1, 1)])
def test_blocks_hold_every_row_once(monkeypatch, most_docs, most_words):
    monkeypatch.setattr(hits, "BLOCK_DOCS", most_docs)
    monkeypatch.setattr(hits, "BLOCK_WORDS", most_words)
    r = random.Random(1)
    rows = [None if r.random() < 0.1 else r.sample("abcdefghij", r.randint(0, 10)) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(rows, pa.list_(pa.string())), pa.nulls(50, pa.list_(pa.int32()))], names=["id", "words", "times"])
    at, found = 0, []
    for block in hits._index([batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)]):
        n, index = len(block["ids"][0]), hits._from_bytes(block["terms"][0].as_py())
        assert n == 1 or n <= most_docs and sum(len(x or ()) for x in rows[at : at + n]) <= most_words
        for term, docs in zip(index["term"].to_pylist(), index["docs"].to_pylist(), strict=True):
            assert all(a < b for a, b in pairwise(docs))
            found += [(at + d, term) for d in docs]
        at += n
    assert at == len(rows) and sorted(found) == sorted((i, w) for i, x in enumerate(rows) for w in x or ())


def test_bits_of_more_rows_than_are_put_together_at_once():
    bits = np.random.default_rng(0).integers(0, 2**63, (5, 200_000), np.uint64)
    rows, owner = np.array([0, 1, 2, 4, 3, 0]), np.array([0, 0, 0, 2, 2, 4])
    both = hits._count(bits, rows, owner, 6, np.bitwise_and).tolist()
    ones = lambda x: int(np.bitwise_count(x).sum())
    assert both == [ones(bits[0] & bits[1] & bits[2]), 0, ones(bits[4] & bits[3]), 0, ones(bits[0]), 0]


def hybrid(docs, items):
    """hybrid_search by loops: rows of one id are one document to words, each a candidate to embeddings."""

    def best(found):
        return {(q, d): n for q, rows in found.items() for n, (_, d) in reversed([*enumerate(sorted(rows)[:40], 1)])}

    def few(text):
        x = [*dict.fromkeys(words(text))]
        return ([w for w in x if len(w) >= 3] or x)[:12]

    def vector(text):
        n = Counter(int(hashlib.sha256(w.encode()).hexdigest()[:6], 16) % 32 for w in words(text))
        size = sum(x * x for x in n.values()) ** 0.5 or 1
        return [n[i] / size for i in range(32)]

    words = lambda text: re.findall(r"\w+", text.lower())
    docs = [(d, t) for d, t in docs if d is not None and t is not None]
    tf = defaultdict(Counter)
    for d, t in docs:
        tf[d].update(words(t))
    df = Counter(w for x in tf.values() for w in x)
    whole, lexical, near = defaultdict(list), defaultdict(list), defaultdict(list)
    vectors = [(d, vector(t)) for d, t in docs]
    asked = defaultdict(list)
    for q, t in items:
        if t is not None:
            asked[q] += few(t)
            whole[q] += [(d, d) for d, x in docs if t and t in x]
            v = vector(t)
            near[q] += sorted((round(1 - sum(a * b for a, b in zip(v, x, strict=True)), 9), d) for d, x in vectors)[:40]
    for q, terms in asked.items():
        lexical[q] = [(-round(sum(n[w] / (n[w] + 1) / df[w] for w in terms if w in n), 9), d) for d, n in tf.items() if any(w in n for w in terms)]
    score = defaultdict(float)
    for weight, ranks in zip((2, 1, 1), map(best, (whole, lexical, near)), strict=True):
        for key, rank in ranks.items():
            score[key] += weight / (60 + rank)
    return {(q, d, n, round(score[q, d], 9)) for q in asked for n, (_, d) in enumerate(sorted((-s, d) for (p, d), s in score.items() if p == q)[:10], 1)}


@pytest.mark.parametrize("most", [10**6, 60])
def test_hybrid_search_as_by_loops(spark, tmp_path, monkeypatch, most):
    """With repeated and null ids and texts, items of several rows, and queries in several blocks."""
    monkeypatch.setattr(hits, "QUERY_WORDS", most)
    r = random.Random(3)
    vocabulary = [*(f"word{i}" for i in range(60)), "ab", "straße", "日本語"]
    text = lambda a, b: " ".join(r.choices(vocabulary, k=r.randint(a, b)))
    docs = [(1000 + i if i % 5 else r.choice([None, 1, 2, 3]), text(1, 60) if i % 11 else r.choice([None, ""])) for i in range(160)]
    items = [(i, docs[7 * i + 1][1] if i % 3 else text(3, 20)) for i in range(14)] + [(3, text(3, 9)), (4, "ab"), (20, "absent"), (21, ""), (22, None)]
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(x) for x in registry.queries()["hybrid_search"](spark, str(tmp_path)).select("query_id", "item", "rank", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == hybrid(docs, items)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_many_blocks(k):
    rng = np.random.default_rng(k)
    best, seen = hits._Best(np.arange(100, 106), k), defaultdict(list)
    for block in range(9):
        ids = rng.permutation(np.arange(block * 20, block * 20 + rng.integers(1, 20)))
        values = rng.integers(0, 6, (6, len(ids))) / 4
        values[values > 1] = np.inf
        for a, b in ((0, 2), (2, 6)):
            best.put(a, ids, values[a:b])
        for q, row in enumerate(values.tolist()):
            seen[q] += [(100 + q, v, d) for d, v in zip(ids.tolist(), row, strict=True) if v <= 1]
    query, ids, values = best.found()
    want = sorted(x for rows in seen.values() for x in sorted(rows)[:k])
    assert sorted(zip(query.tolist(), values.tolist(), ids.tolist(), strict=True)) == want


def test_texts_without_a_candidate_stay_where_they_are(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"text {i} of many {'with the phrase itself' if i % 50 == 0 else ''}") for i in range(500)], DOCS)
    asked = spark.createDataFrame([(1, "with the phrase itself"), (2, "text 7 of")], "p long, phrase string")
    want = sorted([(i, 1, len(f"text {i} of many ")) for i in range(0, 500, 50)] + [(7, 2, 0)])
    for most in (exact.BROADCAST, 0):
        monkeypatch.setattr(exact, "BROADCAST", most)
        found = exact.find_phrases(texts, asked, "doc_id", "p")
        assert sorted(map(tuple, found.collect())) == want
        assert ("LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()) is bool(most)
