"""Queries that do the whole job where the SQL of another query stops short of it, on small tables of their own."""

import hashlib
import re
from collections import Counter
from itertools import combinations

from lodestone.plans import registry

QUERIES = registry.queries()


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_siblings_that_share_nothing_with_the_first(spark, tmp_path):
    part = [(i, "almond", "A" if i < 8 else "B") for i in range(1, 10)]
    lines = [(1, 10), (2, 20), (3, 20), (3, 20), (4, 30), (5, 30), (5, 40), (6, 40), (7, 50), (8, 10), (9, 60)]
    path = stored(spark, tmp_path, part=(part, "p_partkey long, p_name string, p_brand string"), lineitem=(lines, "l_partkey long, l_suppkey long"))
    links = {tuple(r) for r in QUERIES["sibling_links"](spark, path).select("p_partkey", "sibling").collect()}
    assert links == {(3, 2), (5, 4), (6, 5)}
    brand, suppliers = {i: b for i, _, b in part}, {i: {s for p, s in lines if p == i} for i, _, _ in part}
    direct = {(b, a) for a, b in combinations(sorted(brand), 2) if brand[a] == brand[b] and suppliers[a] & suppliers[b]}
    assert links <= direct and {x for x, _ in links} == {x for x, _ in direct}


def test_embedding_of_long_texts(spark, tmp_path):
    texts = {1: "One two, two.", 2: " ".join(f"Word{i % 977} étage" for i in range(5000)), 3: "", 4: "x " * 301, 5: "x " * 300}
    path = stored(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))
    got = {r["doc_id"]: [int(x) for x in r["vector"].split(",")] for r in QUERIES["hashed_embedding_all"](spark, path).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        n = Counter(int(hashlib.sha256(w.encode()).hexdigest()[:6], 16) % 32 for w in re.findall(r"\w+", text.lower()))
        norm = sum(x * x for x in n.values()) ** 0.5 or 1
        assert all(abs(x - 1000 * n[b] / norm) <= 0.5 + 1e-9 for b, x in enumerate(got[i]))


OPENING = "An opening of an item that goes on for well over sixty characters before"


def test_items_found_whole(spark, tmp_path):
    items = [(0, f"{OPENING} it ends"), (1, f"{OPENING} it goes on\nand on")]
    docs = [(1, f"x {OPENING} it ends otherwise"), (2, OPENING), (3, f"{OPENING} it goes on"), (4, None)]
    path = stored(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    assert [tuple(r) for r in QUERIES["exact_search_whole"](spark, path).collect()] == [(0, 1)]
    assert [tuple(r) for r in QUERIES["exact_absent_whole"](spark, path).collect()] == [(1,)]
    scores = {(r["query_id"], r["item"]): r["score"] for r in QUERIES["hybrid_search"](spark, path).collect()}
    # document 1 alone has an item whole, and leads by more than a place of another ranking
    assert scores[0, 1] > scores[0, 2] + 1 / 61 and (1, 1) in scores


def test_places_across_chunks(spark, tmp_path):
    sentences = [f"Sentence number {i} of a line that no chunk holds whole." for i in range(200)]
    line = " ".join(sentences)
    items = [(0, sentences[3]), (1, line), (2, line[2100:2500]), (3, "absent"), (4, f"{sentences[5]}\n\n{sentences[150]}")]
    path = stored(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=([(7, f"x\n{line}\ny"), (8, None), (9, "")], "doc_id long, text string"))
    got = [tuple(r) for r in QUERIES["exact_search_minimum_slice"](spark, path).select("item_id", "canonical_start", "match_text").collect()]
    wanted = {(i, x) for i, text in items for x in text.split("\n") if x and x in line}
    assert sorted(got) == sorted((i, 2 + line.index(x), x) for i, x in wanted)
    chunks = {(r["item_id"], r["canonical_start"]): (r["chunk"], r["ends_there"]) for r in QUERIES["exact_evidence"](spark, path).collect()}
    assert set(chunks) == {(i, at) for i, at, _ in got}
    assert chunks[0, 2 + line.index(sentences[3])] == (0, True) and chunks[1, 2] == (0, False)
    assert max(n for n, _ in chunks.values()) > 2


def test_lexical_queries_by_all_words(spark, tmp_path):
    words = [f"word{chr(97 + i)}" for i in range(15)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:14])), (3, "red fox extraordinarily x"), (4, "red fox")]
    items = [(0, "Fox red, extraordinarily"), (1, "red fox absent")]
    turns = [(20, 1, "user", " ".join(words)), (40, 1, "user", " ".join([*words, "missing"])), (20, 2, "user", "red fox")]
    path = stored(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"), conversations=(turns, "conv_id long, turn long, role string, text string"))
    assert {(r["item_id"], r["doc_id"]) for r in QUERIES["lexical_rank_cd"](spark, path).collect()} == {(0, 3)}
    got = {(r["conv_id"], r["turn"]): (r["strict_hits"], r["any_hits"], r["strategy"]) for r in QUERIES["lexical_strategy_all"](spark, path).collect()}
    assert got == {(20, 1): (1, 2, "strict"), (40, 1): (0, 2, "or_fallback"), (20, 2): (2, 2, "strict")}
