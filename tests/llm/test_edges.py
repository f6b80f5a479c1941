"""Nulls, empty and long texts, repeated rows, empty tables, clashing column names: every operator, every stage."""

import corpus_pipeline
import public_tokenizers
import pytest
from lodestone.llm import bpe_automaton, html_crf, langid, maxent_lm, minhash, packing, quality, suffix_dedup, token_counts, topk
from pyspark.sql import functions as F

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} lorem" for i in range(30000))
PROSE = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what it is that they see today"
ROWS = [
    (1, PROSE, "en"),
    (2, PROSE, "en"),
    (2, PROSE, "en"),
    (3, None, "en"),
    (4, "", None),
    (None, PROSE, "en"),
    (None, None, None),
    (5, LONG, "xx"),
    (6, " \n\t ", "en"),
    (7, "日本語 é 😀 <|endoftext|>", None),
    (8, "a", "en"),
    (9, LONG, "xx"),
]
#: Columns that the operators use inside, to clash with them.
CLASH = ("id", "key", "bands", "band", "comp", "packed", "blob", "group", "block", "word", "share", "rank", "kept", "train", "count", "score")

DOCS = {
    "minhash": lambda s, d: minhash.near_duplicates(s, d),
    "encode": lambda s, d: bpe_automaton.encode(d, BYTE, digests=True),
    "token_counts": lambda s, d: token_counts.token_counts(d, BYTE),
    "quality": lambda s, d: quality.quality(d),
    "packing": lambda s, d: packing.pack(s, d, WORD, capacity=4096, end_id=1),
    "langid": lambda s, d: langid.identify(d, train=F.col("lang").isNotNull()),
    "suffix_dedup": lambda s, d: suffix_dedup.dedup(s, d),
    "maxent_lm": lambda s, d: maxent_lm.score(s, d, F.col("doc_id") != 1),
}


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", DOCS)
def test_empty_table(spark, name):
    assert DOCS[name](spark, docs(spark, [])).collect() == []


@pytest.fixture(scope="module")
def results(spark):
    df = docs(spark, ROWS).repartition(3).cache()
    return {name: f(spark, df).collect() for name, f in DOCS.items()}


def by_id(rows, column):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r[column])
    return out


@pytest.mark.parametrize("name", [x for x in DOCS if x != "packing"])
def test_all_rows_come_back(results, name):
    assert len(results[name]) == len(ROWS)


def test_near_duplicates(results):
    comp, kept, n = (by_id(results["minhash"], x) for x in ("component_id", "kept", "n_shingles"))
    assert comp[1] == [1] and comp[2] == [1, 1] and comp[5] == [5] and comp[9] == [5]
    assert comp[None] == [None, None] and kept[None] == [True, True]
    assert kept[1] == [True] and kept[2] == [False, False] and kept[3] == [True]
    assert n[3] == n[4] == n[6] == [0] and n[8] == [1]


def test_tokens(results):
    n = by_id(results["encode"], "n_tokens")
    assert n[3] == n[4] == [0] and n[1] == n[2][:1]
    assert n == by_id(results["token_counts"], "n_tokens")


def test_quality(results):
    kept, n = by_id(results["quality"], "kept"), by_id(results["quality"], "n_words")
    assert kept[1] == [True] and kept[3] == kept[4] == kept[6] == kept[8] == [False] and n[6] == [0]


def test_packing(results):
    rows = results["packing"]
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (3, 4, 6))
    long = sorted(r["length"] for r in rows if r["doc_id"] == 5)
    assert len(long) > 1 and long[1:] == [4096] * (len(long) - 1)
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)


def test_language(results):
    got = by_id(results["langid"], "lang_pred")
    assert got[3] == got[4] == got[6] == ["und"] and got[1] == ["en"] and got[5] == ["xx"]


def test_repeats(results):
    gone, n = by_id(results["suffix_dedup"], "n_removed"), by_id(results["suffix_dedup"], "n_bytes")
    assert gone[1] == [0] and gone[2] == n[2] == [len(PROSE)] * 2
    assert gone[9] == n[9] and gone[5] == [0] and gone[None] == [0, 0]


def test_scores(results):
    n, known, total = (by_id(results["maxent_lm"], x) for x in ("n_tokens", "n_known", "train_tokens"))
    assert n[3] == n[4] == [1] and known[3] == [1]
    assert total[3][0] == sum(len((t or "").encode().split()) + 1 for i, t, _ in ROWS if i not in (1, None))


def test_decode_nulls(spark):
    df = spark.createDataFrame([(1, [15496]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe_automaton.decode(df, BYTE).collect()} == {1: "Hello", 2: None, 3: ""}


def test_vectors(spark):
    bad = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [bad, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [9.0, 9.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit("x"))
    got = [tuple(r) for r in topk.top_k(spark, df.where("vec_id % 50 = 0"), df, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 3, 32768)]
    # components of any size that scores have room for
    big = spark.createDataFrame([(0, [1.0, 0.0]), (1, [70000.0, 0.0]), (2, [65536.0, 1.0]), (3, [0.1, 1e6]), (50, [1e6, -3e5])], "vec_id long, embedding array<double>")
    want = {q: sorted(((-sum(int(256 * a // 1) * int(256 * b // 1) for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q))[:3] for vectors in [[tuple(r) for r in big.collect()]] for q, x in vectors if q % 50 == 0}
    found = topk.top_k(spark, big.where("vec_id % 50 = 0"), big, k=3).orderBy("query_id", "rank").collect()
    assert {q: [(-r["score"], r["vec_id"]) for r in found if r["query_id"] == q] for q in want} == want
    assert topk.top_k(spark, df.where("false"), df).collect() == []
    assert topk.top_k(spark, df.where("vec_id = 0"), df.where("false")).collect() == []


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<p>x"), (3, "u", "<article><p>One.</p><p>Two &amp; three.</p></article><footer>&copy; x</footer>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_crf.extract(df, html_crf.train(df)).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "One.\nTwo & three."
    assert html_crf.extract(df.where("false"), html_crf.train(df.where("false"))).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, stage):
    name, f = corpus_pipeline.STAGES[stage]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    out, none = f(spark, df, ""), f(spark, df.where("false"), "")
    assert none.collect() == []
    if stage + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == list(corpus_pipeline.COLUMNS)
    ids = {r["doc_id"] for r in out.collect()}
    assert 1 in ids and (stage != 2 or 2 not in ids) and (stage > 1 or 3 not in ids)
