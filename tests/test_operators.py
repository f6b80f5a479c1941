"""Chunks, search, fusion, selection and evidence against small cases and brute force."""

import random

import pytest
from lodestone.functions import text as T
from lodestone.operators import dense, evidence, fusion
from lodestone.operators.chunking import Config, chunk_documents, chunks, overlap_of, split_long, tail
from lodestone.operators.exact import find_phrases
from pyspark.sql import functions as F

SMALL = Config(target=300, least=80, most=500, overlap=60)


def lines_of(text):
    at, out = 0, []
    for line in text.split("\n"):
        out.append((at, line, line.startswith("#")))
        at += len(line) + 1
    return out


def story(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(3, 14))).capitalize() + r.choice(".!?:")
    return "\n".join(("# " if r.random() < 0.1 else "") + " ".join(sentence() for _ in range(r.randint(1, 12))) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_chunks_are_slices_and_lose_nothing(seed):
    text = story(seed)
    out = list(chunks(lines_of(text), SMALL))
    covered = 0
    for i, c in enumerate(out):
        assert c["ordinal"] == i and c["text"] == text[c["start"] : c["end"]]
        for s in c["spans"]:
            assert text[s["start"] : s["end"]] == c["text"][s["at"] : s["at"] + s["end"] - s["start"]]
        assert c["overlap_chars"] <= SMALL.overlap + 1
        assert c["content_chars"] <= SMALL.least + SMALL.most + 1
        covered += c["content_chars"]
    assert covered == sum(len(line) for line in text.split("\n"))
    assert out == list(chunks(lines_of(text), SMALL))


def test_split_is_lossless_and_bounded():
    text = story(20, 1) * 20
    parts = split_long(text, 100)
    assert "".join(text[a:b] for a, b in parts) == text and all(0 < b - a <= 100 for a, b in parts)
    assert split_long("x" * 250, 100) == [(0, 100), (100, 200), (200, 250)]


def test_tail_takes_sentences_then_words():
    text = "First one here. Second is this. Third."
    assert text[tail(text, 25) :] == "Second is this. Third."
    assert text[tail(text, 10) :] == "Third."
    long = "word " * 40
    assert long[tail(long, 43) :].startswith("word")
    assert tail("x" * 100, 50) == 100


def test_overlap_is_whole_pieces_then_a_tail():
    buffer = [(0, 0, "One sentence that is long enough. And a short one here.", False), (1, 60, "last piece", False)]
    assert [p[2] for p in overlap_of(buffer, 45)] == ["And a short one here.", "last piece"]
    assert overlap_of(buffer, 0) == []


def test_chunks_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "a\n\nb")], "doc_id int, text string")
    got = [(r["doc_id"], r["text"]) for r in chunk_documents(df).collect()]
    assert got == [(4, "a\nb")]


def test_phrases_with_unicode_places(spark):
    docs = spark.createDataFrame([(1, "İ🌊 aXaXa axa"), (2, None), (3, "")], "doc_id int, text string")
    phrases = spark.createDataFrame([(1, "aXa"), (2, "nothing"), (3, None), (4, "")], "p int, phrase string")
    exact = sorted((r["p"], r["position"]) for r in find_phrases(docs, phrases, "doc_id", "p").collect())
    assert exact == [(1, 3), (1, 5)]
    fold = sorted(r["position"] for r in find_phrases(docs, phrases, "doc_id", "p", fold=True).collect())
    assert fold == [3, 5, 9]
    assert len(find_phrases(docs, phrases, "doc_id", "p", most=1).collect()) == 1
    assert find_phrases(docs, phrases.where("false"), "doc_id", "p").collect() == []


@pytest.mark.parametrize("fold", [False, True])
def test_phrases_against_brute_force(spark, fold):
    r = random.Random(5)
    body = lambda n: "".join(r.choice("abAB \n\u00e9\u0130\U0001f30a") for _ in range(n))
    texts = [body(r.choice([1, 3, 20, 300, 2000])) for _ in range(40)]
    said = []
    for n in [1, 2, 3, 7, 8, 15, 16, 31, 32, 63, 64, 65, 127, 500] * 3:
        source = r.choice([x for x in texts if len(x) >= n])
        at = r.randrange(len(source) - n + 1)
        said.append(source[at : at + n].swapcase() if fold and r.random() < 0.5 else source[at : at + n])
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (99, None)], "doc_id int, text string")
    phrases = spark.createDataFrame([*enumerate(said), (0, said[0]), (1, said[-1])], "p int, phrase string")
    low = lambda s: "".join(c.lower() if fold and len(c.lower()) == 1 else c for c in s)
    want = []
    for i, text in [*enumerate(texts), (0, texts[0])]:
        text = low(text)
        for p, s in {*enumerate(map(low, said)), (1, low(said[-1]))}:
            places = [k for k in range(len(text)) if text.startswith(s, k)]
            want += [(i, p, k) for k in places[:3]]
    assert sorted(tuple(x) for x in find_phrases(docs, phrases, "doc_id", "p", most=3, fold=fold).collect()) == sorted(want)


def test_fusion_scores_and_ties(spark):
    rows = [(1, 10, "exact", 1), (1, 11, "lexical", 1), (1, 12, "dense", 1)]
    got = {r["item"]: (r["score"], r["rank"]) for r in fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, item int, component string, rank int")).collect()}
    assert got[10] == (2 / 61, 1) and got[11] == (1 / 61, 2) and got[12] == (1 / 61, 3)


def test_rerank_keeps_the_rest_below(spark):
    fused = spark.createDataFrame([(1, i, 1.0 / i, i) for i in range(1, 6)], "query_id int, item int, score double, rank int")
    got = {r["item"]: r["new_rank"] for r in fusion.rerank(fused, F.when(F.col("item") != 2, F.col("item")), most=3).collect()}
    assert got == {3: 1, 1: 2, 2: 3, 4: 4, 5: 5}


def greedy(rows, top, ratio=0.6):
    kept = []
    for rank, doc, a, b in sorted(rows):
        if len(kept) < top and all(d != doc or (min(b, y) - max(a, x)) <= 0 or (min(b, y) - max(a, x)) / min(max(1, b - a), max(1, y - x)) < ratio for _, d, x, y in kept):
            kept.append((rank, doc, a, b))
    return kept


def test_coverage_against_brute_force(spark):
    case = [(1, 1, 0, 200), (2, 1, 120, 220), (3, 2, 120, 220)]
    r = random.Random(1)
    many = [(i + 1, r.randint(1, 2), a := r.randint(0, 100), a + r.randint(0, 40)) for i in range(60)]
    df = spark.createDataFrame([(1, *x) for x in case] + [(2, *x) for x in many], "query_id int, rank int, doc int, start int, end int")
    got = fusion.select_by_coverage(df, 10).orderBy("query_id", "new_rank").collect()
    assert [tuple(x)[1:5] for x in got if x["query_id"] == 1] == [case[0], case[2]]
    assert [tuple(x)[1:5] for x in got if x["query_id"] == 2] == greedy(many, 10)


def test_nearest_breaks_ties_by_id(spark):
    rows = [(10, [1.0, 0.0]), (9, [2.0, 0.0]), (2, [3.0, 0.0]), (5, [0.0, 1.0]), (6, None), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = [(r["vec_id"], r["distance"]) for r in dense.nearest(spark, df.where("vec_id = 10"), df, 3, "vec_id", "v").orderBy("rank").collect()]
    assert got == [(2, 0.0), (9, 0.0), (5, 1.0)]


def test_evidence_has_three_values(spark):
    df = spark.createDataFrame([("a", "a", ["x"], ["x", "y"]), ("a", "b", ["x"], []), (None, "b", None, ["y"]), ("a", "a", ["x"], ["z"])], "a string, b string, s array<string>, t array<string>")
    one, two = evidence.equal_dimension(F.col("a"), F.col("b")), evidence.overlap_dimension(F.col("s"), F.col("t"))
    got = [tuple(r) for r in df.select(one, two, evidence.any_conflict(one, two)).collect()]
    assert got == [("agree", "agree", False), ("conflict", "absent", True), ("absent", "absent", False), ("agree", "conflict", True)]


def test_text_functions(spark):
    row = spark.createDataFrame([("  The—Old  MAN & the Sea! ", "c. 1899, 2001", "9780306406157", "0306406152", "080442957X", "java\tscript:x", "🌊a")], "t string, y string, i string, j string, x string, u string, w string")
    got = row.select(T.title_key(F.col("t")), T.name_key(F.col("t")), T.year(F.col("y")), T.isbn13_valid(F.col("i")), T.isbn13_of_10(F.col("j")), T.isbn13_of_10(F.col("x")), T.url_verdict(F.col("u")), T.utf16_length(F.col("w"))).first()
    assert tuple(got) == ("the old man the sea", "the—old man & the sea!", 1899, True, "9780306406157", "9780804429573", "blocked", 3)
    assert [tuple(r) for r in spark.range(1, 8).select(T.backoff_seconds(F.col("id").cast("int")), T.index_backoff_seconds(F.col("id").cast("int"))).collect()] == [(30, 30), (120, 60), (600, 120), (600, 240), (600, 480), (600, 600), (600, 600)]


def test_any_terms(spark):
    df = spark.createDataFrame([("An ox, an OX saw the Größe 42 times: it",), ("a b",)], "t string")
    assert [r[0] for r in df.select(T.any_terms(F.col("t"))).collect()] == [["saw", "the", "größe", "times"], ["a", "b"]]
