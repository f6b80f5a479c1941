"""Filter interactions, divergence of sources and removal of benchmark passages, against plain loops."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from lodestone.llm import decontaminate, filter_audit, source_audit
from pyspark.sql import functions as F

CLASH = ("id", "part", "bits", "hash", "text_key", "low", "term", "n", "at", "size", "gram", "item", "w", "rank", "value")


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def prose(r, n, words=60):
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))


# filter interactions


def filter_rows():
    r = random.Random(5)
    rows = [(i, r.choice(["", "A", "#", " \n"]) + prose(r, r.choice([0, 1, 199, 200, 260]), r.choice([20, 400])), r.choice(["en", "de", None]), "s") for i in range(60)]
    rows += [(60 + i, rows[i % 7][1], r.choice(["en", "", None]), "s") for i in range(40)]
    rows += [(200, "ÀB" * 50, "en", "s"), (200, "ÀB" * 50, "en", "s"), (201, "ÀB" * 50, "de", "s"), (201, "other", "de", "s"), (None, "ÀB" * 50, "en", "s"), (None, None, None, None), (3, None, "en", "s"), (202, "", "en", "s"), (203, None, "en", "s")]
    return rows


def labels(spark):
    rows = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 300, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash")).withColumn("good", F.lit("clash"))


def audited(rows, label_rows):
    good, toxic = {x[0] for x in label_rows if x[1] == 1}, {x[0] for x in label_rows if x[2] == 1}
    low = {}
    for i, text, *_ in rows:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    judged = []
    for i, text, lang, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set("A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and low[t] < i))
        judged.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, removed = {}, Counter()
    for part in {x[0] for x in judged}:
        for order in permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            for step, x in enumerate(order):
                gone = [y for y in left if x in y[1]]
                left = [y for y in left if x not in y[1]]
                fail = [y for y in judged if y[0] == part and x in y[1]]
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(fail) - len(gone), sum(y[1] == {x} for y in fail), sum(y[2] for y in gone), sum(y[3] for y in gone)]
                removed[part, x] += len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("few, each", [(10**6, 256), (0, 256), (10**6, 2), (0, 2)])
def test_filter_audit_against_a_loop(spark, monkeypatch, few, each):
    monkeypatch.setattr(filter_audit, "COPIES_A_TASK", each)
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", few)
    rows, marks = filter_rows(), labels(spark)
    want = audited(rows, [tuple(x)[:3] for x in marks.select("doc_id", "quality", "toxic").collect() if x[0] is not None])
    got = {tuple(x[:3]): tuple(x[3:]) for x in filter_audit.audit(spark, docs(spark, rows), marks).collect()}
    assert got == want and len(got) == 600 * len({x[2] or "" for x in rows})


def test_filter_audit_of_nothing(spark):
    assert filter_audit.audit(spark, docs(spark, []), labels(spark)).collect() == []
    one = filter_audit.audit(spark, docs(spark, [(1, "x", "en", "s")]), labels(spark).where("false")).collect()
    assert len(one) == 600 and {x["shapley"] for x in one if x["filter_order"][x["step"] - 1] == "A"} == {120}


def test_copies_give_a_row_each(spark):
    rows = [(i, "same", "en", "s") for i in range(500)] + [(i, f"own {i}", "en", "s") for i in range(500, 520)]
    assert sorted(x["id"] for x in filter_audit.copies(docs(spark, rows)).collect()) == list(range(1, 500))


# divergence of sources


def diverged(rows, least, top):
    groups, in_docs = {}, {}
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        in_docs.setdefault(lang or "", Counter()).update(set(terms))
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def shares(count, kept=kept):
            size = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // size for t in kept}

        p = shares(own)
        pair = [(-sum(abs(p[t] - x) for t, x in shares(c).items()), s.encode(), s) for (of, s), c in groups.items() if of == lang and s != source]
        whole = shares(sum((c for (of, _), c in groups.items() if of == lang), Counter()))
        term = [(whole[t] - p[t], t.encode(), t) for t in kept if own[t] and p[t] > whole[t]]
        for part, ranked in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            out |= {(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(ranked)}
    return out


def source_rows():
    r = random.Random(9)
    rows = [(i, prose(r, r.randint(0, 40)).replace("w1", "Éa-").replace("w2", "b\x00C"), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "ß", None])) for i in range(200)]
    rows += [(None, "w5 w5", "en", "only"), (1, None, "en", "none"), (2, "", "fr", "x"), (3, "1 2 3", "fr", "y"), (4, "日本 語", "fr", "y"), (4, "日本 語", "fr", "y")]
    return rows


@pytest.mark.parametrize("block, stripe, held", [(8192, 64, 400_000), (3, 2, 10)])
def test_source_audit_against_a_loop(spark, monkeypatch, block, stripe, held):
    for name, value in (("BLOCK", block), ("STRIPE", stripe), ("HELD", held)):
        monkeypatch.setattr(source_audit, name, value)
    rows = source_rows()
    got = source_audit.audit(spark, docs(spark, rows), least_docs=8, top=5).collect()
    want = diverged(rows, 8, 5)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert {x["value"] for x in got if x["lang"] == "fr"} == {0}  # no term is in eight documents


def test_source_audit_of_nothing(spark):
    assert source_audit.audit(spark, docs(spark, [])).collect() == []
    assert source_audit.audit(spark, docs(spark, [(1, "a", "en", "s")])).collect() == []


def test_galloping_finds_what_both_have():
    r = np.random.default_rng(3)
    for few, many in ((0, 5), (5, 0), (1, 1), (40, 3000), (500, 500), (200, 100_000)):
        a, b = (np.unique(r.integers(0, 4 * max(few, many), n)) for n in (few, many))
        i, j = source_audit.meet(a, b, step=16)
        assert (a[i] == b[j]).all() and set(a[i]) == set(a) & set(b)


def test_shares_are_exact():
    count = np.array([0, 1, 10**12, 3 * 10**14 + 7], np.int64)
    size = 8 * 10**15 + 13
    assert source_audit.share(count, size).tolist() == [1 + 10**9 * (int(c) + 5) // size for c in count]


# benchmark passages


def contaminated(rows, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[p : p + k]), set()).add(item)
    out = []
    for i, text, *_ in rows:
        w, hit, met = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in grams:
                    hit |= set(range(p, p + k))
                    met |= grams[g]
        spans = [(x, next(y for y in range(x, len(w) + 1) if y not in hit)) for x in sorted(hit) if x - 1 not in hit]
        out.append((i, len(w), len(hit), spans, sorted(str(x) for x in met if x is not None), bool(hit)))
    return out


def leak_rows():
    r = random.Random(2)
    items = [(i, prose(r, r.choice([4, 9, 10, 11, 25]), 500)) for i in range(30)] + [(100, "Solo"), (101, None), (102, ""), (103, "..."), (None, prose(r, 12, 500)), (7, "é É x")]
    items += [(200, items[0][1]), (9, items[1][1])]
    rows = []
    for i in range(80):
        parts = [prose(r, r.randint(0, 30), 500)]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, 3)
            parts += [r.choice([", ", " ", "\n- ", "! "]).join(w[a:]).upper(), prose(r, r.randint(0, 12), 500)]
        rows.append((i, " ".join(parts), "en", "s"))
    rows += [(None, rows[1][1], "en", "s"), (None, rows[1][1], "en", "s"), (5, rows[1][1], "en", "s"), (6, None, "en", "s"), (7, "", None, None), (8, "#!", None, None), (9, "solo", "en", "s"), (9, "Solo", "en", "s")]
    rows += [(10, prose(r, 60_000, 500) + " " + items[0][1], "en", "s")]
    return rows, items


def shown(rows):
    return sorted((str(r[0]), *(repr(x) for x in r[1:])) for r in rows)


@pytest.mark.parametrize("n, held", [(10, 4_000_000), (10, 40), (3, 4_000_000)])
def test_decontamination_against_a_loop(spark, monkeypatch, n, held):
    monkeypatch.setattr(decontaminate, "SET_SIZE", held)
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit("clash")).withColumn("size", F.lit("clash"))
    got = decontaminate.decontaminate(spark, docs(spark, rows), table, n=n).collect()
    got = [(x["doc_id"], x["n_words"], x["n_hit"], [tuple(y) for y in x["spans"]], x["items"], x["contaminated"]) for x in got]
    assert shown(got) == shown(contaminated(rows, items, n))


def test_spans_are_cut_out(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"Before this, {passage.upper()} and after!", "en", "s"), (2, passage, "en", "s"), (3, f"({passage}) ... ", "en", "s"), (4, "Clean, as it was. ", "en", "s"), (5, None, "en", "s"), (6, f"a {passage} b {passage}. C\n", "en", "s")]
    table = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {x["doc_id"]: x["clean"] for x in decontaminate.decontaminate(spark, docs(spark, rows), table).collect()}
    assert got == {1: "Before this and after!", 2: "", 3: ") ... ", 4: "Clean, as it was. ", 5: None, 6: "a b. C\n"}


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(spark, docs(spark, []), items).collect() == []
    rows = decontaminate.decontaminate(spark, docs(spark, [(1, "a b c", "en", "s")]), items.where("false")).collect()
    assert [(x["n_words"], x["n_hit"], x["spans"], x["items"], x["contaminated"], x["clean"]) for x in rows] == [(3, 0, [], [], False, "a b c")]


def test_no_python_on_the_main_path(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string").coalesce(1)
    plan = decontaminate.decontaminate(spark, docs(spark, [(1, "a b c", "en", "s")]), items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
