"""Reconciliation in rounds against one asset after another."""

import random

import pytest
from lodestone.operators import reconcile as R

SCHEMA = "id long, content string, title string, creators array<string>, language string, publisher string, year int, identifiers array<string>"


def random_assets(seed, n=60):
    r = random.Random(seed)
    pick = lambda values, none=0.15: None if r.random() < none else r.choice(values)
    ids = r.sample(range(1000), n)
    return [(i, pick(["c1", "c2", "c3"]), pick(["t1", "t2", ""]), r.sample(["a", "b", "c"], r.randint(0, 2)) if r.random() < 0.9 else None, pick(["en", "de"]), pick(["p", "q"], 0.5), pick([1, 2], 0.5), r.sample(["i1", "i2", "i3", "i4", "i5"], r.randint(0, 2))) for i in ids]


def equal(a, b):
    return "absent" if a is None or b is None else "agree" if a == b else "conflict"


def overlap(a, b):
    return "absent" if not a or not b else "agree" if set(a) & set(b) else "conflict"


def one_by_one(assets):
    holder, twins, edition, record, out = {}, {}, {}, {}, {}
    for a in sorted(assets):
        i, content, title, creators, language, publisher, year, identifiers = a
        title = title or None
        mine = (title, creators, language, publisher, year, identifiers)

        def dims(b, mine=mine):
            return [equal(mine[0], b[0]), overlap(mine[1], b[1]), equal(mine[2], b[2]), overlap(mine[5], b[5]), equal(mine[3], b[3]), equal(mine[4], b[4])]

        found, method, conflict = None, R.FOUNDED, None
        for twin in twins.get(content, []) if content is not None else []:
            d = dims(record[edition[twin]])
            if d[:3] == ["agree"] * 3 and "conflict" not in d:
                found, method = edition[twin], R.TWIN
                break
        if found is None:
            named = next((x for x in identifiers if x in holder), None)
            if named is not None:
                e = edition[holder[named]]
                d = dims(record[e])
                if d[0] == "agree" and "conflict" not in d:
                    found, method = e, R.LINKED
                else:
                    conflict = e
        edition[i] = i if found is None else found
        record[i] = mine
        twins.setdefault(content, []).append(i)
        for x in identifiers:
            holder.setdefault(x, i)
        out[i] = (edition[i], method, conflict)
    return out


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 7), (3, 3)])
def test_rounds_equal_one_by_one(spark, seed, partitions):
    assets = random_assets(seed)
    got, rounds = R.reconcile(spark.createDataFrame(assets, SCHEMA).repartition(partitions))
    rows = {r["id"]: (r["edition"], r["method"], r["conflicts_with"]) for r in got.collect()}
    assert rows == one_by_one(assets)
    assert {x[1] for x in rows.values()} >= {R.TWIN, R.FOUNDED} and 1 < rounds < len(assets) / 2


def test_many_copies_take_few_rounds(spark):
    assets = [(i, "c", "t", ["a"], "en", "p" if i % 2 else "q", None, []) for i in range(400)] + [(1000 + i, "c", None, ["a"], "en", None, None, []) for i in range(100)]
    got, rounds = R.reconcile(spark.createDataFrame(assets, SCHEMA))
    assert {r["id"]: (r["edition"], r["method"], r["conflicts_with"]) for r in got.collect()} == one_by_one(assets) and rounds <= 4


def test_provisional_records(spark):
    assets = [(1, None, "t", ["a", " ", "b"], "en", "p", 3, ["i"]), (2, None, "t", ["a"], "en", None, None, ["i"]), (None, "c", "t", [], None, None, None, [])]
    df = spark.createDataFrame(assets, SCHEMA)
    got, _ = R.reconcile(df)
    assert {r["id"]: r["method"] for r in got.collect()} == {1: R.FOUNDED, 2: R.LINKED}
    editions, credits = R.provisional(df, got)
    assert [(r["id"], r["title"], r["status"]) for r in editions.collect()] == [(1, "t", "provisional")]
    assert sorted((r["position"], r["name"]) for r in credits.collect()) == [(0, "a"), (2, "b")]
    assert R.reconcile(df.where("false"))[0].collect() == []
