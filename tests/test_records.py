"""Identifiers, text functions, evidence dimensions and stored chunks on hand-made rows, nulls and empties included."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import identity
from lodestone.functions import text as T
from lodestone.operators import evidence
from lodestone.sources.library import replace_assets

U = "123e4567-e89b-12d3-a456-426614174000"

IDENTIFIERS = [
    (None, None, None),
    ("", None, ("other", None, None, None)),
    ("  978-0-306-40615-7 ", None, ("isbn13", "9780306406157", "9780306406157", True)),
    ("9780306406158", None, ("other", None, None, False)),
    ("0-306-40615-2", None, ("isbn10", "0306406152", "9780306406157", True)),
    ("080442957x", None, ("isbn10", "080442957X", "9780804429573", True)),
    ("0306406153", None, ("other", None, None, None)),
    ("0306406153", "isbn", ("other", None, None, False)),
    ("urn:isbn:0306406152", None, ("isbn10", "0306406152", "9780306406157", True)),
    ("URN:ISBN:12", None, ("other", None, None, False)),
    (f"urn:uuid:{U.upper()}", None, ("uuid", U, None, True)),
    (U.replace("-", ""), "UUID", ("uuid", U, None, True)),
    ("urn:uuid:12", None, ("other", None, None, False)),
    ("doi:10.1000/182", None, ("doi", "10.1000/182", None, True)),
    ("https://doi.org/10.1234/a b", None, ("doi", "10.1234/a", None, True)),
    ("https://doi.org/x", None, ("uri", "https://doi.org/x", None, True)),
    ("http://example.org/b", None, ("uri", "http://example.org/b", None, True)),
    ("urn:oid:1.2", None, ("uri", "urn:oid:1.2", None, True)),
    ("a novel 12", None, ("other", None, None, None)),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_identifiers(spark):
    df = spark.createDataFrame([(i, raw, hint) for i, (raw, hint, _) in enumerate(IDENTIFIERS)], "i int, raw string, hint string")
    got = df.select("i", identity.normalize_identifier(F.col("raw"), F.col("hint")).alias("x")).orderBy("i").collect()
    assert [None if r.x is None else tuple(r.x) for r in got] == [w for *_, w in IDENTIFIERS]
    assert uuid.UUID(U)


def test_tokens(spark):
    raws = spark.createDataFrame([(["0306406152", "978-0306406157", "doi:10.1000/182", "x", None, f"urn:uuid:{U}"],), ([],), (None,)], "raws array<string>")
    got = raws.select(identity.tokens(F.transform("raws", identity.normalize_identifier)).alias("t")).collect()
    assert [r.t for r in got] == [["doi:10.1000/182", "isbn:9780306406157", f"uuid:{U}"], [], []]


def test_all_isbn10_of_a_range(spark):
    def check(n):
        d = f"{n:09d}"
        return "0123456789X"[-sum((10 - i) * int(c) for i, c in enumerate(d)) % 11]

    df = spark.range(2000).withColumn("d", F.lpad((F.col("id") * 499_979).cast("string"), 9, "0"))
    for last in "0123456789X":
        for r in df.select("d", T.isbn13_of_10(F.concat("d", F.lit(last))).alias("x")).collect():
            assert (r.x is not None) == (check(int(r.d)) == last)


@pytest.mark.parametrize("text", [None, "", "  a ", "aé", "é" * 9, "日本語", "😀😀", "a" * 30])
@pytest.mark.parametrize("most", [4, 5, 6, 7, 8])
def test_cap_bytes(spark, text, most):
    want = (text or "").strip().encode()[:most].decode(errors="ignore")
    assert one(spark, T.cap_bytes(F.col("t"), most), t=text) == want


def test_composed_keys(spark):
    for key in (T.title_key, T.name_key):
        assert one(spark, key(F.col("t")), t="Étude") == one(spark, key(F.col("t")), t="Étude") == "étude"
        assert one(spark, key(F.col("t")), t=None) is None


def test_small_functions(spark):
    assert one(spark, T.like_escape(F.col("t")), t=r"5%_\x") == r"5\%\_\\x"
    assert one(spark, T.display(F.col("t")), t=b"a\xffb") == "a�b"
    assert one(spark, T.decode_path(T.encode_path(F.col("t"))), t=b"a\xff/\x00") == b"a\xff/\x00"
    assert one(spark, T.decode_path(F.col("t")), t="?!") == b""
    assert one(spark, T.heading_text(F.array("t", "t")), t="a" * 700) == ("a" * 700 + " › " + "a" * 700)[:1000]
    assert one(spark, T.heading_text(F.array().cast("array<string>")), t="") is None
    assert one(spark, T.embedding_text(F.lit(None), F.col("t")), t="b") == "b"
    assert one(spark, T.embedding_text(F.lit("h"), F.col("t")), t="b") == "h\n\nb"
    assert [one(spark, T.version_before(F.col("t"), "1.1.0"), t=v) for v in ("1.0.9", "1.1", "1.1.0", "1.1.0.1", "0", "2", "1.10")] == [True, False, False, False, True, False, False]
    unsafe = ["/a", "\\a", "c:x", "a/../b", "..\\b", ".."]
    assert all(one(spark, T.unsafe_path(F.col("t")), t=p) for p in unsafe)
    assert not any(one(spark, T.unsafe_path(F.col("t")), t=p) for p in ["a/b", "a..b/c", "", "a/.b"])


def test_title_dimension(spark):
    df = spark.createDataFrame([("a", "a", True, True), ("a", "b", True, True), ("a", "a", True, False), ("", "", True, True), (None, "a", True, True)], "a string, b string, x boolean, y boolean")
    got = [r.d for r in df.select(evidence.title_dimension(*[F.col(c) for c in "abxy"]).alias("d")).collect()]
    assert got == ["agree", "conflict", "absent", "absent", "absent"]


def test_replace_assets(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "generation int, asset long, ordinal int, text string")
    stored = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("generation", "asset", "ordinal", "text").collect())
    first = [(1, a, o, f"{a}.{o}") for a in range(9) for o in range(3)] + [(2, 4, 0, "other")]
    replace_assets(rows(*first), path, buckets=4)
    assert stored() == sorted(first)
    new = [(1, 4, 0, "new"), (1, 20, 0, None)]
    for _ in range(2):
        replace_assets(rows(*new), path, buckets=4)
        assert stored() == sorted([r for r in first if r[:2] != (1, 4)] + new, key=lambda r: r[:3])


def test_types_are_text():
    assert isinstance(T.nfc.returnType, StringType)
