"""Discovery and node files."""

import hashlib

from lodestone.sources import library
from pyspark.sql import functions as F


def test_discovery_and_cursor(spark, tmp_path):
    for name in ("a/b/one.epub", "a/two.EPUB", "a-b/three.epub", "a/b/four.txt", "z.epub"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    found = library.discover(spark, str(tmp_path))
    assert sorted(r["relative"] for r in found.collect()) == ["a-b/three.epub", "a/b/one.epub", "a/two.EPUB", "z.epub"]
    assert sorted(r["relative"] for r in library.after_cursor(found, "a/b/one.epub").collect()) == ["a-b/three.epub", "a/two.EPUB", "z.epub"]
    hints = found.select("relative", *library.path_hints(F.col("relative"))).where("author_hint is not null").collect()
    assert [tuple(r) for r in hints] == [("a/b/one.epub", "a", "b")]
    assert library.fresh(found, found.where("relative = 'z.epub'"), "relative").count() == 3


def test_nodes_round_trip_and_fingerprint(spark, tmp_path):
    rows = [("n1", 0, 0, "heading", 1, "Title", ["Title"], True, False), ("n2", 0, 1, "paragraph", None, "Body", ["Title"], True, False), ("n3", 0, 2, "figure", None, "pic", [], True, True), ("n4", 1, 3, "paragraph", None, "aside", [], False, False), ("n5", 1, 4, "other", None, "x", [], True, False)]
    nodes = spark.createDataFrame(rows, library.NODE)
    library.write_nodes(nodes, str(tmp_path / "n"))
    back = library.read_nodes(spark, str(tmp_path / "n"))
    assert sorted(back.collect()) == sorted(nodes.collect())
    got = library.fingerprints(back.withColumn("asset", F.lit(1)), "asset").first()
    assert got["fingerprint"] == hashlib.sha256(b"Title\nBody").hexdigest()
    sha = "abcdef"
    assert spark.range(1).select(library.shard_path(F.lit(sha))).first()[0] == "ab/cd/abcdef"
