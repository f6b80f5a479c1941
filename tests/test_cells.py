"""The index of cells: exact over all of them, recall from a few, large cells, unfit vectors."""

import numpy as np
import pytest
from lodestone.operators import cells as C
from lodestone.operators import dense
from lodestone.plans import registry
from lodestone.session import new_folder
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(30, 16)) * 4
    rows = [(i, [float(x) for x in centers[i % 30] + r.normal(size=16)], int(i % 3)) for i in range(n)]
    # ties, unfit vectors and a large group of equal ones
    rows += [(n + i, rows[0][1], 0) for i in range(n // 2)]
    return [*rows, (-1, None, 0), (-2, [], 0), (-3, [float("nan")] * 16, 0), (-4, [None] * 16, 0), (-5, [1.0, 2.0], 0), (None, rows[0][1], 0), (-6, [0.0] * 16, 0), (-7, rows[1][1], None)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(1500), SCHEMA).withColumn("cell", F.lit("clash")).repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, vectors):
    return C.build(vectors, new_folder(spark), "vec_id", "embedding", cells=30, scope="label")


@pytest.mark.parametrize("block, together, scope", [(2048, 32, None), (40, 1, None), (40, 2, "label")])
def test_all_cells_are_exact(spark, vectors, index, monkeypatch, block, together, scope):
    for name, value in (("BLOCK", block), ("QUERY_BLOCK", block), ("TOGETHER", together)):
        monkeypatch.setattr(C, name, value)
    own = index if scope else C.build(vectors, new_folder(spark), "vec_id", "embedding", cells=7)
    queries = vectors.where("vec_id % 7 = 0 OR vec_id < 0")
    fit = vectors.where("vec_id IS NOT NULL AND size(embedding) = 16" + (" AND label IS NOT NULL" if scope else ""))
    got = C.search(spark, own, queries, 6, "vec_id", "embedding", None, scope)
    want = dense.nearest(spark, queries.where("size(embedding) = 16" + (" AND label IS NOT NULL" if scope else "")), fit, 6, "vec_id", "embedding", scope)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_fit_row_is_in_one_cell(vectors, index, spark):
    stored = [x["id"] for x in index.vectors(spark).collect()]
    assert len(stored) == len(set(stored)) and set(stored) == {x[0] for x in clustered(1500) if x[0] is not None and x[0] not in (-1, -2, -3, -4, -5, -7)}


def test_few_cells_find_clustered_neighbours(spark, vectors, index):
    queries = vectors.where("vec_id % 20 = 0")
    exact = C.search(spark, index, queries, 10, "vec_id", "embedding", None).cache()
    assert C.recall(C.search(spark, index, queries, 10, "vec_id", "embedding", 3), exact, "vec_id") >= 0.9
    assert C.calibrate(spark, index, queries, 10, "vec_id", "embedding", 0.95) <= 4


def test_recall_over_all_queries_of_the_table(spark):
    data = "/root/testdata/sf0.01"
    got, want = (registry.queries()[x](spark, data) for x in ("dense_approximate", "dense_topk"))
    assert C.recall(got, want, "vec_id") >= 0.9


def test_nothing_and_alike(spark):
    none = C.build(spark.createDataFrame([(1, None, 1)], SCHEMA), new_folder(spark), "vec_id", "embedding")
    q = spark.createDataFrame([(1, [1.0, 0.0], 1)], SCHEMA)
    assert C.search(spark, none, q, 3, "vec_id", "embedding").collect() == [] and C.calibrate(spark, none, q, 3, "vec_id", "embedding") == 1
    same = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(9)] + [(9, [0.0, 0.0], 1)], SCHEMA)
    index = C.build(same, new_folder(spark), "vec_id", "embedding")
    assert [x["vec_id"] for x in C.search(spark, index, q, 3, "vec_id", "embedding").orderBy("rank").collect()] == [0, 2, 3]
