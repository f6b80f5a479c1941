"""Approximate nearest vectors: an index of cells, of which a search reads the nearest few.

Centroids are fitted on a bounded sample; every vector is assigned to its nearest centroid
and stored in that cell's folder. A search ranks a query's cells by the distance of their
centroids, reads the first `probes`, and ranks their vectors by their true distances. With
probes=None it reads all cells, and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import written

#: Vectors that centroids are fitted on, about, chosen by a hash of their ids.
SAMPLE = 50_000
#: Cells of an index, at most; below that their number is the root of the number of vectors.
CELLS = 4096
#: Vectors and queries of a block, and blocks of a cell that meet a block of queries in one task.
BLOCK, QUERY_BLOCK, TOGETHER = 2048, 1024, 32
#: Queries that calibrate() measures recall on, about.
MEASURED = 200


@dataclass(frozen=True)
class Cells:
    """An index in a folder: vectors in `path` by cell, of one length; centroids as unit rows, cell by cell."""

    path: str
    kind: str
    centroids: np.ndarray

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id bigint, scope bigint, v array<{self.kind}>, cell int").parquet(self.path)


def _clean(df: DataFrame, id_col: str, vec_col: str, scope: str | None) -> DataFrame:
    """id, scope, v of rows with an id, a vector of finite components and, if scopes are asked for, one of these."""
    out = df.select(df[id_col].cast("long").alias("id"), (df[scope] if scope else F.lit(0)).cast("long").alias("scope"), df[vec_col].alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where("id IS NOT NULL AND scope IS NOT NULL AND size(v) > 0").where(fine)


def _unit(column: pa.ListArray) -> np.ndarray:
    """Vectors as unit rows; zeros stay zeros."""
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _nearest_cells(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of unit rows, nearest first; ties to the smaller cell."""
    return np.argsort(-np.round(m @ centroids.T, 9), axis=1, kind="stable")[:, :n]


def build(vectors: DataFrame, path: str, id_col: str, vec_col: str, cells: int | None = None, scope: str | None = None, seed: int = 7) -> Cells:
    """Writes the index of vectors into a new folder: every row is in exactly one cell.

    Null ids (and scopes, if named), vectors that are null, empty or hold a null or non-finite component, and those
    of another length than the most frequent one take no part. The sample and CELLS
    centroids are what is held whole. A cell of any share of the rows is dealt to several
    tasks and files.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    rows = _clean(vectors, id_col, vec_col, scope)
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if most is None:
        rows.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(path)
        return Cells(path, kind, np.zeros((0, 0)))
    rows = rows.where(F.size("v") == most["dim"])
    share = max(1, 1_000_000 * SAMPLE // most["n"])
    sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share) & F.exists("v", lambda x: x != 0)).select(array_to_vector("v").alias("features"))
    centroids = np.eye(1, most["dim"])
    if not sample.isEmpty():
        wanted = cells or max(1, min(CELLS, round(most["n"] ** 0.5)))
        model = KMeans(k=max(2, wanted), seed=seed, maxIter=12, distanceMeasure="cosine").fit(sample)
        centroids = np.array(model.clusterCenters(), np.float64)
        centroids /= np.sqrt((centroids * centroids).sum(1, keepdims=True))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest_cells(_unit(batch.column(2)), centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "scope", "v", "cell"])

    placed = rows.mapInArrow(assign, f"id bigint, scope bigint, v array<{kind}>, cell int")
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(path)
    return Cells(path, kind, centroids)


def _packed(most: int):
    """Blocks of rows of a cell: ids, scopes and unit rows as bytes; rows come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column(3))
            ends = [*np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)] if len(cell) else []
            start = 0
            for end in ends:
                for a in range(start, end, most):
                    part = batch.slice(a, min(most, end - a))
                    m = _unit(part.column(2))
                    ids, scopes = ([np.asarray(part.column(i)).tolist()] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array([cell[a]], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(scopes, pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["cell", "ids", "scopes", "mat"])
                start = end

    return run


PACKED = "cell int, ids array<bigint>, scopes array<bigint>, mat binary"


def search(spark: SparkSession, index: Cells, queries: DataFrame, k: int, id_col: str, vec_col: str, probes: int | None = 8, scope: str | None = None) -> DataFrame:
    """The k nearest vectors of each query in its `probes` nearest cells (None: all): query_id, id_col, distance, rank.

    With a scope column, only vectors of the query's scope. A query isn't its own candidate;
    ties go to the smaller id. Queries of unfit vectors (see build) find nothing. Blocks of
    a cell meet blocks of the queries that probe it; a large cell's are dealt to several
    tasks, each pair gives at most k rows a query.
    """
    centroids = index.centroids
    asked = _clean(queries, id_col, vec_col, scope).where(F.size("v") == (centroids.shape[1] or -1))
    n = min(probes or len(centroids), len(centroids))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest_cells(_unit(batch.column(2)), centroids, n)
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(cell.ravel().astype(np.int32))], names=["id", "scope", "v", "cell"])

    kind = dict(asked.dtypes)["v"]
    probing = asked.mapInArrow(choose, f"id bigint, scope bigint, v {kind}, cell int")
    probing = probing.hint("rebalance", "cell").sortWithinPartitions("cell", "id").mapInArrow(_packed(QUERY_BLOCK), PACKED)
    probing = written(probing)
    cells = [x[0] for x in probing.select("cell").distinct().collect()]  # at most CELLS numbers
    vectors = index.vectors(spark).where(F.col("cell").isin(cells)).select("id", "scope", "v", "cell")
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count("*") / (BLOCK * TOGETHER)).cast("int").alias("stripes"))
    sizes = written(sizes)  # a row for each cell, at most CELLS
    blocks = vectors.sortWithinPartitions("cell", "id").mapInArrow(_packed(BLOCK), PACKED).join(F.broadcast(sizes), "cell")
    first = F.element_at("ids", 1)
    blocks = blocks.withColumn("stripe", F.pmod(F.xxhash64(first), F.col("stripes")).cast("int")).drop("stripes")
    left = probing.join(F.broadcast(sizes), "cell").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    left = left.select("cell", "stripe", F.col("ids").alias("q_ids"), F.col("scopes").alias("q_scopes"), F.col("mat").alias("q_mat"))
    pairs = left.join(blocks, ["cell", "stripe"]).select("q_ids", "q_scopes", "q_mat", "ids", "scopes", "mat")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_scopes, ids, scopes = (np.array(r[x]) for x in ("q_ids", "q_scopes", "ids", "scopes"))
                q, c = np.frombuffer(r["q_mat"]).reshape(len(q_ids), -1), np.frombuffer(r["mat"]).reshape(len(ids), -1)
                d = np.round(1 - q @ c.T, 9)
                d[(q_ids[:, None] == ids[None, :]) | (q_scopes[:, None] != scopes[None, :])] = np.inf
                # rows within the k-th distance, ties included, then by distance and id
                least = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                at, to = np.nonzero((d <= least[:, None]) & np.isfinite(d))
                order = np.lexsort((ids[to], d[at, to], at))
                at, to = at[order], to[order]
                starts = np.searchsorted(at, at)
                keep = np.arange(len(at)) - starts < k
                at, to = at[keep], to[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[to]), pa.array(d[at, to])], names=["query_id", "id", "distance"])

    found = pairs.mapInArrow(meet, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "distance", "rank")


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> float:
    """The share of the exact neighbours that were found (1 if there are none)."""
    hit = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def calibrate(spark: SparkSession, index: Cells, queries: DataFrame, k: int, id_col: str, vec_col: str, least: float = 0.95, scope: str | None = None) -> int:
    """The fewest probes, of 1, 2, 4, ..., that reach a recall against all cells on a sample of queries.

    The sample of about MEASURED queries is chosen by a hash of their ids. All cells always do.
    """
    share = max(1, 1_000_000 * MEASURED // max(1, queries.count()))
    some = written(queries.where(F.pmod(F.xxhash64(queries[id_col].cast("long")), F.lit(1_000_000)) < share))
    exact = written(search(spark, index, some, k, id_col, vec_col, None, scope))
    probes = 1
    while probes < len(index.centroids) and recall(search(spark, index, some, k, id_col, vec_col, probes, scope), exact, id_col) < least:
        probes *= 2
    return min(probes, max(1, len(index.centroids)))
