"""Nearest vectors by cosine distance, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates or queries.
BLOCK = 2048


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            rows = [(a, b, v) for a, b, v in zip(*(c.to_pylist() for c in part.columns), strict=True) if v and all(x is not None and np.isfinite(x) for x in v)]
            for dim in {len(v) for *_, v in rows}:
                some = [r for r in rows if len(r[2]) == dim]
                m = np.array([r[2] for r in some], np.float64)
                m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([[r[0] for r in some]]), pa.array([[r[1] for r in some]], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["ids", "scopes", "dim", "mat"])


def nearest(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int, id_col: str, vec_col: str, scope: str | None = None) -> DataFrame:
    """The k nearest candidates of each query: query_id, id_col, distance, rank; ties to the smaller id.

    With a scope column, only candidates of the query's scope. A query isn't its own
    candidate. Vectors that are null, empty or hold a null or non-finite component take no
    part. Blocks of the stated queries meet blocks of candidates; each pair of blocks gives
    k rows a query at most.
    """
    column = F.col(scope).cast("long") if scope else F.lit(0).cast("long")
    blocks = lambda x: x.select(F.col(id_col).cast("long").alias("id"), column.alias("scope"), F.col(vec_col).alias("v")).mapInArrow(_pack, "ids array<long>, scopes array<long>, dim int, mat binary")
    stripes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    right = blocks(candidates).withColumn("stripe", F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int"))
    left = blocks(queries).select(F.col("ids").alias("q_ids"), F.col("scopes").alias("q_scopes"), F.col("dim").alias("q_dim"), F.col("mat").alias("q_mat"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, c = (np.frombuffer(r[x], np.float64).reshape(-1, r["dim"]) for x in ("q_mat", "mat"))
                q_ids, c_ids = np.array(r["q_ids"]), np.array(r["ids"])
                d = np.round(1 - q @ c.T, 9)
                out = (q_ids[:, None] == c_ids[None, :]) | (np.array(r["q_scopes"])[:, None] != np.array(r["scopes"])[None, :])
                d[out] = np.inf
                order = np.lexsort((np.broadcast_to(c_ids, d.shape), d), axis=1)[:, :k]
                at = np.repeat(np.arange(len(q_ids)), order.shape[1])
                to = order.ravel()
                fine = np.isfinite(d[at, to])
                at, to = at[fine], to[fine]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(c_ids[to]), pa.array(d[at, to])], names=["query_id", "id", "distance"])

    pairs = left.join(right, "stripe").where("dim = q_dim").select("q_ids", "q_scopes", "q_mat", "ids", "scopes", "dim", "mat")
    found = pairs.mapInArrow(meet, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "distance", "rank")
