"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks, and each block of queries meets each block of candidates
once a pass: the blocks of queries are dealt to stripes of candidates, an equi-join. A pass
scores everything and counts the scores of each query in a histogram over the range that
still holds its k-th score. Summed over all blocks, the histogram names the bucket with the
k-th score, which is the next range, until a range is one score wide. A last pass keeps
what is above the k-th score, and of what equals it the smallest ids.

Of a block's histogram only the buckets from its own k-th score upward are sent: the k-th
score of all is no smaller, so the counts that decide are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors in a block of queries or candidates, and buckets of a histogram.
QUERIES, CANDIDATES, BUCKETS = 512, 4096, 4096
#: Vectors with a component this large once scaled have blocks of their own, kept unscaled and scored in whole numbers of any size.
LARGE = 2**24
#: Scores beyond a long count as the last ones that fit; the least long is kept for a query's own row.
MOST = 2**63 - 1

BLOCK = "ids binary, mat binary, n int, dim int, top double"


def _valid(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of a list column by dimension: {dim: (row numbers, matrix)} of vectors without null or non-finite components."""
    column = column.cast(pa.list_(pa.float64()))
    counts = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = counts.cumsum()
    out = {}
    for dim in np.unique(counts[counts > 0]).tolist():
        rows = np.flatnonzero(counts == dim)
        mat = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        out[dim] = rows, mat
    return counts, out


def _blocks(df: DataFrame, id_col: str, vec_col: str, scale: int, rows: int) -> DataFrame:
    """Blocks of at most `rows` scaled vectors: ids, matrix, their number, dimension, largest absolute component (infinite: large ones, not scaled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}

        def out(dim: int, large: bool, ids: np.ndarray, mat: np.ndarray) -> pa.RecordBatch:
            values = [[ids.tobytes()], [mat.astype("<f8").tobytes()], [len(ids)], [dim], [float("inf") if large else float(np.abs(mat).max())]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["ids", "mat", "n", "dim", "top"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim, (at, mat) in _valid(batch.column(1))[1].items():
                fine = np.isfinite(mat).all(1)
                large = (np.abs(mat) > LARGE / scale).any(1)
                for key, part in (((dim, False), fine & ~large), ((dim, True), fine & large)):
                    kept.setdefault(key, []).append((ids[at[part]].astype("<i8"), mat[part] if key[1] else np.floor(mat[part] * scale)))
                    while sum(len(x) for x, _ in kept[key]) >= rows:
                        a, m = (np.concatenate(x) for x in zip(*kept[key], strict=True))
                        yield out(*key, a[:rows], m[:rows])
                        kept[key] = [(a[rows:], m[rows:])]
        for key, parts in kept.items():
            a, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(a):
                yield out(*key, a, m)

    return df.where(df[id_col].isNotNull() & df[vec_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[vec_col].alias("vec")).mapInArrow(run, BLOCK)


def _whole(mat: np.ndarray, top: float, scale: int) -> np.ndarray:
    """A block's scaled components as Python's whole numbers; above 2**53 a number has no fraction, so scaling is exact."""
    of = (lambda v: int(v) * scale if abs(v) > 2**53 else int(np.floor(v * scale))) if np.isinf(top) else int
    return np.array([[of(v) for v in row] for row in mat.tolist()], object)


def _scores(row: dict, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries and the candidates of a pair of blocks, and their scores; a query's own row has the least one."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    q = np.frombuffer(row["q_mat"], "<f8").reshape(len(q_ids), -1)
    c = np.frombuffer(row["mat"], "<f8").reshape(len(c_ids), -1)
    if np.isfinite(row["q_top"]) and np.isfinite(row["top"]) and q.shape[1] * row["q_top"] * row["top"] < 2**53:
        s = (q @ c.T).astype(np.int64)  # exact: all sums are whole numbers below 2**53
    else:
        s = _whole(q, row["q_top"], scale) @ _whole(c, row["top"], scale).T
        s = np.minimum(np.maximum(s, -MOST), MOST).astype(np.int64)
    s[q_ids[:, None] == c_ids[None, :]] = np.iinfo(np.int64).min
    return q_ids, c_ids, s


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    return s.min(1) if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, -k]


def _map(df: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = fn(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return df.mapInArrow(run, schema)


def top_k(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k candidates of highest inner product for each query, ties to the smaller id.

    Components are floor(scale * x). Returns query_id, rank (from 1), vec_id, score. A
    candidate with the query's own id is left out; a query with fewer than k candidates
    gets all. Rows with a null id, a null or empty vector, a null or non-finite component
    take no part; a score beyond a long counts as the largest or (its negative) the least one,
    so that such scores tie; vectors of unlike lengths don't meet. A
    repeated candidate counts as often as it occurs, a repeated query is answered as often
    (under the same query_id). Empty tables give no rows; other columns are ignored.
    """
    n = queries.count()
    q = _blocks(queries.repartition(max(1, -(-n // QUERIES))), id_col, vec_col, scale, QUERIES).withColumn("qb", F.monotonically_increasing_id())
    q = checkpointed(q.select("qb", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), F.col("n").alias("q_n"), F.col("dim").alias("q_dim"), F.col("top").alias("q_top")))
    stripes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = checkpointed(_blocks(candidates, id_col, vec_col, scale, CANDIDATES).withColumn("stripe", F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int")))
    bound = c.agg(F.max(F.col("dim") * F.col("top"))).first()[0]
    reach = (q.agg(F.max("q_top")).first()[0] or 0.0) * (bound or 0.0)
    reach = min(int(reach) + 1, MOST) if reach < MOST else MOST

    # by query: [low, low + span) holds the k-th score, which is the need-th from the range's top
    span = 2 * reach + 1
    state = q.select("qb", F.transform(F.sequence(F.lit(0), F.col("q_n") - 1), lambda i: F.struct(i.alias("at"), F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("all"))).alias("state"))

    def met(state: DataFrame) -> DataFrame:
        dealt = q.join(state, "qb").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        return dealt.join(c, "stripe").where(F.col("dim") == F.col("q_dim")).drop("stripe", "dim", "q_dim", "n")

    while span > 1:
        width = -(-span // BUCKETS)

        def histogram(row: dict, span: int = span, width: int = width) -> list:
            _, _, s = _scores(row, scale)
            own = s == np.iinfo(np.int64).min
            # differences of longs fit one only within half of their range
            kind = np.int64 if span < 2**61 and abs(s[~own]).max(initial=0) < 2**61 else object
            low = np.array([x["low"] for x in row["state"]], kind)
            bucket_of = lambda x, low: np.where(x < low, -1, np.minimum((np.maximum(x.astype(kind), low) - low) // width, BUCKETS)).astype(np.int64)
            bucket = bucket_of(s, low[:, None])
            bucket[own | (s.astype(kind) >= low[:, None] + span)] = BUCKETS
            at, _ = np.nonzero(keep := (bucket >= 0) & (bucket < BUCKETS) & (bucket >= bucket_of(_kth(s, k), low)[:, None]))
            both, count = np.unique(at * BUCKETS + bucket[keep], return_counts=True)
            return [np.full(len(both), row["qb"]), (both // BUCKETS).astype(np.int32), both % BUCKETS, count.astype(np.int64)]

        counts = _map(met(state), histogram, "qb bigint, at int, bucket bigint, n bigint", ["qb", "at", "bucket", "n"]).groupBy("qb", "at", "bucket").agg(F.sum("n").alias("n"))
        old = state.select("qb", F.explode("state").alias("s")).select("qb", "s.*")
        from_top = Window.partitionBy("qb", "at").orderBy(F.desc("bucket"))
        found = (
            counts.withColumn("above", F.sum("n").over(from_top) - F.col("n"))
            .join(old, ["qb", "at"])
            .where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
            .select("qb", "at", (F.col("low").cast("decimal(38,0)") + F.col("bucket") * F.lit(width).cast("decimal(25,0)")).cast("long").alias("new"), (F.col("need") - F.col("above")).alias("left"))
        )
        # a query with fewer than k candidates finds no bucket: it keeps them all
        fresh = old.join(found, ["qb", "at"], "left").select(
            "qb", "at", F.coalesce("new", "low").alias("low"), F.coalesce("left", "need").alias("need"), (F.col("all") | F.col("new").isNull()).alias("all")
        )
        state = checkpointed(fresh.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("at", "low", "need", "all"))).alias("state")))
        span = width

    def select(row: dict) -> list:
        q_ids, c_ids, s = _scores(row, scale)
        least = np.iinfo(np.int64).min
        value = np.array([least if x["all"] else x["low"] for x in row["state"]], np.int64)[:, None]
        at, to = np.nonzero((s > value) & (s != least))
        tie_at, tie_to = np.nonzero((s == value) & (s != least))
        # of equal scores, a block gives no more than are needed, by the smallest ids
        order = np.lexsort((c_ids[tie_to], tie_at))
        tie_at, tie_to = tie_at[order], tie_to[order]
        need = np.array([x["need"] for x in row["state"]], np.int64)
        first = np.arange(len(tie_at)) - np.searchsorted(tie_at, tie_at)
        few = first < need[tie_at]
        at, to = np.concatenate([at, tie_at[few]]), np.concatenate([to, tie_to[few]])
        return [np.full(len(at), row["qb"]), at.astype(np.int32), q_ids[at], c_ids[to], s[at, to]]

    best = Window.partitionBy("qb", "at").orderBy(F.desc("score"), "vec_id")
    rows = _map(met(state), select, "qb bigint, at int, query_id bigint, vec_id bigint, score bigint", ["qb", "at", "query_id", "vec_id", "score"])
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
