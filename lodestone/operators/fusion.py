"""Rank fusion, reranking of the first candidates, and selection by coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant and weights of reciprocal rank fusion; candidates that are reranked; overlap from which a chunk is dropped.
RRF_K, WEIGHTS, RERANKED, OVERLAP = 60, {"exact": 2.0, "lexical": 1.0, "dense": 1.0}, 24, 0.6


def reciprocal_rank_fusion(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Fuses rows (query_id, item, component, rank): query_id, item, score, rank.

    An item scores weight / (k + rank) for each component, summed in the order of the
    weights so that sums are stable; ties go to the smaller item.
    """
    weights = weights or WEIGHTS
    part = lambda name: F.coalesce(F.max(F.when(F.col("component") == name, weights[name] / (k + F.col("rank")))), F.lit(0.0))
    score: Column = sum((part(n) for n in weights), F.lit(0.0))
    fused = ranked.groupBy("query_id", "item").agg(score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return fused.withColumn("rank", F.row_number().over(w))


def rerank(fused: DataFrame, score: Column, most: int = RERANKED) -> DataFrame:
    """New ranks: of the first `most`, those with a score by it, then those without; the rest stays below."""
    head = F.col("rank") <= most
    s = F.when(head, score)
    w = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.desc_nulls_last("rerank_score"), F.desc("score"), "rank")
    return fused.withColumn("rerank_score", s).withColumn("new_rank", F.row_number().over(w))


def select_by_coverage(ranked: DataFrame, top: int, ratio: float = OVERLAP) -> DataFrame:
    """Greedy choice by rank: a row whose interval overlaps a chosen one's of the same document by `ratio` of the shorter is left out.

    Takes (query_id, rank, doc, start, end), a bounded list of candidates per query, and
    returns the chosen rows with their new rank. A fold over each query's list.
    """
    row = F.struct("rank", "doc", "start", "end")
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = lists.schema["rows"].dataType

    def covers(x: Column, y: Column) -> Column:
        share = overlap_share(x["start"], x["end"], y["start"], y["end"])
        return (x["doc"] == y["doc"]) & (share > 0) & (share >= ratio)

    def add(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) < top) & ~F.exists(kept, lambda y: covers(x, y)), F.concat(kept, F.array(x))).otherwise(kept)

    chosen = F.aggregate("rows", F.array().cast(kind), add)
    return lists.select("query_id", F.posexplode(chosen).alias("at", "x")).select("query_id", "x.*", (F.col("at") + 1).alias("new_rank"))


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two intervals as a share of the shorter, at most one unit long intervals counting as one."""
    over = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    least = F.least(F.greatest(F.lit(1), a_end - a_start), F.greatest(F.lit(1), b_end - b_start))
    return F.greatest(over, F.lit(0)) / least

