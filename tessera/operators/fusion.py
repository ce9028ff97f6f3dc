"""Ranked lists: ranks, reciprocal rank fusion, caps, pins and appendices. Lists here hold some tens of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, LEXICAL_WEIGHT, PINNED_WEIGHT = 20, 0.5, 1.5
DECIMALS = 9


def with_rank(hits: DataFrame, score: str, key: str, rank: str = "rank") -> DataFrame:
    """Positions from 1, by score, ties to the smaller key. hits: a list already cut to its best."""
    return hits.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(dense: DataFrame, lexical: DataFrame, key: str = "chunk_id", rrf_k: int = RRF_K, weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """key, score, vector_rank, bm25_rank (0: not in that list), best first. Either list: (key, rank)."""
    both = dense.select(key, F.col("rank").alias("v")).join(lexical.select(key, F.col("rank").alias("b")), key, "full")
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.col(rank) + rrf_k), F.lit(0.0))
    fused = both.select(key, F.round(part("v", 1.0) + part("b", float(weight)), DECIMALS).alias("score"), F.coalesce("v", F.lit(0)).alias("vector_rank"), F.coalesce("b", F.lit(0)).alias("bm25_rank"))
    return fused.orderBy(F.desc("score"), key)


def cap_per_group(hits: DataFrame, group: str, cap: int, top: int, rank: str = "rank") -> DataFrame:
    """At most cap of each group in order of rank, then those put back, in order, up to top; ranks anew."""
    if cap <= 0:
        return hits.filter(F.col(rank) <= top)
    own = F.row_number().over(Window.partitionBy(group).orderBy(rank))
    held = hits.withColumn("__over", (own > cap).cast("int"))
    placed = held.withColumn("__place", F.row_number().over(Window.orderBy("__over", rank)))
    return placed.filter(F.col("__place") <= top).withColumn(rank, F.col("__place")).drop("__over", "__place")


def best_per_group(hits: DataFrame, groups: list[str], rank: str = "rank") -> DataFrame:
    """The first of each group."""
    own = F.row_number().over(Window.partitionBy(*groups).orderBy(rank))
    return hits.withColumn("__own", own).filter("__own = 1").drop("__own")


def merge_pinned(pinned: DataFrame, fused: DataFrame, key: str, top: int, rank: str = "rank") -> DataFrame:
    """Pinned hits first, then the others without them, up to top; all pinned ones stay, even beyond it."""
    rest = fused.join(pinned.select(key), key, "left_anti")
    both = pinned.withColumn("__arm", F.lit(0)).unionByName(rest.withColumn("__arm", F.lit(1)))
    placed = both.withColumn("__place", F.row_number().over(Window.orderBy("__arm", rank, key)))
    return placed.filter((F.col("__arm") == 0) | (F.col("__place") <= top)).withColumn(rank, F.col("__place")).drop("__arm", "__place")


def append_new(hits: DataFrame, more: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """hits, then those of more that are not among them; the list may grow past its limit."""
    rest = more.join(hits.select(key), key, "left_anti")
    both = hits.withColumn("__arm", F.lit(0)).unionByName(rest.withColumn("__arm", F.lit(1)))
    return both.withColumn("__place", F.row_number().over(Window.orderBy("__arm", rank, key))).withColumn(rank, F.col("__place")).drop("__arm", "__place")
