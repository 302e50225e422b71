"""Unions, semi-joins and rank fusion of hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """All hits of either side, repeats included."""
    return left.unionByName(right)


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each id once, with its best score."""
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "source_op")
    return left.unionByName(right).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def then(first: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search held to what first found for each query: it gets the pairs (query_id, id) and ranks among them only."""
    return search(first.select("query_id", "id").distinct())


def fuse_rrf(hits: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal ranks summed over legs, a leg being a source_op and its index."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source_op", "leg").orderBy(F.desc("score"), "id")))
    w: Column = F.lit(1.0)
    for op, x in (weights or {}).items():
        w = F.when(F.col("source_op") == op, F.lit(float(x))).otherwise(w)
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(w / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))
    return fused.select("query_id", "id", "score", F.lit("Fused").alias("source_op"), F.lit("fused").alias("leg"))


def fuse_with_provenance(hits: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """As fuse_rrf over legs, with each id's legs in order; a leg of weight 0 adds nothing but is named."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "leg").orderBy(F.desc("score"), "id")))
    w: Column = F.lit(1.0)
    for leg, x in weights.items():
        w = F.when(F.col("leg") == leg, F.lit(float(x))).otherwise(w)
    out = ranked.groupBy("query_id", "id").agg(F.round(F.sum(w / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"))
    return out


def degraded_fallback(preferred: Callable[[], DataFrame], fallback: Callable[[], DataFrame], run: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What preferred makes, or on an error what fallback makes, marked degraded.

    Plans fail while they are made; rows fail when they are read. run (sources.tables.saved, say) makes the
    preferred rows here, so that either failure falls back.
    """
    try:
        rows = preferred()
        return (run(rows) if run else rows).withColumn("degraded", F.lit(False))
    except Exception:  # noqa: BLE001 any failure of the preferred plan is what this is for
        return fallback().withColumn("degraded", F.lit(True))


def floored_top(hits: DataFrame, n: int, leg: str, floor: int) -> DataFrame:
    """The n best, of which at least floor are of one leg where it has them; hits without a leg count for it."""
    own = F.coalesce(F.col("leg"), F.lit(leg)) == leg
    order = [F.desc("score"), F.col("id")]
    inside = hits.withColumn("_own", own).withColumn("_in_leg", F.row_number().over(Window.partitionBy("query_id", "_own").orderBy(*order)))
    reserved = F.col("_own") & (F.col("_in_leg") <= min(floor, n))
    chosen = inside.withColumn("_kept", reserved).withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_kept"), *order))).where(F.col("_place") <= n)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_own", "_in_leg", "_kept", "_place")
