"""Rescoring of hydrated hits: recency, priors, staleness, rerank, curation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import temporal as time
from palimpsest.functions import text as T
from palimpsest.functions.values import rounded

#: How sources rank in a context (the longest matching beginning of a source or of its kind), and kinds that never enter it.
SOURCE_PRIORITY = (("distilled:", 95), ("decision:", 90), ("constraint:", 88), ("fix:", 87), ("preference:", 86), ("edit:", 85))
KIND_PRIORITY = (("tool_call:post", 75), ("post_tool_use", 70), ("tool_call:pre", 55), ("pre_tool_use", 45))
NEVER_SHOWN = ("memory_injection", "turn_feedback", "session_start", "stop", "memory_feedback")


def recency(hits: DataFrame, at_col: str, now: int, half_life_s: float = 7 * 86400.0, grows: bool = False) -> DataFrame:
    """Halved each half-life of age; a time of zero leaves the score, and so does one to come, unless scores grow: then it doubles each half-life ahead."""
    age = F.when(F.col(at_col) > 0, (F.lit(now) - F.col(at_col)) / F.lit(1000.0))
    return hits.withColumn("score", rounded(time.half_life_score(F.col("score"), age, half_life_s, grows), 6))


def recency_power(hits: DataFrame, at_col: str, now: int, decay: float = 0.5) -> DataFrame:
    return hits.withColumn("score", F.round(time.power_law_score(F.col("score"), (F.lit(now) - F.col(at_col)) / F.lit(1000.0), decay), 6))


def ledger_prior(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds a logistic prior of the activation (id, activation) of rows that are not archived."""
    live = ledger.where("archived_at IS NULL").select("id", "activation")
    prior = F.when(F.col("activation").isNotNull(), time.logistic_prior(F.col("activation"))).otherwise(0.0)
    return hits.join(live, "id", "left").withColumn("score", rounded(F.col("score") + prior, 6)).drop("activation")


def boosted(hits: DataFrame, boosts: DataFrame, each: float = 0.25) -> DataFrame:
    """Adds each boost of an id (one row a boost)."""
    n = boosts.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return hits.join(n, "id", "left").withColumn("score", rounded(F.col("score") + F.lit(each) * F.coalesce("_n", F.lit(0)), 6)).drop("_n")


def stale(hits: DataFrame, changed: list[str], files_col: str = "files", factor: float = 0.7) -> DataFrame:
    """Hits anchored in changed files count for less."""
    hit = F.coalesce(F.arrays_overlap(F.col(files_col), F.array(*map(F.lit, changed))), F.lit(False))
    return hits.withColumn("score", F.round(F.when(hit, F.col("score") * factor).otherwise(F.col("score")), 6))


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], Column] | None, top_in: int = 30, min_score: float | None = None) -> DataFrame:
    """The best top_in of each query (with text and query_text) scored anew; without a scorer nothing changes."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pool = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_in).drop("_n")
    if scorer is None:
        return pool
    out = pool.withColumn("score", F.round(scorer(pool), 6)).withColumn("source_op", F.lit("Reranked"))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def token_overlap(pool: DataFrame) -> Column:
    """The share of a query's distinct terms that a text has."""
    q, t = F.array_distinct(T.tokens(F.col("query_text"))), F.array_distinct(T.tokens(F.col("text")))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def source_priority(source: Column) -> Column:
    kind = F.expr("substring(source, instr(source, ':') + 1)")
    out = F.lit(50)
    for x, p in KIND_PRIORITY:
        out = F.when(kind == x, p).otherwise(out)
    for x, p in reversed(SOURCE_PRIORITY):
        out = F.when(source.startswith(x), p).otherwise(out)
    return out


def curated(hits: DataFrame, most: int) -> DataFrame:
    """Hits for a context: shown kinds only, by source, score and id, each snippet once for its class."""
    kind = F.expr("substring(source, instr(source, ':') + 1)")
    shown = hits.where(~kind.isin(*NEVER_SHOWN)).withColumn("priority", source_priority(F.col("source")))
    order = [F.desc("priority"), F.desc("score"), F.col("id")]
    same = Window.partitionBy(T.source_class(F.col("source")), F.lower("snippet")).orderBy(*order)
    once = shown.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return once.orderBy(*order).limit(most)


def rendered(hits: DataFrame, most_chars: int, order_col: str = "rank") -> DataFrame:
    """Each query's snippets as lines within a budget of characters."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_col, "snippet"))), lambda x: x["snippet"]), "\n")
    return hits.groupBy("query_id").agg(T.trimmed(lines, most_chars).alias("context"))
