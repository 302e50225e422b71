"""Recall as services offer it: whole pipelines from stated queries to what is shown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import combine, graph, hydrate, leaves, rescore
from palimpsest.plans import tree

#: Hits, characters and least scores of what is put into a prompt, into a tool's call and at a session's start.
PROMPT, TOOL, DIGEST = (5, 1600, 0.55), (3, 900, 0.60), (8, 2000, 0.0)
#: Fixed value: entries that a verify queue may hold before recall tells that it lags.
MOST_WAITING = 1000
#: Fixed value: the age from which a digest is built anew.
DIGEST_AGE = 15 * 60_000


def ranked(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long"))


def rescored(hits: DataFrame, chunks: DataFrame, episodes: DataFrame, now: int, ledger: DataFrame | None = None, boosts: DataFrame | None = None, as_of: int | None = None, grows: bool = False) -> DataFrame:
    """Hits hydrated, then scored by recency, by the ledger's prior and by boosts, in this order; rank is that of the last score. grows: as in recency."""
    out = hydrate.hydrate(hits, chunks, episodes, as_of).join(episodes.select("id", "valid_from"), "id", "left")
    out = rescore.recency(out, "valid_from", now, grows=grows)
    out = out if ledger is None else rescore.ledger_prior(out, ledger)
    return ranked(out if boosts is None else rescore.boosted(out, boosts))


def lagging(hits: DataFrame, queue: DataFrame, most: int = MOST_WAITING) -> DataFrame:
    """degraded where a hit was already, and everywhere if more of a queue's entries (done) wait than that."""
    waiting = queue.agg(F.count(F.when(~F.col("done"), 1)).alias("_waiting"))
    own = F.col("degraded") if "degraded" in hits.columns else F.lit(False)
    return hits.crossJoin(F.broadcast(waiting)).withColumn("degraded", F.coalesce(own, F.lit(False)) | (F.col("_waiting") > most)).drop("_waiting")  # one row


def fused_natively(vector: DataFrame, keyword: DataFrame, k: int, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Both searches of one index as one: weighted reciprocal ranks, the k best stretched to 0 .. 1."""
    fused = combine.fuse_rrf(combine.both(vector, keyword), weights={"Vector": weights[0], "Keyword": weights[1]})
    return leaves.min_max(leaves.top(fused, k).drop("rank"))


def recall(c: tree.Context, chunks: DataFrame, episodes: DataFrame, k: int = 5, prefix: str = "", snippet: int = 240) -> DataFrame:
    """A service's recall: the production plan, wider if only sources that begin with a prefix are wanted, with snippets on one line.

    Empty queries find nothing. k: 5 unless asked, at most 100 candidates.
    """
    k = k or 5
    wide = max(1, min(100, max(8 * k, 32) if prefix else k))
    asked = replace(c, texts=c.texts.where(F.length(F.trim("text")) > 0))
    hits = tree.compile_plan(tree.production(wide), asked).join(asked.texts.select("query_id").distinct(), "query_id", "left_semi")
    shown = hydrate.hydrate(hits.select("query_id", "id", "score"), chunks, episodes, c.as_of).where(F.col("source").startswith(prefix))
    return ranked(shown).where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "source", T.trimmed(T.single_line(F.col("text")), snippet).alias("snippet"))


def recall_by_graph(c: tree.Context, names: DataFrame, k: int = 30, hops: int = 2) -> DataFrame:
    """Vector hits fused with walks from the vertices (name, id) that a query names; a query that names none is answered by vectors alone, marked degraded."""
    seeds = graph.entity_links(c.texts, names).select("query_id", "id", F.lit(1.0).alias("confidence"))
    vector = leaves.vector_search(c.vectors, c.vector_tables["chunks"], k)
    both = combine.both(vector, graph.graph_hits(seeds, c.edges, hops, k).select(*vector.columns))
    named = seeds.select("query_id").distinct()
    fused = combine.fuse_rrf(both.join(named, "query_id", "left_semi")).withColumn("degraded", F.lit(False))
    alone = vector.join(named, "query_id", "left_anti").withColumn("degraded", F.lit(True))
    return fused.unionByName(alone).select("query_id", "id", "score", "degraded")


def injected(vector: DataFrame, keyword: DataFrame, sources: DataFrame, limits: tuple[int, int, float] = PROMPT) -> DataFrame:
    """What is put before a model: up to four times as many candidates as shown, those of a least score, keywords where vectors find none.

    sources: id, source and snippet of the rows that may be shown. Returns query_id and context.
    """
    hits, chars, least = limits
    near = leaves.top(vector, 4 * hits).where(F.col("score") >= least)
    instead = leaves.top(keyword, 4 * hits).where(F.col("score") >= least).join(near.select("query_id").distinct(), "query_id", "left_anti")
    shown = near.unionByName(instead).join(sources.select("id", "source", "snippet"), "id")
    return rescore.rendered(ranked(shown).where(F.col("rank") <= hits), chars)


def latest_writes(writes: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last content of each key (key, id, at, content) of a scratchpad, now or as of a time; one written null is gone."""
    seen = writes if as_of is None else writes.where(F.col("at") <= as_of)
    last = F.max_by(F.struct("id", "content"), F.struct("at", "id"))
    return seen.groupBy("key").agg(last.alias("l")).select("key", "l.id", "l.content").where("content IS NOT NULL")


def grepped(hits: DataFrame, episodes: DataFrame, prefix: str, n: int = 8) -> DataFrame:
    """Both legs fused, within sources that begin with a prefix, each episode once."""
    own = episodes.where(F.col("source").startswith(prefix)).select("id", "source")
    return leaves.top(combine.fuse_rrf(hits).join(own, "id"), n).select("query_id", "rank", "id", "source", "score")


def drained(events: DataFrame, prefix: str, most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(own, foreign): of the first events (offset, source) of a queue those of a scratchpad, and the others, which go back."""
    first = events.orderBy("offset").limit(most)
    own = F.col("source").startswith(prefix)
    return first.where(own), first.where(~own)


def paths(writes: DataFrame, prefix: str = "", as_of: int | None = None) -> DataFrame:
    """The paths of a session's files under a prefix, in order."""
    return latest_writes(writes, as_of).where(F.col("key").startswith(prefix)).select(F.col("key").alias("path")).orderBy("path")


def edited(writes: DataFrame, key: str, old: str, new: str, now: int) -> DataFrame:
    """One write more: the file's last content with the first place of a text replaced; no row if it isn't there."""
    at = F.position(F.lit(old), F.col("content"))
    body = F.concat(F.substring("content", 1, at - 1), F.lit(new), F.substring(F.col("content"), at + len(old), F.lit(2147483647)))
    return latest_writes(writes).where((F.col("key") == key) & (at > 0)).select("key", (F.col("id") + 1).alias("id"), F.lit(now).alias("at"), body.alias("content"))


def archive_recall(hits: DataFrame, episodes: DataFrame, matched: Column, n: int = 8, wide: int = 24) -> DataFrame:
    """Messages of a channel, a user or a meeting: each leg's best `wide` among them, fused, the n best."""
    legs = hits.join(episodes.where(matched).select("id", "source"), "id")
    return leaves.top(combine.fuse_rrf(leaves.top(legs, wide, "query_id", "source_op", "leg").drop("rank", "source")), n).select("query_id", "rank", "id", "score")


def feature_card(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, n: int = 10) -> DataFrame:
    """Chunks, symbols, commits and the like fused by reciprocal ranks, each hit with the legs that found it."""
    named = None
    for name, hits in legs.items():
        one = hits.select("query_id", "id", "score", F.lit(name).alias("leg"))
        named = one if named is None else named.unionByName(one)
    return leaves.top(combine.fuse_with_provenance(named, weights or {}), n)


def served_digests(cache: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Digests (scope, built_at, built_for, digest) for requests (scope, hits): any that was built for so many hits is served; rebuild tells that it is old or missing."""
    fit = asked.join(cache, "scope", "left").withColumn("_fit", F.coalesce(F.col("built_for") >= F.col("hits"), F.lit(False)))
    return fit.select("scope", F.when(F.col("_fit"), F.col("digest")).alias("digest"), (~F.col("_fit") | (F.lit(now) - F.col("built_at") >= DIGEST_AGE)).alias("rebuild"))


def layered(recall_: Callable[..., DataFrame], *layers: Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]) -> Callable[..., DataFrame]:
    """A recall wrapped in layers, the first outermost; a layer takes the call inside it and gives the call around it."""
    out = recall_
    for layer in reversed(layers):
        out = wraps(recall_)(layer(out))
    return out
