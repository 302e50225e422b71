"""Lookup joins from hits to their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import temporal


def live(as_of: int | None):
    """Rows of the store now, or as it was at a time."""
    return F.col("sys_to").isNull() if as_of is None else temporal.system_at(as_of)


def hydrate(hits: DataFrame, chunks: DataFrame, episodes: DataFrame, as_of: int | None = None) -> DataFrame:
    """Hits with text and source. Missing or closed chunks and chunks of closed episodes go; a missing episode leaves an empty source."""
    open_chunks = chunks.where(live(as_of)).select("id", "episode_id", "text")
    state = episodes.select(F.col("id").alias("episode_id"), "source", live(as_of).alias("_live"))
    out = hits.join(open_chunks, "id").join(state, "episode_id", "left")
    return out.where(F.coalesce("_live", F.lit(True))).withColumn("source", F.coalesce("source", F.lit(""))).drop("_live")


def hydrate_mixed(hits: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """A chunk's text, or else a fact's, whose source is its predicate."""
    c = chunks.select("id", F.col("text").alias("_chunk"), F.col("source").alias("_source"))
    f = facts.select("id", "fact_text", "predicate")
    out = hits.join(c, "id", "left").join(f, "id", "left").where("_chunk IS NOT NULL OR fact_text IS NOT NULL")
    return out.select(*hits.columns, F.coalesce("_chunk", "fact_text").alias("text"), F.when(F.col("_chunk").isNotNull(), F.col("_source")).otherwise(F.concat(F.lit("fact:"), "predicate")).alias("source"))
