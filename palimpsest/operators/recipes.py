"""Task-shaped compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import temporal
from palimpsest.functions.filters import ValidTimeRange
from palimpsest.operators import combine, leaves, rescore

#: The sections of a profile, longest-lived first.
SECTIONS = (("constraint:", "Constraints"), ("preference:", "Preferences"), ("decision:", "Decisions"), ("fix:", "Fixes"), ("distilled:", "Distilled"), ("edit:", "Notable edits"))


def message_stream(hits: DataFrame, episodes: DataFrame, prefix: str, now: int, n: int = 8) -> DataFrame:
    """Both legs fused, of one stream's sources, newer ones first."""
    own = episodes.where(F.col("source").startswith(prefix)).select("id", "valid_from", "source")
    fused = combine.fuse_rrf(hits).join(own, "id")
    return leaves.top(rescore.recency_power(fused, "valid_from", now), n)


def document_corpus(hits: DataFrame, documents: DataFrame, n: int = 10) -> DataFrame:
    """Both legs fused, within documents already filtered."""
    return leaves.top(combine.fuse_rrf(hits).join(documents.select("id", "source"), "id"), n)


def between(episodes: DataFrame, after: int | None, before: int | None, as_of: int | None = None) -> DataFrame:
    """Episodes valid from after on, before before, as the store was at a time."""
    if after is not None and before is not None and after > before:
        raise ValueError("after must not be later than before")
    rows = episodes.where(ValidTimeRange(after, before).column())
    return rows if as_of is None else rows.where(temporal.system_at(as_of))


def in_parts(*parts: DataFrame) -> DataFrame:
    """Results one after another; part tells which."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), *p.columns)
        out = p if out is None else out.unionByName(p)
    return out


def profile(episodes: DataFrame, n: int = 10) -> DataFrame:
    """Sections of what was written down (source, id, line), the newest n lines of each."""
    section = F.lit(None).cast("string")
    for prefix, _ in reversed(SECTIONS):
        section = F.when(F.col("source").startswith(prefix), prefix).otherwise(section)
    w = Window.partitionBy("section")
    rows = episodes.withColumn("section", section).where("section IS NOT NULL")
    rows = rows.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("id")))).where(F.col("_n") <= n)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    return rows.groupBy("section").agg(F.first("total").alias("total"), lines.alias("markdown"))


def remembered(text: str, kind: str, scope: str) -> dict:
    """A row for a thing that someone chose to write down."""
    if kind not in ("constraint", "preference", "decision", "fix"):
        raise ValueError(f"no such kind: {kind}")
    return {"source": f"{kind}:{scope}", "content": text}


def handover(writes: DataFrame, most: int = 8) -> DataFrame:
    """The newest value of each key of a session's scratchpad (key, id, content)."""
    return writes.groupBy("key").agg(F.max("id").alias("id"), F.max_by("content", "id").alias("content")).orderBy(F.desc("id")).limit(most)


def transcript(lines: DataFrame) -> DataFrame:
    """Parsed rows of a transcript of JSON lines (seq, value): kind and text; what can't be parsed is skipped."""
    v = F.try_parse_json("value")
    return lines.select("seq", v.alias("v")).where("v IS NOT NULL").select("seq", F.try_variant_get("v", "$.type", "string").alias("kind"), F.try_variant_get("v", "$.text", "string").alias("text")).where("kind IS NOT NULL")


def detail(rows: DataFrame, provenance: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows (id) with the sources of the episodes behind them (id, episode_id); partial where one is missing."""
    named = provenance.join(episodes.select(F.col("id").alias("episode_id"), "source"), "episode_id", "left")
    found = named.groupBy("id").agg(F.sort_array(F.collect_list("source")).alias("sources"), F.max(F.col("source").isNull().cast("int")).alias("_missing"))
    return rows.join(found, "id", "left").withColumn("partial", F.coalesce(F.col("_missing") == 1, F.lit(False))).drop("_missing")


def snapshot(tables: dict[str, DataFrame], scope: str, at: int, now: int) -> DataFrame:
    """All rows of a scope as they were at a time, as lines of JSON; times to come are refused."""
    if at > now:
        raise LookupError("that time is still to come")
    parts = [df.where((F.col("scope") == scope) & temporal.system_at(at)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[c for c in df.columns])).alias("value")) for kind, df in tables.items()]
    return in_parts(*parts).drop("part")


def allowed_paths(rows: DataFrame, deny: list[str], include: list[str] | None = None, path: str = "path") -> DataFrame:
    """Rows whose path no denied glob matches, and an included one if there are any; ** crosses folders."""
    import re

    regex = lambda g: "^" + re.escape(g).replace(r"\*\*", "\x00").replace(r"\*", "[^/]*").replace("\x00", ".*").replace(r"\?", "[^/]") + "$"
    any_of = lambda globs: F.col(path).rlike("|".join(map(regex, globs))) if globs else F.lit(False)
    return rows.where(~any_of(deny) & (any_of(include) if include else F.lit(True)))


def whole_sessions(hits: DataFrame, turns: DataFrame, chronological: bool = False) -> DataFrame:
    """All turns (session, turn, ..) of the sessions that were hit (query_id, session, rank), by first hit or by session."""
    first = hits.groupBy("query_id", "session").agg(F.min("rank").alias("first"))
    order = ["session"] if chronological else ["first", "session"]
    return turns.join(first, "session").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "turn")))


def raptor_members(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(parent, child, is_leaf): each chunk under the deepest node whose path of titles its own begins with, each node under its parent.

    nodes: node_id, parent_id, path; chunks: id, path. Prefixes of a chunk's path are exploded and joined by
    equality, so no pair of all nodes and chunks is made.
    """
    prefixes = chunks.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    own = prefixes.join(nodes, "path").groupBy("id").agg(F.max_by("node_id", F.struct(F.size("path"), -F.col("node_id"))).alias("parent"))
    leaves_ = own.select("parent", F.col("id").alias("child"), F.lit(True).alias("is_leaf"))
    return leaves_.unionByName(nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("node_id").alias("child"), F.lit(False).alias("is_leaf")))


def audit_counts(log: DataFrame) -> DataFrame:
    """Events of a log (value) by kind, undecodable ones counted apart."""
    v = F.try_parse_json("value")
    kind = F.coalesce(F.try_variant_get(v, "$.kind", "string"), F.lit("(undecodable)"))
    return log.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def listing(edges: DataFrame, root: int, depth: int, most: int = 30) -> DataFrame:
    """Nodes around a root, nearest first, the root left out; truncated tells whether there were more."""
    from palimpsest.operators import graph

    seed = edges.sparkSession.createDataFrame([(0, root, 1.0)], "query_id long, id long, confidence double")
    near = graph.walk(seed, edges, depth).select(F.col("node").alias("id"), F.col("path_len").cast("long").alias("path_len"))
    w = Window.orderBy("path_len", "id")
    first = near.orderBy("path_len", "id").limit(most + 1)
    return first.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > most).where(F.col("_n") <= most).drop("_n")


#: What this store can do.
CAPABILITIES = {"bi_temporal": True, "graph": True, "rrf": True, "decay": True, "navigate": True, "as_of_any_age": True}


def status(topics: DataFrame) -> DataFrame:
    """Entries of each topic (topic, offset, done) that are still to be taken."""
    return topics.groupBy("topic").agg(F.sum((~F.col("done")).cast("long")).alias("pending"))
