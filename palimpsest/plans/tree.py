"""JSON plans, their compiler and their printed form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import temporal
from palimpsest.functions.filters import parse_filter
from palimpsest.operators import aggregate, combine, graph, leaves, rescore


class PlanError(ValueError):
    """An unknown operator, a missing field or a field of the wrong kind."""


@dataclass
class Context:
    """What a plan runs against: stated queries, and tables by the names of indexes."""

    vectors: DataFrame
    texts: DataFrame
    vector_tables: dict[str, DataFrame]
    text_tables: dict[str, DataFrame]
    edges: DataFrame | None = None
    members: DataFrame | None = None
    scorer: Callable | None = None
    as_of: int | None = None
    within: DataFrame | None = None
    extra: dict[str, Callable[[dict, Context], DataFrame]] = field(default_factory=dict)

    def index(self, tables: dict[str, DataFrame], name: str) -> DataFrame | None:
        """A table as of the plan's time; an index that isn't there has no rows."""
        df = tables.get(name)
        return df.where(temporal.system_at(self.as_of)) if df is not None and self.as_of is not None and "sys_from" in df.columns else df


HITS = "query_id long, id long, score double, source_op string, leg string"


def need(node: dict, name: str, kind: type):
    if name not in node:
        raise PlanError(f"{node.get('op')}: {name} is missing")
    if not isinstance(node[name], kind) or isinstance(node[name], bool) and kind is int:
        raise PlanError(f"{node['op']}: {name} must be {kind.__name__}")
    return node[name]


def compile_plan(node: dict, c: Context) -> DataFrame:
    """Hits of a plan; all filters stand below the ranking that they narrow."""
    if not isinstance(node, dict) or not isinstance(node.get("op"), str):
        raise PlanError("a plan is an object with an op")
    op = node["op"]
    spark = c.vectors.sparkSession
    below = lambda name="input": compile_plan(need(node, name, dict), c)
    narrowed = lambda df: df.where(parse_filter(node["filter"]).column()) if "filter" in node else df
    if op in ("vector", "keyword"):
        index, k = need(node, "index", str), need(node, "k", int)
        table = c.index(c.vector_tables if op == "vector" else c.text_tables, index)
        if table is None:
            return spark.createDataFrame([], HITS)
        search, asked = (leaves.vector_search, c.vectors) if op == "vector" else (leaves.keyword_search, c.texts)
        return search(asked, narrowed(table), k, index, within=c.within)
    if op == "graph":
        seeds = spark.createDataFrame([(int(x["query_id"]), int(x["id"]), float(x.get("confidence", 1.0))) for x in need(node, "seeds", list)], "query_id long, id long, confidence double")
        if c.edges is None or not node["seeds"]:
            return spark.createDataFrame([], HITS)
        k = node.get("k", 30)
        hits = graph.graph_hits(seeds, c.edges, node.get("hops", 2), k if c.within is None else leaves.MOST_K).select("query_id", "id", "score", "source_op", "leg")
        return hits if c.within is None else leaves.top(held(hits, c), k).drop("rank")
    if op == "navigate":
        fallback = {"op": "vector", "index": node.get("fallback", need(node, "index", str)), "k": need(node, "k", int)} | {k: v for k, v in node.items() if k == "filter"}
        if "filter" in node or c.edges is None or c.within is not None:  # a filtered walk is a filtered search
            return compile_plan(fallback, c)
        seeds = compile_plan({"op": "vector", "index": node["index"], "k": node["k"]}, c)
        return graph.navigate(seeds, c.edges, node.get("hops", 2), node["k"]).select("query_id", "id", "score", F.lit("Graph").alias("source_op"), F.lit(node["index"]).alias("leg"))
    if op == "tree":
        if c.members is None:
            return spark.createDataFrame([], HITS)
        hits = compile_plan({"op": "vector", "index": need(node, "index", str), "k": need(node, "k", int)}, replace(c, within=None))
        return held(graph.descend(hits, c.members, node.get("depth", 1)), c).select("query_id", "id", "score", F.lit("Tree").alias("source_op"), F.lit(node["index"]).alias("leg"))
    if op == "and":
        return combine.both(below("left"), below("right"))
    if op == "or":
        return combine.either(below("left"), below("right"))
    if op == "then":
        return combine.then(below("left"), lambda pairs: compile_plan(need(node, "right", dict), replace(c, within=pairs)))
    if op == "fuse_rrf":
        return combine.fuse_rrf(below(), node.get("k", combine.RRF_K), node.get("weights"))
    if op == "top":
        return leaves.top(below(), need(node, "n", int))
    if op == "floored_top":
        return combine.floored_top(below(), need(node, "n", int), need(node, "index", str), need(node, "floor", int))
    if op == "rerank":
        texts = c.text_tables[node.get("index", "chunks")].select("id", F.col("content").alias("text"))
        pool = below().join(texts, "id").join(c.texts.withColumnRenamed("text", "query_text"), "query_id")
        return rescore.rerank(pool, c.scorer, node.get("top_in", 30), node.get("min_score"))
    if op == "aggregate":
        table = narrowed(c.index(c.text_tables, need(node, "index", str)))
        return aggregate.aggregate(table, need(node, "group_by", str), [(r["op"], r.get("field")) for r in need(node, "reducers", list)], limit=node.get("limit"))
    if op in c.extra:
        return held(c.extra[op](node, c), c)
    raise PlanError(f"unknown op {op}")


def held(hits: DataFrame, c: Context) -> DataFrame:
    """Hits among those that an enclosing then allows."""
    return hits if c.within is None else hits.join(c.within, ["query_id", "id"], "left_semi")


def printed(node: dict) -> str:
    """One line for a plan, equal for equal plans."""
    op = node["op"]
    inner = [printed(node[k]) for k in ("left", "right", "input") if isinstance(node.get(k), dict)]
    args = [f"{k}={len(v) if k == 'seeds' else v}" for k, v in sorted(node.items()) if k not in ("op", "left", "right", "input") and not k.startswith("_")]
    return f"{op}({', '.join([*args, *inner])})"


def production(k: int = 30, facts: bool = False, reranked: bool = False) -> dict:
    """The default plan: both legs of the chunks, and of the facts by navigation if asked, fused and cut to k."""
    legs: dict = {"op": "and", "left": {"op": "vector", "index": "chunks", "k": k}, "right": {"op": "keyword", "index": "chunks", "k": k}}
    if facts:
        legs = {"op": "and", "left": legs, "right": {"op": "and", "left": {"op": "navigate", "index": "facts", "k": k}, "right": {"op": "keyword", "index": "facts", "k": k}}}
    out: dict = {"op": "fuse_rrf", "k": combine.RRF_K, "input": legs}
    if reranked:
        out = {"op": "rerank", "top_in": max(k, 2 * k), "input": out}
    return {"op": "top", "n": k, "input": out}
