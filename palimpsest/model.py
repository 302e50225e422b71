"""The driver's tables as episodes, facts, signals and graphs; times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
START = 1_704_067_200_000  # 2024-01-01
NOW = START + 60 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone is."""
    return (F.unix_date(F.to_date(ts)).cast("long") * DAY + F.hour(ts) * HOUR + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)).cast("long")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda hours: F.lit(START) + (F.col("doc_id") + hours) * HOUR
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("scope"), F.concat(F.lit("doc:"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("content"),
        at(0).alias("valid_from"), F.when(F.col("doc_id") % 5 == 0, at(720)).alias("valid_to"), at(24).alias("sys_from"), F.when(F.col("doc_id") % 17 == 0, at(240)).alias("sys_to"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each episode, with its id."""
    return episodes(spark, sf_dir).select("id", F.col("id").alias("episode_id"), F.col("content").alias("text"), "source", "sys_from", "sys_to")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every vector whose id is divisible by a hundred, numbered from 0."""
    return vectors(spark, sf_dir).where(F.col("id") % 100 == 0).select(F.expr("id div 100").alias("query_id"), "embedding")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five terms of every benchmark item."""
    from palimpsest.functions.text import tokens

    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.array_distinct(tokens(F.col("text"))), 1, 5), " ").alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = millis(F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("subject"), F.lit("supplied_by").alias("predicate"), F.col("l_suppkey").alias("object"), at.alias("valid_from"), (at + 30 * DAY).alias("valid_to"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "error", -3.0).otherwise(1.0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), millis(F.col("ts")).alias("at"), strength.alias("strength"), F.col("event_type").alias("source"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between kinds of rows; a vertex is its kind's number times 10**9 plus its key."""
    v = lambda kind, c: (F.lit(kind * 1_000_000_000) + F.col(c).cast("long"))
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, b, w=None: df.select(a.alias("src"), b.alias("dst"), (F.lit(1.0) if w is None else w).alias("weight"))
    parts = [
        edge(t("orders"), v(1, "o_custkey"), v(2, "o_orderkey")),
        edge(t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.lit(1.0) - F.col("l_discount")).alias("w")), v(2, "l_orderkey"), v(3, "l_partkey"), F.col("w")),
        edge(t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.lit(1.0) - F.col("l_discount")).alias("w")), v(3, "l_partkey"), v(4, "l_suppkey"), F.col("w")),
        edge(t("supplier"), v(4, "s_suppkey"), v(5, "s_nationkey")), edge(t("customer"), v(1, "c_custkey"), v(5, "c_nationkey")), edge(t("nation"), v(5, "n_nationkey"), v(6, "n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same views as SQL.
SQL = {
    "ep": f"ep AS (SELECT doc_id AS id, lang AS scope, 'doc:' || source || '/' || doc_id AS source, text AS content, {START} + doc_id * {HOUR} AS valid_from, CASE WHEN doc_id % 5 = 0 THEN {START} + (doc_id + 720) * {HOUR} END AS valid_to, {START} + (doc_id + 24) * {HOUR} AS sys_from, CASE WHEN doc_id % 17 = 0 THEN {START} + (doc_id + 240) * {HOUR} END AS sys_to FROM documents)",
    "qv": "qv AS (SELECT vec_id // 100 AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)",
    "knn_all": "knn_all AS (SELECT query_id, vec_id AS id, label, round(1 / (1 + greatest(1 - list_cosine_similarity(embedding::DOUBLE[], v), 0)), 6) AS score FROM embeddings, qv)",
    "knn": "knn AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM knn_all) WHERE r <= 30)",
    "qt": "qt AS (SELECT item_id AS query_id, list_distinct(terms) AS terms FROM (SELECT item_id, list_transform(list_filter(list_transform(range(len(t)), lambda i: {'i': i, 'x': t[i + 1]}), lambda p: list_position(t, p.x) = p.i + 1), lambda p: p.x)[1:5] AS terms FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)))",
    "bm": """tk AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
        cs AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), asked AS (SELECT query_id, unnest(terms) AS term FROM qt),
        ex AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk), tf AS (SELECT id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN dfs USING (term) JOIN asked USING (term), cs GROUP BY query_id, id)""",
    "kwr": "kwr AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm) WHERE r <= 30)",
    "kw": "kw AS (SELECT query_id, id, round(CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM kwr WINDOW w AS (PARTITION BY query_id))",
    "legs": "legs AS (SELECT query_id, id, score, 'Vector' AS source_op FROM knn UNION ALL SELECT query_id, id, score, 'Keyword' FROM kw)",
    "ranked": "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_op ORDER BY score DESC, id) AS rk FROM legs)",
    "fused": "fused AS (SELECT query_id, id, round(sum(1::DOUBLE / (60 + rk)), 6) AS score FROM ranked GROUP BY query_id, id)",
    "fa": f"fa AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS subject, l_suppkey AS object, epoch_ms(l_shipdate) AS valid_from, epoch_ms(l_shipdate) + {30 * DAY} AS valid_to, 1 - l_discount AS confidence FROM lineitem)",
    "sg": "sg AS (SELECT user_id AS id, event_id AS seq, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'error' THEN -3.0::DOUBLE ELSE 1.0::DOUBLE END AS strength, event_type AS source FROM events)",
    "gr": """gr AS (SELECT 1000000000 + o_custkey AS src, 2000000000 + o_orderkey AS dst, 1.0::DOUBLE AS weight FROM orders
        UNION ALL SELECT 2000000000 + l_orderkey, 3000000000 + l_partkey, max(1 - l_discount) FROM lineitem GROUP BY l_orderkey, l_partkey
        UNION ALL SELECT 3000000000 + l_partkey, 4000000000 + l_suppkey, max(1 - l_discount) FROM lineitem GROUP BY l_partkey, l_suppkey
        UNION ALL SELECT 4000000000 + s_suppkey, 5000000000 + s_nationkey, 1 FROM supplier UNION ALL SELECT 1000000000 + c_custkey, 5000000000 + c_nationkey, 1 FROM customer
        UNION ALL SELECT 5000000000 + n_nationkey, 6000000000 + n_regionkey, 1 FROM nation),
        ug AS (SELECT * FROM gr UNION ALL SELECT dst, src, weight FROM gr)""",
}
NEEDS = {"knn_all": ("qv",), "knn": ("knn_all",), "bm": ("qt",), "kwr": ("bm",), "kw": ("kwr",), "legs": ("knn", "kw"), "ranked": ("legs",), "fused": ("ranked",)}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH .. for the views and those that they need."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return "WITH " + "RECURSIVE " * recursive + ", ".join(SQL[n] for n in out)
