"""Tables that outlive executors, and connected components over them."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df written to the folder named by spark.checkpoint.dir, which all executors share. A session of one machine without one gets its own; a cluster must name it.

    tasks: as many partitions as the rows are worth. Where spark.sql.shuffle.partitions has more, the last stage's
    partitions are read in so many tasks (in one for each core at least; nothing is shuffled for it), for each task writes a
    file: on a local disk Hadoop starts two processes for each, which for a moment hold the executor's memory once more.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-"))
    if tasks is not None:
        tasks = max(tasks, context.defaultParallelism)
        if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > tasks:
            df = df.coalesce(tasks)
    return df.checkpoint()


#: Rows up to which a table is broadcast; callers' rows are numbers and short names.
SMALL_ROWS = 20_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that; it should be saved, for its rows are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Links that one task joins up before the distributed rounds.
LOCAL_LINKS = 2_000_000


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: each node with the least node it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = x = root[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in root if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node it is connected to. tasks: see saved.

    Links are first joined up within partitions; then large-star and small-star rounds run until nothing
    changes. Each round is saved, so the plan stays short and lost executors cost one round.
    """
    links = saved(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), tasks)
    n = links.count()
    now = links.coalesce(max(1, -(-n // LOCAL_LINKS))).mapInArrow(_join_up, "a long, b long")
    if n <= LOCAL_LINKS:  # one task saw every link, and names each node once
        now = saved(now)
        return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
    now, seen = saved(now.distinct(), tasks), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        now = saved(small, tasks)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
