"""Consolidation, deduplication and stateful activation over streams of events.

Batches are written to idempotent sinks under a checkpoint, so a failed batch runs again and a replayed
one changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import millis
from palimpsest.operators import lifecycle
from palimpsest.sources.tables import shared_dir


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str, reader) -> DataFrame:
    """A stream of the Parquet files of a folder, or of the one file that path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def drained(spark: SparkSession, path: str, write: Callable[[DataFrame, int], None], files: int = 4) -> None:
    """Feeds what a folder of Parquet files holds through write, batch by batch, and stops."""
    schema = spark.read.parquet(path).schema
    stream = files_of(spark, path, spark.readStream.schema(schema).option("maxFilesPerTrigger", files))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{shared_folder(spark)}/c").trigger(availableNow=True).start().awaitTermination()


def consolidated(spark: SparkSession, path: str, now: int) -> DataFrame:
    """Base-level activations kept up to date from micro-batches: each adds its events' terms by episode.

    A batch's partial sums go to a folder of its own number, which a repeated batch overwrites.
    """
    out = shared_folder(spark)
    age = F.greatest((F.lit(now) - millis(F.col("ts"))) / F.lit(1000.0), F.lit(1.0))

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.col("user_id").alias("episode_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(age, F.lit(-0.5))).alias("s"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drained(spark, path, write)
    parts = spark.read.parquet(out)
    return parts.groupBy("episode_id").agg(F.sum("n").alias("n"), F.round(F.log(F.sum("s")), 6).alias("activation"))


def written_before(spark: SparkSession, out: str, number: int) -> list[str]:
    """Folders of the batches before this one, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS")))
    return [f"{out}/batch={k}" for k in done if k < number]


def deduplicated(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    """Events once each, however late a repeat comes: the keys written so far are kept in the output itself.

    A batch drops its own repeats and what earlier batches wrote, and goes to a folder of its number, which a
    repeated batch overwrites; nothing is dropped for being late.
    """
    out = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates([key])
        if before := written_before(spark, out, number):
            once = once.join(spark.read.parquet(*before).select(key), key, "left_anti")
        once.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drained(spark, path, write)
    return spark.read.parquet(*written_before(spark, out, 1 << 62)) if written_before(spark, out, 1 << 62) else spark.read.parquet(path).limit(0)


IDLE_MS = 30 * 60 * 1000


def running_sums(now: int) -> Callable:
    """The state function of activation_stream: a key's count and sum outlive its time-out, which marks it idle."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        idle = state.hasTimedOut
        if not idle:
            for pdf in parts:
                n += len(pdf)
                s += float(((now - pdf["at"]) / 1000.0).clip(lower=1.0).pow(-0.5).sum())
            state.update((n, s))
            state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"episode_id": [key[0]], "n": [n], "sum": [s], "idle": [idle]})

    return update


def activation_stream(events: DataFrame, now: int) -> DataFrame:
    """Running counts and sums by episode as state; what is idle for half an hour is told so once, with its sums, and goes on from them."""
    return events.groupBy("episode_id").applyInPandasWithState(running_sums(now), "episode_id long, n long, sum double, idle boolean", "n long, sum double", "update", "ProcessingTimeTimeout")


def superseding(facts_path: str, spark: SparkSession, verdicts_path: str, out: str, now: int, files: int = 4) -> None:
    """Applies verdicts (loser, winner) to facts as they arrive: each batch rewrites what the one before it wrote, into a folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        before = written_before(spark, out, number)
        lifecycle.superseded(spark.read.parquet(before[-1] if before else facts_path), batch, now).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drained(spark, verdicts_path, write, files)


def superseded_facts(spark: SparkSession, facts_path: str, out: str) -> DataFrame:
    """The facts after the last batch that superseding() finished."""
    before = written_before(spark, out, 1 << 62)
    return spark.read.parquet(before[-1] if before else facts_path)
