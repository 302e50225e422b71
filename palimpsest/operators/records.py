"""What is written down: memories, distillations, feedback, archive marks, structured ingest and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import ingest, leaves, lifecycle

#: Bounds of a sweep over what was written at other commits.
MOST_HEADS, MOST_SWEPT = 8, 5000
#: Chunk and overlap tokens of structured ingest.
STRUCTURED_CHUNK, STRUCTURED_OVERLAP = 256, 32


def archived(ledger: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """The ledger with archived_at set for ids, once: what is archived already, or isn't there, stays as it is."""
    marked = ids.select("id").distinct().withColumn("_m", F.lit(True))
    return ledger.join(marked, "id", "left").withColumn("archived_at", F.when(F.col("_m") & F.col("archived_at").isNull(), F.lit(now)).otherwise(F.col("archived_at"))).drop("_m")


def newly_archived(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many of the ids archived() marks."""
    return ledger.where("archived_at IS NULL").join(ids.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("archived"))


def retained(episodes: DataFrame, chunks: DataFrame, now: int, max_age: int | None, mode: str = "soft", token: str | None = None) -> DataFrame:
    """Episodes under a retention policy: soft closes those too old, hard drops them by a dry run's token, preview counts them; without an age nothing happens."""
    if mode not in ("soft", "hard", "preview"):
        raise ValueError(f"no such mode: {mode}")
    if max_age is None:
        return episodes
    old = lifecycle.older_than(now, min(max(0, max_age), now))
    if mode == "preview":
        return lifecycle.dry_run(episodes, chunks, old)
    return lifecycle.soft_forget(episodes, old, now) if mode == "soft" else lifecycle.hard_forget(episodes, old, token)


def invalidated(facts: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(facts, audit): open facts of the ids closed now, and an audit row for each of them; closed and missing ones are passed over."""
    asked = ids.select("id").distinct()
    audit = facts.where("sys_to IS NULL").join(asked, "id", "left_semi").select("id", F.lit("reflect_invalidate").alias("kind"), F.lit(now).alias("at"))
    closed = facts.join(asked.withColumn("_m", F.lit(True)), "id", "left")
    return closed.withColumn("sys_to", F.when(F.col("_m") & F.col("sys_to").isNull(), F.lit(now)).otherwise(F.col("sys_to"))).drop("_m"), audit


def swept(episodes: DataFrame, changed: DataFrame, head: str) -> DataFrame:
    """Episodes (id, git_head, files) of other commits whose files changed since (git_head, file), with the current head.

    Heads are 40 hex digits; the first eight in order are looked at and the 5,000 least ids taken.
    """
    other = episodes.where(F.col("git_head").rlike("^[0-9a-f]{40}$") & (F.col("git_head") != head))
    heads = other.select("git_head").distinct().orderBy("git_head").limit(MOST_HEADS)
    files = other.join(F.broadcast(heads), "git_head").select("id", "git_head", F.explode(F.array_distinct("files")).alias("file"))  # eight rows
    hit = files.join(changed.select("git_head", "file").distinct(), ["git_head", "file"]).groupBy("id", "git_head").agg(F.sort_array(F.collect_set("file")).alias("changed_files"))
    return hit.orderBy("id").limit(MOST_SWEPT).withColumn("current_head", F.lit(head))


def resolved(episodes: DataFrame, agenda: DataFrame, verdicts: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(episodes, agenda) after verdicts (id, verdict): keep leaves an episode, invalidate and supersede close it, and each takes it off the agenda."""
    gone = verdicts.where(F.col("verdict").isin("invalidate", "supersede")).select("id").distinct().withColumn("_m", F.lit(True))
    out = episodes.join(gone, "id", "left").withColumn("sys_to", F.when(F.col("_m") & F.col("sys_to").isNull(), F.lit(now)).otherwise(F.col("sys_to"))).drop("_m")
    done = verdicts.where(F.col("verdict").isin("keep", "invalidate", "supersede")).select(F.col("id").alias("episode_id"))
    return out, agenda.join(done, "episode_id", "left_anti")


def remembered(rows: DataFrame, scope: str, *carried: str) -> DataFrame:
    """Rows (kind, content, why) as episodes: source <kind>:<scope>; empty contents and other kinds are told by reason."""
    kinds = F.col("kind").isin("constraint", "preference", "decision", "fix")
    body = F.concat(F.trim("content"), F.coalesce(F.concat(F.lit("\nWhy: "), F.nullif(F.trim("why"), F.lit(""))), F.lit("")))
    reason = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty_content").when(~F.coalesce(kinds, F.lit(False)), "invalid_kind")
    return rows.select(F.concat("kind", F.lit(f":{scope}")).alias("source"), body.alias("content"), reason.alias("reason"), *carried)


def distilled(rows: DataFrame, ledger: DataFrame, scope: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(episodes, ledger): distillations (id, kind, content, sources, firsthand) as episodes distilled:<kind>:<scope>, with their sources archived.

    One without sources that isn't firsthand, or without content, is told by reason and archives nothing.
    """
    bare = (F.coalesce(F.size("sources"), F.lit(0)) < 1) & ~F.coalesce("firsthand", F.lit(False))
    reason = F.when(bare, "empty_provenance").when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty_content")
    out = rows.select("id", F.concat(F.lit("distilled:"), "kind", F.lit(f":{scope}")).alias("source"), "content", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"), reason.alias("reason"))
    used = out.where("reason IS NULL").select(F.explode("sources").alias("id"))
    return out.drop("sources"), archived(ledger, used, now)


def feedback(rows: DataFrame, chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """Signals (id, dedupe_key, at, strength) of feedback (target, dedupe_key, at, strong, negative): a chunk's goes to its episode, one that was given before gives none."""
    own = chunks.select(F.col("id").alias("target"), "episode_id")
    strength = F.when(F.col("negative"), lifecycle.STRENGTH["StrongNegative"]).when(F.col("strong"), lifecycle.STRENGTH["Strong"]).otherwise(lifecycle.STRENGTH["Weak"])
    first = lifecycle.first_writers(seen.select("dedupe_key", F.lit(-1).cast("long").alias("seq")), rows.withColumn("seq", F.col("at")))
    fresh = rows.join(first.select("dedupe_key", F.col("seq").alias("at")), ["dedupe_key", "at"], "left_semi").dropDuplicates(["dedupe_key"])
    return fresh.join(own, "target", "left").select(F.coalesce("episode_id", "target").alias("id"), "dedupe_key", "at", strength.alias("strength"))


def index_text(kind: str) -> Column:
    """What an index of a kind of rows is searched by."""
    return {"chunks": F.col("text"), "entities": F.concat_ws(" ", "name", "type"), "facts": F.col("fact_text"), "communities": F.col("summary")}[kind]


def repaired_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with vectors that no search can use set null."""
    return rows.withColumn(vector, F.when(leaves.knn_eligible(vector), F.col(vector)))


def compacted(rows: DataFrame, upserts: int, files: int, least: int = 512) -> DataFrame | None:
    """rows in fewer files, to be written anew, once a table has had so many upserts."""
    return rows.coalesce(max(1, files)) if upserts >= least else None


def published(events: DataFrame, topic: str) -> DataFrame:
    """Events (at, seq, ..) of a topic with their offsets: milliseconds times a million and the number within the millisecond."""
    n = F.row_number().over(Window.partitionBy("at").orderBy("seq")) - 1
    return events.withColumns({"topic": F.lit(topic), "offset": F.col("at") * 1_000_000 + n})


def event_envelopes(episodes: DataFrame) -> DataFrame:
    """What a stream of new episodes (id, source, at, counter) carries."""
    return episodes.select(F.lit("ingest").alias("kind"), F.col("id").alias("episode_id"), F.col("at").alias("lsn_wall_ms"), F.col("counter").alias("lsn_counter"), "source")


def cached_embeddings(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], cache: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """rows with the embedding of each text, made once for equal texts and not at all for those in a cache (text, embedding)."""
    asked = rows.select(F.col(text_col).alias("_t")).where("_t IS NOT NULL").distinct()
    known = None if cache is None else cache.select(F.col("text").alias("_t"), "embedding")
    new = asked if known is None else asked.join(known, "_t", "left_anti")
    made = ingest.embedded(new, embed, "_t").select("_t", "embedding")
    return rows.join(made if known is None else made.unionByName(known), rows[text_col] == F.col("_t"), "left").drop("_t")


def promoted(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """Captured chunks that have no vector yet, embedded in batches; the others as they are."""
    kind = dict(chunks.dtypes)["embedding"]
    bare = chunks.where("embedding IS NULL").drop("embedding")
    made = ingest.embedded(bare, embed, "text", batch).withColumn("embedding", F.col("embedding").cast(kind))
    return chunks.where("embedding IS NOT NULL").unionByName(made)


def extracted(units: DataFrame, extract: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """Facts (unit_id, subject, predicate, object, confidence) that a callable finds in texts (unit_id, text); a text on which it fails has none.

    Units are chunks or whole episodes, as the caller has them. Without a callable nothing is found.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for unit, text in zip(pdf["unit_id"], pdf["text"], strict=True):
                try:
                    rows += [(unit, f["subject"], f["predicate"], f["object"], float(f.get("confidence", 1.0))) for f in (extract(text or "") if extract else [])]
                except Exception:  # noqa: BLE001 an extractor may fail in any way
                    continue
            yield pd.DataFrame(rows, columns=["unit_id", "subject", "predicate", "object", "confidence"])

    return units.select("unit_id", "text").mapInPandas(run, f"unit_id {dict(units.dtypes)['unit_id']}, subject string, predicate string, object string, confidence double")


def structured(episodes: DataFrame, entities: DataFrame, facts: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> dict[str, DataFrame]:
    """The tables of one atomic commit: episodes (id, content), their chunks of 256 tokens with vectors, and the entities (name, type) and facts (subject, predicate, object) that came with them, under content ids.

    Entities and facts that are given more than once are written once.
    """
    chunks = ingest.embedded(ingest.chunk_plain(episodes, STRUCTURED_CHUNK, STRUCTURED_OVERLAP), embed)
    named = entities.withColumn("id", T.entity_id(F.col("name"), F.col("type"))).dropDuplicates(["id"])
    told = facts.withColumn("id", T.fact_id(F.col("subject"), F.col("predicate"), F.col("object"))).dropDuplicates(["id"])
    return {"episodes": episodes, "chunks": chunks, "entities": named, "facts": told}
