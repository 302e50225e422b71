"""Table lifecycle: forgetting, retention, reconciliation, ledgers and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import temporal as time

#: Strengths of signals and the activations at which an episode is promoted or archived.
STRENGTH = {"Weak": 1.0, "Strong": 3.0, "StrongNegative": -3.0}
PROMOTE_ABOVE, ARCHIVE_BELOW = 1.0, -0.5


def soft_forget(rows: DataFrame, matched: Column, now: int) -> DataFrame:
    """Closes matching rows that are open; doing it again changes nothing."""
    return rows.withColumn("sys_to", F.when(matched & F.col("sys_to").isNull(), F.lit(now)).otherwise(F.col("sys_to")))


def target_token(matched_ids: DataFrame) -> DataFrame:
    """One row: how many rows a target matches, and a token that only the same rows give."""
    rows = matched_ids.agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("_sum"))
    return rows.select("matched", F.sha2(F.concat_ws(":", F.lit("dry run"), F.col("matched").cast("string"), F.col("_sum").cast("string")).cast("binary"), 256).alias("token"))


def hard_forget(rows: DataFrame, matched: Column, token: str | None) -> DataFrame:
    """Drops matching rows. Takes the token of a dry run of the same target over the same rows: one that matched others, or none, is refused."""
    hit = F.coalesce(matched, F.lit(False))
    if not token or token != target_token(rows.where(hit).select("id")).first()["token"]:
        raise PermissionError("hard deletion takes the token of a dry run of the same target")
    return rows.where(~hit)


def dry_run(episodes: DataFrame, chunks: DataFrame, matched: Column, hard: bool = False) -> DataFrame:
    """How many open episodes match (of a hard deletion: open or not), how many rows would be written, and the token for it."""
    hit = episodes.where(matched if hard else matched & F.col("sys_to").isNull()).select("id")
    n = target_token(hit)
    c = chunks.join(hit.withColumnRenamed("id", "episode_id"), "episode_id", "left_semi").agg(F.count(F.lit(1)).alias("_c"))
    return n.crossJoin(c).select("matched", (F.col("matched") + F.col("_c")).alias("rows_written"), F.lit(True).alias("preview"), "token")  # one row each


def cascade(episodes: DataFrame, chunks: DataFrame, matched: Column, now: int) -> DataFrame:
    """Chunks with those of forgotten episodes closed."""
    gone = episodes.where(matched).select(F.col("id").alias("episode_id"), F.lit(True).alias("_gone"))
    return chunks.join(gone, "episode_id", "left").withColumn("sys_to", F.when(F.col("_gone") & F.col("sys_to").isNull(), F.lit(now)).otherwise(F.col("sys_to"))).drop("_gone")


def older_than(now: int, max_age_ms: int) -> Column:
    return F.col("valid_from") < F.lit(max(0, now - max_age_ms))


def invalidate_range(rows: DataFrame, node, lo: int, hi: int, now: int, id_col: str = "id") -> DataFrame:
    """Closes a node's rows written in [lo, hi], both ends included; an empty range closes nothing."""
    hit = (F.col(id_col) == F.lit(node)) & F.col("sys_from").between(lo, hi)
    return soft_forget(rows, hit & F.lit(lo <= hi), now)


def first_writers(existing: DataFrame, incoming: DataFrame, key: str = "dedupe_key", order: str = "seq") -> DataFrame:
    """Incoming rows whose key is new, the first of each key."""
    new = incoming.join(existing.select(key), key, "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def validated(relations: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """A reason for each relation that needs review, null for good ones. texts: other columns that must hold something, as names, kinds and texts do."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    reason = F.when(empty("predicate"), "empty_predicate").when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence_range").when(F.col("valid_to").isNotNull() & (F.col("valid_from") >= F.col("valid_to")), "invalid_interval")
    for c in texts:
        reason = reason.when(empty(c), f"empty_{c}")
    return relations.withColumn("reason", reason)


def contradictions(facts: DataFrame) -> DataFrame:
    """Keys (subject, predicate) under which two different objects hold at one time.

    Spans of one object that touch are made one, by a running maximum of their ends; of any two spans of a key
    that overlap then, the objects differ, and a running maximum of all ends finds whether there are such.
    Windows replace the join of all pairs of a key.
    """
    rows = facts.where("valid_to IS NULL OR valid_from < valid_to").select("subject", "predicate", "object", F.col("valid_from").alias("a"), F.coalesce("valid_to", F.lit(2**62)).alias("b"))
    own = Window.partitionBy("subject", "predicate", "object").orderBy("a", "b")
    begins = (F.col("a") > F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    span = F.sum(F.coalesce(begins, F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = rows.withColumn("span", span).groupBy("subject", "predicate", "object", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    key = Window.partitionBy("subject", "predicate").orderBy("a", "b", "object").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("latest", F.max("b").over(key)).where(F.col("a") < F.col("latest")).select("subject", "predicate").distinct()


def deduped_triples(facts: DataFrame) -> DataFrame:
    """Each (subject, predicate, object, interval) once, the first id and the greatest confidence."""
    return facts.groupBy("subject", "predicate", "object", "valid_from", "valid_to").agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"))


def capped_dates(facts: DataFrame, reference: int) -> DataFrame:
    """Open-ended facts that start in the future start at the reference."""
    return facts.withColumn("valid_from", F.when(F.col("valid_to").isNull(), F.least("valid_from", F.lit(reference))).otherwise(F.col("valid_from")))


def classified(new: DataFrame, prior: DataFrame) -> DataFrame:
    """Noop if the object is known, else Supersede of the first prior fact that overlaps, else Append."""
    p = prior.select("subject", "predicate", F.col("object").alias("_o"), F.col("valid_from").alias("_a"), F.col("valid_to").alias("_b"), F.col("id").alias("_id"))
    meets = time.intervals_meet(F.col("valid_from"), F.col("valid_to"), F.col("_a"), F.col("_b")) & (F.col("_o") != F.col("object"))
    joined = new.join(p, ["subject", "predicate"], "left").groupBy(*new.columns).agg(F.coalesce(F.bool_or(F.col("_o") == F.col("object")), F.lit(False)).alias("_same"), F.min(F.when(meets, F.col("_id"))).alias("_loser"))
    decision = F.when(F.col("_same"), "Noop").when(F.col("_loser").isNotNull(), "Supersede").otherwise("Append")
    return joined.withColumn("decision", decision).withColumn("loser", F.when(decision == "Supersede", F.col("_loser"))).drop("_same", "_loser")


def folded_spo(facts: DataFrame) -> DataFrame:
    """Decisions when facts of a key come one after another (seq), each seeing those before it in its batch."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: list[list] = []
        out = []
        for f in pdf.sort_values("seq").itertuples():
            end = None if pd.isna(f.valid_to) else int(f.valid_to)
            same = next((h for h in held if h[0] == f.object), None)
            if same:
                same[1:3] = f.valid_from, end
                out.append((f.id, "Noop", None))
                continue
            loser = next((h for h in held if (h[2] is None or f.valid_from < h[2]) and (end is None or h[1] < end)), None)
            out.append((f.id, "Supersede" if loser else "Append", loser[3] if loser else None))
            held.append([f.object, f.valid_from, end, f.id])
        return pd.DataFrame(out, columns=["id", "decision", "loser"]).astype({"id": "int64", "loser": "Int64"})

    return facts.groupBy("subject", "predicate").applyInPandas(run, "id long, decision string, loser long")


def latest_assertions(facts: DataFrame) -> DataFrame:
    """Of each key the fact that began last, the greater id on ties."""
    return facts.groupBy("subject", "predicate").agg(F.max_by(F.struct("object", "id", "valid_from"), F.struct("valid_from", "id")).alias("f")).select("subject", "predicate", "f.*")


def superseded(facts: DataFrame, pairs: DataFrame, now: int, synthetic: bool = False) -> DataFrame:
    """Losers (loser) are closed now, and winners (winner) begin now, on both axes; synthetic adds a row for each that isn't there, with an id and times only."""
    l = pairs.select(F.col("loser").alias("id"), F.lit(True).alias("_l")).distinct()
    w = pairs.select(F.col("winner").alias("id"), F.lit(True).alias("_w")).distinct()
    out = facts.join(l, "id", "full" if synthetic else "left").join(w, "id", "full" if synthetic else "left")
    begin = lambda c: F.when(F.col("_w"), F.lit(now)).otherwise(F.col(c))
    return out.withColumns({"sys_to": F.when(F.col("_l") & F.col("sys_to").isNull(), F.lit(now)).otherwise(F.col("sys_to")), "sys_from": begin("sys_from"), "valid_from": begin("valid_from")}).drop("_l", "_w")


def ledger(signals: DataFrame) -> DataFrame:
    """Signals (id, at, seq, strength) folded in order: the sum may not fall below zero.

    The fold w = max(0, w + s) is the running sum less its least value so far, so two windows replace it.
    """
    order = Window.partitionBy("id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = signals.withColumn("_s", F.sum("strength").over(order)).withColumn("_low", F.min("_s").over(order))
    last = F.max_by(F.struct("_s", "_low"), F.struct("at", "seq"))
    out = sums.groupBy("id").agg(F.count(F.lit(1)).alias("n"), last.alias("l"), F.min("at").alias("first_ref"), F.max("at").alias("last_ref"))
    return out.select("id", "n", (F.col("l._s") - F.least(F.lit(0.0), F.col("l._low"))).alias("weighted"), "first_ref", "last_ref")


def ledger_activation(rows: DataFrame, now: int, decay: float = 0.5) -> DataFrame:
    age = F.greatest((F.lit(now) - F.col("last_ref")) / F.lit(1000.0), F.lit(1.0))
    return rows.withColumn("activation", F.when(F.col("weighted") == 0, F.lit(float("-inf"))).otherwise(F.round(F.log(F.col("weighted") * F.pow(age, F.lit(-decay))), 6)))


def base_level(events: DataFrame, now: int, decay: float = 0.5, by: str = "episode_id", spreading: Column | float = 0.0, noise: Column | float = 0.0) -> DataFrame:
    """Activation of each episode: the base level of its events' ages, and spreading and noise as the caller has them, by episode."""
    age = F.greatest((F.lit(now) - F.col("at")) / F.lit(1000.0), F.lit(1.0))
    more = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.log(F.sum(F.pow(age, F.lit(-decay)))) + F.max(more(spreading)) + F.max(more(noise)), 6).alias("activation"))


def decided(activations: DataFrame) -> DataFrame:
    a = F.col("activation")
    return activations.withColumn("decision", F.when(a > PROMOTE_ABOVE, "promote").when(a < ARCHIVE_BELOW, "archive").otherwise("noop"))


def dream_agenda(ledger_rows: DataFrame, episodes: DataFrame, most_activation: float, min_size: int = 2, limit: int = 10) -> DataFrame:
    """Clusters of quiet episodes by the class of their source: size, mean and greatest activation, dominant source."""
    from palimpsest.functions.text import source_class

    quiet = ledger_rows.where((F.col("activation") <= most_activation) & F.col("archived_at").isNull()).join(episodes.where("sys_to IS NULL").select("id", "source"), "id")
    quiet = quiet.where(~F.col("source").startswith("distilled:")).withColumn("cluster", source_class(F.col("source")))
    by_source = quiet.groupBy("cluster", "source").agg(F.count(F.lit(1)).alias("_k"), F.sum("activation").alias("_a"), F.max("activation").alias("_m"))
    out = by_source.groupBy("cluster").agg(F.sum("_k").alias("size"), F.round(F.sum("_a") / F.sum("_k"), 6).alias("mean_activation"), F.max("_m").alias("max_activation"), F.min_by("source", F.struct(-F.col("_k"), F.col("source"))).alias("dominant_source"))
    return out.where(F.col("size") >= min_size).orderBy(F.desc("size"), F.desc("mean_activation"), "cluster").limit(max(1, min(limit, 100)))


def agenda_merged(agenda: DataFrame, seen: DataFrame) -> DataFrame:
    """The verify agenda (episode_id, current_head, first_seen, last_seen) with new sightings; the first time stays."""
    both = agenda.unionByName(seen)
    return both.groupBy("episode_id").agg(F.max_by("current_head", "last_seen").alias("current_head"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
