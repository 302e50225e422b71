"""Mixing sources to target weights (operator 9). DataFrame functions only.

A source's weight is its share of tokens to the power of an exponent, normalised.  The exponent is
bisected on a grid of 2**-20: the largest that reaches a target entropy, or the smallest at which the budget
runs through no source more often than a limit; targets that can't be met are refused.  A source's budget is its weight times the token budget (by default the
smallest budget at which every source is used whole at least once).  The budget is realised in epochs:
each epoch of a source is a permutation of its documents by a hash of seed, epoch and id, cut into blocks
of about `block_docs`; all whole epochs are used, and of the last one as long a beginning as the rest of
the budget pays.  A copy's place among its source's tokens, as a share of the budget, says in which block
of the mix it comes, so every block of the mix holds the target weights.

Running sums go over a source's blocks and within a block, never over all documents of a source at once.
The driver sees one row of sums for four levels of the bisection, whatever the number of sources.

Cases: a null source is a source of its own; null texts have no tokens and cost nothing; a source without
tokens is used once as it is; rows of one id in one source are used together; null ids count as one id;
an empty table gives an empty mix; the input's other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.quality_rules import SPACES
from palimpsest.llm.shared import saved, small

GRID = 20
LEVELS = 4


def word_count(text_col: str = "text") -> Column:
    """Words of a text, the default measure of tokens."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES), "")).cast("long")


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))


def exponent(shares: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget_share: float | None = None) -> float:
    """The exponent in [0, 1], from the column p of the sources' shares: the largest that reaches the entropy, else the smallest within the limit.

    budget_share: the budget over all tokens; without one it is the least that uses every source whole once.
    Raises ValueError for an entropy or a limit that no exponent meets, or if none meets both.
    """
    entropy = lambda z, pl, a: math.log(z) - a * pl / z if z else 0.0
    epochs = lambda row, k: row[f"h{k}"] / row[f"w{k}"] if budget_share is None else budget_share * row[f"h{k}"] / row[f"z{k}"]

    def sums(points: list[int]) -> dict:
        """At points of the grid: sum of weights z, of weights times log shares l, most and least repetitions h and w."""
        out = []
        for k in points:
            a = k / (1 << GRID)
            w, again = F.pow("p", F.lit(a)), F.pow("p", F.lit(a - 1))
            out += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log("p")).alias(f"l{k}"), F.max(again).alias(f"h{k}"), F.min(again).alias(f"w{k}")]
        return shares.agg(*out).first().asDict()

    reaches = lambda row, k: entropy(row[f"z{k}"], row[f"l{k}"], k / (1 << GRID)) >= target_entropy - 1e-9
    within = lambda row, k: epochs(row, k) <= repetition_limit * (1 + 1e-9)
    top = 1 << GRID
    ends = sums([0, top])
    if target_entropy is not None and not reaches(ends, 0):
        raise ValueError(f"an entropy of {target_entropy} is beyond that of equal weights")
    if repetition_limit is not None and not within(ends, top):
        raise ValueError(f"the budget repeats the corpus more often than {repetition_limit} times, whatever the weights")
    found = {}
    for wanted, ok, low in (("entropy", reaches, True), ("repetition", within, False)):
        if (target_entropy if low else repetition_limit) is None:
            continue
        if ok(ends, top if low else 0):  # the natural shares reach the entropy, or equal weights stay within the limit
            found[wanted] = float(low)
            continue
        lo, hi, level = 0, top, GRID  # grid points; the answer lies in between
        while level > 0:
            step = min(LEVELS, level)
            row = sums([lo + ((hi - lo) * k >> step) for k in range(1, 1 << step)])
            for _ in range(step):
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if ok(row, mid) == low else (lo, mid)
            level -= step
        found[wanted] = (lo if low else hi) / top
    if len(found) == 2 and found["repetition"] > found["entropy"]:
        raise ValueError(f"no weights reach an entropy of {target_entropy} within {repetition_limit} repetitions")
    return found.get("entropy", found.get("repetition", 1.0))


def weights(rows: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: int | None, block_docs: int) -> DataFrame:
    """By source: tokens, docs, weight, budget, whole (epochs), rest (tokens of the last one), blocks (of an epoch)."""
    sources = saved(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), 1)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").select("source", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    a = exponent(shares, target_entropy, repetition_limit, None if budget is None else budget / total) if total else 1.0
    z, low = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first() if total else (1.0, 1.0)
    # At this budget the source with the fewest repetitions is used just once.
    tokens = float(budget) if budget is not None else total * z / low
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(max(total, 1)), F.lit(a)) / z).otherwise(0.0)
    out = sources.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * tokens + 1e-6).cast("long"))
    used = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1)
    return out.withColumns({"whole": used.cast("long"), "rest": F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0), "blocks": F.ceil(F.col("docs") / block_docs).cast("long")})


def permuted(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """A row for each copy that the budgets pay: source, id, n_tokens, epoch, block, h, before (tokens of the source before it), budget."""
    epochs = F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1))
    copies = rows.join(small(plan).where("whole > 0 OR rest > 0"), "source").withColumn("epoch", F.explode(epochs))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "epoch", F.coalesce(F.col("id").cast("string"), F.lit("-")))).withColumn("block", F.expr("pmod(h, blocks)"))
    blocks = copies.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("held"))
    earlier = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    # Rows of one id have one h and are taken together: the frame goes by value.
    inside = Window.partitionBy("source", "epoch", "block").orderBy("h", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    copies = copies.join(blocks, ["source", "epoch", "block"]).withColumn("until", F.col("start") + F.sum("n_tokens").over(inside))
    return copies.where("epoch < whole OR until <= rest").withColumn("before", F.col("epoch") * F.col("tokens") + F.col("until") - F.col("n_tokens"))


def _rows(docs: DataFrame, tokens: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("source"), F.coalesce(tokens if tokens is not None else word_count(text_col), F.lit(0)).cast("long").alias("n_tokens"))


def mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None, mix_block_tokens: int = 1 << 20, block_docs: int = 4096, seed: int = 17, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: id_col, source, epoch, n_tokens, mix_block (in which block of the mix the copy comes), mix_order (its place there)."""
    rows = saved(_rows(docs, tokens, id_col, text_col, source_col))
    plan = saved(weights(rows, target_entropy, repetition_limit, budget, block_docs))
    total = plan.agg(F.sum("budget")).first()[0] or 0
    n = max(1, -(-total // mix_block_tokens))
    place = F.when(F.col("budget") > 0, F.least(F.floor(F.col("before") / F.col("budget") * n), F.lit(n - 1))).otherwise(0)
    source = F.when(F.col("source") != "-", F.expr("substring(source, 2)"))
    return permuted(rows, plan, seed).select(F.col("id").alias(id_col), source.alias("source"), "epoch", "n_tokens", place.cast("long").alias("mix_block"), F.col("h").alias("mix_order"))


def mixed_rows(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None, block_docs: int = 4096, seed: int = 17, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix has it. Whole rows are not shuffled: which of them the last epoch holds follows from the last one that it pays, by source."""
    rows = saved(_rows(docs, tokens, id_col, text_col, source_col))
    plan = saved(weights(rows, target_entropy, repetition_limit, budget, block_docs))
    last = permuted(rows, plan, seed).where("epoch = whole").groupBy("source").agg(F.max(F.struct("block", "h", F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("id"))).alias("last"))
    by_source = saved(plan.join(last, "source", "left").select(F.col("source").alias("_s"), F.col("whole").alias("_whole"), F.col("blocks").alias("_blocks"), F.col("last").alias("_last")), 1)
    own_id = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    h = F.xxhash64(F.lit(seed), F.col("_whole"), own_id)
    at = F.struct(F.pmod(h, F.col("_blocks")).alias("block"), h.alias("h"), own_id.alias("id"))
    times = F.col("_whole") + F.coalesce((at <= F.col("_last")).cast("int"), F.lit(0))
    out = docs.withColumn("_s", source_key(source_col)).join(small(by_source), "_s").withColumn("_n", times.cast("int"))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
