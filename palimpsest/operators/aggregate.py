"""Grouped reducers and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The question forms of the intent classifier.
UNITS, CONNECTIVES, SPAN_VERBS = ("day", "week", "month", "year"), ("between", "since", "until", "before", "after"), ("spend", "spent", " take", " took")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TIME_FORMS = ("happened first", "happened earlier", "happened later", "came first", "first, second", "order from", "first to last", "how long", "how soon", "when did", "when was", "when will", "when is", "what date", "which date", "most recent", "last time", "first time", "earliest", " ago", "order of", "how much time")
COUNT_FORMS, ADVICE_FORMS = ("how many", "how much", "number of", "total"), ("recommend", "suggest", "advice", "should i")


def aggregate(rows: DataFrame, by: str, reducers: list[tuple[str, str | None]], where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Reducers (count, count_distinct, sum, avg, min, max) by one key; a count puts the largest groups first."""
    named = {"count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    columns = [F.count(F.lit(1)).alias("count") if r == "count" else named[r](f).alias(f"{r}_{f}") for r, f in reducers]
    out = (rows if where is None else rows.where(where)).groupBy(by).agg(*columns)
    if limit is not None:
        out = out.orderBy(*([F.desc("count")] if ("count", None) in reducers else []), by).limit(limit)
    return out


def micro_f1(gold: DataFrame, found: DataFrame) -> DataFrame:
    """F1 of two sets of rows; both empty is 1, one empty is 0."""
    g, f = gold.distinct(), found.distinct()
    n = g.agg(F.count(F.lit(1)).alias("gold")).crossJoin(f.agg(F.count(F.lit(1)).alias("found"))).crossJoin(g.join(f, g.columns).agg(F.count(F.lit(1)).alias("both")))  # one row each
    f1 = F.when((F.col("gold") == 0) & (F.col("found") == 0), 1.0).otherwise(F.coalesce(F.lit(2.0) * F.col("both") / F.nullif(F.col("gold") + F.col("found"), F.lit(0)), F.lit(0.0)))
    return n.withColumn("f1", F.round(f1, 6))


def any_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """The percentage of queries (query_id, gold) one of whose hits' texts contains the gold text."""
    per = gold.join(hits, "query_id", "left").groupBy("query_id").agg(F.max(F.coalesce(F.contains("text", "gold"), F.lit(False)).cast("int")).alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.lit(100.0) * F.avg("ok"), 6).alias("score"))


def divergence(primary: DataFrame, shadow: DataFrame, key: str = "case_id", pass_at: float = 0.05) -> DataFrame:
    """How often two verifiers differ."""
    both = primary.select(key, F.col("verdict").alias("_a")).join(shadow.select(key, F.col("verdict").alias("_b")), key)
    out = both.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")), F.lit(0)).alias("diverged"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("diverged") / F.col("total"))
    return out.withColumn("rate", F.round(rate, 6)).withColumn("passed", rate <= pass_at)


def evidence_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query: gold sessions, how many of them a hit's source names, whether any or all."""
    found = gold.join(hits.select("query_id", "source"), "query_id", "left").groupBy("query_id", "session").agg(F.max(F.coalesce(F.contains("source", "session"), F.lit(False)).cast("int")).alias("hit"))
    out = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.sum("hit").alias("covered"))
    return out.withColumn("any_hit", F.col("covered") > 0).withColumn("all_hit", (F.col("total") > 0) & (F.col("covered") == F.col("total")))


def capped_sessions(hits: DataFrame, most: int, session: str = "session") -> DataFrame:
    """Hits of the first so many sessions in the order of rank; hits without a session go."""
    first = Window.partitionBy("query_id", session)
    kept = hits.where(F.col(session).isNotNull()).withColumn("_first", F.min("rank").over(first))
    return kept.withColumn("_s", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).where(F.col("_s") <= most).drop("_first", "_s")


def neighbours(hits: DataFrame, n: int, most: DataFrame) -> DataFrame:
    """Positions within n of each hit (query_id, doc, position), within the document (doc, size)."""
    if n == 0:
        return hits.select("query_id", "doc", "position")
    around = hits.join(most, "doc").withColumn("position", F.explode(F.sequence(F.greatest(F.col("position") - n, F.lit(0)), F.least(F.col("position") + n, F.col("size") - 1))))
    return around.select("query_id", "doc", "position").distinct()


def distilled_facts(facts: DataFrame, most: int) -> DataFrame:
    """Texts once each with the greatest confidence, best first, the earlier on ties."""
    once = facts.groupBy(F.trim("text").alias("text")).agg(F.max("confidence").alias("confidence"), F.min("seq").alias("seq"))
    return once.where(F.col("text") != "").orderBy(F.desc("confidence"), "seq").limit(most)


def intent(question: Column) -> Column:
    """Temporal before Counting before Recommendation before Factual."""
    q = F.lower(question)
    has = lambda forms: F.greatest(*(F.contains(q, F.lit(x)).cast("int") for x in forms)) == 1
    unit = has([f"how many {u}" for u in UNITS])
    temporal = (unit & (has(CONNECTIVES) | has(SPAN_VERBS))) | has([f"last {d}" for d in WEEKDAYS]) | has(TIME_FORMS) | q.startswith("when")
    return F.when(temporal, "Temporal").when(has(COUNT_FORMS), "Counting").when(has(ADVICE_FORMS), "Recommendation").otherwise("Factual")


def retrieval_of(kind: Column) -> Column:
    """How many sessions a question of an intent is answered from, and whether they are put in the order of time."""
    return F.struct(F.when(kind == "Recommendation", 4).otherwise(12).cast("long").alias("sessions"), (kind == "Temporal").alias("chronological"))


def nearest_rank(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at place floor(n * p) of each sorted group, counted from 0."""
    w = Window.partitionBy(by)
    at = F.least(F.floor(F.count(F.lit(1)).over(w) * F.lit(p)), F.count(F.lit(1)).over(w) - 1)
    place = F.row_number().over(w.orderBy(value)) - 1
    return rows.where(F.col(value).isNotNull()).withColumn("_at", at).withColumn("_n", place).where("_n = _at").select(by, F.col(value).alias("value"))


def bio_spans(tags: DataFrame) -> DataFrame:
    """Entity spans of token tags (sentence_id, pos, token, tag): a B- begins one, I- of the same kind goes on."""
    order = Window.partitionBy("sentence_id").orderBy("pos")
    kind = F.when(F.col("tag") != "O", F.substring_index("tag", "-", -1))
    prior = F.lag("_kind").over(order)
    begins = F.col("_kind").isNotNull() & (F.col("tag").startswith("B-") | prior.isNull() | (prior != F.col("_kind")))
    marked = tags.withColumn("_kind", kind).withColumn("_b", begins.cast("int")).withColumn("span", F.sum("_b").over(order)).where("_kind IS NOT NULL")
    return marked.groupBy("sentence_id", "span", F.col("_kind").alias("kind")).agg(F.min("pos").alias("start"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text"))


#: Words that the citation tokens leave out.
STOPWORDS = (
    "a an and the is are was were be been being to of in on at for with by from as that this these those it its "
    "but or not no do does did has have had will would should can could may might must shall i you he she we they them "
    "his her their our your my me him us than then so if into about over under before after up down out off again "
    "once here there when where why how all any both each few more most other some such only own same too very just"
).split()


def citation_grams(memories: DataFrame, n: int = 5, among: DataFrame | None = None) -> DataFrame:
    """Distinctive n-grams (id, gram): those of one memory (id, text) only. among: the only grams (gram) that are asked for."""
    w = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda x: ~x.isin(*STOPWORDS))
    grams = memories.select("id", w.alias("w")).where(F.size("w") >= n).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("gram"))
    grams = (grams if among is None else grams.join(among, "gram", "left_semi")).distinct()
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).where("_n = 1").select("id", "gram")


def cited(memories: DataFrame, answers: DataFrame, n: int = 5) -> DataFrame:
    """Memories one of whose distinctive n-grams an answer has."""
    return citation_grams(memories, n, citation_all(answers, n)).select("id").distinct()


def citation_all(texts: DataFrame, n: int = 5) -> DataFrame:
    w = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda x: ~x.isin(*STOPWORDS))
    return texts.select(w.alias("w")).where(F.size("w") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram")).distinct()
