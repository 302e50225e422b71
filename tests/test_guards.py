"""Restrictions, tokens, commits, state and byte cuts where they are put to the test."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import combine, ingest, lifecycle
from palimpsest.plans import tree
from palimpsest.sources import tables
from palimpsest.streaming import jobs


@pytest.fixture(scope="module")
def context(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    texts = spark.createDataFrame([(1, "apple"), (2, "pear apple"), (3, "plum pear")], "id long, content string")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, embedding array<double>")
    said = spark.createDataFrame([(0, "pear"), (1, "plum")], "query_id long, text string")
    edges = spark.createDataFrame([(9, 1, 1.0), (9, 2, 1.0), (9, 3, 1.0)], "src long, dst long, weight double")
    return tree.Context(asked, said, {"chunks": vectors}, {"chunks": texts}, edges=edges)


VECTOR = {"op": "vector", "index": "chunks", "k": 5}
KEYWORD = {"op": "keyword", "index": "chunks", "k": 5}


@pytest.mark.parametrize("right", [
    VECTOR, {"op": "top", "n": 5, "input": VECTOR}, {"op": "fuse_rrf", "input": VECTOR}, {"op": "or", "left": VECTOR, "right": VECTOR},
    {"op": "top", "n": 5, "input": {"op": "fuse_rrf", "input": {"op": "and", "left": VECTOR, "right": {"op": "navigate", "index": "chunks", "k": 5}}}},
    {"op": "graph", "seeds": [{"query_id": 0, "id": 9}, {"query_id": 1, "id": 9}], "hops": 1}, {"op": "then", "left": VECTOR, "right": VECTOR},
])
def test_then_holds_every_node_below_it(spark, context, right):
    """The keyword leg finds 2 and 3 for query 0 and only 3 for query 1."""
    got = tree.compile_plan({"op": "then", "left": KEYWORD, "right": right}, context)
    assert {(r.query_id, r.id) for r in got.collect()} == {(0, 2), (0, 3), (1, 3)}


def test_then_narrows_before_it_ranks(spark, context):
    got = tree.compile_plan({"op": "then", "left": KEYWORD, "right": VECTOR | {"k": 1}}, context)
    assert {(r.query_id, r.id) for r in got.collect()} == {(0, 2), (1, 3)}
    assert tree.compile_plan({"op": "then", "left": {"op": "vector", "index": "none", "k": 1}, "right": VECTOR}, context).collect() == []


def test_hard_deletion_takes_its_own_token(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else 5) for i in range(10)], "id long, sys_to long")
    chunks = spark.createDataFrame([(i,) for i in range(10)], "episode_id long")
    token = lifecycle.dry_run(rows, chunks, F.col("id") < 4, hard=True).first()["token"]
    assert {r.id for r in lifecycle.hard_forget(rows, F.col("id") < 4, token).collect()} == set(range(4, 10))
    for target, t in ((F.col("id") < 5, token), (F.col("id") < 4, "token"), (F.col("id") < 4, None)):
        with pytest.raises(PermissionError):
            lifecycle.hard_forget(rows, target, t)
    with pytest.raises(PermissionError):  # another row has come to match since
        lifecycle.hard_forget(rows.union(spark.createDataFrame([(0, None)], rows.schema)), F.col("id") < 4, token)


def test_commits_meet(spark, tmp_path):
    a, b = tables.Store(spark, str(tmp_path)), tables.Store(spark, str(tmp_path))
    a.commit({"x": spark.range(1), "y": spark.range(1)})
    stale = b.latest()
    a.commit({"x": spark.range(2)})
    seen, calls = b.latest, []
    b.latest = lambda: stale if not calls and not calls.append(1) else seen()
    b.commit({"z": spark.range(3)})  # made from the first manifest, made again over the second
    assert [a.read(n).count() for n in "xyz"] == [2, 1, 3]
    calls.clear()
    with pytest.raises(tables.ConflictError):
        b.commit({"x": spark.range(9)})
    assert a.read("x").count() == 2


class State:
    def __init__(self):
        self.value, self.hasTimedOut = None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        assert ms == jobs.IDLE_MS


def test_idle_episodes_keep_their_sums():
    state, update = State(), jobs.running_sums(10_000)
    events = lambda *at: iter([pd.DataFrame({"at": at})])
    (first,) = update((7,), events(0, 6000), state)
    state.hasTimedOut = True
    (idle,) = update((7,), iter(()), state)
    assert idle.values.tolist() == [[7, 2, first["sum"][0], True]]
    state.hasTimedOut = False
    (more,) = update((7,), events(9000), state)
    assert more["n"][0] == 3 and abs(more["sum"][0] - (10**-0.5 + 4**-0.5 + 1)) < 1e-12


def test_verdicts_of_all_batches_hold(spark, tmp_path):
    facts, verdicts, out = f"{tmp_path}/facts", f"{tmp_path}/verdicts", f"{tmp_path}/out"
    spark.createDataFrame([(i, 1, None, 1) for i in range(6)], "id long, sys_from long, sys_to long, valid_from long").write.parquet(facts)
    for pair in ((0, 1), (2, 3)):
        spark.createDataFrame([pair], "loser long, winner long").coalesce(1).write.mode("append").parquet(verdicts)
    jobs.superseding(facts, spark, verdicts, out, 50, files=1)
    got = {r.id: (r.sys_from, r.sys_to) for r in jobs.superseded_facts(spark, facts, out).collect()}
    assert got == {0: (1, 50), 1: (50, None), 2: (1, 50), 3: (50, None), 4: (1, None), 5: (1, None)}


def test_a_late_repeat_is_still_a_repeat(spark, tmp_path):
    path = f"{tmp_path}/events"
    for rows in ([(1, "2024-03-01"), (2, "2024-03-01")], [(1, "2024-01-01"), (3, "2024-01-01")]):
        spark.createDataFrame(rows, "event_id long, day string").selectExpr("event_id", "to_timestamp(day) AS ts").coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.event_id for r in jobs.deduplicated(spark, path).collect()) == [1, 2, 3]


def test_fallback_on_rows_that_cannot_be_made(spark):
    good = spark.range(2).selectExpr("id", "1.0 AS score")
    bad = spark.range(2).selectExpr("id", "CAST(raise_error('no') AS double) AS score")
    assert {r.degraded for r in combine.degraded_fallback(lambda: bad, lambda: good, run=tables.saved).collect()} == {True}
    assert {r.degraded for r in combine.degraded_fallback(lambda: good, lambda: bad, run=tables.saved).collect()} == {False}


def prefix(text, most):
    return text.encode()[:most].decode("utf-8", "ignore")


def suffix(text, most):
    body = text.encode()[max(0, len(text.encode()) - most) :]
    while body and body[0] & 0xC0 == 0x80:
        body = body[1:]
    return body.decode()


def test_cuts_end_on_characters(spark):
    texts = ["", "abc", "é" * 7, "a€b€c€" * 3, "😀" * 5, "ab😀é€" * 4]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (1, 2, 3, 4, 5, 9, 10, 11):
        for r in df.select("t", T.byte_prefix(F.col("t"), most).alias("p"), T.byte_suffix(F.col("t"), most).alias("s")).collect():
            assert (r.p, r.s) == (prefix(r.t, most), suffix(r.t, most)), (r.t, most)
    long = "é" * 100
    (got,) = spark.createDataFrame([(long,)], "t string").select(T.truncated_payload(F.col("t"), 100, 51, 31)).first()
    assert got == "é" * 25 + "…elided…" + "é" * 15
    (s,) = ingest.descendants_summary(spark.createDataFrame([(1, 1, "é" * 2000)], "d long, n long, text string"), "d", "n").select("summary").first()
    assert s == "é" * 1024


def test_sentences_and_candidates(spark):
    text = "# Title\n\nDr. Smith met J. Doe at 3.14 today. Yes. They left the house!\nIt was late.\n\n- one item of a list\n- another item of it"
    assert ingest.sentences_of(text) == ["Dr. Smith met J. Doe at 3.14 today. Yes.", "They left the house!", "It was late.", "one item of a list", "another item of it"]
    assert ingest.sentences_of("Oh. That was a long way home.") == ["Oh. That was a long way home."]
    assert ingest.split_merged(". ".join(["one two three four five six"] * 4) + ".", 16) == ["one two three four five six. one two three four five six."] * 2
    assert ingest.at_breaks(["a", "b", "c"], [[1, 0], [1, 0.1], [0, 1]]) == ["a b", "c"]
    df = spark.createDataFrame([(1, "it rained. " * 400), (2, "")], "id long, content string")
    got = ingest.chunk_candidates(df, lambda texts: [[1.0, 0.0]] * len(texts))
    assert {r.candidate for r in got.collect()} == {"structural", "size-variant", "recursive", "semantic-breakpoint"}
    best = ingest.bakeoff(ingest.candidate_scores(got).withColumn("candidate_no", F.col("candidate")), {"size": 1.0, "reference": 0.0}).collect()
    assert [(r.episode_id, r.candidate_no) for r in best] == [(1, "structural")]


def test_chunk_scores(spark):
    df = spark.createDataFrame([("one two.", "one two.\n\nthree"), ("one", "one two.\n\nthree"), ("four", "one two"), ("He, then", "He, then")], "c string, t string")
    got = df.select(ingest.block_score(F.col("c"), F.col("t")).alias("b"), ingest.reference_score(F.col("c")).alias("r"), ingest.reference_score(F.col("c"), ["one"]).alias("n")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.3), (0.5, 1.0, 0.3), (0.75, 1.0, 1.0), (1.0, 0.3, 1.0)]
