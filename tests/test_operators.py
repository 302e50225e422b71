"""Operators on small hand-made frames, and the catalog against DuckDB on a few queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import filters, temporal
from palimpsest.functions import text as T
from palimpsest.operators import aggregate, combine, graph, hydrate, ingest, leaves, lifecycle, recipes, rescore
from palimpsest.plans import tree
from palimpsest.sources import tables

HITS = "query_id long, id long, score double, source_op string, leg string"


def hits(spark, *rows):
    return spark.createDataFrame([(0, *r) for r in rows], HITS)


def test_rrf_sums_over_legs_and_ranks_ties_by_id(spark):
    h = hits(spark, (1, 0.9, "Vector", "c"), (2, 0.9, "Vector", "c"), (2, 0.5, "Keyword", "c"), (3, 0.1, "Keyword", "f"))
    got = {r.id: r.score for r in combine.fuse_rrf(h).collect()}
    assert got == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6), 3: round(1 / 61, 6)}
    weighted = {r.id: r.score for r in combine.fuse_rrf(h, weights={"Keyword": 0.0}).collect()}
    assert weighted[3] == 0.0 and weighted[2] == round(1 / 62, 6)


def test_unions(spark):
    a, b = hits(spark, (1, 0.2, "Vector", "c"), (2, 0.3, "Vector", "c")), hits(spark, (1, 0.7, "Keyword", "c"))
    assert combine.both(a, b).count() == 3
    assert {r.id: r.score for r in combine.either(a, b).collect()} == {1: 0.7, 2: 0.3}


def test_floored_top_reserves_and_backfills(spark):
    h = hits(spark, (1, 0.9, "Vector", "v"), (2, 0.8, "Vector", "v"), (3, 0.7, "Vector", "v"), (4, 0.2, "Keyword", "k"), (5, 0.1, "Keyword", None), (6, 0.6, "Vector", "v"))
    ids = lambda n, floor: [r.id for r in combine.floored_top(h, n, "k", floor).orderBy("rank").collect()]
    assert ids(3, 2) == [1, 4, 5]
    assert ids(3, 0) == [1, 2, 3]
    assert ids(2, 9) == [4, 5]
    assert ids(5, 9) == [1, 2, 3, 4, 5]


def test_fallback_marks_degraded(spark):
    def broken():
        raise RuntimeError

    assert combine.degraded_fallback(broken, lambda: spark.range(2)).where("degraded").count() == 2


def test_hydration_gate(spark):
    h = hits(spark, (1, 0.9, "Vector", "c"), (2, 0.8, "Vector", "c"), (3, 0.7, "Vector", "c"), (4, 0.6, "Vector", "c"))
    chunks = spark.createDataFrame([(1, 10, "a", 0, None), (2, 11, "b", 0, None), (3, 12, "c", 0, 5), (4, 99, "d", 0, None)], "id long, episode_id long, text string, sys_from long, sys_to long")
    eps = spark.createDataFrame([(10, "x", 0, None), (11, "y", 0, 7), (12, "z", 0, None)], "id long, source string, sys_from long, sys_to long")
    assert {(r.id, r.source) for r in hydrate.hydrate(h, chunks, eps).collect()} == {(1, "x"), (4, "")}
    assert {r.id for r in hydrate.hydrate(h, chunks, eps, as_of=4).collect()} == {1, 2, 3, 4}


def test_recency(spark):
    day = 86_400_000
    df = spark.createDataFrame([(1, 1.0, 14 * day), (2, 1.0, 7 * day), (3, 1.0, 0)], "id long, score double, at long")
    got = {r.id: r.score for r in rescore.recency(df, "at", 14 * day).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 1.0}
    assert {r.id: r.score for r in rescore.recency_power(df.where("id = 2"), "at", 14 * day).collect()} == {2: round(1 - 0.5 * math.log(7 * 86400), 6)}


@pytest.mark.parametrize(("a", "b", "meet"), [((0, 5), (5, 9), False), ((0, 6), (5, 9), True), ((0, None), (100, None), True), ((7, None), (0, 7), False)])
def test_half_open_intervals(spark, a, b, meet):
    lit = lambda x: F.lit(x).cast("long")
    assert spark.range(1).select(temporal.intervals_meet(*map(lit, (*a, *b)))).first()[0] is meet


def test_contradictions_equal_all_pairs(spark):
    r = random.Random(0)
    rows = []
    for _ in range(400):
        a = r.randint(0, 100)
        rows.append((r.randint(0, 40), "p", r.randint(0, 2), a, r.choice([None, a + r.randint(-1, 6)])))
    df = spark.createDataFrame(rows, "subject long, predicate string, object long, valid_from long, valid_to long")
    end = lambda x: 10**9 if x is None else x
    good = [x for x in rows if end(x[4]) > x[3]]
    want = {x[0] for x in good for y in good if x[0] == y[0] and x[2] != y[2] and x[3] < end(y[4]) and y[3] < end(x[4])}
    assert {x.subject for x in lifecycle.contradictions(df).collect()} == want


def test_ledger_equals_the_fold(spark):
    r = random.Random(1)
    rows = [(i, t, t, r.choice([1.0, 3.0, -3.0])) for i in range(30) for t in range(r.randint(1, 20))] + [(99, t, t, s) for t, s in enumerate([3.0, -3.0, -3.0, 1.0])]
    want: dict = {}
    for i, _, _, s in rows:
        want[i] = max(0.0, want.get(i, 0.0) + s)
    got = {x.id: x.weighted for x in lifecycle.ledger(spark.createDataFrame(rows, "id long, at long, seq long, strength double")).collect()}
    assert got == want and got[99] == 1.0


def test_classify_and_fold(spark):
    kind = "id long, subject long, predicate string, object long, valid_from long, valid_to long"
    new = spark.createDataFrame([(1, 1, "p", 5, 0, 10), (2, 1, "p", 6, 20, None), (3, 1, "p", 7, 50, 60), (4, 2, "p", 1, 0, None)], kind)
    prior = spark.createDataFrame([(9, 1, "p", 5, 90, 99), (8, 1, "p", 4, 15, 25)], kind)
    assert {r.id: (r.decision, r.loser) for r in lifecycle.classified(new, prior).collect()} == {1: ("Noop", None), 2: ("Supersede", 8), 3: ("Append", None), 4: ("Append", None)}
    assert {r.id: r.decision for r in lifecycle.folded_spo(new.withColumn("seq", F.col("id"))).collect()} == {1: "Append", 2: "Append", 3: "Supersede", 4: "Append"}


def test_soft_forget_is_idempotent(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, sys_to long")
    once = lifecycle.soft_forget(df, F.lit(True), 9)
    assert sorted(map(tuple, lifecycle.soft_forget(once, F.lit(True), 11).collect())) == [(1, 9), (2, 5)]
    with pytest.raises(PermissionError):
        lifecycle.hard_forget(df, F.lit(True), None)


def test_walk_keeps_shortest_and_strongest(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.1), (3, 4, 1.0), (1, 5, 0.9), (5, 4, 0.9)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(0, 1, 0.3), (0, 1, 0.9)], "query_id long, id long, confidence double")
    got = {r.node: (r.path_len, round(r["product"], 4), r.confidence) for r in graph.walk(seeds, e, 2).collect()}
    assert got == {2: (1, 0.5, 0.9), 3: (1, 0.1, 0.9), 5: (1, 0.9, 0.9), 4: (2, 0.81, 0.9)}


def test_label_propagation(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 1, 3), (4, 4, 5), (6, 6, 7), (8, 8, 8)], "component long, a long, b long")
    got = {r.node: r.label for r in graph.label_propagation(e).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and got[4] == got[5] and got[6] == got[7] and 8 not in got
    parts = {r.node: r.component for r in graph.components(e.select("a", "b").where("a <> b")).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6}


def test_chunk_windows_equal_the_sequential_rule(spark):
    def rule(words, target, overlap):
        out, cur, fresh = [], [], 0
        for w in words:
            cur.append(w)
            fresh += 1
            if math.ceil(len(cur) * 1.3) >= target:
                out.append(" ".join(cur))
                cur, fresh = cur[-overlap:], 0
        return out + [" ".join(cur)] * bool(fresh)

    assert ingest.chunk_sizes(500, 100) == (384, 284) and ingest.chunk_sizes(256, 32) == (197, 165)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 383, 384, 385, 668, 669, 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for plain in (ingest.chunk_plain, ingest.chunk_markdown):
        got: dict = {}
        for r in plain(df).orderBy("episode_id", "chunk_no").collect():
            got.setdefault(r.episode_id, []).append(r.text)
        for i, t in enumerate(texts):
            assert got.get(i, []) == rule(t.split(), 500, 100), (plain, i)


def test_markdown_paths(spark):
    df = spark.createDataFrame([(1, "# A\nx y\n## B\nz\n# C\nq")], "id long, content string")
    assert [r.heading_path for r in ingest.chunk_markdown(df, 3, 1).orderBy("chunk_no").collect()] == [["A"], ["A", "B"], ["C"]]


def test_sentences():
    assert ingest.sentences_of("Dr. Smith paid 3.5 to J. Doe. Then he left!  Why?\n\nNew one") == ["Dr. Smith paid 3.5 to J. Doe.", "Then he left! Why?", "New one"]


SAMPLES = ["MY_KEY=abcd1234", "AKIA" + "A" * 16, "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "eyJab.cd.ef", "sk-ant-" + "x" * 20, "xoxb-1234567890", "glpat-" + "a" * 20, "AIza" + "b" * 35, 'password: "hunter22"', "Bearer " + "a" * 20]


def test_every_redaction(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i long, t string")
    for r in df.select("i", T.scrubbed(F.col("t")).alias("t"), T.n_scrubbed(F.col("t")).alias("n")).collect():
        assert f"<REDACTED:{T.SECRETS[r.i][0]}>" in r.t and r.n == 1, r
    assert df.limit(1).select(T.scrubbed(F.lit("max_tokens: 4096"))).first()[0] == "max_tokens: 4096"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a/b", None), (2, "a/c", 5), (3, "z", 9)], "id long, source string, valid_from long")
    ids = lambda f: [r.id for r in df.where(f.column()).orderBy("id").collect()]
    assert ids(filters.And()) == [1, 2, 3] and ids(filters.Or()) == []
    assert ids(filters.ValidTimeRange(5, 9)) == [2]
    assert ids(filters.parse_filter("source LIKE 'a/%'")) == [1, 2] and ids(filters.parse_filter("source = 'z'")) == [3]
    for bad in ("source LIKE 'a'", "source like 'a%'", "source = a", "source LIKE 'a%b%'"):
        with pytest.raises(filters.FilterError):
            filters.parse_filter(bad)


def test_pages_and_scopes(spark):
    df = spark.range(10)
    assert [r.id for r in tables.page(df, 3, 4).collect()] == [5, 6, 7]
    with pytest.raises(tables.PageError, match="large"):
        tables.page(df, 501)
    with pytest.raises(tables.ScopeError):
        tables.checked_scope("no spaces")
    assert tables.composed_scope("b", user="u", session="s") == "b.u-u.s-s"


def test_store_publishes_commits_whole(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    assert store.read("episodes", "id long, scope string").count() == 0
    a = spark.createDataFrame([(1, "s")], "id long, scope string")
    first = store.commit({"episodes": a, "chunks": a})
    second = store.commit({"chunks": a.limit(0)})
    assert first < second and store.read("episodes").count() == 1 and store.read("chunks").count() == 0


def test_plans(spark):
    c = tree.Context(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>"), spark.createDataFrame([(0, "fox")], "query_id long, text string"), {"chunks": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, embedding array<double>")}, {"chunks": spark.createDataFrame([(2, "a fox"), (3, "a dog")], "id long, content string")})
    assert [r.id for r in tree.compile_plan(tree.production(2), c).orderBy("rank").collect()] == [2, 1]
    then = {"op": "then", "left": {"op": "keyword", "index": "chunks", "k": 5}, "right": {"op": "vector", "index": "chunks", "k": 5}}
    assert [r.id for r in tree.compile_plan(then, c).collect()] == [2]
    assert tree.compile_plan({"op": "vector", "index": "nowhere", "k": 3}, c).count() == 0
    for bad in ({"op": "what"}, {"op": "vector", "index": "chunks"}, {"op": "vector", "index": 3, "k": 3}, {}):
        with pytest.raises(tree.PlanError):
            tree.compile_plan(bad, c)
    assert tree.printed(tree.production(2)) == "top(n=2, fuse_rrf(k=60, and(vector(index=chunks, k=2), keyword(index=chunks, k=2))))"


def test_intents_and_measures(spark):
    q = {"When did it start?": "Temporal", "How many days did I jog?": "Counting", "How many weeks did it take?": "Temporal", "What do you recommend?": "Recommendation", "Who is it?": "Factual"}
    got = {r.q: r.i for r in spark.createDataFrame([(x,) for x in q], "q string").select("q", aggregate.intent(F.col("q")).alias("i")).collect()}
    assert got == q
    empty = spark.range(0)
    assert aggregate.micro_f1(empty, empty).first().f1 == 1.0
    assert aggregate.micro_f1(empty, spark.range(3)).first().f1 == 0.0
    assert aggregate.nearest_rank(spark.range(10).withColumn("g", F.lit(1)), "g", "id", 0.95).first().value == 9


def test_citations(spark):
    m = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "beta gamma delta epsilon zeta eta"), (3, "short")], "id long, text string")
    a = spark.createDataFrame([("it said Alpha the beta, gamma delta epsilon!",)], "text string")
    assert [r.id for r in aggregate.cited(m, a).collect()] == [1]


def test_recipes(spark):
    with pytest.raises(ValueError, match="later"):
        recipes.between(spark.range(1), 5, 4)
    df = spark.createDataFrame([("src/a.py",), ("node_modules/x/y.js",), ("src/deep/b.py",)], "path string")
    assert [r.path for r in recipes.allowed_paths(df, ["node_modules/**"], ["src/*.py"]).collect()] == ["src/a.py"]


def test_stream_equals_batch(spark, tmp_path):
    import pandas as pd

    from palimpsest.streaming import jobs

    pdf = pd.DataFrame({"event_id": range(40), "ts": pd.date_range("2024-01-01", periods=40, freq="h"), "user_id": [i % 3 for i in range(40)]})
    pdf["ts"] = pdf["ts"].astype("datetime64[us]")
    (tmp_path / "e").mkdir()
    for i in range(4):
        pdf.iloc[i * 10 : i * 10 + 11].to_parquet(tmp_path / "e" / f"{i}.parquet", index=False)  # each file repeats a row of the next
    assert jobs.deduplicated(spark, str(tmp_path / "e")).count() == 40
    got = {r.episode_id: r.n for r in jobs.consolidated(spark, str(tmp_path / "e"), 1_800_000_000_000).collect()}
    assert sum(got.values()) == 43


@pytest.mark.parametrize("name", ["hybrid_recall", "bm25_filtered", "then_semijoin", "graph_scored", "chunk_plain", "reconcile_classify", "ledger_fold"])
def test_catalog_against_duckdb(spark, name):
    import duckdb

    from palimpsest import catalog

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    r = c.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(r.columns)
    norm = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(x[r.columns.index(k)]) for k in order) for x in r.fetchall())
    assert sorted(tuple(norm(x[k]) for k in order) for x in df.collect()) == want
