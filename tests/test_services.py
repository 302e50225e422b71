"""Services, records and value functions beyond what their SQL shows."""

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog, model
from palimpsest.functions import values as V
from palimpsest.operators import ingest, leaves, lifecycle, records, services
from palimpsest.sources import tables

SF = "/root/testdata/sf0.01"


def test_the_index_finds_what_a_scan_finds(spark):
    q, v = model.query_vectors(spark, SF), model.vectors(spark, SF)
    exact = {(r.query_id, r.id) for r in leaves.vector_search(q, v, 30).collect()}
    got = {(r.query_id, r.id) for r in catalog.queries()["knn_indexed"](spark, SF).collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    held = leaves.listed(v, "id", leaves.centres(v, 16)).collect()
    assert sorted(r.key for r in held) == sorted(r.id for r in v.where(leaves.knn_eligible()).select("id").collect())


def test_values(spark):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.250+01:00",), (" 2024-01-02 ",), ("soon",), (None,), ("1960-01-01T00:00:00Z",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(V.instant_or(F.col("t"), F.lit(-1).cast("long")).alias("x")).collect()]
    assert got == [1704164645000, 1704161045250, 1704153600000, -1, -1, -1]
    texts = ['{"b": 2, "a": {"d": "}", "c": 1}}', "so {\"x\": \"a \\\" } b\"} and", "{ open", None]
    assert [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.first_object(F.col("t")).alias("x")).collect()] == [texts[0], "{\"x\": \"a \\\" } b\"}", None, None]
    assert spark.createDataFrame([(texts[0],)], "t string").select(V.sorted_json(F.col("t"))).first()[0] == '{"a":{"c":1,"d":"}"},"b":2}'
    logs = [("1.2",), ("1.2.3",), ("1.2.99999",), ("x.1",), ("1",), (None,)]
    assert [r.p and tuple(r.p) for r in spark.createDataFrame(logs, "t string").select(V.log_position(F.col("t")).alias("p")).collect()] == [(1, 2, 0), (1, 2, 3), None, None, None, None]


def test_equal_texts_are_embedded_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, text string")
    cache = spark.createDataFrame([("b", [9.0])], "text string, embedding array<float>")
    got = {r.id: r.embedding for r in records.cached_embeddings(rows, lambda t: [[float(len(t))] for _ in t], cache).collect()}
    assert got[1] == got[2] == [1.0] and got[3] == [9.0] and got[4] is None
    chunks = spark.createDataFrame([(1, "x", [1.0]), (2, "y", None)], "id long, text string, embedding array<float>")
    assert {r.id: r.embedding for r in records.promoted(chunks, lambda t: [[5.0] for _ in t]).collect()} == {1: [1.0], 2: [5.0]}


def test_a_failing_extractor_finds_nothing(spark):
    def extract(text):
        if text == "bad":
            raise RuntimeError
        return [{"subject": text, "predicate": "is", "object": "o"}]

    units = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "unit_id long, text string")
    assert sorted(r.unit_id for r in records.extracted(units, extract).collect()) == [1, 3]
    assert records.extracted(units).collect() == []


def test_structured_ingest_is_one_commit(spark, tmp_path):
    e = spark.createDataFrame([(1, "word " * 500)], "id long, content string")
    n = spark.createDataFrame([("Ada", "person"), ("ada ", "person")], "name string, type string")
    f = spark.createDataFrame([("a", "b", "c")] * 2, "subject string, predicate string, object string")
    store = tables.Store(spark, str(tmp_path))
    store.commit(records.structured(e, n, f, ingest.stub_embed))
    assert [store.read(t).count() for t in ("episodes", "entities", "facts")] == [1, 1, 1]
    assert store.read("chunks").where("size(embedding) = 64").count() > 1
    assert records.compacted(e, 511, 1) is None and records.compacted(e, 512, 1).count() == 1


def test_pages_and_kinds(spark):
    kinds = {"episode": spark.range(5)}
    assert [r.id for r in tables.browse(kinds, "episode", 2, 1).collect()] == [2, 3]
    assert tables.browse(kinds, "entity", 2).collect() == [] and tables.next_cursor(tables.page(spark.range(5), 2), 2) == 1
    assert tables.next_cursor(tables.page(spark.range(5), 9), 9) is None
    with pytest.raises(tables.PageError):
        tables.browse(kinds, "other", 2)


def test_files_of_a_session(spark):
    w = spark.createDataFrame([("a.py", 1, 1, "x = 1"), ("a.py", 2, 2, "x = 2"), ("b.py", 3, 3, "y"), ("b.py", 4, 4, None)], "key string, id long, at long, content string")
    assert [r.path for r in services.paths(w).collect()] == ["a.py"] and [r.path for r in services.paths(w, as_of=3).collect()] == ["a.py", "b.py"]
    assert services.edited(w, "a.py", "2", "3", 9).collect()[0].content == "x = 3" and services.edited(w, "a.py", "q", "3", 9).collect() == []
    own, foreign = services.drained(spark.createDataFrame([(1, "s:1"), (2, "t:1"), (3, "s:2")], "offset long, source string"), "s:", 2)
    assert [r.offset for r in own.collect()] == [1] and [r.offset for r in foreign.collect()] == [2]


def test_layers_and_retention(spark):
    calls = []
    layer = lambda name: lambda inner: lambda *a: calls.append(name) or inner(*a)
    assert services.layered(lambda x: x + 1, layer("out"), layer("in"))(1) == 2 and calls == ["out", "in"]
    e = spark.createDataFrame([(1, 0, None), (2, 900, None)], "id long, valid_from long, sys_to long")
    c = spark.createDataFrame([(1,)], "episode_id long")
    assert records.retained(e, c, 1000, None).count() == 2
    assert [(r.id, r.sys_to) for r in records.retained(e, c, 1000, 500).orderBy("id").collect()] == [(1, 1000), (2, None)]
    token = records.retained(e, c, 1000, 500, "preview").first()["token"]
    assert [r.id for r in records.retained(e, c, 1000, 500, "hard", token).collect()] == [2]
    with pytest.raises(PermissionError):
        records.retained(e, c, 1000, 500, "hard")


def test_missing_winners_and_empty_names(spark):
    f = spark.createDataFrame([(1, 5, None, 5, "a", "p", 0.5, None)], "id long, sys_from long, sys_to long, valid_from long, name string, predicate string, confidence double, valid_to long")
    pairs = spark.createDataFrame([(1, 2)], "loser long, winner long")
    assert [r.id for r in lifecycle.superseded(f, pairs, 9).collect()] == [1]
    assert {r.id: (r.sys_from, r.sys_to) for r in lifecycle.superseded(f, pairs, 9, synthetic=True).collect()} == {1: (5, 9), 2: (9, None)}
    bad = f.withColumn("name", F.lit(" "))
    assert [lifecycle.validated(x, ("name",)).first()["reason"] for x in (f, bad)] == [None, "empty_name"]
    e = spark.createDataFrame([(1, 0)], "episode_id long, at long")
    assert lifecycle.base_level(e, 1000, spreading=2.0).first()["activation"] == 2.0
