"""Empty tables, clashing columns and very long texts."""

import corpus_pipeline
from palimpsest.llm import byte_bpe, license_scan, token_counts
from palimpsest.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_tokens_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert byte_bpe.encode_documents(none, *tokenizer()).collect() == []
    trees = token_counts.build_trees(none, *tokenizer())
    assert trees.collect() == []
    edited = token_counts.edits_by_rule(trees, [("a", "b")])
    assert edited.collect() == [] and token_counts.apply_edits(edited, *tokenizer()).collect() == []


def test_a_column_named_edits_gives_way(spark):
    trees = token_counts.build_trees(spark.createDataFrame([(1, "a cat")], "doc_id long, text string"), *tokenizer()).selectExpr("*", "7 AS edits")
    edited = token_counts.edits_by_rule(trees, [("cat", "dog")])
    assert [r.n_edits for r in token_counts.apply_edits(edited, *tokenizer()).collect()] == [1]


def test_very_long_texts(spark):
    long = "the quick brown fox " * 60_000
    rows = [(1, long + "Released under the MIT License. " + long, "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert [(r.license, r.containment) for r in license_scan.scan(df).collect()] == [("MIT", 1.0)]
    (n,) = [r.n_tokens for r in byte_bpe.encode_documents(df, *tokenizer()).collect()]
    trees = token_counts.build_trees(df, *tokenizer())
    (got,) = token_counts.apply_edits(token_counts.edits_by_rule(trees, [("MIT", "BSD")]), *tokenizer()).collect()
    assert got.n_tokens == n and got.n_reencoded < 1000


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
