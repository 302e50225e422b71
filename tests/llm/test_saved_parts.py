"""How many files saved tables have: on a local disk each costs two processes, which for a moment hold an executor's memory once more."""

from pathlib import Path
from urllib.parse import urlparse

from palimpsest.llm import jaccard_join, mixing, quality_rules
from palimpsest.llm.shared import saved

WORDS = [f"w{i}" for i in range(40)]


def files(spark):
    at = spark.sparkContext.getCheckpointDir()
    return {p for p in Path(urlparse(at).path).rglob("part-*")} if at else set()


def test_small_tables_are_saved_in_few_parts(spark):
    rows = [(i, " ".join(WORDS[(i * i + k * (1 + i % 7)) % 40] for k in range(60)) + f" {i // 2}", "en", f"s{i % 2}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = {}
    try:
        for n in (4, 61):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            for name, run in (("rules", quality_rules.judge), ("join", jaccard_join.near_duplicates), ("mix", mixing.mixed_rows)):
                old = files(spark)
                out = sorted(map(tuple, run(docs).collect()), key=repr)
                got[name, n] = out
                tables = {}
                for p in files(spark) - old:
                    tables[p.parent] = tables.get(p.parent, 0) + 1
                assert tables and max(tables.values()) <= 4, (name, n, sorted(tables.values()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("rules", "join", "mix"):
        assert got[name, 4] == got[name, 61] and got[name, 4]


def test_parts_are_merged_only_beyond_what_rows_are_worth(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        rows = spark.range(0, 100, 1, 20)
        assert [saved(rows, k).rdd.getNumPartitions() for k in (None, 1, 7, 20, 99)] == [20, 4, 7, 20, 20]
        assert saved(rows, 1).count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
