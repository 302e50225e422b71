"""The pipeline's stages on a small table."""

import random

import corpus_pipeline


def rows_of(seed=0):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = text(60)
    rows = [(d, text(r.randint(40, 200)), "en", f"s{d % 3 if d % 2 else 0}", 7) for d in range(200)]
    rows += [(200 + i, rows[i][1] + " one more", "en", "s1", 7) for i in range(10)]
    rows += [(300 + i, f"{text(80)} {shared} {text(80)}", "en", "s2", 7) for i in range(6)]
    rows += [(400, "$$$ " * 100, "en", "s1", 7), (401, None, None, None, None), (402, "", "en", "s1", 0)]
    return rows, shared


def test_stages(spark, tmp_path):
    rows, shared = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        if name != "byte-level BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    kept, single, cut, mixed, encoded = seen
    assert {r.doc_id for r in kept} == ids - {400, 401, 402}
    assert {r.doc_id for r in single} == ids - {400, 401, 402} - set(range(200, 210))
    assert sum(shared in (r.text or "") for r in cut) == 1 and len(cut) == len(single)
    assert {r.doc_id for r in mixed} == {r.doc_id for r in cut} and len(mixed) > len(cut)
    assert len(encoded) == len(mixed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, encoded))
