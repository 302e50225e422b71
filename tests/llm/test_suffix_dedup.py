"""Removal of repeated substrings against a brute-force version."""

import hashlib
import random

from palimpsest.llm import suffix_dedup


def brute(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if d is not None and first[b[i : i + width]] < d:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=3, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(12)]
    rows = []
    for d in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else word() for _ in range(r.randint(0, 25))]
        rows.append((d, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 49), (n + 3, "x" * 50), (n + 4, "x" * 300), (n + 5, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (n + 6, rows[5][1] * 40)]
    r.shuffle(rows)
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pack", "2 AS blob")
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, **more).collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_many_packs_and_buckets(spark, monkeypatch):
    rows = corpus(5, 200)
    plain = suffix_dedup.exchange
    monkeypatch.setattr(suffix_dedup, "exchange", lambda *a: plain(*a, pack_bytes=4000, bucket_bytes=9000))
    assert got(spark, rows) == brute(rows)


def test_steps_within_a_text(spark):
    r = random.Random(1)
    base = "".join(r.choice("ab") for _ in range(1_200_000))
    rows = [(1, base), (2, "zz" + base[1_048_000:1_049_500] + "yy" + base[5:80])]
    assert got(spark, rows) == [r_ for r_ in [(1, 1_200_000, 0, 0, hashlib.sha256(base.encode()).hexdigest()), (2, 2 + 1500 + 2 + 75, 1575, 2, hashlib.sha256(b"zzyy").hexdigest())]]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_cleaned_keeps_rows_and_columns(spark):
    rows = [(1, "x" * 60, 60, 7), (2, "x" * 60, 60, 8), (3, None, None, 9), (4, "ab" + "x" * 55, 57, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, n_removed long").selectExpr("*", "'k' AS kept_text")
    got = suffix_dedup.cleaned(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "x" * 60, 60, 7, "k"), (2, "", 0, 8, "k"), (3, None, None, 9, "k"), (4, "ab", 2, None, "k")]


def test_longest_previous_factors():
    import numpy as np

    r = random.Random(12)
    for case in range(60):
        width = r.choice([24, 30, 50])
        pieces = [bytes(r.choice(b"ab\0") for _ in range(r.randint(10, 60))) for _ in range(6)]
        texts = [b"".join(r.choice(pieces)[r.randint(0, 5) :] for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 9))]
        body = b"".join(texts)
        begins = [sum(map(len, texts[:k])) for k in range(len(texts))]
        places = np.array([b + i for b, t in zip(begins, texts) for i in range(len(t) - width + 1)], np.int64)
        doc = np.array([k for k, t in enumerate(texts) for _ in range(len(t) - width + 1)], np.int64)
        doc = np.array([r.randint(0, 4) for _ in texts], np.int64)[doc] if len(doc) else doc  # some texts of one document
        data = np.frombuffer(body, np.uint8)
        levels = suffix_dedup.suffix_levels(data, width)
        order = np.argsort(levels[-1][1][places], kind="stable")
        assert [body[p : p + width] for p in places[order]] == sorted(body[p : p + width] for p in places)
        common = lambda p, q: next((k for k in range(width) if body[p + k] != body[q + k]), width)
        lcp = suffix_dedup.common_prefixes(data, levels, places[order])
        assert lcp[1:].tolist() == [common(p, q) for p, q in zip(places[order], places[order][1:])]
        want = [max([0, *(common(p, q) for q, e in zip(places, doc) if e < d)]) for p, d in zip(places[order], doc[order])]
        for least in (1, 10, width):
            assert suffix_dedup.longest_previous(doc[order], lcp, least).tolist() == [x if x >= least else 0 for x in want]


def test_equal_hashes_of_different_strings(spark, monkeypatch):
    """Were all strings to share a few hashes, their bytes would still tell them apart."""
    plain = suffix_dedup.string_hashes
    monkeypatch.setattr(suffix_dedup, "string_hashes", lambda *a: plain(*a) % suffix_dedup.U64(3))
    rows = corpus(9, 60)
    assert got(spark, rows) == brute(rows)
