"""Mixing against a plain version of the same rule."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing


def rows_of(seed=1):
    r = random.Random(seed)
    rows = [(d, "w " * r.randint(0, 60), r.choice(["a"] * 6 + ["b", "b", "c", None])) for d in range(900)]
    rows += [(900, None, "a"), (901, None, "none"), (5, *rows[5][1:]), (None, "x y z", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS h", "2 AS block", "3 AS epoch")


def brute(spark, rows, limit, block_docs, seed=17):
    tokens, docs = Counter(), defaultdict(list)
    for d, t, s in rows:
        tokens[s] += len((t or "").split())
        docs[s].append((d, len((t or "").split())))
    total = sum(tokens.values())
    p = {s: v / total for s, v in tokens.items() if v}
    lo, hi = 0, 1 << 20
    while hi - lo > 1:
        a = (lo + hi) // 2 / (1 << 20)
        e = [v ** (a - 1) for v in p.values()]
        lo, hi = (lo, (lo + hi) // 2) if max(e) / min(e) <= limit else ((lo + hi) // 2, hi)
    a = hi / (1 << 20)
    z = sum(v**a for v in p.values())
    budget = total * z / min(v ** (a - 1) for v in p.values())
    out = []
    for s in docs:
        b = int(p[s] ** a / z * budget + 1e-6) if s in p else 0
        whole, rest = divmod(b, tokens[s]) if s in p else (1, 0)
        blocks = -(-len(docs[s]) // block_docs)
        for e in range(whole + (rest > 0)):
            h = {d: x for d, x in spark.createDataFrame([(d,) for d, _ in docs[s]], "d long").select("d", F.xxhash64(F.lit(seed), F.lit(e).cast("long"), F.coalesce(F.col("d").cast("string"), F.lit("-")))).collect()}
            used = Counter()
            for d, n in docs[s]:
                used[(h[d] % blocks, h[d], -1 if d is None else d)] += n
            run = 0
            for (blk, hh, d), n in sorted(used.items()):
                run += n
                if e < whole or run <= rest:
                    out += [(None if d < 0 else d, s, e)] * sum((x is None and d < 0) or x == d for x, _ in docs[s])
    return sorted(out, key=repr)


def test_against_plain_version(spark):
    rows = rows_of()
    df = frame(spark, rows)
    got = mixing.mix(df, block_docs=50, mix_block_tokens=2000).collect()
    assert sorted(((x.doc_id, x.source, x.epoch) for x in got), key=repr) == brute(spark, rows, 2.0, 50)
    # every document is used, and each block of the mix holds the weights
    assert {x.doc_id for x in got} == {d for d, *_ in rows}
    by = defaultdict(Counter)
    for x in got:
        by[x.mix_block][x.source] += x.n_tokens
    shares = [c["a"] / sum(c.values()) for b, c in sorted(by.items())][:-1]
    assert max(shares) - min(shares) < 0.15
    # the stage repeats rows as the mix does
    again = Counter(r.doc_id for r in mixing.mixed_rows(df, block_docs=50).collect())
    assert again == Counter(x.doc_id for x in got)
    assert mixing.mixed_rows(df, block_docs=50).columns == df.columns


def test_entropy_target(spark):
    p = [0.7, 0.2, 0.06, 0.04]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    a = mixing.exponent(df, 1.2, None)
    w = [x**a for x in p]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert 0 <= h - 1.2 < 1e-4


def test_budget_below_the_corpus(spark):
    got = mixing.mix(frame(spark, rows_of(2)), budget=5000, block_docs=64).collect()
    assert 4000 < sum(x.n_tokens for x in got) <= 5000


def test_empty_and_single(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert mixing.mixed_rows(frame(spark, [])).collect() == []
    assert [x.epoch for x in mixing.mix(frame(spark, [(1, "a b", "s")])).collect()] == [0]


def two_sources(spark):
    return frame(spark, [(d, "w " * 40, "small") for d in range(3)] + [(100 + d, "w " * 40, "large") for d in range(30)])


def epochs(got):
    return {s: max(x.epoch for x in got if x.source == s) + 1 for s in {x.source for x in got}}


def test_repetition_limit_holds_under_any_budget(spark):
    df = two_sources(spark)
    # 1,320 tokens; a budget of 2,000 repeats them 1.5 times, the smaller source no more than twice
    assert epochs(mixing.mix(df, repetition_limit=2.0, budget=2000).collect()) == {"small": 2, "large": 2}
    got = mixing.mix(df, repetition_limit=2.0, budget=1320).collect()
    assert epochs(got)["small"] <= 2 and sum(x.n_tokens for x in got if x.source == "small") <= 2 * 120
    with pytest.raises(ValueError, match="repeats"):
        mixing.mix(df, repetition_limit=2.0, budget=5000)


def test_targets_that_cannot_be_met(spark):
    df = two_sources(spark)
    with pytest.raises(ValueError, match="entropy"):
        mixing.mix(df, target_entropy=5.0, repetition_limit=None)
    with pytest.raises(ValueError, match="within"):
        mixing.mix(df, target_entropy=math.log(2) - 1e-6, repetition_limit=1.5)
    p = spark.createDataFrame([(3 / 33,), (30 / 33,)], "p double")
    a = mixing.exponent(p, 0.4, 6.0)
    w = [(3 / 33) ** a, (30 / 33) ** a]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert h >= 0.4 - 1e-6 and (3 / 30) ** (a - 1) <= 6.0
