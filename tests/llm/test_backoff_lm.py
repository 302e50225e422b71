"""Stupid backoff against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from palimpsest.llm import backoff_lm


def brute(rows, order, leave_out):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    grams = lambda w: Counter(tuple(w[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(k - 1, len(w)))
    every = sum((grams(w) for w in words), Counter())
    out = []
    for (d, _), w in zip(rows, words):
        own = grams(w) if leave_out else Counter()
        c = lambda g: every[g] - own[g]
        total = max(1, sum(map(len, words)) - (len(w) if leave_out else 0))
        score = 0.0
        for i in range(len(w)):
            longest = min(i + 1, order)
            for k in range(longest, 1, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if c(g) > 0:
                    score += math.log(c(g) / c(g[:-1])) + (longest - k) * math.log(0.4)
                    break
            else:
                score += math.log(max(c((w[i],)), 1) / total) + (longest - 1) * math.log(0.4)
        out.append((d, len(w), round(score, 6) if w else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("order", "leave_out"), [(2, True), (3, True), (3, False), (1, True)])
def test_against_plain_version(spark, order, leave_out):
    r = random.Random(order)
    vocab = ["a", "b", "c", "dd", "é", "f.", "G", "h"] * 4 + [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for d in range(150)]
    rows += [(150, None), (151, " \n"), (3, rows[3][1]), (None, rows[4][1]), (152, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS part")
    got = backoff_lm.score_documents(df, order, leave_out=leave_out, pack_bytes=1500, bucket_bytes=3000).collect()
    assert sorted(((x.doc_id, x.n_words, None if x.log_score is None else round(x.log_score, 6)) for x in got), key=repr) == brute(rows, order, leave_out)


def test_empty_table(spark):
    assert backoff_lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
