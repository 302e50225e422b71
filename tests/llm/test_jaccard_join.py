"""The Jaccard join against all pairs."""

import random
import re

from palimpsest.llm import jaccard_join


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (d, x) in enumerate(sets):
        for j in range(i):
            e, y = sets[j]
            if x and y and d is not None and e is not None and 100 * len(x & y) >= percent * len(x | y):
                label[find(i)] = find(j)
    least = {}
    for i, (d, x) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(x), None if d is None else least[find(i)]) for i, (d, x) in enumerate(sets)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgHIJé") for _ in range(4)) for _ in range(300)]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, 60, 150]))] for _ in range(25)]
    rows = []
    for d in range(220):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w += [r.choice(vocab) for _ in range(len(w) // 12)]
        rows.append((d, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(300, None), (301, ""), (302, " \n "), (303, rows[0][1].upper().replace("É", "é")), (0, rows[0][1]), (None, rows[0][1]), (None, None)]
    r.shuffle(rows)
    return rows


def got(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS cls", "2 AS component", "3 AS n")
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(df, k, percent).collect()), key=repr)


def test_against_all_pairs(spark):
    rows = corpus(2)
    assert got(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_second_round_and_packs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    plain = jaccard_join.exchange
    monkeypatch.setattr(jaccard_join, "exchange", lambda *a: plain(*a, pack_bytes=3000, bucket_bytes=4000))
    rows = corpus(3)
    assert got(spark, rows, 2, 60) == brute(rows, 2, 60)


def test_empty_table(spark):
    assert got(spark, [], 4, 85) == []


def test_one_of_each_keeps_the_least(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (9, "x y z u v w t"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(df).collect()) == [2, 7, 9]
