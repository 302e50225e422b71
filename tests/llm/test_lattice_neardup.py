"""Lattice hashing against all pairs."""

import numpy as np
import pytest

from palimpsest.llm import lattice_neardup


def brute(rows, at_least=0.95):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: 0 for k in range(len(ok))}
    label = list(range(len(ok)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(ok):
        for j in range(i):
            b = ok[j][1]
            if len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= at_least:
                    links[i] += 1
                    links[j] += 1
                    label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ok):
        least[find(i)] = min(least.get(find(i), d), d)
    good = [(d, links[i], least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(ok)]
    rest = [(i, 0, i, None if i is None else True) for i, v in rows if (i, v) not in ok]
    return sorted(good + rest, key=repr)


def rows_of(seed=0, dim=64):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        c = r.standard_normal(dim)
        for _ in range(r.integers(1, 12)):
            x = c + r.standard_normal(dim) * r.choice([0.0, 0.05, 0.2, 0.25])
            rows.append((len(rows), [float(v) for v in x]))
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [None, *rows[0][1][1:]]), (n + 5, [2 * x for x in rows[0][1]]), (0, rows[0][1]), (None, rows[0][1]), (n + 6, [1e200] * dim), (n + 7, [1e-200] * dim), (n + 8, [1.0, 2.0, 3.0]), (n + 9, [1.0, 2.0, 3.01]), (n + 10, [float("inf"), *rows[0][1][1:]])]
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS cls", "3 AS key")
    return sorted((tuple(x) for x in lattice_neardup.near_vectors(df).collect()), key=repr)


def test_against_all_pairs(spark):
    rows = rows_of()
    assert got(spark, rows) == brute(rows)


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(lattice_neardup, "BLOCK", 3)
    rows = rows_of(3)
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_nearest_lattice_point():
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 8)) * 2
    p = lattice_neardup.nearest_e8(x)
    d = ((x - p) ** 2).sum(1)
    for v in lattice_neardup.MINIMAL:
        assert (((x - p - v) ** 2).sum(1) >= d - 1e-9).all()


@pytest.mark.parametrize("cosine", [0.951, 0.97])
def test_recall_on_pairs_at_the_threshold(cosine):
    r = np.random.default_rng(0)
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.standard_normal(a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    c = lattice_neardup.Cells(64, 5, 2, 4, 3.0, 7)
    (ha, va), (hb, vb) = c.of(a), c.of(b)
    hit = (ha == hb) | (va == hb[:, :, None]).any(2) | (vb == ha[:, :, None]).any(2)
    assert hit.any(1).mean() > 0.99
