"""Connected components by distributed rounds, and the packed arrays."""

import random

import numpy as np
import pytest

from palimpsest.llm import arrays, shared


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("at_once", [2, 2_000_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(shared, "LOCAL_LINKS", at_once)
    r = random.Random(at_once)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 400 + i) for i in range(20)]
    links += links[:5]
    got = {x.node: x.component for x in shared.components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == brute([x for x in links if x[0] != x[1]])
    assert shared.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_packed_integers():
    r = np.random.default_rng(0)
    for bits in (3, 20, 46, 64):
        for n in (0, 1, 2, 1000):
            x = np.unique(r.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True))
            assert (arrays.unpack_sorted(arrays.pack_sorted(x)) == x).all()
            c = r.integers(0, 100, len(x)).astype("<u4")
            if len(x):
                keys, counts = arrays.unpack_counts(arrays.pack_counts(x, c))
                assert (keys == x).all() and (counts == c).all()


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 8, 50):
        assert (arrays.sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def test_long_words_hash_by_their_bytes():
    rng = np.random.default_rng(2)
    word = bytes(rng.integers(97, 122, 2 * arrays.STEP + 5000, dtype=np.uint8))
    data = np.frombuffer(word + b" " + word + b" " + word[:-1] + b"!", np.uint8)
    starts, ends, _ = arrays.word_spans(data, np.array([0, len(data)]))
    h = arrays.span_hashes(data, starts, ends)
    assert len(h) == 3 and h[0] == h[1] != h[2]


def test_packed_integers_of_any_size():
    import numpy as np

    from palimpsest.llm import arrays

    cases = [np.array([], np.int64), np.array([5]), np.array([-7, 2**40, 3]), np.array([-(2**63), 2**63 - 1]), np.arange(1000) % 300]
    got = arrays.unpack_ints(arrays.pack_ints(*cases))
    assert [g.tolist() for g in got] == [c.tolist() for c in cases]
    keys = np.array([0, 1, 1 << 20, (1 << 64) - 1], np.uint64)
    assert arrays.unpack_sorted(arrays.pack_sorted(keys)).tolist() == keys.tolist()
    assert arrays.unpack_sorted(arrays.pack_sorted(keys[:1])).tolist() == [0] and len(arrays.unpack_sorted(arrays.pack_sorted(keys[:0]))) == 0
