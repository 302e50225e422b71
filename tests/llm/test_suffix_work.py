"""What a bucket's answers cost: the bytes that they name, not those of the whole pack."""

import tracemalloc

import numpy as np

from palimpsest.llm import suffix_dedup as S


def test_places_take_memory_for_what_they_name():
    starts, sizes = np.array([5_000_000, 3, 7_999_990], np.int64), np.array([3, 0, 2], np.int64)
    tracemalloc.start()
    assert S.places(starts, sizes).tolist() == [5_000_000, 5_000_001, 5_000_002, 7_999_990, 7_999_991]
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    assert S.places(starts[:0], sizes[:0]).tolist() == []
