"""How many bands short templates need."""

import pytest

from palimpsest.llm import license_scan


def test_bands_hold_the_bound():
    assert license_scan.bands_needed(1, 12, 0.8, 2e-6) == 151 and (11 / 12) ** 151 <= 2e-6 < (11 / 12) ** 150
    assert license_scan.bands_needed(5, 28, 0.8, 2e-6) == 89


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0"])
def test_no_short_line_is_lost(spark, name):
    """Each line lies whole in one window only, among words of its own."""
    words = lambda d, k, n: " ".join(f"x{d}y{k}z{i}" for i in range(n))
    rows = [(d, f"{words(d, 0, 17)} {license_scan.TEMPLATES[name]} {words(d, 1, 30)}") for d in range(4000)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where(f"license = '{name}'")
    assert {r.doc_id for r in got.collect()} == set(range(4000))
