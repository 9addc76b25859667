"""Readable bin edges and pairs of words, against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from conftest import rows

from tillview.operators.binning import readable_histogram
from tillview.plans.business import product_collocations


@pytest.mark.parametrize("values, most, width", [
    ([0.0, 9.0, 99.0], 10, 10.0), ([-0.5, 0.0, 0.26, 0.5], 12, 0.1), ([-3.0, 4.0, None, float("nan"), float("inf")], 2, 5.0),
    ([7.5, 7.5], 5, 1.0), ([1e6, 3.1e6], 40, 1e5),
])
def test_readable_histogram(spark, values, most, width):
    table = spark.createDataFrame([(v,) for v in values], "x double")
    found = sorted(rows(readable_histogram(table, "x", most)))
    kept = [v for v in values if v is not None and math.isfinite(v)]
    assert len(found) <= most and sum(r[3] for r in found) == len(kept)
    for at, (number, start, end, n) in enumerate(found):
        assert number == at and end - start == pytest.approx(width)
        assert n == sum(math.floor(v / width) == round(start / width) for v in kept)
    assert found[0][3] and found[-1][3]


def test_no_values(spark):
    assert rows(readable_histogram(spark.createDataFrame([(None,)], "x double"), "x", 5)) == []
    with pytest.raises(ValueError):
        readable_histogram(spark.createDataFrame([(1.0,)], "x double"), "x", 1)


def test_collocations(spark):
    names = ["Green Tea cup"] * 30 + ["green tea"] * 20 + ["cup of tea"] * 9 + ["blue cup"] * 40 + ["green hat"] * 3 + [None, ""]
    table = spark.createDataFrame([(n,) for n in names], "product string")
    words, pairs = Counter(), Counter()
    for name in names:
        parts = (name or "").lower().split()
        words.update(w for w in parts if w != "of")
        pairs.update((x, y) for x, y in zip(parts, parts[1:], strict=False) if "of" not in (x, y))
    total, want = sum(words.values()), {}
    for (x, y), a in pairs.items():
        b, c = words[x] - a, words[y] - a
        d = total - a - b - c
        cells = [(a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)]
        g2 = 2 * sum(o * math.log(o * total / (r * s)) for o, r, s in cells if o)
        if g2 >= 3 and a * total > words[x] * words[y]:
            want[x, y] = (a, g2)
    found = {(r[0], r[1]): r[2:] for r in rows(product_collocations(table, stop_words=("of",), least=3.0))}
    assert set(found) == set(want) and len(want) >= 2
    for key, (n, g2) in want.items():
        assert found[key][0] == n and found[key][1] == pytest.approx(g2, abs=1e-3)
