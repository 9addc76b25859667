from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from tillview.operators.neighbours import PLACE_SCALE, line_sign, projected_matches


def by_hand(ids, blocks, vectors, lines, reach):
    """The written definition: best of the neighbours within ``reach`` places on any line."""
    found = {i: set() for i in range(len(ids))}
    whole = np.floor(vectors * PLACE_SCALE).astype(int)
    for line in range(1, lines + 1):
        places = whole @ np.array([line_sign(line, i) for i in range(vectors.shape[1])])
        for block in set(blocks):
            order = sorted((int(places[i]), ids[i], i) for i in range(len(ids)) if blocks[i] == block)
            for at, (_, _, i) in enumerate(order):
                found[i] |= {j for _, _, j in order[max(0, at - reach) : at + reach + 1]} - {i}
    out = {}
    for i, near in found.items():
        offers = [(-round(float(vectors[i] @ vectors[j]), 9), ids[j]) for j in near]
        offers = [o for o in offers if o[0] < 0]
        out[ids[i]] = (min(offers)[1], -min(offers)[0]) if offers else (None, None)
    return out


def profiles(draw, n, size):
    vectors = draw.integers(0, 4, (n, size)) * draw.integers(0, 2, (n, size)).astype(float)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


@pytest.mark.parametrize("seed, lines, reach, cell", [(0, 3, 2, 7), (1, 5, 1, 3), (2, 4, 8, 512)])
def test_matches_follow_the_definition(spark, seed, lines, reach, cell):
    draw = np.random.default_rng(seed)
    n, size = 90, 6
    vectors = profiles(draw, n, size)
    vectors[10:20], vectors[5] = vectors[0:10], 0
    blocks = ["hot" if i < 60 else None if i < 65 else "warm" for i in range(n - 1)] + ["alone"]
    ids = [f"c{i}" for i in draw.permutation(1000)[:n]]
    data = [(i, b, [float(x) for x in v]) for i, b, v in zip(ids, blocks, vectors)]
    df = spark.createDataFrame(data, "id string, block string, vector array<double>").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in rows(projected_matches(df, size, lines, reach, cell))}
    assert got == by_hand(ids, blocks, vectors, lines, reach)


def test_work_doubles_with_the_rows(spark):
    compared = []
    for n in (400, 800, 1600):
        draw = np.random.default_rng(4)
        data = [(i, "one", [float(x) for x in v]) for i, v in enumerate(profiles(draw, n, 8))]
        df = spark.createDataFrame(data, "id long, block string, vector array<double>")
        compared.append(sum(r[3] for r in rows(projected_matches(df, 8, cell_rows=64))))
    assert 1.9 < compared[1] / compared[0] < 2.1 and 1.9 < compared[2] / compared[1] < 2.1
    assert compared[2] <= 1600 * 12 * 16


def test_short_cells_and_empty_tables(spark):
    df = spark.createDataFrame([], "id long, block string, vector array<double>")
    assert projected_matches(df, 3).count() == 0
    with pytest.raises(ValueError):
        projected_matches(df, 3, reach=8, cell_rows=16)
