from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from tillview.operators import matching
from tillview.operators.matching import best_matches
from tillview.sources import star


def brute_force(ids, blocks, vectors):
    sims = np.round(vectors @ vectors.T, 9)
    found = {}
    for i, own in enumerate(ids):
        others = [(-sims[i, j], ids[j]) for j in range(len(ids)) if j != i and blocks[j] == blocks[i] and sims[i, j] > 0]
        found[own] = (min(others)[1], -min(others)[0]) if others else (None, None)
    return found


@pytest.mark.parametrize("seed, cell_bits", [(0, 2), (1, 3), (2, 11)])
def test_best_matches_are_exact(spark, seed, cell_bits):
    draw = np.random.default_rng(seed)
    n, size = 90, 6
    # Sparse profiles with repeats; the first block owns most rows, the last one row.
    vectors = draw.integers(0, 4, (n, size)) * draw.integers(0, 2, (n, size)).astype(float)
    vectors[10:20] = vectors[0:10]
    vectors[5] = 0
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    blocks = ["hot" if i < 70 else "warm" for i in range(n - 1)] + ["alone"]
    ids = [int(i) for i in draw.permutation(1000)[:n]]
    data = [(i, b, str(int(np.argmax(v))), [float(x) for x in v]) for i, b, v in zip(ids, blocks, vectors)]
    df = spark.createDataFrame(data, "id long, block string, near string, vector array<double>")
    got = {r[0]: (r[1], r[2]) for r in rows(best_matches(df, size, cell_bits=cell_bits, salts=3))}
    assert got == brute_force(ids, blocks, vectors)


def test_tiles_give_what_one_matrix_gives(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 7)
    draw = np.random.default_rng(5)
    vectors = draw.integers(0, 3, (80, 4)).astype(float)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    ids, blocks = [int(i) for i in draw.permutation(80)], ["one"] * 80
    data = [(i, b, "", [float(x) for x in v]) for i, b, v in zip(ids, blocks, vectors)]
    df = spark.createDataFrame(data, "id long, block string, near string, vector array<double>").repartition(3)
    for bits in (4, 15):
        got = {r[0]: (r[1], r[2]) for r in rows(best_matches(df, 4, cell_bits=bits, salts=2))}
        assert got == brute_force(ids, blocks, vectors)


def test_customers_get_their_best_match_however_many_there_are(spark):
    draw = np.random.default_rng(6)
    spend = draw.integers(1, 1000, (400, 12)).astype(float)
    spend[:, 0] += 2000
    names = [f"c{i}" for i in range(12)]
    columns = ", ".join(f"{c}_spend double" for c in names)
    features = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(spend)], f"customer_id long, {columns}")
    vectors = spend / np.linalg.norm(spend, axis=1, keepdims=True)
    got = {r[0]: (r[1], r[2]) for r in rows(star.customer_matches(features, categories=names))}
    assert got == brute_force(list(range(400)), ["c0"] * 400, vectors)
