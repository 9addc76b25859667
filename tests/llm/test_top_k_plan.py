"""What op6 sends through the driver."""

from __future__ import annotations

import numpy as np

from conftest import plan
from tillview.llm import inner_top_k


def test_copies_of_queries_are_not_broadcast(spark):
    vectors = np.random.default_rng(8).normal(size=(300, 8)).tolist()
    table = inner_top_k.quantised(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    best = inner_top_k.top_inner_products(table.where("vec_id % 20 = 0"), table)
    assert "BroadcastHashJoin" not in plan(best) and "SortMergeJoin" in plan(best)
    whole = np.floor(64 * np.array(vectors))
    for query, rows in ((q, [r for r in best.collect() if r.query_id == q]) for q in (0, 140)):
        scores = sorted((-int(s), n) for n, s in enumerate(whole @ whole[query]) if n != query)[:20]
        assert [(-r.score, r.vec_id) for r in sorted(rows, key=lambda r: r.rank)] == scores
