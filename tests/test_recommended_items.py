"""Recommended items of made-up purchases."""

from __future__ import annotations

import numpy as np
from conftest import plan, rows

from __spark_entry__ import queries
from tillview.sources import star


def test_recommended_items_with_nulls_and_repeats(spark):
    draw, categories = np.random.default_rng(2), star.CATEGORIES[:3]
    names = [None, *(f"p{k}" for k in range(9))]
    bought = [(int(c), names[draw.integers(10)], categories[draw.integers(3)]) for c in draw.integers(1, 13, 90)]
    bought += [(3, None, categories[0]), (4, "p1", None), (None, "p2", categories[1])]
    spend = {c: [float(x) for x in draw.integers(1, 99, 3)] for c in range(1, 15)}
    matches = [(int(c), int(m), 0.5) for c, m in zip(range(1, 15), draw.integers(1, 15, 14), strict=True)] + [(15, 1, 0.1), (2, None, None)]
    wide = "customer_id long, " + ", ".join(f"`{c}{star.SPEND_SUFFIX}` double" for c in categories)
    found = star.recommended_items(
        spark.createDataFrame(matches, "customer_id long, Matched_Customer_ID long, Similarity_Score double"),
        spark.createDataFrame(bought, "customer_id long, product string, category string"),
        spark.createDataFrame([(c, *x) for c, x in spend.items()], wide), categories,
    )
    want = []
    for customer, matched, _ in matches:
        if customer in spend and matched is not None:
            top = min(zip((-x for x in spend[customer]), categories, strict=True))[1]
            own = {p for c, p, _ in bought if c == customer}
            want += [(customer, p, None if k is None else k == top) for c, p, k in bought if c == matched and (p is None or p not in own)]
    assert sorted(rows(found), key=repr) == sorted(want, key=repr) and any(p is None for _, p, _ in want)


def test_purchases_are_not_dealt_again_for_recommended_items(spark, folder):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = plan(queries()["pre_07_recommended_items"](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # Two exchanges bring matches to their customer and the purchases, one what is offered to the customer.
    assert "LeftAnti" not in built and built.count("Exchange hashpartitioning(") == 3
    assert built.count("Bucketed: true") == 3
