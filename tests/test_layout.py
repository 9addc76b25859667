from __future__ import annotations

from datetime import date

import pytest
from conftest import plan, rows

from registry import tables as t
from tillview.operators import filters, joins, scoring
from tillview.sources import layout, star


@pytest.fixture(scope="module")
def stored_orders(spark, folder, tmp_path_factory):
    orders = star.orders_with_place(spark, folder)
    path = layout.write_orders(orders, str(tmp_path_factory.mktemp("orders") / "o"))
    return orders, layout.read_orders(spark, path, orders.schema)


@pytest.mark.parametrize("low, high, whole", [
    (date(1996, 1, 1), date(1996, 1, 31), True), (date(1995, 11, 17), date(1997, 2, 3), False), (date(1996, 5, 5), date(1996, 5, 4), False),
    (None, date(1996, 1, 1), False),
])
def test_date_filters_prune_months(stored_orders, low, high, whole):
    plain, stored = stored_orders
    kept = layout.orders_between(stored, low, high, whole)
    assert sorted(rows(kept.drop(layout.MONTH))) == sorted(rows(filters.by_date_range(plain, low, high, whole)))
    if low:
        part = plan(kept).split("PartitionFilters: [")[1].split("]")[0]
        assert f"(order_month" in part and f">= {low:%Y-%m}" in part and f"<= {high:%Y-%m}" in part


def test_orders_without_a_date_are_kept(spark, tmp_path):
    df = spark.sql("SELECT 1L AS transaction_id, CAST(NULL AS TIMESTAMP_NTZ) AS order_date UNION ALL SELECT 2L, TIMESTAMP_NTZ '2024-02-03 10:00:00'")
    path = layout.write_orders(df, str(tmp_path / "o"))
    back = layout.read_orders(spark, path, df.schema)
    assert sorted(r.transaction_id for r in back.collect()) == [1, 2]
    assert [r.transaction_id for r in layout.orders_between(back, date(2024, 1, 9), date(2024, 2, 28)).collect()] == [2]


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    made = {
        "predictions": t.predictions(spark, folder), "orders": star.transactions(spark, folder), "rfm": t.rfm(spark, folder),
        "features": t.features(spark, folder),
    }
    return layout.customer_tables(made, str(tmp_path_factory.mktemp("buckets")), buckets=4)


def test_base_join_does_not_shuffle(spark, folder, tables):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = layout.bucketed_insights_base(**tables)
        text = plan(base)
        assert "Exchange" not in text and text.count("SortMergeJoin") == 3 and "Bucketed: true" in text
        assert "Exchange" in plan(joins.insights_base(**{k: v for k, v in {
            "predictions": t.predictions(spark, folder), "orders": star.transactions(spark, folder), "rfm": t.rfm(spark, folder),
            "features": t.features(spark, folder)}.items()}))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_base_join_has_the_same_rows(tables):
    got, want = layout.bucketed_insights_base(**tables), joins.insights_base(**tables)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == want.count()


def test_counts_per_customer_do_not_shuffle(tables):
    assert "Exchange" not in plan(tables["predictions"].groupBy("customer_id").count())


def test_predictions_are_dealt_once_for_scores_and_base(spark, folder):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bought, wide = star.shared_inputs(spark, folder)
        # Purchases meet features and are added up by customer where they lie.
        assert "Exchange" not in plan(star.category_features(bought)) and "Exchange" not in plan(bought.join(wide, "customer_id"))
        predicted = star.predictions(spark, folder, bought=bought, features=wide)
        stored = scoring.preprocess_predictions(predicted)
        assert "Exchange" not in plan(stored.groupBy("customer_id").count())
        again = scoring.scored_predictions(t.predictions(spark, folder))
        assert stored.exceptAll(again).isEmpty() and stored.count() == again.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
