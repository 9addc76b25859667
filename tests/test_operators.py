from __future__ import annotations

from datetime import date

import pytest
from conftest import plan, rows

from tillview.operators import filters, joins, ranking, scoring
from tillview.plans import customers


def test_date_range_cuts_at_midnight(spark):
    df = spark.sql("SELECT CAST(x AS timestamp_ntz) AS order_date FROM VALUES "
                   "('2024-01-02 00:00:00'), ('2024-01-02 10:00:00'), (NULL) AS t(x)")
    bounds = (date(2024, 1, 1), date(2024, 1, 2))
    assert filters.by_date_range(df, *bounds).count() == 1
    assert filters.by_date_range(df, *bounds, end_inclusive_day=True).count() == 2
    assert filters.by_date_range(df, date(2024, 1, 1), None).count() == 3


def test_priority_tier(spark):
    data = [(p, r) for p in (0.39, 0.4, 0.7, 0.71) for r in (30, 31, None)]
    df = spark.createDataFrame(data, "propensity_score double, Recency int")
    got = {(r[0], r[1]): r[2] for r in rows(scoring.priority_tier(df))}
    assert [got[0.39, r] for r in (30, 31, None)] == [None, "at_risk", None]
    assert {got[p, r] for p in (0.4, 0.7) for r in (30, 31, None)} == {"medium"}
    assert {got[0.71, r] for r in (30, 31, None)} == {"high"}
    alone = scoring.priority_tier(df.drop("Recency")).filter("propensity_score = 0.39")
    assert {r["tier"] for r in alone.collect()} == {"at_risk"}


def test_engagement_with_zero_maximum(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0)], "propensity_score double, embedding_similarity double, total_transactions long")
    assert scoring.engagement_score(df).first()["engagement_score"] is None


def test_fill_unknown(spark):
    df = spark.createDataFrame([(None, "c", None)], "region string, city string, gender string")
    assert rows(scoring.fill_unknown(df)) == [("Unknown", "c", "Unknown")]


ORDERS = "customer_id long, transaction_id long, order_date timestamp_ntz, name string"


def orders(spark):
    return spark.sql("SELECT 1L AS customer_id, 10L AS transaction_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS order_date, 'a' AS name "
                     "UNION ALL SELECT 1, 11, TIMESTAMP_NTZ '2024-02-01 00:00:00', 'b' "
                     "UNION ALL SELECT 1, 12, TIMESTAMP_NTZ '2024-02-01 00:00:00', 'c' "
                     "UNION ALL SELECT 1, 13, NULL, 'd' UNION ALL SELECT 2, 14, NULL, 'e'")


def test_latest_order_does_not_fan_out(spark):
    predictions = spark.createDataFrame([(1, "p", "x"), (1, "q", "x"), (3, "p", "x")], "customer_id long, product string, name string")
    got = rows(joins.with_latest_order(predictions, orders(spark)).orderBy("customer_id", "product"))
    assert [r[3] for r in got] == ["c", "c", None]
    assert joins.with_latest_order(predictions, orders(spark)).columns[3] == "name_purchase"
    assert {r["customer_id"]: r["name"] for r in joins.one_row_per_customer(orders(spark)).collect()} == {1: "c", 2: "e"}


def test_insights_base_equals_three_left_joins(spark):
    predictions = spark.createDataFrame([(i, p) for i in (1, 2, 3) for p in "pq"], "customer_id long, product string")
    rfm = spark.createDataFrame([(1, 5), (4, 6)], "customer_id long, Recency int")
    features = spark.createDataFrame([(2, 0.5)], "customer_id long, home_pct double")
    whole = joins.insights_base(predictions, orders(spark), rfm, features)
    chain = joins.with_category_features(joins.with_rfm(joins.with_latest_order(predictions, orders(spark)), rfm), features)
    assert sorted(map(str, rows(whole))) == sorted(map(str, rows(chain.select(whole.columns))))


def test_overlapping_columns_raise(spark):
    a = spark.createDataFrame([(1, 2)], "customer_id long, Recency int")
    with pytest.raises(ValueError, match="Recency"):
        joins.with_rfm(a, a)


def test_orders_of_is_a_semi_join(spark):
    wanted = spark.createDataFrame([(1,), (1,)], "customer_id long")
    theirs = joins.orders_of(orders(spark), wanted)
    assert theirs.count() == 4 and "LeftSemi" in plan(theirs)


def test_similar_customer_without_match(spark):
    df = spark.createDataFrame(
        [(1, 2, 0.5, "a", "x, y"), (2, None, None, "b", "z"), (3, 99, 0.1, "c", None)],
        "customer_id long, Matched_Customer_ID long, Similarity_Score double, name string, purchased_products_names string",
    )
    got = rows(customers.similar_customers(df).orderBy("customer_id"))
    assert got == [(1, 2, "50.0%", "b", 1), (2, None, "", None, 0), (3, 99, "10.0%", None, 0)]


@pytest.mark.parametrize("total, number, want", [
    (0, 1, []), (10, 1, list(range(1, 11))), (10, 99, list(range(1, 11))), (11, 2, [11]), (11, 99, [11]), (11, 0, list(range(1, 11))),
])
def test_pages(spark, total, number, want):
    df = spark.range(total).selectExpr("id AS customer_id", "double(100 - id) AS total_spent")
    got = rows(ranking.page(df, number).orderBy("number"))
    assert [r[2] for r in got] == want and [r[0] for r in got] == [n - 1 for n in want]


def test_page_by_rank_equals_page(spark):
    df = spark.range(200).selectExpr("id AS customer_id", "double(id % 9) AS total_spent")
    shallow = rows(ranking.page(df, 7).orderBy("number"))
    assert rows(ranking.page_by_rank(df, 7).orderBy("number")) == shallow
    last = shallow[-1]
    following = ranking.page_after(df, last[1], last[0])
    assert [r[0] for r in rows(following)] == [r[0] for r in rows(ranking.page(df, 8).orderBy("number"))]


def test_top_k_plan(spark):
    df = spark.range(100).selectExpr("id AS customer_id", "double(id) AS total_spent")
    assert "TakeOrderedAndProject" in plan(ranking.top_k(df, "total_spent", 5, ["customer_id"]))


def test_filters_without_arguments_keep_rows(spark):
    df = spark.createDataFrame([("r", "g", 1)], "region string, gender string, customer_id long")
    assert filters.by_gender(filters.by_region(df, None), None).count() == 1
    assert filters.by_similarity(df, (0, 1)).count() == 1


def test_recency_is_cut_only_on_demand(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 10.0, 5), (2, 0.5, 10.0, None), (3, 0.5, 10.0, 400), (4, None, 10.0, 5), (5, 0.5, None, 5)],
        "customer_id long, propensity_score double, price_inr double, Recency int",
    ).selectExpr("*", "'p' AS product")
    assert {r["customer_id"] for r in filters.insights_filter(df).collect()} == {1, 2, 3}
    assert [r["customer_id"] for r in filters.insights_filter(df, max_recency=365).collect()] == [1]


def test_lookups(spark):
    df = spark.createDataFrame([(2, "a", "m"), (1, "a", "f")], "customer_id long, name string, gender string")
    assert rows(filters.customer_by_name(df, "a")) == [(1, "a", "f")]
    assert filters.customer_by_id(df, 2).first()["gender"] == "m"
    assert filters.customer_by_id(df, 5).first() is None


def test_paging_through_nulls_gives_each_row_once(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, None), (4, 7.0), (5, None)], "customer_id long, total_spent double")
    seen, last = [], (float("inf"), 0)
    while page := ranking.page_after(df, *last, size=2).collect():
        seen += [r["customer_id"] for r in page]
        last = (page[-1]["total_spent"], page[-1]["customer_id"])
    assert seen == [4, 1, 2, 3, 5]


def test_page_far_down_equals_top_k(spark):
    data = [(i, None if i % 7 == 0 else float(i * 37 % 11)) for i in range(60)] + [(None, 3.0), (5, 5.0), (5, 5.0)]
    df = spark.createDataFrame(data, "customer_id long, total_spent double").repartition(3)
    for number in (1, 4, 6, 13, 99):
        near, far = (rows(ranking.page(df, number, 5, top_rows=n).orderBy("number")) for n in (1000, 0))
        assert near == far
    assert rows(ranking.page(df.limit(0), 3, top_rows=0)) == []
    # No task holds the rows before the page.
    assert ranking.TOP_ROWS < 10**5 and "offset=25" not in plan(ranking.page(df.dropDuplicates(), 6, 5, top_rows=0))
