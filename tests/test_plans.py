from __future__ import annotations

from datetime import date

import pandas as pd
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from registry import tables as t
from tillview.operators import filters
from tillview.plans import business, campaign, customers, insights
from tillview.session import cached
from tillview.sources import star


def null_orders(spark):
    return spark.sql(
        "SELECT 1L AS transaction_id, 1L AS customer_id, 10D AS total_spent, 'N' AS region, 'f' AS gender, TIMESTAMP_NTZ '2024-01-01 05:00:00' AS order_date "
        "UNION ALL SELECT 2, 2, NULL, 'S', NULL, NULL UNION ALL SELECT NULL, 3, 5D, NULL, 'm', TIMESTAMP_NTZ '2024-01-01 06:00:00'"
    )


def test_null_keys_are_dropped(spark):
    df = null_orders(spark)
    assert rows(business.revenue_by_region(df)) == [("N", 10.0), ("S", 0.0)]
    assert rows(business.customers_by_gender(df)) == [("f", 1), ("m", 1)]
    assert [(r[1], r[2]) for r in rows(business.daily_revenue_orders(df))] == [(15.0, 1)]
    assert rows(business.monthly_revenue(df)) == [("2024-01", 15.0)]
    assert rows(business.hourly_orders(df)) == [(5, 1), (6, 1)]
    assert rows(business.hourly_orders(df.filter("transaction_id = 1"))) == []


def test_overview_equals_single_kpis(spark, folder):
    orders = t.orders(spark, folder)
    single = [f(orders).first()[0] for f in (
        business.total_customers, business.total_revenue, business.total_orders, business.average_order_value)]
    assert list(business.business_overview(orders).first()) == single


def test_empty_catalog_has_no_total(spark):
    empty = spark.createDataFrame([], "category string, product string, price_inr double")
    assert rows(business.total_products(empty)) == [(None,)]


def test_shares_add_up(spark, folder):
    shares = business.payment_distribution(t.orders(spark, folder)).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)
    spend = customers.customer_category_spend(t.features(spark, folder))
    off = spend.groupBy("customer_id").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9")
    assert off.count() == 0


def test_business_page(spark, folder):
    orders = t.orders(spark, folder)
    lines = t.lines(spark, folder)
    page = business.business_page(orders, lines, t.features(spark, folder), t.rfm(spark, folder), t.catalog(spark, folder))
    assert page["items_per_customer"].agg(F.sum("n")).first()[0] == lines.select("customer_id").distinct().count()
    assert page["rfm_points"].count() == orders.select("customer_id").distinct().count()
    assert "payments" not in business.business_page(
        orders.drop("mode_of_payment"), lines, t.features(spark, folder), t.rfm(spark, folder), t.catalog(spark, folder))


def test_insights_page(spark, folder):
    with cached(t.base(spark, folder)) as base:
        filtered = filters.insights_filter(base, category="brand_7", top_n=50)
        page = insights.insights_page(base, filtered, t.orders(spark, folder), product="any")
        summary = page["summary"].first()
        assert summary["filtered_rows"] <= min(50, summary["original_rows"])
        assert page["propensity_histogram"].agg(F.sum("n")).first()[0] == summary["filtered_rows"]
        assert sorted(r["tier"] for r in page["tiers"].collect()) == ["at_risk", "high", "medium"]
        assert page["top_customers"].columns[:2] == ["Rank", "Customer ID"]
        assert "Phone" not in page["tracking"].columns
        assert {"rfm_points", "carts", "quarter_orders", "product_segments"} <= set(page)


def test_overview_falls_back(spark):
    df = spark.createDataFrame([(0.8, 10.0, 3), (0.2, 20.0, 5)], "propensity_score double, total_spent double, total_transactions long")
    assert rows(insights.insights_overview(df)) == [(0.5, 1, 15.0, None, 4.0, 30.0)]
    counts = insights.product_segment_counts(df.withColumn("spending_category", F.lit("High Spender")))
    assert rows(counts) == [(2, None, None)]


def test_numeric_carts_are_averaged_as_they_are(spark):
    df = spark.createDataFrame([(1, "['a', 'b']"), (2, "[]")], "in_cart_same_category int, in_cart_other_category string")
    assert rows(insights.cart_averages(df)) == [("Same Category", 1.5), ("Other Category", 1.0)]


def test_tier_summary_keeps_empty_tiers(spark):
    df = spark.createDataFrame([(1, 0.8, 10.0)], "customer_id long, propensity_score double, total_spent double")
    got = {r[0]: r[1:] for r in rows(insights.tier_summary(df))}
    assert got == {"high": (1, 1, 10.0, 10.0), "medium": (0, 0, 0.0, None), "at_risk": (0, 0, 0.0, None)}


def test_parse_persona(spark):
    texts = ["I think: loyal customers!", "both Champions and At Risk", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(campaign.parse_persona(F.col("x"))).collect()]
    assert got == ["Loyal Customers", "Champions", "Unclassified", "Unclassified"]


def test_parse_offer(spark):
    df = spark.createDataFrame([("\n  Buy now! \nMore",), ("one",)], "x string")
    assert rows(df.select(campaign.parse_offer(F.col("x")))) == [("Buy now! ",), ("one",)]


def recommendations(spark):
    return spark.createDataFrame(
        [(1, "a", "x, y", "z"), (2, "b", None, "z"), (3, "c", "", None)],
        "customer_id long, name string, Predicted_Products_from_Same_Category string, Predicted_Products_from_Other_Categories string",
    )


def test_offer_product(spark):
    got = {r[0]: r[2] for r in rows(campaign.offer_product(recommendations(spark)))}
    assert got[1] in ("x", "y") and got[2] == "z" and got[3] is None
    assert rows(campaign.offer_product(recommendations(spark))) == rows(campaign.offer_product(recommendations(spark)))


def test_campaign_sheet(spark):
    def model(prompts: pd.Series) -> pd.Series:
        return prompts.str.extract(r"Product: (.*)", expand=False) + " for you\nbye"

    got = sorted(rows(campaign.campaign_sheet(recommendations(spark), model)))
    assert [r[0] for r in got] == [1, 2]
    assert got[1] == (2, "b", "z", "z for you")


def test_filters_and_columns_reach_the_scan(spark, folder):
    orders = filters.by_date_range(t.orders(spark, folder), date(1996, 1, 1), date(1996, 1, 31))
    text = plan(business.revenue_by_region(orders))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "o_orderpriority" not in text and "c_name" not in text


def test_recommendations_exclude_what_was_bought(spark, folder):
    features, bought = t.features(spark, folder), star.bought_products(spark, folder)
    items = star.recommended_items(star.customer_matches(features), bought, features)
    assert items.count() > 0
    assert items.join(bought, ["customer_id", "product"]).count() == 0
