from __future__ import annotations

from datetime import date

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tillview.operators import sketches


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(60000).select(
        (F.col("id") % 7919).alias("customer_id"), F.expr("timestampadd(HOUR, CAST(id % 2400 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("order_date"),
        F.concat(F.lit("r"), F.col("id") % 3).alias("region"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), F.col("id") % 2)).alias("gender"),
        F.lit(1.5).alias("total_spent"),
    )


@pytest.fixture(scope="module")
def stored(spark, orders, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "s")
    sketches.customer_sketches(orders).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("low, high, region, gender", [
    (None, None, None, None), (date(2024, 1, 5), date(2024, 2, 9), None, None), (None, None, "r1", "g0"), (date(2024, 3, 1), None, "r2", None),
])
def test_any_filter_stays_within_the_bound(orders, stored, low, high, region, gender):
    kept = orders
    for given, test in ((low, F.col("order_date") >= F.lit(low)), (high, F.to_date("order_date") <= F.lit(high)),
                        (region, F.col("region") == region), (gender, F.col("gender") == gender)):
        kept = kept if given is None else kept.filter(test)
    exact = kept.agg(F.countDistinct("customer_id"), F.count("*"), F.sum("total_spent")).first()
    said = sketches.estimated_customers(sketches.sketch_filter(stored, low, high, region, gender)).first()
    assert abs(said.customers - exact[0]) <= sketches.error_bound() * exact[0] + 1
    assert (said.n_orders, said.revenue) == (exact[1], exact[2])


def test_groups_and_nulls(orders, stored):
    said = {r.gender: (r.customers, r.n_orders) for r in sketches.estimated_customers(stored, ["gender"]).collect()}
    exact = {r[0]: (r[1], r[2]) for r in orders.groupBy("gender").agg(F.countDistinct("customer_id"), F.count("*")).collect()}
    assert set(said) == {None, "g0", "g1"}
    for gender, (n, orders_of) in exact.items():
        assert abs(said[gender][0] - n) <= sketches.error_bound() * n and said[gender][1] == orders_of


def test_merged_sketches_merge_again(orders, stored):
    months = sketches.merged(stored.withColumn("month", F.date_format("order_day", "yyyy-MM")), ["month", "region"])
    said = sketches.estimated_customers(months).first()
    exact = orders.select("customer_id").distinct().count()
    assert abs(said.customers - exact) <= sketches.error_bound() * exact
    assert (said.n_orders, said.revenue) == (60000, 90000.0)


def test_orders_are_not_read_again(stored):
    text = plan(sketches.estimated_customers(sketches.sketch_filter(stored, region="r1"), ["gender"]))
    assert "total_spent" not in text and "order_date" not in text and "PushedFilters: [IsNotNull(region), EqualTo(region,r1)]" in text


def test_empty(spark, orders):
    nothing = sketches.estimated_customers(sketches.customer_sketches(orders.limit(0)))
    assert rows(nothing) == [(0, 0, 0.0)]
    assert sketches.estimated_customers(sketches.customer_sketches(orders.limit(0)), ["region"]).count() == 0
