from __future__ import annotations

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillview.functions import lists, numbers
from tillview.functions.dates import with_order_timestamp
from tillview.operators.filters import bought_any_of


def values(spark, items, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_split_list(spark):
    got = values(spark, ["a, b,,c", " ", "a\t,b", None, ",", "  a b \n, c"], lists.split_list("x"))
    assert got == [["a", "b", "c"], [], ["a", "b"], [], [], ["a b", "c"]]


def test_split_cart(spark):
    got = values(spark, ["['Jeans', 'Men T-Shirt']", "[]", "nan", None, '["x"]'], lists.split_cart("x"))
    assert got == [["Jeans", "Men T-Shirt"], [], [], [], ["x"]]


@pytest.mark.parametrize("text, product, exact, regex", [
    ("Smartphone (mid-range), Jeans", "Smartphone (mid-range)", True, False),
    ("Baby Shampoo", "shampoo", False, True),
    ("JEANS", "jeans", True, True),
    (None, "jeans", False, False),
])
def test_contains_any(spark, text, product, exact, regex):
    df = spark.createDataFrame([(text,)], "purchased_products_names string")
    assert bought_any_of(df, [product]).count() == exact
    assert bought_any_of(df, [product], "regex").count() == regex


def test_money_text(spark):
    df = spark.createDataFrame([(0, 1234.5), (1, 1235.5), (2, None)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(numbers.format_money("x")).collect()] == ["₹1,234", "₹1,236", None]


def test_score_text(spark):
    df = spark.createDataFrame([(0.1234, 0.5), (None, None)], "x double, y double")
    got = rows(df.select(
        numbers.format_percent("x", 2), numbers.format_similarity("x"), numbers.similarity_text("y")
    ))
    assert got == [("12.34%", "0.123", "50.0%"), (None, None, "")]


def test_money_sum_and_average(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", None), ("b", None)], "k string, x double")
    got = rows(df.groupBy("k").agg(numbers.money_sum("x"), numbers.money_avg("x")).orderBy("k"))
    assert got == [("a", 0.3, 0.15), ("b", 0.0, None)]


def test_category_label(spark):
    assert values(spark, ["home_decor_spend"], lists.category_label(F.col("x"), "_spend")) == ["Home Decor"]


def test_order_timestamp(spark):
    good = spark.createDataFrame([("2024-01-02 10:00:00",)], "order_date string")
    bad = spark.createDataFrame([("someday",)], "order_date string")
    assert str(with_order_timestamp(good).first()[0]) == "2024-01-02 10:00:00"
    with pytest.raises(PySparkException):
        with_order_timestamp(bad).collect()
    assert with_order_timestamp(bad, strict=False).first()[0] is None
    plain = spark.range(1)
    assert with_order_timestamp(plain) is plain
