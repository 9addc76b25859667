"""Tables stored so that date filters prune folders and customer joins need no shuffle.

Orders lie in one folder per month. Customer tables are bucketed and sorted by ``customer_id`` with one
bucket count, so joins and aggregates on that key read matching buckets as they lie. Bucketed tables are
catalog tables over files at a path the caller names.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.operators.filters import by_date_range
from tillview.operators.joins import latest_order_columns, with_category_features, with_rfm

BUCKETS = 32
MONTH = "order_month"


def write_orders(orders: DataFrame, path: str) -> str:
    """Write orders below ``path``, one folder per month; orders without a date lie in a folder of their own.

    A month is written by as many tasks as hold its rows, so a month with very many orders is no large task.
    """
    month = F.date_format("order_date", "yyyy-MM").alias(MONTH)
    orders.select("*", month).write.partitionBy(MONTH).parquet(path)
    return path


def read_orders(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored orders with the columns of ``schema`` and the month as text."""
    fields = [f for f in schema.fields if f.name != MONTH]
    return spark.read.schema(T.StructType([*fields, T.StructField(MONTH, T.StringType())])).parquet(path)


def orders_between(orders: DataFrame, low: date | None, high: date | None, end_inclusive_day: bool = False) -> DataFrame:
    """``by_date_range`` on stored orders; reads the folders of the months in question only."""
    if low is None or high is None:
        return orders
    months = F.col(MONTH).between(f"{low:%Y-%m}", f"{high:%Y-%m}")
    return by_date_range(orders.filter(months), low, high, end_inclusive_day)


def write_bucketed(df: DataFrame, path: str, key: str = "customer_id", buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` below ``path`` in buckets of ``key`` and return it as a table.

    Rows are dealt by key first, so each bucket is one file; all rows of a key lie in one bucket.
    """
    name = f"tillview_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, key)
    placed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def customer_tables(tables: Mapping[str, DataFrame], folder: str, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Every table of ``tables`` stored in buckets of ``customer_id`` below ``folder``, under its name."""
    return {name: write_bucketed(df, f"{folder}/{name}", buckets=buckets) for name, df in tables.items()}


def bucketed_insights_base(predictions: DataFrame, orders: DataFrame, rfm: DataFrame, features: DataFrame) -> DataFrame:
    """``insights_base`` of four tables bucketed alike: left joins one after the other, without a shuffle.

    Buckets stay as they lie, so a customer with very many predictions is not split; where one has a large
    part of all rows, ``insights_base`` is the better choice.
    """
    latest = latest_order_columns(orders)
    both = set(latest.columns) & set(predictions.columns) - {"customer_id"}
    latest = latest.withColumnsRenamed({c: f"{c}_purchase" for c in both})
    joined = predictions.join(latest, "customer_id", "left")
    return with_category_features(with_rfm(joined, rfm), features)
