"""Joins that build the base tables of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.schemas import existing
from tillview.session import written_once

# Columns an insights row takes from the customer's latest order.
ORDER_COLUMNS = (
    "name", "phone_number", "order_date", "order_quarter", "days_since_last_visit", "state",
    "in_cart_same_category", "in_cart_other_category",
)


def _no_overlap(*tables: DataFrame) -> None:
    seen: set[str] = set()
    for df in tables:
        extra = set(df.columns) - {"customer_id"}
        if seen & extra:
            raise ValueError(f"column in two tables: {', '.join(sorted(seen & extra))}")
        seen |= extra


def customer_ids(df: DataFrame) -> DataFrame:
    return df.select("customer_id").distinct()


def one_row_per_customer(orders: DataFrame) -> DataFrame:
    """The latest order of each customer; of two on one date, the one with the higher id.

    ``max_by`` combines before the shuffle, so a customer with very many orders sends one row per
    task. A NULL date counts as the earliest.
    """
    others = [c for c in orders.columns if c != "customer_id"]
    key = F.struct("order_date", "transaction_id")
    latest = orders.groupBy("customer_id").agg(F.max_by(F.struct(*others), key).alias("_row"))
    return latest.select("customer_id", *[F.col(f"_row.{c}").alias(c) for c in others])


def latest_order_columns(orders: DataFrame) -> DataFrame:
    wanted = existing(orders, ORDER_COLUMNS)
    keys = [c for c in ("order_date", "transaction_id") if c not in wanted]
    return one_row_per_customer(orders.select("customer_id", *wanted, *keys)).select("customer_id", *wanted)


def with_latest_order(predictions: DataFrame, orders: DataFrame) -> DataFrame:
    """Predictions with columns of the customer's latest order; a name both have gets ``_purchase``."""
    latest = latest_order_columns(orders)
    both = set(latest.columns) & set(predictions.columns) - {"customer_id"}
    latest = latest.withColumnsRenamed({c: f"{c}_purchase" for c in both})
    return predictions.join(latest, "customer_id", "left")


def with_rfm(df: DataFrame, rfm: DataFrame) -> DataFrame:
    _no_overlap(df, rfm)
    return df.join(rfm, "customer_id", "left")


def with_category_features(df: DataFrame, features: DataFrame) -> DataFrame:
    _no_overlap(df, features)
    return df.join(features, "customer_id", "left")


def insights_base(
    predictions: DataFrame, orders: DataFrame, rfm: DataFrame, features: DataFrame
) -> DataFrame:
    """Predictions with latest order, RFM and category features of the customer.

    The three customer tables have one row per customer and are put together first. The large,
    possibly skewed predictions then meet them in one left join, whose hot keys adaptive
    execution can split; in a chain of three joins it could not. Predictions stored in buckets of the
    customer are not moved for it, and not split either.
    """
    latest = latest_order_columns(orders)
    both = set(latest.columns) & set(predictions.columns) - {"customer_id"}
    latest = latest.withColumnsRenamed({c: f"{c}_purchase" for c in both})
    _no_overlap(predictions, latest, rfm, features)
    customers = latest.join(rfm, "customer_id", "full").join(features, "customer_id", "full")
    return predictions.join(customers, "customer_id", "left")


def recs_base(recs: DataFrame, rfm: DataFrame, features: DataFrame) -> DataFrame:
    _no_overlap(recs, rfm, features)
    return recs.join(rfm, "customer_id", "left").join(features, "customer_id", "left")


def orders_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of the customers that occur in ``customers``."""
    return orders.join(customer_ids(customers), "customer_id", "left_semi")


def similar_customer(base: DataFrame) -> DataFrame:
    """Each customer with name and purchases of the matched one; NULLs when there is none.

    Both sides are one table, which is written once. A customer many others are matched to is a hot
    key of the left side, which adaptive execution splits.
    """
    base = written_once(base, "customers")
    matched = base.select(
        F.col("customer_id").alias("Matched_Customer_ID"),
        F.col("name").alias("matched_name"),
        F.col("purchased_products_names").alias("matched_products_names"),
    )
    return base.join(matched, "Matched_Customer_ID", "left")
