"""Next-purchase page: customer cards, profiles, similar customers and list views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.lists import category_label, split_cart, split_list
from tillview.functions.numbers import similarity_text
from tillview.operators.filters import positive_only
from tillview.operators.joins import similar_customer
from tillview.operators.ranking import top_k
from tillview.operators.scoring import recency_band
from tillview.schemas import SPEND_SUFFIX, columns_by_suffix, existing, has

# List columns of the recommendations table.
PURCHASED = "purchased_products_names"
CARTS = ("in_cart_same_category", "in_cart_other_category")
PREDICTED = ("Predicted_Products_from_Same_Category", "Predicted_Products_from_Other_Categories")

# Columns of the base table that a profile is made of.
PROFILE = (
    "customer_id", "name", "gender", "city_name", "total_spent", "days_since_last_visit", "Frequency", "Monetary",
    PURCHASED, *CARTS, *PREDICTED, "Matched_Customer_ID", "Similarity_Score",
)


def order_by_spent(df: DataFrame) -> DataFrame:
    return top_k(df, "total_spent", None, ["customer_id"])


def default_customer(df: DataFrame) -> DataFrame:
    """The top spender."""
    return top_k(df, "total_spent", 1, ["customer_id"])


def customer_card(df: DataFrame) -> DataFrame:
    """Name, id, spend, whole days since the last visit, city and gender."""
    card = existing(df, ("name", "customer_id", "total_spent", "city_name", "gender", "number"))
    return df.select(*card, F.col("days_since_last_visit").cast("int").alias("recency_days"))


def frequency_or_zero(df: DataFrame) -> Column:
    if not has(df, "Frequency"):
        return F.lit(0)
    return F.coalesce(F.col("Frequency").cast("int"), F.lit(0))


def list_sizes(df: DataFrame) -> DataFrame:
    """Number of purchases, cart items and recommendations of each customer."""
    def size(column: str, split) -> Column:
        return F.size(split(column))

    return df.select(
        "customer_id",
        size(PURCHASED, split_list).alias("purchases"),
        (size(CARTS[0], split_cart) + size(CARTS[1], split_cart)).alias("cart_items"),
        (size(PREDICTED[0], split_list) + size(PREDICTED[1], split_list)).alias("recommendations"),
    )


def numbered_items(df: DataFrame, column: str, cart: bool = False) -> DataFrame:
    """Each list item as a row with its number from 1."""
    items = split_cart(column) if cart else split_list(column)
    return df.select("customer_id", F.posexplode(items).alias("_at", "item")).select(
        "customer_id", (F.col("_at") + 1).alias("number"), "item"
    )


def customer_category_spend(df: DataFrame) -> DataFrame:
    """Positive spend per category of every customer, with the share of the customer's total."""
    columns = columns_by_suffix(df, SPEND_SUFFIX)
    long = df.select("customer_id", *columns).unpivot("customer_id", columns, "_column", "amount")
    positive = positive_only(long, "amount").select(
        "customer_id", category_label(F.col("_column"), SPEND_SUFFIX).alias("category"), "amount"
    )
    # At most one row per category and customer.
    total = F.sum(F.col("amount").cast("decimal(18,4)")).over(Window.partitionBy("customer_id"))
    return positive.withColumn("share", F.try_divide("amount", total.cast("double")))


def similar_customers(base: DataFrame) -> DataFrame:
    """Matched customer with name, similarity as text, and its number of purchases."""
    base = base.select("customer_id", "name", PURCHASED, "Matched_Customer_ID", "Similarity_Score")
    return similar_customer(base).select(
        "customer_id",
        "Matched_Customer_ID",
        similarity_text("Similarity_Score").alias("similarity"),
        "matched_name",
        F.size(split_list("matched_products_names")).alias("matched_purchases"),
    )


def customer_profile(base: DataFrame) -> DataFrame:
    """The whole detail panel as one row per customer."""
    def items(column: str, cart: bool = False) -> Column:
        return split_cart(column) if cart else split_list(column)

    days = F.col("days_since_last_visit").cast("int")
    # Only what the panel shows is written and sent to the matched customers.
    base = base.select(*existing(base, PROFILE))
    return similar_customer(base).select(
        "customer_id", "name", "gender", "city_name", "total_spent",
        days.alias("recency_days"),
        recency_band("days_since_last_visit").alias("recency_band"),
        frequency_or_zero(base).alias("frequency"),
        *existing(base, ["Monetary"]),
        items(PURCHASED).alias("purchased"),
        items(CARTS[0], True).alias("cart_same"),
        items(CARTS[1], True).alias("cart_other"),
        items(PREDICTED[0]).alias("recommended_same"),
        items(PREDICTED[1]).alias("recommended_other"),
        "Matched_Customer_ID",
        similarity_text("Similarity_Score").alias("similarity"),
        "matched_name",
        items("matched_products_names").alias("matched_purchased"),
    ).select(
        "*",
        F.size("purchased").alias("n_purchased"),
        (F.size("cart_same") + F.size("cart_other")).alias("n_cart"),
        (F.size("recommended_same") + F.size("recommended_other")).alias("n_recommended"),
    )
