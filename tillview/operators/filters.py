"""Filters of the three pages, lookups and option lists. ``None`` leaves a filter out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.lists import contains_any, split_list
from tillview.operators.ranking import top_k
from tillview.schemas import has

Range = tuple[float, float]


def _equal(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def _between(df: DataFrame, column: str, bounds: Range | None) -> DataFrame:
    return df if bounds is None else df.filter(F.col(column).between(*bounds))


def _moment(day: date) -> Column:
    return F.lit(datetime.combine(day, time()).isoformat()).cast("timestamp_ntz")


# -- orders ---------------------------------------------------------------------------------

def by_date_range(
    df: DataFrame, low: date | None, high: date | None, end_inclusive_day: bool = False
) -> DataFrame:
    """Orders from ``low`` to midnight at the start of ``high``, or to the end of that day.

    Applied only when both bounds are given.
    """
    if low is None or high is None:
        return df
    when = F.col("order_date")
    if end_inclusive_day:
        return df.filter((when >= _moment(low)) & (when < _moment(high + timedelta(days=1))))
    return df.filter(when.between(_moment(low), _moment(high)))


def by_region(df: DataFrame, region: str | None) -> DataFrame:
    return _equal(df, "region", region)


def by_gender(df: DataFrame, gender: str | None) -> DataFrame:
    return _equal(df, "gender", gender)


def orders_filter(
    df: DataFrame, low: date | None = None, high: date | None = None,
    region: str | None = None, gender: str | None = None, end_inclusive_day: bool = False,
) -> DataFrame:
    return by_gender(by_region(by_date_range(df, low, high, end_inclusive_day), region), gender)


# -- insights -------------------------------------------------------------------------------

def by_category(df: DataFrame, category: str | None) -> DataFrame:
    return _equal(df, "category", category)


def by_product(df: DataFrame, product: str | None) -> DataFrame:
    return _equal(df, "product", product)


def by_propensity(df: DataFrame, bounds: Range | None = (0.0, 1.0)) -> DataFrame:
    return _between(df, "propensity_score", bounds)


def by_price(df: DataFrame, bounds: Range | None = None) -> DataFrame:
    """Prices in a closed range; the default range is the whole table's, so it drops only NULLs."""
    return df.filter(F.col("price_inr").isNotNull()) if bounds is None else _between(df, "price_inr", bounds)


def by_spending_level(df: DataFrame, label: str | None) -> DataFrame:
    return _equal(df, "spending_category", label)


def by_max_recency(df: DataFrame, days: int | None) -> DataFrame:
    """Drops customers without an RFM row too; no effect without the column."""
    return df if days is None or not has(df, "Recency") else df.filter(F.col("Recency") <= days)


def by_min_frequency(df: DataFrame, orders: int | None) -> DataFrame:
    return df if orders is None or not has(df, "Frequency") else df.filter(F.col("Frequency") >= orders)


def insights_filter(
    df: DataFrame,
    category: str | None = None,
    product: str | None = None,
    propensity: Range | None = (0.0, 1.0),
    region: str | None = None,
    price: Range | None = None,
    gender: str | None = None,
    spending: str | None = None,
    max_recency: int | None = None,
    min_frequency: int | None = 0,
    top_n: int | None = 100,
) -> DataFrame:
    """All insights filters, then the ``top_n`` rows by propensity (all of them if ``None``).

    No customer is dropped for a long absence unless ``max_recency`` is given.
    """
    kept = by_product(by_category(df, category), product)
    kept = by_price(by_region(by_propensity(kept, propensity), region), price)
    kept = by_spending_level(by_gender(kept, gender), spending)
    kept = by_min_frequency(by_max_recency(kept, max_recency), min_frequency)
    return kept if top_n is None else top_n_by_propensity(kept, top_n)


def top_n_by_propensity(df: DataFrame, n: int = 100) -> DataFrame:
    return top_k(df, "propensity_score", n, ["customer_id", "product"])


# -- recommendations ------------------------------------------------------------------------

def by_customer(
    df: DataFrame, customer_id: int | None = None, name: str | None = None, gender: str | None = None
) -> DataFrame:
    return _equal(_equal(_equal(df, "customer_id", customer_id), "name", name), "gender", gender)


def by_place(df: DataFrame, state: str | None = None, city: str | None = None) -> DataFrame:
    return _equal(_equal(df, "state", state), "city_name", city)


def bought_any_of(df: DataFrame, products: Sequence[str] | None, mode: str = "exact") -> DataFrame:
    if not products:
        return df
    return df.filter(contains_any("purchased_products_names", products, mode))


def by_similarity(df: DataFrame, bounds: Range | None) -> DataFrame:
    """Similarity as fractions of 1, so the bare column is compared and can be pushed down."""
    return _between(df, "Similarity_Score", bounds) if has(df, "Similarity_Score") else df


def by_total_spent(df: DataFrame, bounds: Range | None) -> DataFrame:
    return _between(df, "total_spent", bounds)


def recs_filter(
    df: DataFrame,
    customer_id: int | None = None,
    name: str | None = None,
    gender: str | None = None,
    state: str | None = None,
    city: str | None = None,
    products: Sequence[str] | None = None,
    product_mode: str = "exact",
    similarity: Range | None = None,
    spent: Range | None = None,
) -> DataFrame:
    kept = by_place(by_customer(df, customer_id, name, gender), state, city)
    kept = bought_any_of(kept, products, product_mode)
    return by_total_spent(by_similarity(kept, similarity), spent)


# -- lookups and options --------------------------------------------------------------------

def positive_only(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def customer_by_id(df: DataFrame, customer_id: int, order: str = "name") -> DataFrame:
    return df.filter(F.col("customer_id") == F.lit(customer_id)).orderBy(order).limit(1)


def customer_by_name(df: DataFrame, name: str) -> DataFrame:
    """The customer of that name with the lowest id, with the attributes linked to it."""
    linked = [c for c in ("customer_id", "name", "gender", "state", "city_name") if c in df.columns]
    return df.filter(F.col("name") == F.lit(name)).select(linked).orderBy("customer_id").limit(1)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def product_options(df: DataFrame, category: str | None = None) -> DataFrame:
    return distinct_sorted(by_category(df, category), "product")


def product_vocabulary(recs: DataFrame) -> DataFrame:
    """Every product that occurs in a purchase list, sorted."""
    items = recs.select(F.explode(split_list("purchased_products_names")).alias("product"))
    return items.distinct().orderBy("product")


def bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of several columns in one row."""
    return df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
