"""Business page: KPIs, revenue, products, RFM, places and time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.dates import order_day, order_hour, order_month
from tillview.functions.lists import category_label
from tillview.functions.numbers import money_avg, money_sum
from tillview.operators.binning import histogram
from tillview.operators.ranking import top_k
from tillview.operators.scoring import rfm_segments
from tillview.schemas import SPEND_SUFFIX, columns_by_suffix, has, validate_inputs


# -- KPIs -----------------------------------------------------------------------------------

def total_customers(orders: DataFrame) -> DataFrame:
    return orders.agg(F.countDistinct("customer_id").alias("total_customers"))


def total_revenue(orders: DataFrame) -> DataFrame:
    return orders.agg(money_sum("total_spent").alias("total_revenue"))


def total_orders(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("total_orders"))


def average_order_value(orders: DataFrame) -> DataFrame:
    return orders.agg(money_avg("total_spent").alias("avg_order_value"))


def total_products(catalog: DataFrame) -> DataFrame:
    """Number of catalog rows; NULL (not available) for an empty catalog."""
    rows = F.count(F.lit(1))
    return catalog.agg(F.when(rows > 0, rows).alias("total_products"))


def business_overview(orders: DataFrame) -> DataFrame:
    """The four order KPIs in one pass."""
    return orders.agg(
        F.countDistinct("customer_id").alias("total_customers"),
        money_sum("total_spent").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"),
        money_avg("total_spent").alias("avg_order_value"),
    )


# -- revenue and customers ------------------------------------------------------------------

def _revenue_by(orders: DataFrame, key: Column, name: str) -> DataFrame:
    keyed = orders.withColumn(name, key).filter(F.col(name).isNotNull())
    return keyed.groupBy(name).agg(money_sum("total_spent").alias("revenue"))


def daily_revenue(orders: DataFrame) -> DataFrame:
    return _revenue_by(orders, order_day(), "day").orderBy("day")


def payment_distribution(orders: DataFrame) -> DataFrame:
    """Orders per payment mode, most frequent first, with the share of all."""
    known = orders.filter(F.col("mode_of_payment").isNotNull())
    # One row per payment mode reaches the window, so the orders are read once.
    total = F.sum("orders").over(Window.partitionBy())
    return (
        known.groupBy("mode_of_payment")
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("share", F.try_divide("orders", total))
        .orderBy(F.desc("orders"), "mode_of_payment")
    )


def top_customers_by_revenue(orders: DataFrame, k: int = 10) -> DataFrame:
    return top_k(_revenue_by(orders, F.col("customer_id"), "customer_id"), "revenue", k, ["customer_id"])


def customers_by_gender(orders: DataFrame) -> DataFrame:
    known = orders.filter(F.col("gender").isNotNull())
    return known.groupBy("gender").agg(F.countDistinct("customer_id").alias("customers")).orderBy("gender")


def column_averages(df: DataFrame, columns: Sequence[str], suffix: str, average, name: str) -> DataFrame:
    """Average of each wide column as rows ``category``, ``name``.

    The wide columns are averaged first and only the one result row is unpivoted.
    """
    one_row = df.agg(*[average(c).alias(c) for c in columns])
    long = one_row.unpivot([], list(columns), "_column", name)
    return long.select(category_label(F.col("_column"), suffix).alias("category"), name)


def avg_spend_by_category(features: DataFrame) -> DataFrame:
    columns = columns_by_suffix(features, SPEND_SUFFIX)
    averages = column_averages(features, columns, SPEND_SUFFIX, money_avg, "avg_spend")
    return averages.orderBy(F.desc_nulls_last("avg_spend"), "category")


# -- products -------------------------------------------------------------------------------

def catalog_value_by_category(catalog: DataFrame, k: int = 15) -> DataFrame:
    values = catalog.filter(F.col("category").isNotNull()).groupBy("category").agg(
        money_sum("price_inr").alias("total_value")
    )
    return top_k(values, "total_value", k, ["category"])


def avg_price_by_category(catalog: DataFrame, k: int = 15) -> DataFrame:
    prices = catalog.filter(F.col("category").isNotNull()).groupBy("category").agg(
        money_avg("price_inr").alias("avg_price")
    )
    return top_k(prices, "avg_price", k, ["category"])


def product_count_by_category(catalog: DataFrame, k: int = 15) -> DataFrame:
    counts = catalog.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("product").alias("products")
    )
    return top_k(counts, "products", k, ["category"])


def items_per_customer(purchases: DataFrame) -> DataFrame:
    known = purchases.filter(F.col("customer_id").isNotNull())
    return known.groupBy("customer_id").agg(F.count(F.lit(1)).alias("items"))


def items_per_customer_histogram(purchases: DataFrame, nbins: int = 20) -> DataFrame:
    return histogram(items_per_customer(purchases), "items", nbins)


def repurchase_rate(purchases: DataFrame, k: int | None = 15) -> DataFrame:
    """Purchases over distinct customers per product: what the two aligned series divide to."""
    rates = purchases.filter(F.col("product").isNotNull()).groupBy("product").agg(
        F.count(F.lit(1)).alias("purchases"), F.countDistinct("customer_id").alias("customers")
    )
    rates = rates.withColumn("repurchase_rate", F.try_divide("purchases", "customers"))
    return top_k(rates, "repurchase_rate", k, ["product"])


def product_popularity(purchases: DataFrame) -> DataFrame:
    known = purchases.filter(F.col("product").isNotNull())
    return known.groupBy("product").agg(F.count(F.lit(1)).alias("purchases"))


def popular_products(purchases: DataFrame, k: int = 20) -> DataFrame:
    return top_k(product_popularity(purchases), "purchases", k, ["product"])


def product_term_frequency(
    purchases: DataFrame, k: int | None = None, stop_words: Sequence[str] = ()
) -> DataFrame:
    """How often each word of two letters or more occurs in the names of purchased products.

    Names are counted first, so each distinct name is cut into words once.
    """
    words = F.explode(F.regexp_extract_all(F.lower("product"), F.lit(r"\w[\w']*"), F.lit(0)))
    terms = product_popularity(purchases).select(words.alias("term"), "purchases")
    kept = terms.filter((F.length("term") > 1) & ~F.col("term").isin(*stop_words))
    return top_k(kept.groupBy("term").agg(F.sum("purchases").alias("n")), "n", k, ["term"])


def product_collocations(
    purchases: DataFrame, k: int | None = None, stop_words: Sequence[str] = (), least: float = 30.0
) -> DataFrame:
    """Pairs of neighbouring words of product names that stand together more often than chance has it.

    ``g2`` is the log likelihood ratio of the second word being as frequent after the first as
    elsewhere; pairs below ``least``, and those that are rarer than by chance, are left out. A word that
    is too short or a stop word ends a pair. Counts are by purchase; one row holds the number of all words.
    """
    words = F.regexp_extract_all(F.lower("product"), F.lit(r"\w[\w']*"), F.lit(0))
    usable = lambda w: (F.length(w) > 1) & ~w.isin(*stop_words)
    names = product_popularity(purchases).select(words.alias("words"), "purchases")
    singles = names.select(F.explode("words").alias("word"), "purchases").filter(usable(F.col("word")))
    singles = singles.groupBy("word").agg(F.sum("purchases").alias("n"))
    pairs = names.select(F.explode(F.arrays_zip(
        F.col("words").alias("first"), F.expr("slice(words, 2, size(words))").alias("second")
    )).alias("pair"), "purchases").select("pair.*", "purchases")
    pairs = pairs.filter(F.col("second").isNotNull() & usable(F.col("first")) & usable(F.col("second")))
    pairs = pairs.groupBy("first", "second").agg(F.sum("purchases").alias("n"))
    side = lambda name, as_: singles.select(F.col("word").alias(name), F.col("n").alias(as_))
    counted = pairs.join(side("first", "n_first"), "first").join(side("second", "n_second"), "second")
    total = singles.agg(F.sum("n")).scalar()
    both, rest, others = F.col("n"), F.col("n_second") - F.col("n"), total - F.col("n_first")

    def log_odds(hits: Column, tries: Column, share: Column) -> Column:
        return F.when(hits > 0, hits * F.ln(share)).otherwise(0.0) + F.when(tries > hits, (tries - hits) * F.ln(1 - share)).otherwise(0.0)

    after, elsewhere, anywhere = both / F.col("n_first"), F.try_divide(rest, others), F.col("n_second") / total
    g2 = 2 * (
        log_odds(both, F.col("n_first"), after) + log_odds(rest, others, elsewhere)
        - log_odds(both, F.col("n_first"), anywhere) - log_odds(rest, others, anywhere)
    )
    scored = counted.withColumn("g2", F.round(g2, 4)).filter((F.col("g2") >= least) & (after > anywhere))
    return top_k(scored.select("first", "second", "n", "g2"), "g2", k, ["first", "second"])


# -- places and time ------------------------------------------------------------------------

def revenue_by_region(orders: DataFrame) -> DataFrame:
    return _revenue_by(orders, F.col("region"), "region").orderBy(F.desc("revenue"), "region")


def top_cities_by_revenue(orders: DataFrame, k: int = 20) -> DataFrame:
    return top_k(_revenue_by(orders, F.col("city_name"), "city_name"), "revenue", k, ["city_name"])


def daily_revenue_orders(orders: DataFrame) -> DataFrame:
    days = orders.withColumn("day", order_day()).filter(F.col("day").isNotNull())
    return days.groupBy("day").agg(
        money_sum("total_spent").alias("revenue"), F.count("transaction_id").alias("orders")
    ).orderBy("day")


def monthly_revenue(orders: DataFrame) -> DataFrame:
    return _revenue_by(orders, order_month(), "month").orderBy("month")


def hourly_orders(orders: DataFrame) -> DataFrame:
    """Orders per hour of the day; empty when all orders share one hour."""
    hours = orders.withColumn("hour", order_hour()).filter(F.col("hour").isNotNull())
    counts = hours.groupBy("hour").agg(F.count(F.lit(1)).alias("orders"))
    several = hours.agg(F.min("hour") < F.max("hour")).scalar()
    return counts.filter(several).orderBy("hour")


# -- RFM ------------------------------------------------------------------------------------

def rfm_points(rfm: DataFrame) -> DataFrame:
    return rfm_segments(rfm).select("customer_id", "Recency", "Frequency", "Monetary", "Segment")


def business_page(
    orders: DataFrame, purchases: DataFrame, features: DataFrame, rfm: DataFrame, catalog: DataFrame
) -> dict[str, DataFrame]:
    """All tables of the page. Only ``orders`` is meant to be filtered; persist it beforehand.

    Reports whose optional columns are absent are left out; an absent required one raises first.
    """
    validate_inputs({
        "transactions": orders, "purchases": purchases, "category_features": features, "rfm": rfm, "catalog": catalog,
    })
    page = {
        "overview": business_overview(orders),
        "total_products": total_products(catalog),
        "top_customers": top_customers_by_revenue(orders),
        "catalog_value": catalog_value_by_category(catalog),
        "avg_price": avg_price_by_category(catalog),
        "product_count": product_count_by_category(catalog),
        "items_per_customer": items_per_customer_histogram(purchases),
        "repurchase_rate": repurchase_rate(purchases),
        "popular_products": popular_products(purchases),
        "product_terms": product_term_frequency(purchases),
        "rfm_points": rfm_points(rfm),
    }
    if columns_by_suffix(features, SPEND_SUFFIX):
        page["avg_spend"] = avg_spend_by_category(features)
    optional = {
        "order_date": {
            "daily_revenue": daily_revenue, "daily_revenue_orders": daily_revenue_orders,
            "monthly_revenue": monthly_revenue, "hourly_orders": hourly_orders,
        },
        "mode_of_payment": {"payments": payment_distribution},
        "gender": {"genders": customers_by_gender},
        "region": {"regions": revenue_by_region},
        "city_name": {"cities": top_cities_by_revenue},
    }
    for column, reports in optional.items():
        if has(orders, column):
            page.update({name: report(orders) for name, report in reports.items()})
    return page
