"""Product-based customer insights: reports on the filtered predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.functions.dates import order_month
from tillview.functions.lists import split_cart
from tillview.functions.numbers import (
    format_money, format_percent, format_similarity, money_avg, money_sum, score_avg,
)
from tillview.operators.binning import histogram, quantile_edges
from tillview.operators.joins import customer_ids
from tillview.operators.ranking import display_rank, top_k
from tillview.operators.scoring import TIERS, priority_score, priority_tier
from tillview.plans.business import column_averages
from tillview.schemas import PCT_SUFFIX, SPEND_SUFFIX, columns_by_suffix, existing, has

# Display columns in order with their headings, and the text of the tier playbook.
TRACKING_NAMES = {
    "customer_id": "Customer ID",
    "name": "Name",
    "product": "Product",
    "category": "Category",
    "propensity_score": "Propensity",
    "embedding_similarity": "Similarity",
    "total_spent": "Total Spent",
    "total_transactions": "Transactions",
    "Recency": "Days Since Visit",
    "Frequency": "Purchase Freq",
    "Monetary": "RFM Value",
    "gender": "Gender",
    "region": "Region",
    "city": "City",
    "phone_number": "Phone",
    "engagement_score": "Engagement",
}
TOP_CUSTOMER_NAMES = {
    "customer_id": "Customer ID",
    "name": "Name",
    "propensity_score": "Propensity",
    "engagement_score": "Engagement",
    "total_spent": "Total Spent",
    "Recency": "Days Since Visit",
    "Frequency": "Purchases",
    "phone_number": "Phone",
    "city": "City",
    "priority_score": "Priority Score",
}
PLAYBOOK = (
    ("high", "Launch immediate campaign", "Email + WhatsApp", "Exclusive product access"),
    ("medium", "Nurture campaign", "Email series", "Limited-time discount"),
    ("at_risk", "Win-back campaign", "Special offers", "20% off + free shipping"),
)


# -- display tables -------------------------------------------------------------------------

def tracking_columns(df: DataFrame) -> DataFrame:
    return df.select(existing(df, TRACKING_NAMES))


def top_customer_columns(df: DataFrame) -> DataFrame:
    return df.select(existing(df, TOP_CUSTOMER_NAMES))


def rename_display(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def _formatted(df: DataFrame, formats: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: text for c, text in formats.items() if c in df.columns})


def tracking_table(df: DataFrame) -> DataFrame:
    """The customer tracking list as shown and exported."""
    shown = _formatted(tracking_columns(df), {
        "propensity_score": format_percent("propensity_score", 2),
        "embedding_similarity": format_similarity("embedding_similarity"),
        "engagement_score": format_percent("engagement_score", 2),
        "total_spent": format_money("total_spent"),
        "Monetary": format_money("Monetary"),
    })
    return rename_display(shown, TRACKING_NAMES)


def top_priority(df: DataFrame, k: int = 20) -> DataFrame:
    return top_k(priority_score(df), "priority_score", k, ["customer_id", "product"])


def top_customers_table(df: DataFrame, k: int = 20) -> DataFrame:
    """The top list by priority score as shown and exported, numbered from 1."""
    ranked = display_rank(top_priority(df, k), "priority_score", ["customer_id", "product"])
    shown = _formatted(ranked, {
        c: format_percent(c, 1) for c in ("propensity_score", "engagement_score", "priority_score")
    } | {"total_spent": format_money("total_spent")})
    shown = shown.select("Rank", *existing(shown, TOP_CUSTOMER_NAMES))
    return rename_display(shown, TOP_CUSTOMER_NAMES)


def rfm_propensity_points(df: DataFrame) -> DataFrame:
    return df.select(existing(df, (
        "customer_id", "name", "Recency", "Monetary", "Frequency", "propensity_score",
    )))


def frequency_propensity_points(df: DataFrame) -> DataFrame:
    return df.select("customer_id", "Frequency", "propensity_score", "spending_category")


# -- summaries ------------------------------------------------------------------------------

def insights_overview(df: DataFrame) -> DataFrame:
    """Averages, high-propensity count and revenue potential; averages fall back as columns lack."""
    value = "Monetary" if has(df, "Monetary") else "total_spent"
    often = "Frequency" if has(df, "Frequency") else "total_transactions"
    recency = money_avg("Recency") if has(df, "Recency") else F.lit(None).cast("double")
    return df.agg(
        score_avg("propensity_score").alias("avg_propensity"),
        F.count_if(F.col("propensity_score") > 0.7).alias("high_propensity"),
        money_avg(value).alias("avg_value"),
        recency.alias("avg_recency"),
        money_avg(often).alias("avg_frequency"),
        money_sum("total_spent").alias("revenue_potential"),
    )


def loaded_profiles(base: DataFrame) -> DataFrame:
    return base.agg(F.count(F.lit(1)).alias("profiles"))


def filter_summary(base: DataFrame, filtered: DataFrame) -> DataFrame:
    """Rows before and after the filters, their difference, the share kept and distinct customers."""
    kept = filtered.agg(
        F.count(F.lit(1)).alias("filtered_rows"),
        F.countDistinct("customer_id").alias("distinct_customers"),
    )
    original = base.agg(F.count(F.lit(1))).scalar()
    share = F.coalesce(F.try_divide(F.col("filtered_rows") * 100, F.col("original_rows")), F.lit(0.0))
    return kept.withColumn("original_rows", original).select(
        "original_rows",
        "filtered_rows",
        (F.col("original_rows") - F.col("filtered_rows")).alias("removed_rows"),
        share.alias("retained_pct"),
        "distinct_customers",
    )


def gender_segments(df: DataFrame) -> DataFrame:
    return df.filter(F.col("gender").isNotNull()).groupBy("gender").agg(
        F.count("customer_id").alias("n_rows"),
        F.countDistinct("customer_id").alias("distinct_customers"),
        score_avg("propensity_score").alias("avg_propensity"),
        money_sum("total_spent").alias("total_spent"),
    ).orderBy("gender")


def region_segments(df: DataFrame, k: int = 10) -> DataFrame:
    regions = df.filter(F.col("region").isNotNull()).groupBy("region").agg(
        F.count("customer_id").alias("n_rows"), score_avg("propensity_score").alias("avg_propensity")
    )
    return top_k(regions, "n_rows", k, ["region"])


def category_spend_profile(df: DataFrame, k: int = 10) -> DataFrame:
    columns = columns_by_suffix(df, SPEND_SUFFIX)
    averages = column_averages(df, columns, SPEND_SUFFIX, money_avg, "avg_spend")
    return top_k(averages, "avg_spend", k, ["category"])


def category_pct_profile(df: DataFrame, k: int = 10, first: int | None = None) -> DataFrame:
    """The ``k`` highest average shares, positive ones only; of the ``first`` share columns if given."""
    columns = columns_by_suffix(df, PCT_SUFFIX)[:first]
    averages = column_averages(df, columns, PCT_SUFFIX, score_avg, "avg_pct")
    return top_k(averages.filter(F.col("avg_pct") > 0), "avg_pct", k, ["category"])


def _cart_items(df: DataFrame, column: str) -> Column:
    """Items of a cart column: a number as it is, a list text by its length."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.col(column)
    return F.size(split_cart(column))


def cart_averages(df: DataFrame) -> DataFrame:
    """Average number of cart items, for the own and for other categories."""
    averages = df.agg(
        money_avg(_cart_items(df, "in_cart_same_category")).alias("Same Category"),
        money_avg(_cart_items(df, "in_cart_other_category")).alias("Other Category"),
    )
    return averages.unpivot([], ["Same Category", "Other Category"], "cart_type", "avg_items")


def _orders_per(orders: DataFrame, customers: DataFrame, key: Column, name: str) -> DataFrame:
    """Orders of the given customers per ``key``.

    Counted per customer before the semi join, so a customer with very many orders is a few rows.
    """
    counts = orders.groupBy("customer_id", key.alias(name)).agg(F.count(F.lit(1)).alias("_n"))
    theirs = counts.filter(F.col(name).isNotNull()).join(customer_ids(customers), "customer_id", "left_semi")
    return theirs.groupBy(name).agg(F.sum("_n").alias("orders")).orderBy(name)


def monthly_orders_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return _orders_per(orders, customers, order_month(), "month")


def quarter_orders_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return _orders_per(orders, customers, F.col("order_quarter"), "order_quarter")


def tier_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct customers, summed and average spend per tier; empty tiers are kept."""
    found = priority_tier(df).filter(F.col("tier").isNotNull()).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("customer_id").alias("distinct_customers"),
        money_sum("total_spent").alias("revenue_potential"),
        money_avg("total_spent").alias("avg_spent"),
    )
    tiers = df.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return tiers.join(found, "tier", "left").fillna(0, ["n_rows", "distinct_customers", "revenue_potential"])


def tier_playbook(df: DataFrame) -> DataFrame:
    """The tier summary with the fixed action, channel and offer of each tier."""
    playbook = df.sparkSession.createDataFrame(
        list(PLAYBOOK), "tier string, action string, channel string, offer string"
    )
    return tier_summary(df).join(playbook, "tier")


def product_segment_counts(df: DataFrame) -> DataFrame:
    """High spenders, customers above the median frequency, and recent visitors; NULL if unknown."""
    none = F.lit(None).cast("long")
    active, frequent = none, df
    if has(df, "Frequency"):
        frequent = df.withColumn("_median", quantile_edges(df, "Frequency", [0.5]).scalar()[0])
        active = F.count_if(F.col("Frequency") > F.col("_median"))
    recent = F.count_if(F.col("Recency") < 30) if has(df, "Recency") else none
    return frequent.agg(
        F.count_if(F.col("spending_category") == "High Spender").alias("high_spenders"),
        active.alias("active_buyers"),
        recent.alias("recent_visitors"),
    )


# -- distributions --------------------------------------------------------------------------

def propensity_histogram(df: DataFrame, nbins: int = 30) -> DataFrame:
    return histogram(df, "propensity_score", nbins)


def engagement_histogram(df: DataFrame, nbins: int = 25) -> DataFrame:
    return histogram(df, "engagement_score", nbins)


def spend_box_by_propensity(df: DataFrame) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, extremes and outlier count."""
    known = df.filter(F.col("propensity_category").isNotNull() & F.col("total_spent").isNotNull())
    # One row per propensity category, of which there are three.
    edges = F.broadcast(quantile_edges(known, "total_spent", [0.25, 0.5, 0.75], ["propensity_category"]))
    reach = (F.col("edges")[2] - F.col("edges")[0]) * 1.5
    spent = F.col("total_spent")
    inside = spent.between(F.col("edges")[0] - reach, F.col("edges")[2] + reach)
    return (
        known.join(edges, "propensity_category")
        .groupBy("propensity_category")
        .agg(
            F.min("total_spent").alias("min_spent"),
            F.min(F.when(inside, spent)).alias("whisker_low"),
            F.max(F.col("edges")[0]).alias("q1"),
            F.max(F.col("edges")[1]).alias("median"),
            F.max(F.col("edges")[2]).alias("q3"),
            F.max(F.when(inside, spent)).alias("whisker_high"),
            F.max("total_spent").alias("max_spent"),
            F.count_if(~inside).alias("outliers"),
        )
        .orderBy("propensity_category")
    )


def insights_page(
    base: DataFrame, filtered: DataFrame, orders: DataFrame, product: str | None = None
) -> dict[str, DataFrame]:
    """All tables of the page for rows kept by the insights filter; persist both frames beforehand.

    Reports whose optional columns are absent are left out.
    """
    page = {
        "summary": filter_summary(base, filtered),
        "overview": insights_overview(filtered),
        "tracking": tracking_table(filtered),
        "top_customers": top_customers_table(filtered),
        "tiers": tier_playbook(filtered),
        "propensity_histogram": propensity_histogram(filtered),
        "engagement_histogram": engagement_histogram(filtered),
        "genders": gender_segments(filtered),
        "regions": region_segments(filtered),
    }
    if has(filtered, "Recency", "Monetary"):
        page["rfm_points"] = rfm_propensity_points(filtered)
    else:
        page["spend_box"] = spend_box_by_propensity(filtered)
    if has(filtered, "Frequency"):
        page["frequency_points"] = frequency_propensity_points(filtered)
    if has(filtered, "in_cart_same_category", "in_cart_other_category"):
        page["carts"] = cart_averages(filtered)
    if has(orders, "order_date"):
        page["monthly_orders"] = monthly_orders_of(orders, filtered)
    if has(orders, "order_date", "order_quarter"):
        page["quarter_orders"] = quarter_orders_of(orders, filtered)
    if columns_by_suffix(filtered, SPEND_SUFFIX):
        page["category_spend"] = category_spend_profile(filtered)
    if columns_by_suffix(filtered, SPEND_SUFFIX) and columns_by_suffix(filtered, PCT_SUFFIX):
        page["category_pct"] = category_pct_profile(filtered)
    if product is not None:
        page["product_segments"] = product_segment_counts(filtered)
    return page
