"""Distinct customers and quantiles from mergeable sketches, kept per day, region and gender.

Orders are read once, when the sketches are made. Any later choice of days, regions and genders merges
the stored sketches and never goes back to the orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import order_day
from tillview.functions.numbers import money_sum
from tillview.schemas import existing

# A sketch has 2 ** SKETCH_BITS counters; more are more exact and larger.
SKETCH_BITS = 12
SKETCH_KEYS = ("order_day", "region", "gender")


def error_bound(bits: int = SKETCH_BITS, deviations: float = 3.0) -> float:
    """Relative error that an estimate stays within, as so many standard errors of a sketch."""
    return deviations * 1.04 / 2 ** (bits / 2)


def customer_sketches(orders: DataFrame, by: Sequence[str] = SKETCH_KEYS, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per value of ``by`` (those ``orders`` has): a sketch of the customers, orders and revenue.

    NULL keys are kept as groups of their own; NULL customers count in none.
    """
    days = orders.withColumn("order_day", order_day()) if "order_date" in orders.columns else orders
    return days.groupBy(*existing(days, by)).agg(
        F.hll_sketch_agg("customer_id", bits).alias("customers"),
        F.count(F.lit(1)).alias("n_orders"),
        money_sum("total_spent").alias("revenue"),
    )


def sketch_filter(
    sketches: DataFrame, low: date | None = None, high: date | None = None, region: str | None = None, gender: str | None = None
) -> DataFrame:
    """Sketches of whole days from ``low`` to ``high``, of a region, of a gender."""
    tests = [
        (low, lambda: F.col("order_day") >= F.lit(low)), (high, lambda: F.col("order_day") <= F.lit(high)),
        (region, lambda: F.col("region") == region), (gender, lambda: F.col("gender") == gender),
    ]
    for given, test in tests:
        sketches = sketches if given is None else sketches.filter(test())
    return sketches


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups, such as months from days; can be merged again."""
    return sketches.groupBy(*by).agg(
        F.hll_union_agg("customers").alias("customers"), F.sum("n_orders").alias("n_orders"), money_sum("revenue").alias("revenue")
    )


def estimated_customers(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct customers, orders and revenue by group; one row for no group.

    Nothing to merge is 0 customers and 0 orders.
    """
    whole = merged(sketches, by)
    return whole.select(
        *by, F.coalesce(F.hll_sketch_estimate("customers"), F.lit(0)).cast("long").alias("customers"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "revenue",
    )


# Size of a quantile sketch; its rank error falls nearly in proportion.
QUANTILE_K = 800


def rank_error_bound(k: int = QUANTILE_K) -> float:
    """Share of all values by which the rank of an approximate edge may be off (99% of sketches)."""
    return 2.296 / k**0.9723


def value_sketches(df: DataFrame, column: str, by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """(*by, ``sketch``, ``n``): a mergeable quantile sketch of ``column`` for each group, one map-side pass.

    NULL and NaN take no part; a group without values has a NULL sketch and ``n`` 0. No value is sorted or
    shuffled: what leaves a task is one sketch of bounded size for each group.
    """
    value = F.col(column).cast("double")
    known = F.when(~F.isnan(value), value)
    made = df.groupBy(*by).agg(F.kll_sketch_agg_double(known, k).alias("sketch"), F.count(known).alias("n"))
    return made.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def sketched_edges(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """(*by, ``edges``, ``n``): approximate quantiles of merged sketches; NULL edges where there are no values.

    The way to ``quantile_edges`` without a range sort: an edge is a value of the column whose rank is off by
    at most ``rank_error_bound(k)`` of all values. ``qcut`` takes the result as its ``edges``.
    """
    merged_rows = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("_all"), F.sum("n").alias("n"))
    found = [F.kll_sketch_get_quantile_double("_all", F.lit(float(p))) for p in probs]
    edges = F.when(F.col("n") > 0, F.array(*found))
    return merged_rows.select(*by, edges.alias("edges"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
