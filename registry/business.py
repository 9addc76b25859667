"""Business page: order filters, KPIs, products, RFM, places and time series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry import tables as t
from registry.core import count, money_avg, money_sum, query
from registry.tables import SPEND
from tillview.functions.dates import date_parts, order_day
from tillview.operators import binning, filters, ranking, scoring, sketches
from tillview.plans import business as b
from tillview.session import new_folder
from tillview.sources import layout

LOW, HIGH = date(1996, 1, 1), date(1998, 12, 31)
IN_RANGE = f"order_date BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'"
STOP_WORDS = ("red", "small")


def as_text(df: DataFrame, column: str) -> DataFrame:
    """A date as text, which every engine hands out alike."""
    return df.withColumn(column, F.col(column).cast("string"))


# -- filters and option lists ---------------------------------------------------------------

@query("fil_01_by_date_range", "SELECT * FROM t_events WHERE order_date BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09'", "t_events")
def _(spark, sf):
    return filters.by_date_range(t.event_orders(spark, sf), date(2024, 1, 2), date(2024, 1, 9))


@query("fil_01_by_date_range_whole_days", "SELECT * FROM t_events WHERE order_date >= TIMESTAMP '2024-01-02' AND order_date < TIMESTAMP '2024-01-10'", "t_events")
def _(spark, sf):
    return filters.by_date_range(t.event_orders(spark, sf), date(2024, 1, 2), date(2024, 1, 9), True)


@query("fil_02_by_region", "SELECT * FROM t_orders WHERE region = 'ASIA'", "t_orders")
def _(spark, sf):
    return filters.by_region(t.orders(spark, sf), "ASIA")


@query("fil_03_by_gender", "SELECT * FROM t_orders WHERE gender = 'MACHINERY'", "t_orders")
def _(spark, sf):
    return filters.by_gender(t.orders(spark, sf), "MACHINERY")


@query("fil_01_stored_by_month", f"SELECT * FROM t_orders WHERE {IN_RANGE}", "t_orders")
def _(spark, sf):
    orders = t.orders(spark, sf)
    stored = layout.read_orders(spark, layout.write_orders(orders, new_folder(spark, "orders")), orders.schema)
    return layout.orders_between(stored, LOW, HIGH).drop(layout.MONTH)


@query("fil_01_03_orders_filter", f"SELECT * FROM t_orders WHERE {IN_RANGE} AND region = 'EUROPE' AND gender = 'BUILDING'", "t_orders")
def _(spark, sf):
    return filters.orders_filter(t.orders(spark, sf), LOW, HIGH, "EUROPE", "BUILDING")


for _column in ("region", "gender", "customer_id", "name", "state", "city_name"):
    @query(f"ded_02_distinct_{_column}", f"SELECT DISTINCT {_column} FROM t_orders WHERE {_column} IS NOT NULL", "t_orders")
    def _(spark, sf, column=_column):
        return filters.distinct_sorted(t.orders(spark, sf), column)


@query("ded_02_distinct_category", "SELECT DISTINCT category FROM t_catalog WHERE category IS NOT NULL", "t_catalog")
def _(spark, sf):
    return filters.distinct_sorted(t.catalog(spark, sf), "category")


@query("agg_41_order_bounds", "SELECT min(order_date) AS min_order_date, max(order_date) AS max_order_date, min(total_spent) AS min_total_spent, max(total_spent) AS max_total_spent FROM t_orders", "t_orders")
def _(spark, sf):
    return filters.bounds(t.orders(spark, sf), ["order_date", "total_spent"])


# -- KPIs -----------------------------------------------------------------------------------

@query("agg_01_total_customers", f"SELECT {count('DISTINCT customer_id')} AS total_customers FROM t_orders", "t_orders")
def _(spark, sf):
    return b.total_customers(t.orders(spark, sf))


@query("agg_02_total_revenue", f"SELECT {money_sum('total_spent')} AS total_revenue FROM t_orders", "t_orders")
def _(spark, sf):
    return b.total_revenue(t.orders(spark, sf))


@query("agg_03_total_orders", f"SELECT {count()} AS total_orders FROM t_orders", "t_orders")
def _(spark, sf):
    return b.total_orders(t.orders(spark, sf))


@query("agg_04_average_order_value", f"SELECT {money_avg('total_spent')} AS avg_order_value FROM t_orders", "t_orders")
def _(spark, sf):
    return b.average_order_value(t.orders(spark, sf))


@query("agg_05_total_products", f"SELECT {count()} AS total_products FROM t_catalog", "t_catalog")
def _(spark, sf):
    return b.total_products(t.catalog(spark, sf))


@query("agg_23_business_overview", f"""SELECT {count('DISTINCT customer_id')} AS total_customers,
  {money_sum('total_spent')} AS total_revenue, {count()} AS total_orders,
  {money_avg('total_spent')} AS avg_order_value FROM t_orders""", "t_orders")
def _(spark, sf):
    return b.business_overview(t.orders(spark, sf))


# -- revenue and customers ------------------------------------------------------------------

@query("agg_06_daily_revenue", f"SELECT CAST(CAST(order_date AS DATE) AS VARCHAR) AS day, {money_sum('total_spent')} AS revenue FROM t_orders GROUP BY 1", "t_orders")
def _(spark, sf):
    return as_text(b.daily_revenue(t.orders(spark, sf)), "day")


@query("agg_07_payment_distribution", f"SELECT mode_of_payment, {count()} AS orders, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM t_orders) AS share FROM t_orders GROUP BY 1", "t_orders")
def _(spark, sf):
    return b.payment_distribution(t.orders(spark, sf))


@query("agg_08_top_customers_by_revenue", f"SELECT customer_id, {money_sum('total_spent')} AS revenue FROM t_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "t_orders")
def _(spark, sf):
    return b.top_customers_by_revenue(t.orders(spark, sf))


@query("agg_09_customers_by_gender", f"SELECT gender, {count('DISTINCT customer_id')} AS customers FROM t_orders GROUP BY 1", "t_orders")
def _(spark, sf):
    return b.customers_by_gender(t.orders(spark, sf))


def label(column: str, suffix: str) -> str:
    """Title-cased category of a wide column such as ``brand_7_spend``."""
    text = column.removesuffix(suffix).replace("_", " ")
    return text[0].upper() + text[1:]


AVERAGES = " UNION ALL ".join(f"SELECT '{label(s, '_spend')}' AS category, {money_avg(s)} AS avg_spend FROM t_features" for s in SPEND)


@query("agg_10_avg_spend_by_category", AVERAGES, "t_features")
def _(spark, sf):
    return b.avg_spend_by_category(t.features(spark, sf))


@query("prj_05_spend_columns", f"SELECT customer_id, {', '.join(SPEND)} FROM t_features", "t_features")
def _(spark, sf):
    features = t.features(spark, sf)
    return features.select("customer_id", *b.columns_by_suffix(features, b.SPEND_SUFFIX))


@query("prj_06_category_label", "SELECT DISTINCT upper(left(category, 1)) || replace(substr(category, 2), '_', ' ') AS label FROM t_catalog", "t_catalog")
def _(spark, sf):
    return t.catalog(spark, sf).select(b.category_label(F.col("category"), b.SPEND_SUFFIX).alias("label")).distinct()


# -- products -------------------------------------------------------------------------------

@query("agg_11_catalog_value_by_category", f"SELECT category, {money_sum('price_inr')} AS total_value FROM t_catalog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "t_catalog")
def _(spark, sf):
    return b.catalog_value_by_category(t.catalog(spark, sf))


@query("agg_12_avg_price_by_category", f"SELECT category, {money_avg('price_inr')} AS avg_price FROM t_catalog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "t_catalog")
def _(spark, sf):
    return b.avg_price_by_category(t.catalog(spark, sf))


@query("agg_13_product_count_by_category", f"SELECT category, {count('product')} AS products FROM t_catalog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "t_catalog")
def _(spark, sf):
    return b.product_count_by_category(t.catalog(spark, sf))


def histogram_sql(source: str, column: str, nbins: int) -> str:
    return f"""SELECT CAST(i AS BIGINT) AS bin, low + width * i AS bin_start, low + width * (i + 1) AS bin_end,
      CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM range({nbins}) r(i) CROSS JOIN (SELECT min({column})::DOUBLE AS low, (max({column})::DOUBLE - min({column})::DOUBLE) / {nbins} AS width FROM {source})
    LEFT JOIN (SELECT least(CAST(floor(({column}::DOUBLE - low) / width) AS BIGINT), {nbins - 1}) AS bin, count(*) AS n
      FROM {source}, (SELECT min({column})::DOUBLE AS low, (max({column})::DOUBLE - min({column})::DOUBLE) / {nbins} AS width FROM {source})
      GROUP BY 1) h ON h.bin = i"""


ITEMS = "(SELECT customer_id, count(*) AS items FROM t_lines GROUP BY 1)"


@query("agg_14_items_per_customer_histogram", histogram_sql(ITEMS, "items", 20), "t_lines")
def _(spark, sf):
    return b.items_per_customer_histogram(t.lines(spark, sf))


@query("his_01_order_value_histogram", histogram_sql("t_orders", "total_spent", 40), "t_orders")
def _(spark, sf):
    return binning.histogram(t.orders(spark, sf), "total_spent", 40)


RATE = f"""SELECT product, {count()} AS purchases, {count('DISTINCT customer_id')} AS customers,
  CAST(count(*) AS DOUBLE) / count(DISTINCT customer_id) AS repurchase_rate FROM t_lines GROUP BY 1"""


@query("agg_15_repurchase_rate", f"{RATE} ORDER BY 4 DESC, 1 LIMIT 15", "t_lines")
def _(spark, sf):
    return b.repurchase_rate(t.lines(spark, sf))


@query("joi_08_repurchase_rate_of_all_products", RATE, "t_lines")
def _(spark, sf):
    return b.repurchase_rate(t.lines(spark, sf), None)


@query("agg_16_popular_products", f"SELECT product, {count()} AS purchases FROM t_lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "t_lines")
def _(spark, sf):
    return b.popular_products(t.lines(spark, sf))


COLLOCATIONS = """names AS (SELECT regexp_extract_all(lower(product), '\\w[\\w'']*') AS w, count(*) AS c FROM t_lines WHERE product IS NOT NULL GROUP BY product),
  words AS (SELECT word, sum(c) AS n FROM (SELECT unnest(w) AS word, c FROM names) WHERE length(word) > 1 AND word NOT IN ('red', 'small') GROUP BY 1),
  pairs AS (SELECT first, second, sum(c) AS n FROM (SELECT w[i] AS first, w[i + 1] AS second, c FROM (SELECT w, c, unnest(range(1, len(w))) AS i FROM names))
    WHERE first IN (SELECT word FROM words) AND second IN (SELECT word FROM words) GROUP BY 1, 2),
  k AS (SELECT first, second, p.n::DOUBLE AS a, x.n - p.n::DOUBLE AS b, y.n - p.n::DOUBLE AS c,
    (SELECT sum(n) FROM words) - x.n - y.n + p.n::DOUBLE AS d FROM pairs p JOIN words x ON x.word = first JOIN words y ON y.word = second)"""


@query("agg_17_product_collocations", f"""SELECT first, second, CAST(a AS BIGINT) AS n, g2 FROM (SELECT *, round(2 * (
  CASE WHEN a > 0 THEN a * ln(a * (a + b + c + d) / ((a + b) * (a + c))) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * (a + b + c + d) / ((a + b) * (b + d))) ELSE 0 END
  + CASE WHEN c > 0 THEN c * ln(c * (a + b + c + d) / ((c + d) * (a + c))) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d * (a + b + c + d) / ((c + d) * (b + d))) ELSE 0 END), 4) AS g2
  FROM (WITH {COLLOCATIONS} SELECT * FROM k)) WHERE g2 >= 10 AND a * (a + b + c + d) > (a + b) * (a + c)""", "t_lines")
def _(spark, sf):
    return b.product_collocations(t.lines(spark, sf), stop_words=STOP_WORDS, least=10.0)


@query("his_01_readable_order_values", """SELECT CAST(k - kl AS BIGINT) AS bin, k * width AS bin_start, (k + 1) * width AS bin_end, (SELECT count(*) FROM t_orders WHERE floor(total_spent / width) = k) AS n
  FROM (SELECT width, floor(low / width) AS kl, unnest(range(CAST(floor(low / width) AS BIGINT), CAST(floor(high / width) AS BIGINT) + 1)) AS k FROM (
    SELECT low, high, min(width) AS width FROM (SELECT min(total_spent) AS low, max(total_spent) AS high FROM t_orders),
      (SELECT m * CAST(pow(10, e) AS DOUBLE) AS width FROM unnest([1, 2, 5]) AS ms(m), range(0, 12) AS es(e))
    WHERE floor(high / width) - floor(low / width) < 40 GROUP BY low, high))""", "t_orders")
def _(spark, sf):
    return binning.readable_histogram(t.orders(spark, sf), "total_spent", 40)


@query("agg_17_product_term_frequency", f"""SELECT term, {count()} AS n FROM (SELECT unnest(regexp_extract_all(lower(product), '\\w[\\w'']*')) AS term FROM t_lines)
  WHERE length(term) > 1 AND term NOT IN {STOP_WORDS} GROUP BY 1""", "t_lines")
def _(spark, sf):
    return b.product_term_frequency(t.lines(spark, sf), stop_words=STOP_WORDS)


# -- places and time ------------------------------------------------------------------------

@query("agg_18_revenue_by_region", f"SELECT region, {money_sum('total_spent')} AS revenue FROM t_orders GROUP BY 1", "t_orders")
def _(spark, sf):
    return b.revenue_by_region(t.orders(spark, sf))


@query("agg_19_top_cities_by_revenue", f"SELECT city_name, {money_sum('total_spent')} AS revenue FROM t_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "t_orders")
def _(spark, sf):
    return b.top_cities_by_revenue(t.orders(spark, sf))


@query("srt_06_top_states_after_aggregate", f"SELECT state, {money_sum('total_spent')} AS revenue FROM t_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "t_orders")
def _(spark, sf):
    return ranking.top_k(b._revenue_by(t.orders(spark, sf), F.col("state"), "state"), "revenue", 15, ["state"])


@query("agg_20_daily_revenue_orders", f"SELECT CAST(CAST(order_date AS DATE) AS VARCHAR) AS day, {money_sum('total_spent')} AS revenue, {count('transaction_id')} AS orders FROM t_orders GROUP BY 1", "t_orders")
def _(spark, sf):
    return as_text(b.daily_revenue_orders(t.orders(spark, sf)), "day")


@query("agg_21_monthly_revenue", f"SELECT strftime(order_date, '%Y-%m') AS month, {money_sum('total_spent')} AS revenue FROM t_orders GROUP BY 1", "t_orders")
def _(spark, sf):
    return b.monthly_revenue(t.orders(spark, sf))


@query("agg_22_hourly_orders", f"SELECT CAST(hour(order_date) AS INTEGER) AS hour, {count()} AS orders FROM t_events WHERE (SELECT count(DISTINCT hour(order_date)) FROM t_events) > 1 GROUP BY 1", "t_events")
def _(spark, sf):
    return b.hourly_orders(t.event_orders(spark, sf))


@query("dat_01_date_parts", "SELECT *, CAST(CAST(order_date AS DATE) AS VARCHAR) AS order_day, CAST(hour(order_date) AS INTEGER) AS order_hour, strftime(order_date, '%Y-%m') AS order_month FROM t_events", "t_events")
def _(spark, sf):
    return as_text(date_parts(t.event_orders(spark, sf)), "order_day")


# -- quantiles, ranks and RFM ---------------------------------------------------------------

RANKED = "(SELECT *, row_number() OVER (ORDER BY Frequency, customer_id) AS rn, count(*) OVER () AS n FROM t_rfm)"
F_SCORE = "CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(4.0 * (rn - 1) / (n - 1))) END AS INTEGER)"
EDGES = """(SELECT quantile_cont(Recency, 0.25) AS r1, quantile_cont(Recency, 0.5) AS r2, quantile_cont(Recency, 0.75) AS r3,
  quantile_cont(Monetary, 0.25) AS m1, quantile_cont(Monetary, 0.5) AS m2, quantile_cont(Monetary, 0.75) AS m3 FROM t_rfm)"""
R_SCORE = "CAST(CASE WHEN Recency <= r1 THEN 4 WHEN Recency <= r2 THEN 3 WHEN Recency <= r3 THEN 2 ELSE 1 END AS INTEGER)"
M_SCORE = "CAST(CASE WHEN Monetary <= m1 THEN 1 WHEN Monetary <= m2 THEN 2 WHEN Monetary <= m3 THEN 3 ELSE 4 END AS INTEGER)"
SCORES = f"""SELECT customer_id, Recency, Frequency, Monetary, {F_SCORE} AS F_Score, {R_SCORE} AS R_Score, {M_SCORE} AS M_Score,
  {R_SCORE} + {F_SCORE} + {M_SCORE} AS RFM_Score FROM {RANKED}, {EDGES}"""
SEGMENTS = f"""SELECT *, CASE WHEN RFM_Score >= 10 THEN 'Champions' WHEN RFM_Score >= 8 THEN 'Loyal Customers'
  WHEN RFM_Score >= 6 THEN 'Potential Loyalists' WHEN RFM_Score >= 5 THEN 'At Risk' ELSE 'Lost' END AS Segment FROM ({SCORES})"""


@query("bin_01_quantile_edges", "SELECT round(quantile_cont(total_spent, 0.1), 4) AS p10, round(quantile_cont(total_spent, 0.5), 4) AS p50, round(quantile_cont(total_spent, 0.99), 4) AS p99 FROM t_orders", "t_orders")
def _(spark, sf):
    edges = binning.quantile_edges(t.orders(spark, sf), "total_spent", [0.1, 0.5, 0.99])
    return edges.selectExpr("round(edges[0], 4) AS p10", "round(edges[1], 4) AS p50", "round(edges[2], 4) AS p99")


RANK_SHARES = """FROM t_orders, (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p) GROUP BY region, p"""


@query("bin_01_sketched_edges", f"SELECT region, CAST(p AS DOUBLE) AS p, count(total_spent) AS n, true AS within_bound {RANK_SHARES}", "t_orders")
def _(spark, sf):
    """Edges from stored sketches per day and region, each beside its exact rank in the region's orders."""
    path, probs = new_folder(spark, "value_sketches"), [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    orders = t.orders(spark, sf).withColumn("order_day", order_day())
    sketches.value_sketches(orders, "total_spent", ["order_day", "region"]).write.parquet(path)
    said = sketches.sketched_edges(spark.read.parquet(path), probs, ["region"])
    # One row per region, which the planner may broadcast by its size; counts combine before the shuffle.
    edges = said.select(F.col("region").alias("_region"), "edges")
    facts = orders.join(edges, F.col("region").eqNullSafe(F.col("_region")))
    below = [F.count_if(F.col("total_spent") < F.col("edges")[i]) for i in range(len(probs))]
    upto = [F.count_if(F.col("total_spent") <= F.col("edges")[i]) for i in range(len(probs))]
    row = F.array(*[F.struct(F.lit(p).alias("p"), b.alias("below"), u.alias("upto")) for p, b, u in zip(probs, below, upto, strict=True)])
    ranks = facts.groupBy("region").agg(F.count("total_spent").alias("n"), row.alias("ranks"))
    # Twice the bound of 99% of sketches, about five standard errors, as many edges are checked at once.
    low, high, place = F.col("x.below") / F.col("n"), F.col("x.upto") / F.col("n"), F.col("x.p")
    off = F.greatest(F.lit(0.0), low - place, place - high)
    return ranks.select("region", "n", F.explode("ranks").alias("x")).select(
        "region", place.alias("p"), "n", (off <= 2 * sketches.rank_error_bound()).alias("within_bound")
    )


@query("bin_02_qcut_orders", """SELECT transaction_id, CASE WHEN total_spent <= e1 THEN 'a' WHEN total_spent <= e2 THEN 'b'
  WHEN total_spent <= e3 THEN 'c' WHEN total_spent <= e4 THEN 'd' ELSE 'e' END AS fifth FROM t_orders,
  (SELECT quantile_cont(total_spent, 0.2) AS e1, quantile_cont(total_spent, 0.4) AS e2,
  quantile_cont(total_spent, 0.6) AS e3, quantile_cont(total_spent, 0.8) AS e4 FROM t_orders)""", "t_orders")
def _(spark, sf):
    return binning.qcut(t.orders(spark, sf), "total_spent", list("abcde"), "fifth").select("transaction_id", "fifth")


@query("bin_03_global_rank", "SELECT transaction_id, total_spent, row_number() OVER (ORDER BY total_spent, transaction_id) AS rank FROM t_orders", "t_orders")
def _(spark, sf):
    orders = t.orders(spark, sf).select("transaction_id", "total_spent")
    return ranking.global_rank(orders, ["total_spent", "transaction_id"])


@query("bin_06_r_score", f"SELECT customer_id, Recency, Frequency, Monetary, {R_SCORE} AS R_Score FROM t_rfm, {EDGES}", "t_rfm")
def _(spark, sf):
    return scoring.r_score(t.rfm(spark, sf))


@query("bin_07_f_score", f"SELECT customer_id, Recency, Frequency, Monetary, {F_SCORE} AS F_Score FROM {RANKED}", "t_rfm")
def _(spark, sf):
    return binning.f_score(t.rfm(spark, sf))


@query("bin_08_m_score", f"SELECT customer_id, Recency, Frequency, Monetary, {M_SCORE} AS M_Score FROM t_rfm, {EDGES}", "t_rfm")
def _(spark, sf):
    return scoring.m_score(t.rfm(spark, sf))


@query("seg_01_rfm_score", SCORES, "t_rfm")
def _(spark, sf):
    return scoring.rfm_segments(t.rfm(spark, sf)).drop("Segment")


@query("seg_02_rfm_segment", SEGMENTS, "t_rfm")
def _(spark, sf):
    return scoring.rfm_segments(t.rfm(spark, sf))


@query("prj_10_rfm_points", f"SELECT customer_id, Recency, Frequency, Monetary, Segment FROM ({SEGMENTS})", "t_rfm")
def _(spark, sf):
    return b.rfm_points(t.rfm(spark, sf))


# -- mergeable sketches ---------------------------------------------------------------------

def beside_exact(spark, sf, by: list[str], low: date | None = None, high: date | None = None) -> DataFrame:
    """Exact customers beside what stored day sketches say: whether that is within the error bound."""
    path = new_folder(spark, "sketches")
    sketches.customer_sketches(t.orders(spark, sf)).write.parquet(path)
    stored = sketches.sketch_filter(spark.read.parquet(path), low, high)
    said = sketches.estimated_customers(stored, by).withColumnsRenamed({"customers": "_said", "n_orders": "orders"})
    orders = filters.by_date_range(t.orders(spark, sf), low, high, end_inclusive_day=True)
    exact = orders.groupBy(*by).agg(F.countDistinct("customer_id").alias("customers"))
    # Without keys there is one row on either side.
    both = said.withColumn("_all", F.lit(0)).join(exact.withColumn("_all", F.lit(0)), [*by, "_all"])
    near = F.abs(F.col("_said") - F.col("customers")) <= F.ceil(sketches.error_bound() * F.col("customers"))
    return both.select(*by, "customers", "orders", "revenue", near.alias("within_bound"))


def exact_sql(by: str, where: str = "TRUE") -> str:
    keys, grouped = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"SELECT {keys}{count('DISTINCT customer_id')} AS customers, {count()} AS orders, {money_sum('total_spent')} AS revenue, "
        f"TRUE AS within_bound FROM t_orders WHERE {where}{grouped}"
    )


@query("agg_01_sketched_customers", exact_sql(""), "t_orders")
def _(spark, sf):
    return beside_exact(spark, sf, [])


@query("agg_01_sketched_by_region", exact_sql("region", IN_RANGE), "t_orders")
def _(spark, sf):
    return beside_exact(spark, sf, ["region"], LOW, HIGH)


@query("agg_09_sketched_by_gender", exact_sql("gender", IN_RANGE), "t_orders")
def _(spark, sf):
    return beside_exact(spark, sf, ["gender"], LOW, HIGH)
