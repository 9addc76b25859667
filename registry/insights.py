"""Insights page: preprocessing, filters, scores and reports over all prediction rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import tables as t
from registry.business import histogram_sql, label
from registry.core import count, money_avg, money_sum, query, score_avg
from registry.tables import PCT, SPEND
from tillview.operators import binning, filters, scoring
from tillview.plans import insights as i
from tillview.session import new_folder
from tillview.sources import files

PRODUCT_CATEGORY = "brand_7"
FILTERS = {
    "category": PRODUCT_CATEGORY, "propensity": (0.2, 0.95), "region": "ASIA",
    "price": (900.0, 990.0), "spending": "High Spender", "max_recency": 700, "min_frequency": 3,
}
FILTER_SQL = """category = 'brand_7' AND propensity_score BETWEEN 0.2 AND 0.95 AND region = 'ASIA'
  AND price_inr BETWEEN 900 AND 990 AND spending_category = 'High Spender' AND Recency <= 700
  AND Frequency >= 3"""
TIER = """CASE WHEN propensity_score > 0.7 THEN 'high' WHEN propensity_score BETWEEN 0.4 AND 0.7 THEN 'medium'
  WHEN propensity_score < 0.4 AND Recency > 30 THEN 'at_risk' END"""
PRIORITY = """propensity_score * 0.5::DOUBLE + engagement_score * 0.3::DOUBLE
  + total_spent / (SELECT max(total_spent) FROM t_base) * 0.2::DOUBLE"""


def percent(column: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}%', {column} * 100)"


def money(column: str) -> str:
    return f"format('₹{{:,.0f}}', {column})"


# -- preprocessing and scores ---------------------------------------------------------------

@query("prj_04_fill_unknown", """SELECT customer_id, product, coalesce(nullif(region, 'ASIA'), 'Unknown') AS region,
  coalesce(city, 'Unknown') AS city, coalesce(gender, 'Unknown') AS gender FROM t_predictions""", "t_predictions")
def _(spark, sf):
    df = t.predictions(spark, sf).select("customer_id", "product", "region", "city", "gender")
    return scoring.fill_unknown(df.withColumn("region", F.nullif(F.col("region"), F.lit("ASIA"))))


@query("bin_04_spending_category", "SELECT customer_id, product, spending_category FROM t_scored", "t_scored")
def _(spark, sf):
    return scoring.spending_category(t.predictions(spark, sf)).select("customer_id", "product", "spending_category")


@query("bin_05_propensity_category", "SELECT customer_id, product, propensity_category FROM t_scored", "t_scored")
def _(spark, sf):
    return t.predictions(spark, sf).select("customer_id", "product", binning.propensity_category().alias("propensity_category"))


@query("sco_01_engagement_score", "SELECT customer_id, product, engagement_score FROM t_scored", "t_scored")
def _(spark, sf):
    return scoring.engagement_score(t.predictions(spark, sf)).select("customer_id", "product", "engagement_score")


@query("sco_02_priority_score", f"SELECT customer_id, product, {PRIORITY} AS priority_score FROM t_base", "t_base")
def _(spark, sf):
    return scoring.priority_score(t.base(spark, sf)).select("customer_id", "product", "priority_score")


# -- filters --------------------------------------------------------------------------------

SINGLE_FILTERS = {
    "fil_04_by_category": (lambda df: filters.by_category(df, "brand_7"), "category = 'brand_7'"),
    "fil_05_by_product": (lambda df: filters.by_product(df, "small ring #0"), "product = 'small ring #0'"),
    "fil_06_by_propensity": (lambda df: filters.by_propensity(df, (0.25, 0.5)), "propensity_score BETWEEN 0.25 AND 0.5"),
    "fil_07_by_region": (lambda df: filters.by_region(df, "EUROPE"), "region = 'EUROPE'"),
    "fil_08_by_price": (lambda df: filters.by_price(df, (905.0, 910.0)), "price_inr BETWEEN 905 AND 910"),
    "fil_09_by_gender": (lambda df: filters.by_gender(df, "FURNITURE"), "gender = 'FURNITURE'"),
    "fil_10_by_spending_level": (lambda df: filters.by_spending_level(df, "Medium Spender"), "spending_category = 'Medium Spender'"),
}
for _name, (_filter, _where) in SINGLE_FILTERS.items():
    @query(_name, f"SELECT * FROM t_scored WHERE {_where}", "t_scored")
    def _(spark, sf, keep=_filter):
        return keep(t.scored(spark, sf))


@query("fil_11_by_max_recency", "SELECT * FROM t_predictions JOIN t_rfm USING (customer_id) WHERE Recency <= 60", "t_predictions t_rfm")
def _(spark, sf):
    return filters.by_max_recency(t.joins.with_rfm(t.predictions(spark, sf), t.rfm(spark, sf)), 60)


@query("fil_12_by_min_frequency", "SELECT * FROM t_predictions JOIN t_rfm USING (customer_id) WHERE Frequency >= 14", "t_predictions t_rfm")
def _(spark, sf):
    return filters.by_min_frequency(t.joins.with_rfm(t.predictions(spark, sf), t.rfm(spark, sf)), 14)


@query("fil_18_insights_filter", f"SELECT * FROM t_base WHERE {FILTER_SQL} ORDER BY propensity_score DESC, customer_id, product LIMIT 100", "t_base")
def _(spark, sf):
    return filters.insights_filter(t.base(spark, sf), **FILTERS)


@query("fil_18_insights_filter_defaults", "SELECT * FROM t_base WHERE propensity_score BETWEEN 0 AND 1 AND price_inr IS NOT NULL AND Frequency >= 0 ORDER BY propensity_score DESC, customer_id, product LIMIT 100", "t_base")
def _(spark, sf):
    return filters.insights_filter(t.base(spark, sf))


@query("fil_18_insights_filter_recent", "SELECT * FROM t_base WHERE propensity_score BETWEEN 0 AND 1 AND price_inr IS NOT NULL AND Recency <= 365 AND Frequency >= 0 ORDER BY propensity_score DESC, customer_id, product LIMIT 100", "t_base")
def _(spark, sf):
    return filters.insights_filter(t.base(spark, sf), max_recency=365)


@query("fil_20_priority_tier", f"SELECT customer_id, product, {TIER} AS tier FROM t_base", "t_base")
def _(spark, sf):
    return scoring.priority_tier(t.base(spark, sf)).select("customer_id", "product", "tier")


@query("fil_21_positive_only", "SELECT customer_id, brand_3_spend FROM t_features WHERE brand_3_spend > 0", "t_features")
def _(spark, sf):
    return filters.positive_only(t.features(spark, sf).select("customer_id", "brand_3_spend"), "brand_3_spend")


@query("ded_03_product_options", "SELECT DISTINCT product FROM t_predictions WHERE category = 'brand_7'", "t_predictions")
def _(spark, sf):
    return filters.product_options(t.predictions(spark, sf), PRODUCT_CATEGORY)


@query("agg_41_insights_bounds", "SELECT min(price_inr) AS min_price_inr, max(price_inr) AS max_price_inr, min(Recency) AS min_Recency, max(Recency) AS max_Recency, min(Frequency) AS min_Frequency, max(Frequency) AS max_Frequency FROM t_predictions JOIN t_rfm USING (customer_id)", "t_predictions t_rfm")
def _(spark, sf):
    joined = t.joins.with_rfm(t.predictions(spark, sf), t.rfm(spark, sf))
    return filters.bounds(joined, ["price_inr", "Recency", "Frequency"])


@query("srt_01_top_n_by_propensity", "SELECT * FROM t_predictions ORDER BY propensity_score DESC, customer_id, product LIMIT 1000", "t_predictions")
def _(spark, sf):
    return filters.top_n_by_propensity(t.predictions(spark, sf), 1000)


# -- display tables -------------------------------------------------------------------------

TRACKING = f"""SELECT customer_id AS "Customer ID", name AS "Name", product AS "Product", category AS "Category",
  {percent('propensity_score', 2)} AS "Propensity", format('{{:,.3f}}', embedding_similarity) AS "Similarity",
  {money('total_spent')} AS "Total Spent", total_transactions AS "Transactions", Recency AS "Days Since Visit",
  Frequency AS "Purchase Freq", {money('Monetary')} AS "RFM Value", gender AS "Gender", region AS "Region",
  city AS "City", {percent('engagement_score', 2)} AS "Engagement" FROM t_base"""


@query("prj_01_tracking_columns", "SELECT customer_id, name, product, category, propensity_score, embedding_similarity, total_spent, total_transactions, Recency, Frequency, Monetary, gender, region, city, engagement_score FROM t_base", "t_base")
def _(spark, sf):
    return i.tracking_columns(t.base(spark, sf))


@query("prj_02_tracking_table", TRACKING, "t_base")
def _(spark, sf):
    return i.tracking_table(t.base(spark, sf))


@query("prj_03_top_customer_columns", f"SELECT customer_id, name, propensity_score, engagement_score, total_spent, Recency, Frequency, city, {PRIORITY} AS priority_score FROM t_base", "t_base")
def _(spark, sf):
    return i.top_customer_columns(scoring.priority_score(t.base(spark, sf)))


@query("prj_07_format_percent", f"SELECT customer_id, product, {percent('propensity_score', 1)} AS one, {percent('propensity_score', 2)} AS two FROM t_predictions", "t_predictions")
def _(spark, sf):
    return t.predictions(spark, sf).select("customer_id", "product", i.format_percent("propensity_score", 1).alias("one"), i.format_percent("propensity_score", 2).alias("two"))


@query("prj_08_format_money", f"SELECT transaction_id, {money('total_spent')} AS spent FROM t_orders", "t_orders")
def _(spark, sf):
    return t.orders(spark, sf).select("transaction_id", i.format_money("total_spent").alias("spent"))


@query("prj_09_format_similarity", "SELECT customer_id, product, format('{:,.3f}', embedding_similarity) AS similarity FROM t_predictions", "t_predictions")
def _(spark, sf):
    return t.predictions(spark, sf).select("customer_id", "product", i.format_similarity("embedding_similarity").alias("similarity"))


@query("prj_11_rfm_propensity_points", "SELECT customer_id, name, Recency, Monetary, Frequency, propensity_score FROM t_base", "t_base")
def _(spark, sf):
    return i.rfm_propensity_points(t.base(spark, sf))


@query("prj_12_frequency_propensity_points", "SELECT customer_id, Frequency, propensity_score, spending_category FROM t_base", "t_base")
def _(spark, sf):
    return i.frequency_propensity_points(t.base(spark, sf))


TOP = f"SELECT *, {PRIORITY} AS priority_score FROM t_base ORDER BY priority_score DESC, customer_id, product LIMIT 20"


@query("srt_02_top_priority", TOP, "t_base")
def _(spark, sf):
    return i.top_priority(t.base(spark, sf))


TOP_TABLE = f"""SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, customer_id, product) AS INTEGER) AS "Rank",
  customer_id AS "Customer ID", name AS "Name", {percent('propensity_score', 1)} AS "Propensity", {percent('engagement_score', 1)} AS "Engagement",
  {money('total_spent')} AS "Total Spent", Recency AS "Days Since Visit", Frequency AS "Purchases", city AS "City",
  {percent('priority_score', 1)} AS "Priority Score" FROM ({TOP})"""


@query("sco_03_top_customers_table", TOP_TABLE, "t_base")
def _(spark, sf):
    return i.top_customers_table(t.base(spark, sf))


def read_text(spark, path: str):
    return spark.read.options(**files.CSV_OPTIONS).csv(path)


@query("snk_01_export_tracking", f"SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({TRACKING})", "t_base")
def _(spark, sf):
    return read_text(spark, files.export_tracking(i.tracking_table(t.base(spark, sf)), new_folder(spark, "tracking"), "20010802_000000"))


@query("snk_02_export_top_customers", f"SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({TOP_TABLE})", "t_base")
def _(spark, sf):
    table = i.top_customers_table(t.base(spark, sf))
    return read_text(spark, files.export_top_customers(table, new_folder(spark, "top"), "20010802_000000"))


# -- summaries ------------------------------------------------------------------------------

@query("agg_30_insights_overview", f"""SELECT {score_avg('propensity_score')} AS avg_propensity, {count("CASE WHEN propensity_score > 0.7 THEN 1 END")} AS high_propensity,
  {money_avg('Monetary')} AS avg_value, {money_avg('Recency')} AS avg_recency, {money_avg('Frequency')} AS avg_frequency,
  {money_sum('total_spent')} AS revenue_potential FROM t_base""", "t_base")
def _(spark, sf):
    return i.insights_overview(t.base(spark, sf))


@query("agg_31_filter_summary", f"""SELECT o AS original_rows, f AS filtered_rows, o - f AS removed_rows, f * 100 / CAST(o AS DOUBLE) AS retained_pct, d AS distinct_customers
  FROM (SELECT {count()} AS o, {count("CASE WHEN " + FILTER_SQL + " THEN 1 END")} AS f, {count("DISTINCT CASE WHEN " + FILTER_SQL + " THEN customer_id END")} AS d FROM t_base)""", "t_base")
def _(spark, sf):
    base = t.base(spark, sf)
    return i.filter_summary(base, filters.insights_filter(base, **FILTERS, top_n=None))


@query("agg_32_gender_segments", f"SELECT gender, {count('customer_id')} AS n_rows, {count('DISTINCT customer_id')} AS distinct_customers, {score_avg('propensity_score')} AS avg_propensity, {money_sum('total_spent')} AS total_spent FROM t_base GROUP BY 1", "t_base")
def _(spark, sf):
    return i.gender_segments(t.base(spark, sf))


@query("agg_33_region_segments", f"SELECT region, {count('customer_id')} AS n_rows, {score_avg('propensity_score')} AS avg_propensity FROM t_base GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "t_base")
def _(spark, sf):
    return i.region_segments(t.base(spark, sf))


PROFILE = " UNION ALL ".join(f"SELECT '{label(s, '_spend')}' AS category, {money_avg(s)} AS avg_spend FROM t_base" for s in SPEND)
SHARES = [f"SELECT '{label(p, '_pct')}' AS category, {score_avg(p)} AS avg_pct FROM t_base" for p in PCT]


@query("agg_34_category_spend_profile", f"SELECT * FROM ({PROFILE}) ORDER BY avg_spend DESC, category LIMIT 10", "t_base")
def _(spark, sf):
    return i.category_spend_profile(t.base(spark, sf))


@query("agg_35_category_pct_profile", f"SELECT * FROM ({' UNION ALL '.join(SHARES)}) WHERE avg_pct > 0 ORDER BY avg_pct DESC, category LIMIT 10", "t_base")
def _(spark, sf):
    return i.category_pct_profile(t.base(spark, sf))


@query("agg_35_first_share_columns", f"SELECT * FROM ({' UNION ALL '.join(SHARES[:10])}) WHERE avg_pct > 0", "t_base")
def _(spark, sf):
    return i.category_pct_profile(t.base(spark, sf), first=10)


def items(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 0 ELSE length({column}) - length(replace({column}, ',', '')) + 1 END"


@query("agg_36_cart_averages", f"""SELECT 'Same Category' AS cart_type, {money_avg(items('in_cart_same_category'))} AS avg_items FROM t_base
  UNION ALL SELECT 'Other Category', {money_avg(items('in_cart_other_category'))} FROM t_base""", "t_base")
def _(spark, sf):
    return i.cart_averages(t.base(spark, sf))


THEIRS = "customer_id IN (SELECT customer_id FROM t_predictions WHERE category = 'brand_7' AND propensity_score > 0.9)"


def buyers(spark, sf):
    return t.predictions(spark, sf).filter("category = 'brand_7' AND propensity_score > 0.9")


@query("agg_37_monthly_orders_of", f"SELECT strftime(order_date, '%Y-%m') AS month, {count()} AS orders FROM t_orders WHERE {THEIRS} GROUP BY 1", "t_orders t_predictions")
def _(spark, sf):
    return i.monthly_orders_of(t.orders(spark, sf), buyers(spark, sf))


@query("agg_38_quarter_orders_of", f"SELECT order_quarter, {count()} AS orders FROM t_orders WHERE {THEIRS} GROUP BY 1", "t_orders t_predictions")
def _(spark, sf):
    return i.quarter_orders_of(t.orders(spark, sf), buyers(spark, sf))


SUMMARY = f"""SELECT tier, CAST(coalesce(n, 0) AS BIGINT) AS n_rows, CAST(coalesce(d, 0) AS BIGINT) AS distinct_customers, coalesce(s, 0) AS revenue_potential, a AS avg_spent
  FROM (VALUES ('high'), ('medium'), ('at_risk')) v(tier) LEFT JOIN (SELECT {TIER} AS tier, count(*) AS n, count(DISTINCT customer_id) AS d,
  {money_sum('total_spent')} AS s, {money_avg('total_spent')} AS a FROM t_base GROUP BY 1) USING (tier)"""


@query("agg_39_tier_summary", SUMMARY, "t_base")
def _(spark, sf):
    return i.tier_summary(t.base(spark, sf))


@query("cmp_09_tier_playbook", f"""SELECT s.*, action, channel, offer FROM ({SUMMARY}) s JOIN (VALUES
  ('high', 'Launch immediate campaign', 'Email + WhatsApp', 'Exclusive product access'), ('medium', 'Nurture campaign', 'Email series', 'Limited-time discount'),
  ('at_risk', 'Win-back campaign', 'Special offers', '20% off + free shipping')) p(tier, action, channel, offer) USING (tier)""", "t_base")
def _(spark, sf):
    return i.tier_playbook(t.base(spark, sf))


@query("agg_40_product_segment_counts", f"""SELECT {count("CASE WHEN spending_category = 'High Spender' THEN 1 END")} AS high_spenders,
  {count("CASE WHEN Frequency > (SELECT median(Frequency) FROM t_base) THEN 1 END")} AS active_buyers,
  {count("CASE WHEN Recency < 30 THEN 1 END")} AS recent_visitors FROM t_base""", "t_base")
def _(spark, sf):
    return i.product_segment_counts(t.base(spark, sf))


@query("agg_42_propensity_histogram", histogram_sql("t_predictions", "propensity_score", 30), "t_predictions")
def _(spark, sf):
    return i.propensity_histogram(t.predictions(spark, sf))


@query("agg_43_engagement_histogram", histogram_sql("t_scored", "engagement_score", 25), "t_scored")
def _(spark, sf):
    return i.engagement_histogram(t.scored(spark, sf))


@query("agg_44_spend_box_by_propensity", f"""SELECT propensity_category, min(total_spent) AS min_spent,
  min(total_spent) FILTER (total_spent BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE) AS whisker_low,
  round(max(q1), 6) AS q1, round(max(q2), 6) AS median, round(max(q3), 6) AS q3,
  max(total_spent) FILTER (total_spent BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE) AS whisker_high,
  max(total_spent) AS max_spent,
  {count("CASE WHEN NOT total_spent BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE THEN 1 END")} AS outliers
  FROM t_scored JOIN (SELECT propensity_category, quantile_cont(total_spent, 0.25) AS q1, quantile_cont(total_spent, 0.5) AS q2,
  quantile_cont(total_spent, 0.75) AS q3 FROM t_scored GROUP BY 1) USING (propensity_category) GROUP BY 1""", "t_scored")
def _(spark, sf):
    box = i.spend_box_by_propensity(t.scored(spark, sf))
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})
