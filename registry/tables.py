"""The input tables as DataFrames and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.core import TABLE_SQL, money_sum
from tillview.operators import joins, scoring
from tillview.session import dropped
from tillview.sources import star
from tillview.sources.star import ANCHOR, CATEGORIES

SPEND = [f"{c}_spend" for c in CATEGORIES]
PCT = [f"{c}_pct" for c in CATEGORIES]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return star.orders_with_place(spark, sf)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return star.purchases(spark, sf)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return star.catalog(spark, sf)


def rfm(spark: SparkSession, sf: str) -> DataFrame:
    return star.rfm(star.plain_orders(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return star.category_features(star.bought_products(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return star.predictions(spark, sf)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.preprocess_predictions(predictions(spark, sf))


def base(spark: SparkSession, sf: str) -> DataFrame:
    bought, wide = star.shared_inputs(spark, sf)
    # Scored predictions are stored; no later table reads the purchases.
    scored = scoring.preprocess_predictions(star.predictions(spark, sf, bought=bought, features=wide))
    dropped(bought)
    return joins.insights_base(scored, star.transactions(spark, sf, features=wide), rfm(spark, sf), wide)


def recs(spark: SparkSession, sf: str) -> DataFrame:
    return star.customer_recs(spark, sf)


def recs_base(spark: SparkSession, sf: str) -> DataFrame:
    held = star.shared_holdings(spark, sf)
    return joins.recs_base(star.customer_recs(spark, sf, held=held), rfm(spark, sf), held.drop("held"))


def event_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Events as orders: the one table with times of day."""
    return star.star(spark, sf, "events").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"),
        F.col("value").alias("total_spent"), F.col("ts").alias("order_date"),
    )


TABLE_SQL["t_orders"] = """
SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, c_name AS name,
  c_mktsegment AS gender, r_name AS region, n_name AS state, n_name AS city_name,
  o_orderpriority AS mode_of_payment, o_totalprice AS total_spent, o_orderdate AS order_date,
  CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""

TABLE_SQL["t_lines"] = """
SELECT o_custkey AS customer_id, o_orderkey AS transaction_id,
  p_name || ' #' || p_partkey AS product, replace(lower(p_brand), '#', '_') AS category,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
    AS DECIMAL(18,4)) AS amount,
  p_retailprice AS price_inr, l_linestatus AS line_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

TABLE_SQL["t_catalog"] = """
SELECT replace(lower(p_brand), '#', '_') AS category, p_name || ' #' || p_partkey AS product,
  p_retailprice AS price_inr FROM part"""

TABLE_SQL["t_rfm"] = f"""
SELECT customer_id,
  CAST(date_diff('day', CAST(max(order_date) AS DATE), DATE '{ANCHOR}') AS INTEGER) AS Recency,
  CAST(count(*) AS BIGINT) AS Frequency, {money_sum('total_spent')} AS Monetary
FROM {{t_orders}} GROUP BY customer_id"""

TABLE_SQL["t_spend"] = """
SELECT customer_id, category, CAST(sum(amount) AS DOUBLE) AS spend
FROM {t_lines} GROUP BY customer_id, category"""

TABLE_SQL["t_features"] = (
    "SELECT customer_id, "
    + ", ".join(f"coalesce(max(spend) FILTER (category = '{c}'), 0) AS {c}_spend" for c in CATEGORIES)
    + ", "
    + ", ".join(
        f"coalesce(max(spend) FILTER (category = '{c}'), 0) / max(total) AS {c}_pct"
        for c in CATEGORIES
    )
    + """ FROM {t_spend} JOIN (SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS total
FROM {t_lines} GROUP BY customer_id) USING (customer_id) GROUP BY customer_id"""
)

TABLE_SQL["t_top"] = """
SELECT customer_id, category AS top_category FROM (SELECT *, row_number() OVER (
  PARTITION BY customer_id ORDER BY spend DESC, category) AS rn FROM {t_spend}) WHERE rn = 1"""

TABLE_SQL["t_carts"] = """
SELECT customer_id,
  string_agg(product, ', ' ORDER BY product) FILTER (category = top_category)
    AS in_cart_same_category,
  string_agg(product, ', ' ORDER BY product) FILTER (category <> top_category)
    AS in_cart_other_category
FROM (SELECT DISTINCT customer_id, product, category FROM {t_lines} WHERE line_status = 'O'
  AND transaction_id IN (SELECT transaction_id FROM (SELECT transaction_id, row_number() OVER (
    PARTITION BY customer_id ORDER BY order_date DESC, transaction_id DESC) AS rn FROM {t_orders})
    WHERE rn = 1))
JOIN {t_top} USING (customer_id) GROUP BY customer_id"""

TABLE_SQL["t_transactions"] = """
SELECT o.*, r.Recency AS days_since_last_visit, in_cart_same_category, in_cart_other_category
FROM {t_orders} o JOIN {t_rfm} r USING (customer_id) LEFT JOIN {t_carts} c USING (customer_id)"""

TABLE_SQL["t_norm"] = (
    "SELECT customer_id, sqrt(" + " + ".join(f"{s} * {s}" for s in SPEND) + ") AS norm FROM {t_features}"
)

TABLE_SQL["t_pairs"] = """
SELECT customer_id, product, category, price_inr, CAST(sum(amount) AS DOUBLE) AS amount
FROM {t_lines} GROUP BY customer_id, product, category, price_inr"""

TABLE_SQL["t_predictions"] = """
SELECT p.customer_id, p.product, p.category, p.amount / m.largest AS propensity_score,
  s.spend / n.norm AS embedding_similarity, r.Monetary AS total_spent,
  r.Frequency AS total_transactions, r_name AS region, n_name AS city, c_mktsegment AS gender,
  p.price_inr
FROM {t_pairs} p
JOIN (SELECT customer_id, max(amount) AS largest FROM {t_pairs} GROUP BY customer_id) m
  USING (customer_id)
JOIN {t_spend} s ON s.customer_id = p.customer_id AND s.category = p.category
JOIN {t_norm} n ON n.customer_id = p.customer_id
JOIN {t_rfm} r ON r.customer_id = p.customer_id
JOIN customer ON c_custkey = p.customer_id JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""

TABLE_SQL["t_scored"] = """
SELECT p.*,
  CASE WHEN propensity_score <= 0 THEN NULL WHEN propensity_score <= 0.3 THEN 'Low'
    WHEN propensity_score <= 0.6 THEN 'Medium' WHEN propensity_score <= 1.0 THEN 'High' END
    AS propensity_category,
  CASE WHEN total_spent IS NULL THEN NULL WHEN total_spent <= e1 THEN 'Low Spender'
    WHEN total_spent <= e2 THEN 'Medium Spender' ELSE 'High Spender' END AS spending_category,
  propensity_score * 0.4::DOUBLE + embedding_similarity * 0.3::DOUBLE
    + total_transactions / most * 0.3::DOUBLE AS engagement_score
FROM {t_predictions} p, (SELECT quantile_cont(total_spent, 1.0/3) AS e1,
  quantile_cont(total_spent, 2.0/3) AS e2, max(total_transactions) AS most
  FROM {t_predictions})"""

TABLE_SQL["t_latest"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY order_date DESC, transaction_id DESC) AS rn FROM {t_transactions}) WHERE rn = 1"""

TABLE_SQL["t_base"] = """
SELECT p.*, l.name, l.order_date, l.order_quarter, l.days_since_last_visit, l.state,
  l.in_cart_same_category, l.in_cart_other_category, r.* EXCLUDE (customer_id),
  f.* EXCLUDE (customer_id)
FROM {t_scored} p LEFT JOIN {t_latest} l ON l.customer_id = p.customer_id
LEFT JOIN {t_rfm} r ON r.customer_id = p.customer_id
LEFT JOIN {t_features} f ON f.customer_id = p.customer_id"""

DOT = " + ".join(f"(a.{s} / na.norm) * (b.{s} / nb.norm)" for s in SPEND)
TABLE_SQL["t_exact_matches"] = f"""
SELECT customer_id, Matched_Customer_ID, Similarity_Score FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY Similarity_Score DESC NULLS LAST, Matched_Customer_ID) AS rn
  FROM (SELECT ta.customer_id, tb.customer_id AS Matched_Customer_ID, round({DOT}, 9) AS Similarity_Score
    FROM {{t_top}} ta LEFT JOIN {{t_top}} tb ON ta.top_category = tb.top_category
      AND ta.customer_id <> tb.customer_id
    LEFT JOIN {{t_features}} a ON a.customer_id = ta.customer_id
    LEFT JOIN {{t_features}} b ON b.customer_id = tb.customer_id
    LEFT JOIN {{t_norm}} na ON na.customer_id = ta.customer_id
    LEFT JOIN {{t_norm}} nb ON nb.customer_id = tb.customer_id)) WHERE rn = 1"""

TABLE_SQL["t_matches"] = TABLE_SQL["t_exact_matches"]

TABLE_SQL["t_recommended"] = """
SELECT m.customer_id, b.product, b.category = t.top_category AS same
FROM {t_matches} m JOIN {t_top} t USING (customer_id)
JOIN {t_pairs} b ON b.customer_id = m.Matched_Customer_ID
WHERE NOT EXISTS (SELECT 1 FROM {t_pairs} own WHERE own.customer_id = m.customer_id
  AND own.product = b.product)"""

TABLE_SQL["t_recs"] = """
SELECT r.customer_id, c_name AS name, c_mktsegment AS gender, n_name AS state,
  n_name AS city_name, r.Monetary AS total_spent, r.Recency AS days_since_last_visit,
  h.purchased_products_names, c.in_cart_same_category, c.in_cart_other_category,
  m.Matched_Customer_ID, m.Similarity_Score, o.Predicted_Products_from_Same_Category,
  o.Predicted_Products_from_Other_Categories
FROM {t_rfm} r JOIN customer ON c_custkey = r.customer_id
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT customer_id, string_agg(product, ', ' ORDER BY product)
  AS purchased_products_names FROM {t_pairs} GROUP BY customer_id) h USING (customer_id)
LEFT JOIN {t_carts} c USING (customer_id) LEFT JOIN {t_matches} m USING (customer_id)
LEFT JOIN (SELECT customer_id,
    string_agg(product, ', ' ORDER BY product) FILTER (same)
      AS Predicted_Products_from_Same_Category,
    string_agg(product, ', ' ORDER BY product) FILTER (NOT same)
      AS Predicted_Products_from_Other_Categories
  FROM {t_recommended} GROUP BY customer_id) o USING (customer_id)"""

TABLE_SQL["t_recs_base"] = """
SELECT x.*, r.Recency, r.Frequency, r.Monetary, f.* EXCLUDE (customer_id)
FROM {t_recs} x LEFT JOIN {t_rfm} r USING (customer_id)
LEFT JOIN {t_features} f USING (customer_id)"""

TABLE_SQL["t_events"] = """
SELECT event_id AS transaction_id, user_id AS customer_id, value AS total_spent,
  ts AS order_date FROM events"""
