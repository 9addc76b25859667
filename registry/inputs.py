"""Preparation of the input tables, reading and writing them, and the base joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import tables as t
from registry.core import count, query
from tillview.functions.dates import with_order_timestamp
from tillview.operators import joins, scoring
from tillview.plans import insights
from tillview.schemas import input_report, is_empty
from tillview.session import TableCache, new_folder, written_once
from tillview.sources import files, layout, star

PURCHASES = """SELECT customer_id, product, category, CAST(amount AS DOUBLE) AS amount, price_inr
  FROM t_lines"""


@query("pre_01_transactions", "SELECT * FROM t_transactions", "t_transactions")
def _(spark, sf):
    return star.transactions(spark, sf)


@query("pre_02_purchases", PURCHASES, "t_lines")
def _(spark, sf):
    return t.lines(spark, sf).withColumn("amount", F.col("amount").cast("double"))


@query("pre_03_catalog", "SELECT * FROM t_catalog", "t_catalog")
def _(spark, sf):
    return t.catalog(spark, sf)


@query("pre_04_rfm", "SELECT * FROM t_rfm", "t_rfm")
def _(spark, sf):
    return t.rfm(spark, sf)


@query("pre_05_category_features", "SELECT * FROM t_features", "t_features")
def _(spark, sf):
    return t.features(spark, sf)


@query("pre_06_predictions", "SELECT * FROM t_predictions", "t_predictions")
def _(spark, sf):
    return t.predictions(spark, sf)


@query("pre_07_customer_matches", "SELECT * FROM t_matches", "t_matches")
def _(spark, sf):
    return star.customer_matches(t.features(spark, sf))


@query("pre_07_exact_matches", "SELECT * FROM t_exact_matches", "t_exact_matches")
def exact_matches(spark, sf):
    return star.customer_matches(t.features(spark, sf), exact=True)


@query("pre_07_customer_recs", "SELECT * FROM t_recs", "t_recs")
def _(spark, sf):
    return t.recs(spark, sf)


@query("pre_07_recommended_items", "SELECT * FROM t_recommended", "t_recommended")
def _(spark, sf):
    bought, features = star.shared_inputs(spark, sf)
    return star.recommended_items(written_once(star.customer_matches(features), "matches"), bought, features)


# -- reading: each table is written as CSV to the shared folder and read by its reader ------

def _as_csv(spark: SparkSession, df: DataFrame, label: str) -> str:
    return files.write_csv(df, new_folder(spark, label))


@query("src_01_read_transactions", "SELECT * FROM t_transactions", "t_transactions")
def _(spark, sf):
    return files.read_transactions(spark, _as_csv(spark, star.transactions(spark, sf), "transactions"))


@query("src_02_read_purchases", "SELECT customer_id, product FROM t_lines", "t_lines")
def _(spark, sf):
    purchases = t.lines(spark, sf).select("customer_id", "product")
    return files.read_purchases(spark, _as_csv(spark, purchases, "purchases"))


@query("src_03_read_category_features", "SELECT * FROM t_features", "t_features")
def _(spark, sf):
    return files.read_category_features(spark, _as_csv(spark, t.features(spark, sf), "features"))


@query("src_04_read_rfm", "SELECT * FROM t_rfm", "t_rfm")
def _(spark, sf):
    return files.read_rfm(spark, _as_csv(spark, t.rfm(spark, sf), "rfm"))


@query("src_05_read_catalog", "SELECT * FROM t_catalog", "t_catalog")
def _(spark, sf):
    return files.read_catalog(spark, _as_csv(spark, t.catalog(spark, sf), "catalog"))


@query("src_06_read_predictions", "SELECT * FROM t_predictions", "t_predictions")
def _(spark, sf):
    return files.read_predictions(spark, _as_csv(spark, t.predictions(spark, sf), "predictions"))


@query("src_07_read_customer_recs", "SELECT * FROM t_recs", "t_recs")
def _(spark, sf):
    return files.read_customer_recs(spark, _as_csv(spark, t.recs(spark, sf), "recs"))


@query("src_08_order_timestamp", "SELECT transaction_id, order_date FROM t_events", "t_events")
def _(spark, sf):
    text = t.event_orders(spark, sf).select(
        "transaction_id", F.date_format("order_date", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("order_date")
    )
    return with_order_timestamp(text, "yyyy/MM/dd HH:mm:ss.SSSSSS")


def damaged_rfm(spark: SparkSession, sf: str) -> str:
    """The RFM table as CSV in which some values are missing words, some no numbers, some whole with a point."""
    customer, text = F.col("customer_id"), {c: F.col(c).cast("string") for c in ("Recency", "Frequency")}
    rows = t.rfm(spark, sf).select(
        F.when(customer % 50 == 3, "").otherwise(customer.cast("string")).alias("customer_id"),
        F.when(customer % 10 == 1, "NA").when(customer % 10 == 2, "soon").otherwise(text["Recency"]).alias("Recency"),
        F.when(customer % 15 == 2, "many").otherwise(F.concat(text["Frequency"], F.lit(".0"))).alias("Frequency"),
        F.when(customer % 10 == 4, "nan").otherwise(F.col("Monetary").cast("string")).alias("Monetary"),
    )
    return _as_csv(spark, rows, "damaged")


@query("src_04_read_rfm_with_rejects", """SELECT customer_id, CASE WHEN customer_id % 10 = 1 THEN NULL ELSE Recency END AS Recency,
  Frequency, CASE WHEN customer_id % 10 = 4 THEN NULL ELSE Monetary END AS Monetary FROM t_rfm
  WHERE customer_id % 50 <> 3 AND customer_id % 10 <> 2 AND customer_id % 15 <> 2""", "t_rfm")
def _(spark, sf):
    return files.read_with_rejects(spark, "rfm", damaged_rfm(spark, sf)).rows


@query("src_04_rejects_by_reason", """SELECT concat_ws('; ', CASE WHEN customer_id % 10 = 2 THEN 'Recency is no int' END,
  CASE WHEN customer_id % 15 = 2 THEN 'Frequency is no bigint' END, CASE WHEN customer_id % 50 = 3 THEN 'customer_id is missing' END)
  AS reason, CAST(count(*) AS BIGINT) AS n_rows FROM t_rfm
  WHERE customer_id % 50 = 3 OR customer_id % 10 = 2 OR customer_id % 15 = 2 GROUP BY 1""", "t_rfm")
def _(spark, sf):
    counts = files.read_with_rejects(spark, "rfm", damaged_rfm(spark, sf)).reject_counts()
    return counts.groupBy("reason").agg(F.sum("n_rows").alias("n_rows"))


REPORTED = {
    "transactions": "t_transactions", "purchases": "t_lines", "catalog": "t_catalog", "rfm": "t_rfm", "category_features": "t_features",
}


@query("src_09_input_report", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", CAST(count(*) AS BIGINT) AS n_rows, count(*) = 0 AS is_empty, "
    f"'{'price_inr' if name == 'catalog' else ''}' AS missing FROM {view}" for name, view in REPORTED.items()
), " ".join(REPORTED.values()))
def _(spark, sf):
    tables = {
        "transactions": star.transactions(spark, sf), "purchases": t.lines(spark, sf), "rfm": t.rfm(spark, sf),
        "category_features": t.features(spark, sf), "catalog": t.catalog(spark, sf).drop("price_inr"),
    }
    return input_report(tables)


@query("src_11_is_empty", """SELECT gender, count(*) FILTER (order_date > TIMESTAMP '2000-01-01') = 0 AS is_empty FROM t_orders
  WHERE gender IS NOT NULL GROUP BY 1""", "t_orders")
def _(spark, sf):
    orders = t.orders(spark, sf)
    # One check per filter choice, of which there are few, as the page makes them.
    genders = [r[0] for r in orders.select("gender").where("gender IS NOT NULL").distinct().orderBy("gender").collect()]
    late = orders.where("order_date > TIMESTAMP_NTZ '2000-01-01'")
    return spark.createDataFrame([(g, is_empty(late.where(F.col("gender") == g))) for g in genders], "gender string, is_empty boolean")


@query("cac_01_loaded_once", "SELECT *, CAST(2 AS INTEGER) AS loads FROM t_rfm", "t_rfm")
def _(spark, sf):
    cache, path = TableCache(), _as_csv(spark, t.rfm(spark, sf), "rfm")
    first, second = (cache.load(files.read_rfm, spark, path) for _ in range(2))
    return second.withColumn("loads", F.lit(2 if first is second else 0))


@query("src_10_optional_columns", """SELECT avg_value, avg_recency, avg_frequency FROM (
  SELECT CAST(sum(CAST(total_spent AS DECIMAL(18,4))) AS DOUBLE) / count(total_spent) AS avg_value,
  CAST(NULL AS DOUBLE) AS avg_recency, CAST(sum(total_transactions) AS DOUBLE)
  / count(total_transactions) AS avg_frequency FROM t_scored)""", "t_scored")
def _(spark, sf):
    overview = insights.insights_overview(t.scored(spark, sf))
    return overview.select("avg_value", "avg_recency", "avg_frequency")


# -- base joins -----------------------------------------------------------------------------

@query("joi_01_predictions_with_latest_order", """SELECT p.*, l.name, l.order_date,
  l.order_quarter, l.days_since_last_visit, l.state, l.in_cart_same_category,
  l.in_cart_other_category FROM t_predictions p LEFT JOIN t_latest l USING (customer_id)""",
  "t_predictions t_latest")
def _(spark, sf):
    return joins.with_latest_order(t.predictions(spark, sf), star.transactions(spark, sf))


@query("joi_02_predictions_with_rfm",
       "SELECT * FROM t_predictions LEFT JOIN t_rfm USING (customer_id)", "t_predictions t_rfm")
def _(spark, sf):
    return joins.with_rfm(t.predictions(spark, sf), t.rfm(spark, sf))


@query("joi_03_predictions_with_category_features",
       "SELECT * FROM t_predictions LEFT JOIN t_features USING (customer_id)",
       "t_predictions t_features")
def _(spark, sf):
    return joins.with_category_features(t.predictions(spark, sf), t.features(spark, sf))


@query("joi_04_insights_base", "SELECT * FROM t_base", "t_base")
def _(spark, sf):
    return t.base(spark, sf)


@query("joi_04_bucketed_base", "SELECT * FROM t_base", "t_base")
def _(spark, sf):
    folder = new_folder(spark, "buckets")
    bought = star.shared_purchases(spark, sf)
    # The features are stored first, as predictions and carts read them, too.
    stored = layout.customer_tables({"features": star.category_features(bought)}, folder, buckets=8)
    wide = stored["features"]
    tables = {
        "predictions": star.predictions(spark, sf, bought=bought, features=wide),
        "orders": star.transactions(spark, sf, features=wide), "rfm": t.rfm(spark, sf),
    }
    stored |= layout.customer_tables(tables, folder, buckets=8)
    return layout.bucketed_insights_base(**stored | {"predictions": scoring.scored_predictions(stored["predictions"])})


@query("joi_05_recs_base", "SELECT * FROM t_recs_base", "t_recs_base")
def _(spark, sf):
    return t.recs_base(spark, sf)


HIGH = "propensity_score > 0.99 AND category = 'brand_7'"


@query("joi_06_orders_of", f"""SELECT * FROM t_orders WHERE customer_id IN
  (SELECT customer_id FROM t_predictions WHERE {HIGH})""", "t_orders t_predictions")
def _(spark, sf):
    return joins.orders_of(t.orders(spark, sf), t.predictions(spark, sf).filter(HIGH))


@query("joi_07_similar_customer", """SELECT a.customer_id, a.Matched_Customer_ID,
  b.name AS matched_name, b.purchased_products_names AS matched_products_names
  FROM t_recs a LEFT JOIN t_recs b ON b.customer_id = a.Matched_Customer_ID""", "t_recs")
def _(spark, sf):
    # Only what the result shows is written and sent to the matched customers.
    recs = t.recs(spark, sf).select("customer_id", "name", "purchased_products_names", "Matched_Customer_ID")
    return joins.similar_customer(recs).select(
        "customer_id", "Matched_Customer_ID", "matched_name", "matched_products_names"
    )


@query("ded_01_one_row_per_customer", "SELECT * FROM t_latest", "t_latest")
def _(spark, sf):
    return joins.one_row_per_customer(star.transactions(spark, sf))


@query("ded_05_customer_ids", f"SELECT DISTINCT customer_id FROM t_predictions WHERE {HIGH}",
       "t_predictions")
def _(spark, sf):
    return joins.customer_ids(t.predictions(spark, sf).filter(HIGH))


@query("agg_45_loaded_profiles", f"SELECT {count()} AS profiles FROM t_base", "t_base")
def _(spark, sf):
    return insights.loaded_profiles(t.base(spark, sf))
