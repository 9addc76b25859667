"""RFM scores and segments, engagement and priority scores, priority tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.operators.binning import f_score, propensity_category, qcut, quantile_edges
from tillview.schemas import has
from tillview.session import written_once

# Labels, score limits and weights that results depend on.
R_LABELS = (4, 3, 2, 1)
M_LABELS = (1, 2, 3, 4)
SPENDING_LABELS = ("Low Spender", "Medium Spender", "High Spender")
SEGMENTS = ((10, "Champions"), (8, "Loyal Customers"), (6, "Potential Loyalists"), (5, "At Risk"))
LOWEST_SEGMENT = "Lost"
TIERS = ("high", "medium", "at_risk")


def fill_unknown(df: DataFrame) -> DataFrame:
    return df.fillna("Unknown", ["region", "city", "gender"])


def r_score(rfm: DataFrame) -> DataFrame:
    """Quartile of Recency, 4 for the most recent."""
    return qcut(rfm, "Recency", list(R_LABELS), "R_Score")


def m_score(rfm: DataFrame) -> DataFrame:
    return qcut(rfm, "Monetary", list(M_LABELS), "M_Score")


def rfm_segment(score: Column) -> Column:
    label = F.when(score.isNull(), F.lit(None))
    for limit, name in SEGMENTS:
        label = label.when(score >= limit, F.lit(name))
    return label.otherwise(F.lit(LOWEST_SEGMENT))


def rfm_segments(rfm: DataFrame) -> DataFrame:
    """R, F and M scores, their sum and the segment of each customer; NULL where any input is.

    The quartiles of both values are found in one sorted pass over (measure, value) rows.
    """
    measured = rfm.selectExpr(
        "stack(2, 'Recency', CAST(Recency AS double), 'Monetary', Monetary) AS (measure, value)"
    )
    edges = quantile_edges(measured, "value", [0.25, 0.5, 0.75], ["measure"])
    days = edges.filter(F.col("measure") == "Recency").select("edges")
    money = edges.filter(F.col("measure") == "Monetary").select("edges")
    scored = qcut(f_score(rfm), "Recency", list(R_LABELS), "R_Score", days)
    scored = qcut(scored, "Monetary", list(M_LABELS), "M_Score", money)
    total = F.col("R_Score") + F.col("F_Score") + F.col("M_Score")
    return scored.withColumn("RFM_Score", total).withColumn("Segment", rfm_segment(F.col("RFM_Score")))


def spending_category(predictions: DataFrame) -> DataFrame:
    """Terciles of ``total_spent`` over prediction rows, so each customer weighs by its products."""
    return qcut(predictions, "total_spent", list(SPENDING_LABELS), "spending_category")


def engagement_score(predictions: DataFrame) -> DataFrame:
    """Weighted propensity, similarity and transactions relative to the highest of all rows."""
    most = predictions.agg(F.max("total_transactions")).scalar()
    relative = F.try_divide("total_transactions", "_most")
    score = F.col("propensity_score") * 0.4 + F.col("embedding_similarity") * 0.3 + relative * 0.3
    return predictions.withColumn("_most", most).withColumn("engagement_score", score).drop("_most")


def scored_predictions(predictions: DataFrame) -> DataFrame:
    """Fill unknown labels and add both categories and the engagement score, before any filter.

    Edges, maximum and rows all read the predictions, so pass a stored table.
    """
    known = fill_unknown(predictions).withColumn("propensity_category", propensity_category())
    return engagement_score(spending_category(known))


def preprocess_predictions(predictions: DataFrame) -> DataFrame:
    """``scored_predictions`` of predictions that are written once, in buckets of the customer."""
    return scored_predictions(written_once(predictions, "predictions", "customer_id"))


def priority_score(df: DataFrame) -> DataFrame:
    """Weighted propensity, engagement and spend relative to the highest of the given rows."""
    highest = df.agg(F.max("total_spent")).scalar()
    relative = F.try_divide("total_spent", "_highest")
    score = F.col("propensity_score") * 0.5 + F.col("engagement_score") * 0.3 + relative * 0.2
    return df.withColumn("_highest", highest).withColumn("priority_score", score).drop("_highest")


def priority_tier(df: DataFrame) -> DataFrame:
    """``tier``: high, medium or at_risk; NULL for low scores of recent customers."""
    p = F.col("propensity_score")
    lapsed = F.col("Recency") > 30 if has(df, "Recency") else F.lit(True)
    tier = (
        F.when(p > 0.7, F.lit(TIERS[0]))
        .when(p.between(0.4, 0.7), F.lit(TIERS[1]))
        .when((p < 0.4) & lapsed, F.lit(TIERS[2]))
    )
    return df.withColumn("tier", tier)


def recency_band(column: str = "Recency") -> Column:
    days = F.col(column)
    band = F.when(days.isNull(), F.lit(None)).when(days < 30, F.lit("recent"))
    return band.when(days < 90, F.lit("cooling")).otherwise(F.lit("stale"))
