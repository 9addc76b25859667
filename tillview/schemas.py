"""Column types of the seven logical tables, and the checks on them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, INT, DOUBLE, TEXT, TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType(),
)

# Suffixes of the wide per-category feature columns.
SPEND_SUFFIX = "_spend"
PCT_SUFFIX = "_pct"

COLUMN_TYPES: dict[str, dict[str, T.DataType]] = {
    "transactions": {
        "transaction_id": LONG, "customer_id": LONG, "name": TEXT, "gender": TEXT,
        "phone_number": TEXT, "region": TEXT, "state": TEXT, "city_name": TEXT,
        "mode_of_payment": TEXT, "total_spent": DOUBLE, "order_date": TIME,
        "order_quarter": INT, "days_since_last_visit": INT,
        "in_cart_same_category": TEXT, "in_cart_other_category": TEXT,
    },
    "purchases": {"customer_id": LONG, "product": TEXT},
    "category_features": {"customer_id": LONG},
    "rfm": {"customer_id": LONG, "Recency": INT, "Frequency": LONG, "Monetary": DOUBLE},
    "catalog": {"category": TEXT, "product": TEXT, "price_inr": DOUBLE},
    "predictions": {
        "customer_id": LONG, "product": TEXT, "category": TEXT, "propensity_score": DOUBLE,
        "embedding_similarity": DOUBLE, "total_spent": DOUBLE, "total_transactions": LONG,
        "region": TEXT, "city": TEXT, "gender": TEXT, "price_inr": DOUBLE,
    },
    "customer_recs": {
        "customer_id": LONG, "name": TEXT, "gender": TEXT, "state": TEXT, "city_name": TEXT,
        "total_spent": DOUBLE, "days_since_last_visit": INT,
        "purchased_products_names": TEXT, "in_cart_same_category": TEXT,
        "in_cart_other_category": TEXT, "Matched_Customer_ID": LONG, "Similarity_Score": DOUBLE,
        "Predicted_Products_from_Same_Category": TEXT,
        "Predicted_Products_from_Other_Categories": TEXT,
    },
}

REQUIRED: dict[str, tuple[str, ...]] = {
    "transactions": ("transaction_id", "customer_id", "total_spent"),
    "purchases": ("customer_id", "product"),
    "category_features": ("customer_id",),
    "rfm": ("customer_id", "Recency", "Frequency", "Monetary"),
    "catalog": ("category", "product", "price_inr"),
    "predictions": (
        "customer_id", "product", "category", "propensity_score", "embedding_similarity",
        "total_spent", "total_transactions", "region", "city", "gender", "price_inr",
    ),
    "customer_recs": (
        "customer_id", "name", "gender", "total_spent", "days_since_last_visit",
        "purchased_products_names", "in_cart_same_category", "in_cart_other_category",
        "Predicted_Products_from_Same_Category", "Predicted_Products_from_Other_Categories",
    ),
}


def column_type(table: str, column: str) -> T.DataType:
    """Declared type; ``*_spend`` and ``*_pct`` are doubles and any other extra column is text."""
    declared = COLUMN_TYPES[table].get(column)
    if declared is not None:
        return declared
    return DOUBLE if column.endswith((SPEND_SUFFIX, PCT_SUFFIX)) else TEXT


def struct_for(
    table: str, columns: Iterable[str], types: Mapping[str, T.DataType] | None = None
) -> T.StructType:
    given = types or {}
    return T.StructType(
        [T.StructField(c, given.get(c, column_type(table, c)), True) for c in columns]
    )


def has(df: DataFrame, *columns: str) -> bool:
    """Whether all columns exist. Answered from the plan, without a job."""
    return set(columns) <= set(df.columns)


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the order given."""
    present = set(df.columns)
    return [c for c in columns if c in present]


def columns_by_suffix(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def validate_inputs(tables: Mapping[str, DataFrame | None]) -> None:
    """Raise one error naming every absent table and every absent required column."""
    problems = []
    for name, df in tables.items():
        if df is None:
            problems.append(f"{name}: not loaded")
            continue
        missing = [c for c in REQUIRED[name] if c not in df.columns]
        if missing:
            problems.append(f"{name}: no column {', '.join(missing)}")
    if problems:
        raise ValueError("unusable inputs: " + "; ".join(problems))


def input_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name, rows, whether it is empty, and absent required columns as a comma list."""
    rows = None
    for name, df in tables.items():
        missing = ", ".join(c for c in REQUIRED[name] if c not in df.columns)
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", (F.col("n_rows") == 0).alias("is_empty"), F.lit(missing).alias("missing")
        )
        rows = row if rows is None else rows.unionAll(row)
    if rows is None:
        raise ValueError("no tables given")
    return rows
