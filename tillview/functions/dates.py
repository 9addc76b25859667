"""Date parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.schemas import has


def with_order_timestamp(df: DataFrame, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Turn a text ``order_date`` into a timestamp without time zone.

    Unparsable text raises when ``strict`` and becomes NULL otherwise. Typed columns and tables
    without the column pass through.
    """
    if not has(df, "order_date") or not isinstance(df.schema["order_date"].dataType, T.StringType):
        return df
    text = F.col("order_date")
    pattern = (F.lit(fmt),) if fmt else ()
    if strict:
        parsed = F.to_timestamp_ntz(text, *pattern)
    else:
        parsed = F.try_to_timestamp(text, *pattern).cast("timestamp_ntz")
    return df.withColumn("order_date", parsed)


def order_day(column: str = "order_date") -> Column:
    return F.to_date(column)


def order_hour(column: str = "order_date") -> Column:
    return F.hour(column)


def order_month(column: str = "order_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def date_parts(df: DataFrame, column: str = "order_date") -> DataFrame:
    """Calendar date, hour of day and month of each row."""
    return df.select(
        "*",
        order_day(column).alias("order_day"),
        order_hour(column).alias("order_hour"),
        order_month(column).alias("order_month"),
    )
