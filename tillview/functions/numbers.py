"""Money sums and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is added up with four decimals and scores with nine, which makes sums
# independent of row order.
MONEY = "decimal(18,4)"
SCORE = "decimal(18,9)"


def money_sum(column: str | Column) -> Column:
    """Sum as double; 0 for a group that has only NULLs."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(col.cast(MONEY)).cast("double"), F.lit(0.0))


def money_avg(column: str | Column) -> Column:
    """Mean of the non-NULL values; NULL if there are none."""
    col = F.col(column) if isinstance(column, str) else column
    return F.try_divide(F.sum(col.cast(MONEY)).cast("double"), F.count(col))


def score_avg(column: str | Column) -> Column:
    """Mean of a score; NULL if there are none."""
    col = F.col(column) if isinstance(column, str) else column
    return F.try_divide(F.sum(col.cast(SCORE)).cast("double"), F.count(col))


def format_percent(column: str, decimals: int) -> Column:
    return F.concat(F.format_number(F.col(column) * 100, decimals), F.lit("%"))


def format_money(column: str) -> Column:
    return F.concat(F.lit("₹"), F.format_number(F.col(column), 0))


def format_similarity(column: str) -> Column:
    return F.format_number(F.col(column), 3)


def similarity_text(column: str) -> Column:
    """Score as percent with one decimal; empty text for NULL."""
    return F.coalesce(format_percent(column, 1), F.lit(""))
