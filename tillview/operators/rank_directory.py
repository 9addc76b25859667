"""Pages from one stored range sort: a directory says which parts of it hold a page.

``write_rank_directory`` sorts a table once by descending value (NULLs last) and a unique tie column, numbers
the rows and stores them by sort partition. Beside them lies the directory, with one row for each part: its
first and last number, and the keys of its first and last row. A page, or the place of a key, then reads the
parts that hold it, one or two as a rule, where every call of ``page_by_rank`` sorts the table.

Defined cases: an empty table has no parts and one empty page; a page before the first is the first, a page
beyond the last is the last; rows without a value come last, by tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.operators.ranking import page_count, part_offsets, sorted_positions

ROWS, PARTS, COLUMNS = "rows", "directory", "columns"


def write_rank_directory(df: DataFrame, path: str, by: str = "total_spent", tie: str = "customer_id") -> None:
    """Sort ``df`` once and write its numbered rows and their directory below ``path``."""
    placed = sorted_positions(df, [F.desc_nulls_last(by), F.asc(tie)])
    # One row per sort partition.
    offsets = F.broadcast(part_offsets(placed, F.lit(1)))
    numbered = placed.join(offsets, "_part").select(
        *df.columns, (F.col("_before") + F.col("_at") + 1).alias("number"), F.col("_part").alias("part")
    )
    numbered.limit(0).write.parquet(f"{path}/{COLUMNS}")
    # Rows lie in the order of their numbers, so a page also skips the row groups of its part.
    numbered.sortWithinPartitions("part", "number").write.partitionBy("part").parquet(f"{path}/{ROWS}")
    key = F.struct(F.col(by).alias("value"), F.col(tie).alias("tie"))
    parts = stored_rows(df.sparkSession, path).groupBy("part").agg(
        F.min("number").alias("first_number"), F.max("number").alias("last_number"),
        F.min_by(key, "number").alias("first_key"), F.max_by(key, "number").alias("last_key"),
    )
    parts.coalesce(1).write.parquet(f"{path}/{PARTS}")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All numbered rows with their ``part``."""
    # An empty table has no file of rows, so the columns are kept beside them.
    columns = spark.read.parquet(f"{path}/{COLUMNS}").schema
    return spark.read.schema(columns).parquet(f"{path}/{ROWS}")


def _parts_where(directory: DataFrame, condition: Column) -> list[int]:
    """Numbers of the parts that hold what is asked for: a few, as parts do not overlap."""
    return [r["part"] for r in directory.filter(condition).select("part").collect()]


def directory_page(spark: SparkSession, path: str, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) with the running ``number`` of its rows, read from the parts that hold it."""
    directory = spark.read.parquet(f"{path}/{PARTS}")
    total = directory.agg(F.max("last_number")).first()[0] or 0
    start = (min(max(1, number), page_count(total, size)) - 1) * size
    parts = _parts_where(directory, (F.col("first_number") <= start + size) & (F.col("last_number") > start))
    rows = stored_rows(spark, path)
    held = rows.filter(F.col("part").isin(parts)) if parts else rows.filter(F.lit(False))
    return held.filter(F.col("number").between(start + 1, start + size)).drop("part")


def page_of_key(
    spark: SparkSession, path: str, value: float | None, key: int, size: int = 10, by: str = "total_spent", tie: str = "customer_id"
) -> int:
    """The page on which the row with this value and tie lies, or would lie; reads one part at most."""

    def before(x: Column, t: Column) -> Column:
        """Whether a row with value ``x`` and tie ``t`` comes before the key."""
        if value is None:
            return x.isNotNull() | (t < key)
        return F.coalesce((x > value) | ((x == value) & (t < key)), F.lit(False))

    directory = spark.read.parquet(f"{path}/{PARTS}")
    starts, ends = (before(F.col(f"{c}.value"), F.col(f"{c}.tie")) for c in ("first_key", "last_key"))
    earlier = directory.filter(ends).agg(F.max("last_number")).first()[0] or 0
    rows = stored_rows(spark, path)
    parts = _parts_where(directory, starts & ~ends)
    inside = rows.filter(F.col("part").isin(parts) & before(F.col(by), F.col(tie))).count() if parts else 0
    total = directory.agg(F.max("last_number")).first()[0] or 0
    return min((earlier + inside) // size + 1, page_count(total, size))
