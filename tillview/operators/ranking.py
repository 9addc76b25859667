"""Whole-table ranks, top-k and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.session import checkpointed

# Rows that one task may hold to find a page.
TOP_ROWS = 10_000


def sorted_positions(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted, with ``_part`` (number of the sort partition) and ``_at`` (row within it).

    ``order`` must end in a unique key. The result is checkpointed, so every later reader sees the
    same partitions.
    """
    placed = checkpointed(df.sort(*order).withColumn("_pos", F.monotonically_increasing_id()))
    low_bits = F.lit((1 << 33) - 1)
    return placed.select(
        *df.columns,
        F.shiftright("_pos", 33).alias("_part"),
        F.col("_pos").bitwiseAND(low_bits).alias("_at"),
    )


def part_offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """Total ``weight`` in all earlier sort partitions; one row per sort partition."""
    sizes = placed.groupBy("_part").agg(F.sum(weight).alias("_size"))
    # One row per sort partition, so this window is never larger than the partition count.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table, ``order`` ending in a unique key.

    Range-sorts once and adds the sizes of earlier partitions, where a window without partitions
    would send every row to one task.
    """
    placed = sorted_positions(df, order)
    offsets = F.broadcast(part_offsets(placed, F.lit(1)))
    return placed.join(offsets, "_part").select(
        *df.columns, (F.col("_before") + F.col("_at") + 1).alias(name)
    )


def top_k(df: DataFrame, by: str, k: int | None, tie: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the highest ``by``, NULLs last, ties by ``tie``; all rows if ``k`` is None."""
    ordered = df.orderBy(F.desc_nulls_last(by), *tie)
    return ordered if k is None else ordered.limit(k)


def page_count(total: int, size: int = 10) -> int:
    return max(1, -(-total // size))


def _page_start(df: DataFrame, number: int, size: int, total: int | None) -> int:
    rows = df.count() if total is None else total
    return (min(max(1, number), page_count(rows, size)) - 1) * size


def page(
    df: DataFrame, number: int, size: int = 10, by: str = "total_spent", tie: str = "customer_id",
    total: int | None = None, top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Page ``number`` (from 1) of the rows by descending ``by``, with their running ``number``.

    A page beyond the last shows the last. Pass ``total`` to save the count. Up to ``top_rows`` rows go
    through one top-k; a page that ends beyond them is found by the rank of its keys alone, which one
    distributed sort of the two columns gives, so no task holds the rows before it.
    """
    order = [F.desc_nulls_last(by), F.asc(tie)]
    # Rows are counted by the two columns, so that tables joined only for others are not read.
    start = _page_start(df.select(by, tie), number, size, total)
    if start + size <= top_rows:
        held, skipped = df, start
    else:
        held, skipped = _rows_around(df, start, size, by, tie)
    rows_of_page = held.orderBy(*order).offset(skipped).limit(size)
    # At most one page of rows reaches this window.
    return rows_of_page.withColumn("number", F.row_number().over(Window.orderBy(*order)) + F.lit(start).cast("long"))


def _rows_around(df: DataFrame, start: int, size: int, by: str, tie: str) -> tuple[DataFrame, int]:
    """The rows whose keys fall on ``size`` ranks after ``start``, and how many of them come before these."""
    ranked = global_rank(df.select(F.col(by).alias("_by"), F.col(tie).alias("_tie")), [F.desc_nulls_last("_by"), F.asc("_tie")])
    # One page of keys reaches the driver.
    keys = ranked.filter(F.col("rank").between(start + 1, start + size)).orderBy("rank").collect()
    if not keys:
        return df.limit(0), 0
    first = F.col("_by").eqNullSafe(F.lit(keys[0]["_by"])) & F.col("_tie").eqNullSafe(F.lit(keys[0]["_tie"]))
    # Rows that share the first key of the page may lie before it.
    skipped = start + 1 - ranked.filter(first).agg(F.min("rank")).first()[0]
    distinct = df.sparkSession.createDataFrame(
        list({(r["_by"], r["_tie"]) for r in keys}), ranked.select("_by", "_tie").schema
    )
    # The plain test on the tie is pushed down to the tables; the join compares both columns.
    near = df.filter(F.col(tie).isin([r["_tie"] for r in keys if r["_tie"] is not None]) | F.col(tie).isNull())
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col(tie).eqNullSafe(F.col("_tie"))
    return near.join(F.broadcast(distinct), same, "left_semi"), skipped


def page_by_rank(
    df: DataFrame, number: int, size: int = 10, by: str = "total_spent", tie: str = "customer_id",
    total: int | None = None,
) -> DataFrame:
    """The same rows as ``page``, cut out by their rank: one distributed sort, whatever the depth."""
    start = _page_start(df, number, size, total)
    ranked = global_rank(df, [F.desc_nulls_last(by), F.asc(tie)], "number")
    return ranked.filter(F.col("number").between(start + 1, start + size))


def page_after(
    df: DataFrame, last_value: float | None, last_tie: int, size: int = 10, by: str = "total_spent",
    tie: str = "customer_id",
) -> DataFrame:
    """The page that follows a known last row: a pushed-down range, equally cheap at any depth.

    NULLs come last; a ``last_value`` of None says that the last row was one of them.
    """
    value, key = F.col(by), F.col(tie)
    if last_value is None:
        later = value.isNull() & (key > last_tie)
    else:
        later = (value < last_value) | ((value == last_value) & (key > last_tie)) | value.isNull()
    return df.filter(later).orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(size)


def display_rank(top: DataFrame, by: str, tie: Sequence[str]) -> DataFrame:
    """Number the rows of a top list from 1; meant for the few rows left by a limit."""
    return top.withColumn("Rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), *tie)))
