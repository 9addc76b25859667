"""Quantile bins, fixed-edge bins and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.operators.ranking import global_rank, part_offsets, sorted_positions


def _counted_values(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Distinct values in order, each with the range ``[_start, _end)`` of sorted positions it fills."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = sorted_positions(counts, [*by, "_value"])
    offsets = F.broadcast(part_offsets(placed, F.col("_n")))
    running = F.sum("_n").over(Window.partitionBy("_part").orderBy("_at"))
    end = F.col("_before") + F.col("_end_in_part")
    return (
        placed.withColumn("_end_in_part", running)
        .join(offsets, "_part")
        .select(*by, "_value", "_n", (end - F.col("_n")).alias("_start"), end.alias("_end"))
    )


def quantile_edges(
    df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``edges``, an array of doubles, per group.

    Values are counted before the shuffle, sorted in ranges, and only the two order statistics
    around each quantile are read, so no task holds the values of a group. ``by`` are label
    columns with few values.
    """
    values = _counted_values(df, column, by)
    span = F.struct(F.min("_start").alias("first"), F.sum("_n").alias("n"))
    if by:
        groups = values.groupBy(*by).agg(span.alias("_span"))
        values = values.join(F.broadcast(groups), list(by))
    else:
        values = values.withColumn("_span", values.agg(span).scalar())

    def at(offset: Column) -> Column:
        place = F.col("_span.first") + offset
        hit = (F.col("_start") <= place) & (place < F.col("_end"))
        return F.max(F.when(hit, F.col("_value")))

    last = F.col("_span.n") - 1
    picks, edges = [], []
    for i, p in enumerate(probs):
        exact = last * F.lit(float(p))
        below = F.floor(exact)
        above = F.least(below + 1, last)
        picks += [at(below).alias(f"_low{i}"), at(above).alias(f"_high{i}"),
                  F.max(exact - below).alias(f"_part{i}")]
        low, high, part = (F.col(f"_{x}{i}") for x in ("low", "high", "part"))
        # Measured from the nearer end, so an edge that falls on a value is that value.
        nearer_low = low + (high - low) * part
        edges.append(F.when(part < 0.5, nearer_low).otherwise(high - (high - low) * (1 - part)))
    grouped = values.groupBy(*by) if by else values.groupBy()
    return grouped.agg(*picks).select(*by, F.array(*edges).alias("edges"))


def bin_by_edges(value: Column, edges: Column, labels: Sequence[str | int]) -> Column:
    """Right-closed bins between inner ``edges``; of repeated edges the first bin wins."""
    label = F.when(value.isNull(), F.lit(None))
    for i, name in enumerate(labels[:-1]):
        label = label.when(value <= edges[i], F.lit(name))
    return label.otherwise(F.lit(labels[-1]))


def qcut(
    df: DataFrame, column: str, labels: Sequence[str | int], name: str, edges: DataFrame | None = None
) -> DataFrame:
    """Equal-count bins of ``column`` over the whole table; NULL stays NULL.

    The inner edges come as a scalar subquery, computed once; pass ``edges`` to reuse them.
    """
    if edges is None:
        inner = [i / len(labels) for i in range(1, len(labels))]
        edges = quantile_edges(df, column, inner)
    cut = bin_by_edges(F.col(column), F.col("_edges"), labels)
    return df.withColumn("_edges", edges.scalar()).withColumn(name, cut).drop("_edges")


def rank_quartile(rank: Column, total: Column) -> Column:
    """Quartile 1..4 of a rank among ``total`` ranks, cut where the quantiles of the ranks lie."""
    place = F.try_divide((rank - 1) * 4, total - 1)
    return F.greatest(F.lit(1), F.coalesce(F.ceil(place), F.lit(1))).cast("int")


def f_score(df: DataFrame, column: str = "Frequency", tie: str = "customer_id", name: str = "F_Score") -> DataFrame:
    """Quartile of the rank of ``column``; equal values are ranked by ``tie``. NULL stays NULL."""
    known = global_rank(df.filter(F.col(column).isNotNull()), [column, tie], "_rank")
    total = known.agg(F.count(F.lit(1))).scalar()
    scored = known.withColumn(name, rank_quartile(F.col("_rank"), total)).drop("_rank")
    unknown = df.filter(F.col(column).isNull()).withColumn(name, F.lit(None).cast("int"))
    return scored.unionByName(unknown)


def propensity_category(column: str = "propensity_score") -> Column:
    """Low up to 0.3, Medium up to 0.6, High up to 1; NULL for 0, beyond 1 and NULL."""
    p = F.col(column)
    return (
        F.when(p <= 0, F.lit(None))
        .when(p <= 0.3, F.lit("Low"))
        .when(p <= 0.6, F.lit("Medium"))
        .when(p <= 1.0, F.lit("High"))
    )


def histogram(df: DataFrame, column: str, nbins: int) -> DataFrame:
    """Counts of ``nbins`` equal-width bins between minimum and maximum, empty bins included.

    Columns ``bin``, ``bin_start``, ``bin_end``, ``n``. The last bin is closed; when all values are
    equal the first bin holds them.
    """
    values = df.select(F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    span = values.agg(
        F.struct(F.min("_x").alias("low"), ((F.max("_x") - F.min("_x")) / nbins).alias("width"))
    )
    place = F.floor(F.try_divide(F.col("_x") - F.col("_span.low"), F.col("_span.width")))
    counts = (
        values.withColumn("_span", span.scalar())
        .select(F.least(F.coalesce(place, F.lit(0)), F.lit(nbins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = df.sparkSession.range(nbins).select(F.col("id").alias("bin"))
    low, width = F.col("_span.low"), F.col("_span.width")
    return (
        bins.join(counts, "bin", "left")
        .withColumn("_span", span.scalar())
        .select(
            "bin",
            (low + width * F.col("bin")).alias("bin_start"),
            (low + width * (F.col("bin") + 1)).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def readable_histogram(df: DataFrame, column: str, most: int) -> DataFrame:
    """Counts of at most ``most`` bins whose edges are multiples of 1, 2 or 5 times a power of ten.

    The width is the smallest such number with which ``most`` bins cover all values. Columns as in
    ``histogram``; every bin is open above. Equal values share one bin of width 1; NULL, NaN and
    infinite values are left out, and without any value there are no bins.
    """
    if most < 2:
        raise ValueError("values on both sides of zero need two bins")
    x = F.col(column).cast("double")
    values = df.select(x.alias("_x")).filter(~F.isnan("_x") & (F.abs("_x") < float("inf")))
    low, high = F.col("low"), F.col("high")
    power = F.floor(F.log10((high - low) / most))
    widths = F.array(*[F.when(power < 0, m / F.pow(F.lit(10.0), -power)).otherwise(m * F.pow(F.lit(10.0), power)) for m in map(F.lit, (1.0, 2.0, 5.0, 10.0, 20.0))])
    fitting = F.filter(widths, lambda w: F.floor(high / w) - F.floor(low / w) < most)
    span = values.agg(F.min("_x").alias("low"), F.max("_x").alias("high")).filter("low is not null")
    span = span.withColumn("width", F.when(high > low, F.element_at(fitting, 1)).otherwise(F.lit(1.0)))
    width = span.select("width").scalar()
    counts = values.groupBy(F.floor(F.col("_x") / width).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    first, last = F.floor(low / F.col("width")), F.floor(high / F.col("width"))
    # One row per bin, so at most ``most`` rows.
    bins = span.select("width", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_k"))
    return bins.join(counts, "_k", "left").select(
        (F.col("_k") - F.col("_first")).alias("bin"), (F.col("_k") * F.col("width")).alias("bin_start"),
        ((F.col("_k") + 1) * F.col("width")).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"),
    )
