"""CSV and parquet readers and writers for the logical tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.schemas import COLUMN_TYPES, PCT_SUFFIX, SPEND_SUFFIX, column_type, columns_by_suffix, has

# Doubled quotes inside a quoted field, which list-valued columns contain.
CSV_OPTIONS = {"header": "true", "escape": '"'}
# Words that stand for a missing value in a CSV file.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
BROKEN = "_broken_record"


@dataclass
class Loaded:
    """Rows that fit the declared types, and those that do not, with file, text and reason.

    Both read the files when used; persist or write what is read more than once.
    """

    rows: DataFrame
    rejects: DataFrame

    def reject_counts(self) -> DataFrame:
        """Rejected rows by file and reason."""
        return self.rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def _wanted(table: str, column: str, types: Mapping[str, T.DataType] | None) -> T.DataType:
    return (types or {}).get(column, column_type(table, column))


def _typed(column: str, kind: T.DataType, date_format: str | None) -> tuple[Column, Column]:
    """Value of a text column in its type, NULL where it does not fit, and whether a value is there."""
    text = F.col(f"`{column}`")
    there = text.isNotNull() & ~F.trim(text).isin(*MISSING_WORDS)
    if isinstance(kind, T.StringType):
        value = text
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        value = F.try_to_timestamp(text, *([F.lit(date_format)] if date_format else [])).cast(kind)
    elif isinstance(kind, T.IntegralType):
        # A column with missing values is often written as 12.0.
        value = F.regexp_replace(F.trim(text), r"\.0+$", "").try_cast(kind)
    else:
        value = F.trim(text).try_cast(kind)
    return F.when(there, value), there


def _texts(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """All fields as text; with ``PERMISSIVE``, lines of the wrong length in a column of their own."""
    reader = spark.read.options(**CSV_OPTIONS).option("enforceSchema", "false")
    columns = reader.csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if mode == "PERMISSIVE":
        fields.append(T.StructField(BROKEN, T.StringType()))
    schema = T.StructType(fields)
    return reader.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", BROKEN).csv(path)


def read_table(
    spark: SparkSession,
    table: str,
    path: str,
    date_format: str | None = None,
    types: Mapping[str, T.DataType] | None = None,
    format: str = "csv",
) -> DataFrame:
    """Read one logical table: CSV with a header, or parquet if ``format`` says so.

    The header line is read first, so optional and per-category columns get their declared types
    without schema inference over the data; ``types`` overrides some, such as text customer ids. Both
    formats give the same types. ``MISSING_WORDS`` and NaN are NULL. Text that does not fit its type,
    dates included, raises, and so does a line with too few or too many fields, or a file of the folder
    whose header differs from the first one's; ``read_with_rejects`` sets such rows apart instead.
    """
    if format == "parquet":
        return _declared(spark.read.parquet(path), table, types, date_format)
    if format != "csv":
        raise ValueError(f"unknown format {format!r}")
    texts = _texts(spark, path, "FAILFAST")

    def strict(column: str) -> Column:
        kind = _wanted(table, column, types)
        value, there = _typed(column, kind, date_format)
        said = F.concat(F.lit(f"[MALFORMED_RECORD] {column} is no {kind.simpleString()}: "), F.col(f"`{column}`"))
        return F.when(there & value.isNull(), F.raise_error(said).cast(kind)).otherwise(value).alias(column)

    return _without_nan(texts.select(*[strict(c) for c in texts.columns]))


def _declared(df: DataFrame, table: str, types: Mapping[str, T.DataType] | None, date_format: str | None) -> DataFrame:
    """Typed columns cast to the declared types; extra columns keep theirs unless ``types`` names them."""
    named = {*COLUMN_TYPES[table], *(types or {}), *columns_by_suffix(df, SPEND_SUFFIX), *columns_by_suffix(df, PCT_SUFFIX)}

    def cast(column: str) -> Column:
        kind, has_kind = _wanted(table, column, types), df.schema[column].dataType
        if column not in named or kind == has_kind:
            return F.col(f"`{column}`")
        if isinstance(has_kind, T.StringType) and isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            return F.to_timestamp_ntz(F.col(f"`{column}`"), *([F.lit(date_format)] if date_format else [])).cast(kind).alias(column)
        return F.col(f"`{column}`").cast(kind).alias(column)

    return _without_nan(df.select(*[cast(c) for c in df.columns]))


def _without_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in doubles})


def read_with_rejects(
    spark: SparkSession,
    table: str,
    path: str,
    date_format: str | None = None,
    types: Mapping[str, T.DataType] | None = None,
) -> Loaded:
    """Read a CSV table; a row that does not fit goes to ``rejects`` (file, text, reason) and not to ``rows``.

    A row is rejected for a wrong number of fields, for values of other types (the reason names the
    columns), or for a missing ``customer_id`` where the table has one.
    """
    texts = _texts(spark, path, "PERMISSIVE")
    columns = [c for c in texts.columns if c != BROKEN]
    kinds = {c: _wanted(table, c, types) for c in columns}
    parsed = {c: _typed(c, kind, date_format) for c, kind in kinds.items()}
    wrong = F.array_compact(F.array(
        F.lit(None).cast("string"),
        *[
            F.when(there & value.isNull(), F.lit(f"{c} is no {kinds[c].simpleString()}"))
            for c, (value, there) in parsed.items() if not isinstance(kinds[c], T.StringType)
        ],
        *[F.when(~parsed[c][1], F.lit(f"{c} is missing")) for c in columns if c == "customer_id"],
    ))
    reason = F.when(F.col(BROKEN).isNotNull(), F.lit("wrong number of fields")).otherwise(F.array_join(wrong, "; "))
    marked = texts.select("*", F.col("_metadata.file_path").alias("_file"), reason.alias("_reason"))
    rows = marked.filter("_reason = ''").select(*[value.alias(c) for c, (value, _) in parsed.items()])
    text = F.coalesce(BROKEN, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])))
    rejects = marked.filter("_reason <> ''").select(F.col("_file").alias("file"), text.alias("text"), F.col("_reason").alias("reason"))
    return Loaded(_without_nan(rows), rejects)


def read_transactions(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "transactions", path, **options)


def read_purchases(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "purchases", path, **options)


def read_category_features(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "category_features", path, **options)


def read_rfm(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "rfm", path, **options)


def read_catalog(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "catalog", path, **options)


def read_predictions(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "predictions", path, **options)


def read_customer_recs(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_table(spark, "customer_recs", path, **options)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Write with a header; timestamps keep their microseconds. Returns ``path``."""
    out = df.coalesce(1) if single_file else df
    out.write.options(**CSV_OPTIONS).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    ).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_month: bool = False) -> str:
    """Write as parquet; with ``partition_month`` date filters prune whole folders."""
    if partition_month and has(df, "order_date"):
        month = F.date_format("order_date", "yyyy-MM").alias("order_month")
        df.select("*", month).write.partitionBy("order_month").parquet(path)
    else:
        df.write.parquet(path)
    return path


def export_tracking(display: DataFrame, folder: str, stamp: str) -> str:
    """Customer tracking list as CSV below ``folder``; ``stamp`` is the caller's run time."""
    return write_csv(display, f"{folder}/customer_tracking_{stamp}")


def export_top_customers(display: DataFrame, folder: str, stamp: str) -> str:
    """Top list as one CSV file: it has no more rows than the top-k asked for."""
    return write_csv(display, f"{folder}/top_customers_{stamp}", single_file=True)
