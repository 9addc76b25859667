"""An inverted index over list columns: which customers have bought a product.

The lists are split once, when the index is written. A search for any of some products is then a union
of their postings, read from the folders their names hash to, in place of a test of every list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.lists import split_list

BUCKETS = 64


def _bucket(item: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(item.cast("binary")), F.lit(buckets)).cast("int")


def write_postings(
    recs: DataFrame, path: str, column: str = "purchased_products_names", key: str = "customer_id", buckets: int = BUCKETS
) -> str:
    """Write (product, item, ``key``) of every list entry below ``path``, in one folder per bucket.

    ``item`` is the product in lower case, which searches compare. A product that very many customers
    have is written by as many tasks as hold them.
    """
    entries = recs.select(key, F.explode(split_list(column)).alias("product")).distinct()
    item = F.lower("product")
    placed = entries.select("product", item.alias("item"), key, _bucket(item, buckets).alias("bucket"))
    placed.sortWithinPartitions("bucket", "item").write.partitionBy("bucket").parquet(path)
    return path


def read_postings(spark: SparkSession, path: str, key_type: str = "bigint", key: str = "customer_id") -> DataFrame:
    return spark.read.schema(f"product string, item string, {key} {key_type}, bucket int").parquet(path)


def buyers_of_any(postings: DataFrame, products: Sequence[str], key: str = "customer_id", buckets: int = BUCKETS) -> DataFrame:
    """Customers with any of ``products``, ignoring case; ``buckets`` as the index was written with."""
    if not products:
        return postings.select(key).filter(F.lit(False))
    # Literals fold before planning, so only the folders of these products are read.
    items = [F.lit(p.lower()) for p in products]
    found = postings.filter(F.col("bucket").isin(*[_bucket(i, buckets) for i in items]) & F.col("item").isin(*items))
    return found.select(key).distinct()


def bought_any_of_indexed(
    df: DataFrame, postings: DataFrame, products: Sequence[str] | None, key: str = "customer_id", buckets: int = BUCKETS
) -> DataFrame:
    """Rows of ``df`` whose customer has any of ``products``; all rows if none are given."""
    return df if not products else df.join(buyers_of_any(postings, products, key, buckets), key, "left_semi")


def indexed_vocabulary(postings: DataFrame) -> DataFrame:
    """Every product of the index, sorted."""
    return postings.select("product").distinct().orderBy("product")
