"""Words, scratch tables and size-checked joins that the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillview.session import dropped, new_folder, shuffles_dropped  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
# A side is broadcast only if its measured size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
# Rows that Python code handles at once.
SLICE_ROWS = 1000


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_count(text: Column) -> Column:
    """Number of words as a native expression; 0 for null and blank texts."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    empty = F.coalesce(F.length(trimmed), F.lit(0)) == 0
    return F.when(empty, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def worker_value(name: str, make: Callable[[], object]) -> object:
    """A value kept by one Python worker across its tasks; rebuilt wherever it is missing."""
    kept = sys.modules.setdefault("_tillview_worker", types.ModuleType("_tillview_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


class WordHashes(dict):
    """64-bit hashes of words, looked up once per distinct word; emptied when it grows too large."""

    def __init__(self, most: int = 1 << 18):
        import xxhash

        super().__init__()
        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes() -> WordHashes:
    return worker_value("word_hashes", WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words; of all words if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : n - width + 1 + k])
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage whose size is known.

    Unlike a cache it does not depend on any executor staying alive.
    """
    path = new_folder(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str) -> tuple[DataFrame, str]:
    """``stored``, in buckets of ``key``, with its name in the catalog: joins on ``key`` move the other side only."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    name = "scratch_" + "".join(c if c.isalnum() else "_" for c in path.rsplit("/", 1)[-1]).lower()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key)
    with shuffles_dropped(spark):
        writer.saveAsTable(name)
    return spark.table(name), name


def semi_join(left: DataFrame, keys: DataFrame, on: list[str], key_bytes: int = 24) -> DataFrame:
    """Rows of ``left`` with a match in ``keys``; null keys match null keys.

    ``keys`` is broadcast only if its counted rows are known to fit, else both sides shuffle.
    """
    keys = keys.select(*[F.col(c).alias(f"_k_{c}") for c in on]).distinct()
    if keys.count() * key_bytes * len(on) <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    match = [left[c].eqNullSafe(keys[f"_k_{c}"]) for c in on]
    condition = match[0]
    for more in match[1:]:
        condition = condition & more
    return left.join(keys, condition, "left_semi")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (a clash keeps the operator's own)."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


ARROW = {"long": "int64", "int": "int32", "double": "float64", "boolean": "bool_", "string": "string", "binary": "binary"}


def arrow_type(name: str):
    import pyarrow as pa

    inner = name.removeprefix("array<").removesuffix(">")
    return pa.list_(getattr(pa, ARROW[inner])()) if inner != name else getattr(pa, ARROW[name])()


def add_columns(df: DataFrame, read: list[str], add: dict[str, str], function: Callable, start: Callable[[], object] | None = None) -> DataFrame:
    """``df`` with columns computed batch by batch in Python; all other columns pass through.

    ``function`` takes the columns ``read`` as Arrow arrays and returns one sequence per added column.
    With ``start`` it takes what ``start`` returned first: made when a task begins, gone when it ends.
    """
    df = without(df, *add)
    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in add.items()))
    schema = StructType([*df.schema.fields, *added.fields])
    names, kinds = list(schema.names), list(add.values())

    def run(batches):
        import pyarrow as pa

        state = [start()] if start else []
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                made = function(*state, *[batch.column(c) for c in read])
                new = [x if isinstance(x, pa.Array) else pa.array(x, arrow_type(k)) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str, function: Callable) -> DataFrame:
    """``df.mapInArrow`` with a function from one batch to any number of column lists."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                yield from function(whole.slice(lo, SLICE_ROWS))

    return df.mapInArrow(run, schema)
