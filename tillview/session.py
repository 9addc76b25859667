"""Session settings and the two ways to cut lineage: checkpoints and caching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-node runs. On a cluster use the session it hands out."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a folder is lost
    with its machine, so an unset value is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tillview-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where later steps need to see the very same partitions as earlier ones: a recomputed
    range partitioning may draw other bounds, a checkpoint may not.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run here go when it ends, not when the driver happens to collect its garbage.

    For writes: a plan that is run once and is not kept.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_once(df: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    For a table that several branches of one plan read, which would each build it anew. Readers prune
    columns and rows; losing an executor loses nothing. With ``key`` the files lie in as many buckets of it as
    a shuffle has partitions, so joins and aggregates on ``key`` do not move the table again. The rows stay in
    the tasks that hold them, so pass a ``df`` that its last join or aggregate has dealt by ``key``.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.option("compression", "zstd")
    if key is None:
        with shuffles_dropped(spark):
            writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"tillview_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        writer.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a base table while several reports read it. Losing the cache costs time, not results."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


class TableCache:
    """Loaded tables, kept while their files stay the same.

    A table is known by reader, path and options. Every load compares the names, sizes and times of the
    files; a change drops the kept table and reads anew. Losing kept blocks costs time, not results.
    """

    def __init__(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.level = level
        self._kept: dict[tuple, tuple[tuple, DataFrame]] = {}

    @staticmethod
    def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
        """Number, total size and hash of the files below ``path``; no content is read."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        seen = files.select("path", "length", "modificationTime")
        # One row reaches the driver, however many files there are.
        row = seen.selectExpr(
            "count(*) AS n", "coalesce(sum(length), 0) AS size", "coalesce(bit_xor(xxhash64(path, length, modificationTime)), 0) AS hash"
        ).first()
        return row["n"], row["size"], row["hash"]

    def load(self, reader: Callable[..., DataFrame], spark: SparkSession, path: str, **options) -> DataFrame:
        """What ``reader(spark, path, **options)`` returns, read once for the same files."""
        key = (reader.__module__, reader.__qualname__, path, tuple(sorted((k, repr(v)) for k, v in options.items())))
        now = self.fingerprint(spark, path)
        if key in self._kept:
            then, table = self._kept[key]
            if then == now:
                return table
            table.unpersist()
        table = reader(spark, path, **options).persist(self.level)
        self._kept[key] = now, table
        return table

    def clear(self) -> None:
        for _, table in self._kept.values():
            table.unpersist()
        self._kept.clear()
