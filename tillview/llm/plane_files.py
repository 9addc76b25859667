"""Token ids in files of bit planes.

Documents are range-sorted by id; each sort partition becomes one run of ids that is cut into chunks
of a fixed number of ids. A chunk is transposed into bit planes (the lowest bit of all its ids, then
the next one, and so on), each plane is a zstandard frame of its own, and ``plane_ends`` says where
each frame ends. A chunk also lists the documents that lie in it, so a reader needs no other file and
can read any chunk alone. Files are Parquet files with one row per chunk; Spark's own writer makes
them, so they are complete or absent when an executor is lost, and any store Spark knows will do.

Defined cases: null and empty texts are the end id alone; documents without an id come last; rows with
the same id are kept apart and ordered by a hash of their text; an empty table gives no chunk. Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillview.llm.bpe_tree import TreeCoder
from tillview.llm.common import map_rows
from tillview.llm.subwords import vocabulary_path

CHUNK_IDS = 1 << 16
PLANE_LEVEL = 1
CHUNKS = (
    "part int, chunk int, first long, n_ids long, bits int, doc_ids array<long>, doc_firsts array<long>, "
    "doc_sizes array<long>, plane_ends array<int>, planes binary"
)
PIECES = "doc_id long, part int, first long, n_tokens long, offset long, ids binary"


def to_planes(ids: np.ndarray, bits: int, compressor) -> tuple[bytes, list[int]]:
    """Compressed planes of ``ids``, lowest bit first, and the end of each."""
    wide = ids.astype("<u2" if bits <= 16 else "<u4")
    planes = (np.packbits(((wide >> b) & 1).astype(np.uint8), bitorder="little") for b in range(bits))
    frames = [compressor.compress(plane.tobytes()) for plane in planes]
    return b"".join(frames), np.cumsum([len(f) for f in frames]).tolist()


def from_planes(data: bytes, ends: list[int], count: int, decompressor) -> np.ndarray:
    """The ids back from the planes of a chunk."""
    size = (count + 7) // 8
    ids = np.zeros(count, dtype="<u2" if len(ends) <= 16 else "<u4")
    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        plane = np.frombuffer(decompressor.decompress(data[a:b], max_output_size=size), dtype=np.uint8)
        ids |= np.unpackbits(plane, count=count, bitorder="little").astype(ids.dtype) << ids.dtype.type(k)
    return ids.astype(np.uint32)


def chunk_rows(documents, part: int, chunk_ids: int, bits: int):
    """Chunk rows of one part from its (doc_id, ids) in order."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=PLANE_LEVEL)
    held, listed, count, first, number, place = [], [], 0, 0, 0, 0

    def row(size: int):
        nonlocal held, listed, count, first, number
        ids = np.concatenate(held)
        data, ends = to_planes(ids[:size], bits, compressor)
        made = (
            part, number, first, size, bits, [d for d, _, _ in listed], [s for _, s, _ in listed],
            [n for _, _, n in listed], ends, data,
        )
        first, number, count = first + size, number + 1, count - size
        held = [ids[size:]]
        listed = [x for x in listed if x[1] + x[2] > first]
        return made

    for doc, ids in documents:
        held.append(ids)
        listed.append((doc, place, len(ids)))
        place, count = place + len(ids), count + len(ids)
        while count >= chunk_ids:
            later = [x for x in listed if x[1] >= first + chunk_ids]
            listed = [x for x in listed if x[1] < first + chunk_ids]
            made = row(chunk_ids)
            listed += later
            yield made
    if count:
        yield row(count)


def write_plane_files(
    docs: DataFrame, folder: str, end_id: int = 2, bits: int = 16, chunk_ids: int = CHUNK_IDS, path: str | None = None
) -> None:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write chunk files to ``folder``."""
    path = path or vocabulary_path()
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    placed = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange(*order)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = TreeCoder(path)
        end = np.array([end_id], dtype=np.uint32)

        def documents():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, np.concatenate([coder.encode(text.as_py()), end])

        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary()]
        for row in chunk_rows(documents(), TaskContext.get().partitionId(), chunk_ids, bits):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    chunks = placed.sortWithinPartitions(*order).mapInArrow(run, CHUNKS)
    chunks.write.option("compression", "none").parquet(folder)


def read_plane_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit.
    """
    chunks = spark.read.schema(CHUNKS).parquet(folder)

    def pieces(batch):
        import pyarrow as pa
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in PIECES.split(", ")]
        for k in range(batch.num_rows):
            c = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            data = from_planes(c["planes"], c["plane_ends"], c["n_ids"], decompressor).astype("<u4").tobytes()
            cut = [
                (max(s, c["first"]), min(s + n, c["first"] + c["n_ids"]))
                for s, n in zip(c["doc_firsts"], c["doc_sizes"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c["doc_ids"], pa.int64()),
                    pa.array([c["part"]] * len(cut), pa.int32()),
                    pa.array(c["doc_firsts"], pa.int64()),
                    pa.array(c["doc_sizes"], pa.int64()),
                    pa.array([a - s for (a, _), s in zip(cut, c["doc_firsts"], strict=True)], pa.int64()),
                    pa.array([data[4 * (a - c["first"]) : 4 * (b - c["first"])] for a, b in cut], pa.binary()),
                ],
                names=names,
            )

    found = map_rows(chunks, PIECES, pieces)
    key = ["doc_id", "part", "first", "n_tokens"]
    # Documents that cross a chunk border are put together; all others are whole already.
    whole = F.octet_length("ids") == 4 * F.col("n_tokens")
    crossing = found.where(~whole).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    documents = found.where(whole).select(*key, "ids").union(crossing.select(*key, joined.alias("ids")))
    # One row per written part, far fewer than rows of any task; their sizes add up to where each starts.
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return documents.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids"
    )
