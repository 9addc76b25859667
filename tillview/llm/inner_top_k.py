"""Exact top-k by inner product: long vectors first, partial sums in rotated coordinates, bounds.

Vectors are put into blocks in descending order of length. The rotation comes from the singular value
decomposition of all vectors (of their 64 x 64 or so matrix of products, summed up by Spark), so the
first coordinates carry most of the length. Every block of queries first meets the block of the longest
vectors; the k-th best score so far is its floor. Of all other blocks, those whose longest vector cannot
reach a floor are left out by the join, and in the rest a vector is scored exactly only if its partial
sum over the first coordinates plus the product of the remaining lengths (Cauchy-Schwarz) reaches it.

Scores are sums of products of integers below 2^53, where doubles are exact; bounds get a slack of one
half, far above rounding errors and below the distance of two scores.

Blocks of queries are copied to ``SPREAD`` groups of candidate blocks; a task holds one block of each at
a time. Nothing grows with the table but the number of tasks' inputs.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do
rows without an id; vectors are compared with those of the same number of components only; rows with the
same id and vector count once, and a query never finds its own id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.common import dropped, map_rows, stored

K = 20
SCALE = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 512
# Groups that the candidate blocks are dealt to; each meets all query blocks.
SPREAD = 48
# Coordinates of the partial sum.
LEADING = 16
SLACK = 0.5
BLOCKS = "dim int, block long, top double, ids array<long>, data binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, length, data): the floor of ``scale`` times each component, as packed doubles."""

    def run(batch):
        import pyarrow as pa

        rows = []
        for vec, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if vec is None or not value.is_valid or not len(value.values) or value.values.null_count:
                continue
            x = np.asarray(value.values, dtype=np.float64)
            if np.isfinite(x).all():
                whole = np.floor(scale * x)
                rows.append((vec, len(x), float(np.sqrt(whole @ whole)), whole.tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["vec_id", "dim", "length", "data"],
            )

    picked = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
    return map_rows(picked, "vec_id long, dim int, length double, data binary", run)


def products(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the outer products of all vectors with themselves, by number of components."""

    def summed(batches, packed):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + (x if packed else x.T @ x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            names=["dim", "data"],
        )

    schema = "dim int, data binary"
    parts = vectors.select("dim", "data").mapInArrow(lambda b: summed(b, False), schema)
    # One square matrix per number of components reaches the driver.
    rows = parts.repartition("dim").mapInArrow(lambda b: summed(b, True), schema).collect()
    return {r["dim"]: np.frombuffer(r["data"], dtype=np.float64).reshape(r["dim"], r["dim"]) for r in rows}


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of all vectors, the strongest first."""
    return {dim: np.linalg.eigh(gram)[1][:, ::-1].copy() for dim, gram in products(vectors).items()}


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors in blocks of up to ``rows`` of one length range, the longest first."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, dim = [], None

        def block():
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([held[0][1]], pa.float64()),
                    pa.array([[v for v, _, _ in held]], pa.list_(pa.int64())),
                    pa.array([b"".join(d for _, _, d in held)], pa.binary()),
                ],
                names=["dim", "block", "top", "ids", "data"],
            )

        for batch in batches:
            for vec, d, length, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (d != dim or len(held) == rows):
                    yield block()
                    held = []
                dim = d
                held.append((vec, length, data))
        if held:
            yield block()

    order = [F.col("dim"), F.col("length").desc(), F.col("vec_id")]
    placed = vectors.select("vec_id", "dim", "length", "data").repartitionByRange(*order)
    return placed.sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one query, ties to the smaller id, every id and score once."""
    other = ids != own
    scores, ids = scores[other], ids[other]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return scores[fresh][:k], ids[fresh][:k]


def block_hits(queries, q_ids, floors, data, ids, rotation, k):
    """(query number, scores, ids) of the vectors of a block that reach the floor of a query."""
    q_turned, turned = queries @ rotation, data @ rotation
    m = min(LEADING, queries.shape[1])
    q_rest = np.sqrt(np.maximum((q_turned[:, m:] ** 2).sum(1), 0))
    rest = np.sqrt(np.maximum((turned[:, m:] ** 2).sum(1), 0))
    bound = q_turned[:, :m] @ turned[:, :m].T + np.outer(q_rest, rest)
    open_ = bound >= floors[:, None] - SLACK
    exact = queries @ data.T if open_.mean() > 0.05 else None
    for q in np.flatnonzero(open_.any(axis=1)):
        left = np.flatnonzero(open_[q])
        scores = exact[q, left] if exact is not None else data[left] @ queries[q]
        reach = scores >= floors[q]
        if reach.any():
            yield q, *best_of(scores[reach], ids[left[reach]], q_ids[q], k)


def side(df: DataFrame, mark: str, *more: Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns], *more)


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query.

    Both sides are results of ``quantised``.
    """
    spark = candidates.sparkSession
    turns = spark.sparkContext.broadcast(rotations(candidates))
    c_blocks = stored(blocks(candidates, BLOCK_ROWS), "vectors")
    q_blocks = stored(blocks(queries, QUERY_ROWS), "queries")
    # One block of bounded size for each number of components.
    heads = c_blocks.groupBy("dim").agg(F.max_by("block", F.struct("top", -F.col("block"))).alias("block"))
    heads = c_blocks.join(F.broadcast(heads), ["dim", "block"], "left_semi")

    def unpack(batch, mark, at):
        dim = batch.column(f"{mark}_dim")[at].as_py()
        data = np.frombuffer(batch.column(f"{mark}_data")[at].as_buffer(), dtype=np.float64).reshape(-1, dim)
        return data, np.asarray(batch.column(f"{mark}_ids")[at].values, dtype=np.int64), dim

    def floors_of(batch):
        import pyarrow as pa

        floors = []
        for at in range(batch.num_rows):
            q, q_ids, dim = unpack(batch, "q", at)
            c, ids, _ = unpack(batch, "c", at)
            floor = np.full(len(q), -np.inf)
            for n, scores, _ in block_hits(q, q_ids, floor, c, ids, turns.value[dim], k):
                if len(scores) == k:
                    floor[n] = scores[-1]
            floors.append(floor)
        names = ["q_dim", "q_block", "q_top", "q_ids", "q_data"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(floors, pa.list_(pa.float64())), pa.array([f.min() for f in floors], pa.float64())],
            names=[*names, "floors", "least"],
        )

    def hits_of(batch):
        import pyarrow as pa

        for at in range(batch.num_rows):
            q, q_ids, dim = unpack(batch, "q", at)
            c, ids, _ = unpack(batch, "c", at)
            floor = np.asarray(batch.column("floors")[at].values, dtype=np.float64)
            found = list(block_hits(q, q_ids, floor, c, ids, turns.value[dim], k))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(s), q_ids[n]) for n, s, _ in found]), pa.int64()),
                        pa.array(np.concatenate([i for _, _, i in found]), pa.int64()),
                        pa.array(np.concatenate([s for _, s, _ in found]).astype(np.int64), pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    q_side = "q_dim int, q_block long, q_top double, q_ids array<long>, q_data binary"
    first = side(q_blocks, "q").join(F.broadcast(side(heads, "c")), F.col("q_dim") == F.col("c_dim"))
    floored = stored(map_rows(first, f"{q_side}, floors array<double>, least double", floors_of), "queries")

    groups = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("q_group")
    spread = floored.select("*", groups)
    dealt = side(c_blocks, "c", F.pmod(F.xxhash64("block"), F.lit(SPREAD)).cast("int").alias("c_group"))
    reachable = F.col("q_top") * F.col("c_top") >= F.col("least") - SLACK
    # The planner takes blocks for their packed size on disk, once for all groups, and would broadcast the copies.
    met = spread.hint("merge").join(dealt, (F.col("q_group") == F.col("c_group")) & (F.col("q_dim") == F.col("c_dim")) & reachable)
    hits = map_rows(met.drop("q_group", "c_group"), FOUND, hits_of).distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    result = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    dropped(q_blocks)
    return result.select("query_id", "rank", "vec_id", "score")
