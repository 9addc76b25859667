"""Exact best match by cosine inside blocks, without listing the pairs of a block.

Rows are sorted by block and profile and cut into cells of bounded size. Each cell is searched in
itself; then two cells of a block meet only if the bound of their value ranges can still beat the
worst best-so-far of either. A task holds two cells at most, whatever the size of the block, and
hands on only rows that got better.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.session import written_once

# Task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities are compared with nine decimals, so that equal profiles tie and the lower id wins.
DECIMALS = 9
# Rows of a cell that are multiplied at once: the scores of a tile stay near the processor.
TILE = 1024


def _matrix(table: pa.Table) -> np.ndarray:
    vectors = table["vector"].combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _offer(best: np.ndarray, at: np.ndarray, scores: np.ndarray, first: int) -> None:
    """Raise ``best`` and its position ``at`` of each row by columns that begin at position ``first``.

    Tiles come in ascending position, so the earlier one keeps a tie. Few rows get better late, and only
    those are rounded entry by entry.
    """
    top = np.round(scores.max(axis=1), DECIMALS)
    better = top > best
    best[better] = top[better]
    at[better] = first + (np.round(scores[better], DECIMALS) == top[better, None]).argmax(axis=1)


def _none_yet(rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(rows, -np.inf), np.zeros(rows, dtype=np.int64)


def _within_cell(cell: pa.Table) -> pa.Table:
    """Position of the best other row of the cell, which is sorted by id, tile by tile."""
    cell = cell.sort_by("id")
    vectors, (best, at) = _matrix(cell), _none_yet(cell.num_rows)
    for i in range(0, len(best), TILE):
        for j in range(i, len(best), TILE):
            scores = vectors[i : i + TILE] @ vectors[j : j + TILE].T
            if i == j:
                np.fill_diagonal(scores, -np.inf)
            _offer(best[i : i + TILE], at[i : i + TILE], scores, j)
            if i != j:
                _offer(best[j : j + TILE], at[j : j + TILE], scores.T, i)
    alone = np.isneginf(best)
    return cell.append_column("match", cell["id"].take(pa.array(at, mask=alone))).append_column(
        "similarity", pa.array(best, mask=alone)
    )


def _improved(rows: pa.Table, among: pa.Table, best: np.ndarray, at: np.ndarray) -> pa.Table:
    so_far = rows["similarity"].to_numpy(zero_copy_only=False)
    better = np.isnan(so_far) | (best >= so_far)
    return pa.table({
        "id": rows["id"].filter(pa.array(better)),
        "match": among["id"].take(pa.array(at[better])),
        "similarity": pa.array(best[better]),
    })


def _between_cells(left: pa.Table, right: pa.Table) -> pa.Table:
    left, right = left.sort_by("id"), right.sort_by("id")
    ours, theirs = _matrix(left), _matrix(right)
    (best, at), (back, back_at) = _none_yet(len(ours)), _none_yet(len(theirs))
    for i in range(0, len(ours), TILE):
        for j in range(0, len(theirs), TILE):
            scores = ours[i : i + TILE] @ theirs[j : j + TILE].T
            _offer(best[i : i + TILE], at[i : i + TILE], scores, j)
            _offer(back[j : j + TILE], back_at[j : j + TILE], scores.T, i)
    return pa.concat_tables([_improved(left, right, best, at), _improved(right, left, back, back_at)])


def _highest_product() -> Column:
    """Upper bound of the dot product between any two vectors inside two value ranges."""
    def products(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: x * y)

    def higher(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.greatest(x, y))

    ends = higher(
        higher(products("l.low", "r.low"), products("l.low", "r.high")),
        higher(products("l.high", "r.low"), products("l.high", "r.high")),
    )
    return F.aggregate(ends, F.lit(0.0), lambda total, x: total + x)


def best_matches(
    vectors: DataFrame, size: int, cell_bits: int = 15, salts: int = 16
) -> DataFrame:
    """Best other row of the same block for each ``id``: columns ``id``, ``match``, ``similarity``.

    ``vectors`` has ``id`` (unique), ``block``, ``near`` (orders rows so that similar ones share a
    cell) and ``vector``, an array of ``size`` doubles of unit length. A cell has at most
    ``2 ** cell_bits`` rows; every row is sent once for each cell its own meets, so cells are large and are
    searched in tiles. ``match`` is NULL for a row that has nothing in common with any other,
    such as one alone in its block.
    """
    # The increasing id counts up within each sort partition, so a shift cuts it into cells.
    placed = vectors.sort("block", "near", "id").select(
        "id", "block", "vector",
        F.shiftright(F.monotonically_increasing_id(), cell_bits).alias("cell"),
    )
    id_type = vectors.schema["id"].dataType
    found = [T.StructField("match", id_type), T.StructField("similarity", T.DoubleType())]
    # Written, as the search inside cells is not to run again, nor the sort to draw other bounds.
    cells = written_once(
        placed.groupBy("block", "cell").applyInArrow(
            _within_cell, T.StructType([*placed.schema.fields, *found])
        ),
        "cells",
    )

    def edge(pick: str) -> Column:
        return F.expr("array(" + ", ".join(f"{pick}(vector[{i}])" for i in range(size)) + ")")

    ranges = cells.groupBy("block", "cell").agg(
        # A row alone in its cell has nothing yet, so anything can be better.
        F.min(F.coalesce("similarity", F.lit(-2.0))).alias("floor"),
        edge("min").alias("low"),
        edge("max").alias("high"),
    )
    # One block may own most cells: its left cells are spread over the salts.
    left = ranges.withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(salts)))
    right = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    meetings = (
        left.alias("l")
        .join(right.alias("r"), ["block", "salt"])
        .filter(F.col("l.cell") < F.col("r.cell"))
        .filter(_highest_product() >= F.least("l.floor", "r.floor") - 10.0**-DECIMALS)
        .select("block", F.col("l.cell").alias("a"), F.col("r.cell").alias("b"))
    )
    members = cells.select("id", "block", "cell", "vector", "similarity")

    def side(which: str) -> DataFrame:
        rows = members.withColumnRenamed("cell", which)
        columns = ("block", "a", "b", "id", "vector", "similarity")
        # Fresh aliases keep the two sides apart, which stem from the same table.
        return meetings.join(rows, ["block", which]).select(*[F.col(c).alias(c) for c in columns])

    better = (
        side("a").groupBy("block", "a", "b")
        .cogroup(side("b").groupBy("block", "a", "b"))
        .applyInArrow(_between_cells, T.StructType([T.StructField("id", id_type), *found]))
    )
    offer = F.when(F.col("similarity") > 0, F.struct((-F.col("similarity")).alias("below"), "match"))
    return (
        cells.select("id", "match", "similarity")
        .unionByName(better)
        .groupBy("id")
        .agg(F.min(offer).alias("_best"))
        .select(
            "id",
            F.col("_best.match").alias("match"),
            (-F.col("_best.below")).alias("similarity"),
        )
    )
