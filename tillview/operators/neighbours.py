"""Best match by cosine among near neighbours along fixed projections, in linear work.

Every row has a whole-number place on each of a fixed set of lines. The candidates of a row are the
rows of its block up to ``reach`` places before and after it on any line, whole numbers first and
ids among equal ones; the best of them by cosine is its match. This is a definition that any engine
can repeat, not a sample. A row meets at most ``2 * reach`` others on each line, however large its
block is, so twice the rows cost twice the work.

One range sort places all lines; rows are then cut into cells of neighbours by their rank. Rows near
the edge of a cell are sent to the next one, too. A task holds one cell.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.operators.matching import DECIMALS
from tillview.operators.ranking import global_rank

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = 12
REACH = 8
CELL_ROWS = 4096
# Unit vectors are placed on lines in whole millionths.
PLACE_SCALE = 1_000_000


def line_sign(line: int, entry: int) -> int:
    """+1 or -1: the direction of a line in an entry, a row of the Walsh matrix."""
    return 1 - 2 * ((line & entry).bit_count() & 1)


def line_places(vector: Column | str, size: int, lines: int = LINES) -> Column:
    """Place of a vector of ``size`` entries on lines 1 to ``lines``, exact in whole numbers."""
    whole = F.transform(vector, lambda x: F.floor(x * PLACE_SCALE).cast("long"))
    signs = F.array(*[F.array(*[F.lit(line_sign(k, i)) for i in range(size)]) for k in range(1, lines + 1)])
    return F.transform(
        signs, lambda sign: F.aggregate(F.zip_with(whole, sign, lambda x, s: x * s), F.lit(0).cast("long"), lambda t, x: t + x)
    )


def _best_in_cell(reach: int):
    def best(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("rank").combine_chunks()
        n = cell.num_rows
        vectors = cell["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        line, block = cell["line"].to_numpy(), pc.dictionary_encode(cell["block"]).combine_chunks()
        codes = pc.fill_null(block.indices, -1).to_numpy(zero_copy_only=False)
        order = np.empty(n, dtype=np.int64)
        order[pc.sort_indices(cell["id"]).to_numpy()] = np.arange(n)
        score, match, compared = np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for gap in range(1, min(reach, n - 1) + 1):
            a, b = np.arange(n - gap), np.arange(gap, n)
            near = (line[a] == line[b]) & (codes[a] == codes[b])
            a, b = a[near], b[near]
            cosine = np.round(np.einsum("ij,ij->i", vectors[a], vectors[b]), DECIMALS)
            for own, other in ((a, b), (b, a)):
                compared[own] += 1
                better = (cosine > score[own]) | ((cosine == score[own]) & (order[other] < order[match[own]]))
                score[own[better]], match[own[better]] = cosine[better], other[better]
        none = ~(score > 0)
        found = pa.table({
            "id": cell["id"],
            "match": cell["id"].take(pa.array(match, mask=none)),
            "similarity": pa.array(score, mask=none),
            "compared": pa.array(compared),
        })
        return found.filter(cell["home"])

    return best


def projected_matches(vectors: DataFrame, size: int, lines: int = LINES, reach: int = REACH, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Best neighbour of each ``id``: columns ``id``, ``match``, ``similarity``, ``compared``.

    ``vectors`` has ``id`` (unique), ``block`` and ``vector``, an array of ``size`` doubles of unit length.
    Similarities have nine decimals and the lower id wins a tie. ``match`` is NULL for a row that has
    nothing in common with any neighbour, such as one alone in its block; ``compared`` counts the pairs
    looked at.
    """
    if cell_rows <= 2 * reach:
        raise ValueError("a cell must be longer than twice the reach")
    placed = vectors.select("id", "block", "vector", F.posexplode(line_places("vector", size, lines)).alias("line", "place"))
    ranked = global_rank(placed, ["line", "block", "place", "id"])
    at, cell = (F.col("rank") - 1) % cell_rows, F.floor((F.col("rank") - 1) / cell_rows)
    cells = F.array_compact(F.array(cell, F.when(at < reach, cell - 1), F.when(at >= cell_rows - reach, cell + 1)))
    sent = ranked.select("id", "block", "vector", "line", "rank", cell.alias("own"), F.explode(cells).alias("cell"))
    sent = sent.select("id", "block", "vector", "line", "rank", "cell", (F.col("own") == F.col("cell")).alias("home"))
    id_type = vectors.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("match", id_type), T.StructField("similarity", T.DoubleType()),
        T.StructField("compared", T.LongType()),
    ])
    found = sent.groupBy("cell").applyInArrow(_best_in_cell(reach), schema)
    offer = F.when(F.col("match").isNotNull(), F.struct((-F.col("similarity")).alias("below"), "match"))
    return found.groupBy("id").agg(F.min(offer).alias("_best"), F.sum("compared").alias("compared")).select(
        "id", F.col("_best.match").alias("match"), (-F.col("_best.below")).alias("similarity"), "compared"
    )
