"""Near-duplicate documents: a Jaccard join on word shingles with filters under several token orders.

Under any order of all shingles, two sets of similarity 0.8 share one of the first fifth of their
shingles or so. The index is built under the first order, rarest shingles first, so passages that many
documents share come last and do not make candidates. A candidate pair must also share a shingle in
the first fifth under each of two further orders before its sets are compared exactly.

How often a shingle occurs is counted over all documents in 2^18 cells that shingles are hashed to.
Cells of frequent shingles stand out at any size of the input; a wrong guess makes an order less
selective but never loses a link, because the filter holds for every order. Prefixes are a little longer
than needed, so that similar sets share several of their tokens and one shared line makes no candidate.

Copies are one node. Links are looked for between nodes, and never among nodes that are already known
to be connected; see ``links``.

Defined cases: texts without words have an empty set and no link; fewer than five words are one shingle;
rows with equal ids are separate documents; documents without an id are linked like others and do not
name a component (it is null if no member has an id). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.common import dropped, map_rows, mixed, semi_join, stored, stored_by
from tillview.llm.links import linked_groups
from tillview.llm.shingles import batch_windows, extra_matches, prefix_length, set_name, signed, text_set

CELL_BITS = 18
SLAB = 4096
MORE_ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """Half powers of two of how often the shingles of each cell occur, over all documents."""
    cells = 1 << CELL_BITS

    def counted(batches):
        import pyarrow as pa

        counts = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                found = batch_windows(batch.column("text").slice(lo, 200).to_pylist()) >> np.uint64(64 - CELL_BITS)
                counts += np.bincount(found.astype(np.int64), minlength=cells)
        slabs = counts.reshape(-1, SLAB).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(slabs)), pa.int32()), pa.array([s.tobytes() for s in slabs], pa.binary())],
            names=["slab", "counts"],
        )

    def added(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, dtype="<u4" if len(data) == 4 * SLAB else "<u8").astype(np.uint64)
                sums[slab] = sums[slab] + part if slab in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.astype("<u8").tobytes() for s in sums.values()], pa.binary())],
            names=["slab", "counts"],
        )

    schema = "slab int, counts binary"
    # The result has one row for each of the fixed number of slabs, 2 MB in all.
    slabs = docs.select("text").mapInArrow(counted, schema).repartition("slab").mapInArrow(added, schema).collect()
    total = np.zeros(cells, dtype=np.float64)
    for row in slabs:
        total[row["slab"] * SLAB : (row["slab"] + 1) * SLAB] = np.frombuffer(row["counts"], dtype="<u8")
    return np.floor(2 * np.log2(total + 1)).astype(np.uint8)


def rare_first(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted hashes in the first global order: by class of their cell, then by hash."""
    return hashes[np.argsort(classes[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")]


def prefix_index(docs: DataFrame, classes) -> DataFrame:
    """(doc_id, node, n, prefix) per document; copies within a batch list their prefix once."""

    def run(batch):
        import pyarrow as pa

        seen: set[int] = set()
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes = text_set(text.as_py())
            name = set_name(hashes)
            prefix = None
            if len(hashes) and name not in seen:
                seen.add(name)
                prefix = signed(rare_first(hashes, classes.value)[: prefix_length(len(hashes))])
            rows.append((doc, name, len(hashes), prefix))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)],
            names=["doc_id", "node", "n", "prefix"],
        )

    return map_rows(docs, "doc_id long, node long, n long, prefix array<long>", run)


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, n, tokens, prefix_2, prefix_3): the whole set and its prefixes under the further orders."""

    def run(batch):
        import pyarrow as pa

        rows = []
        for text in batch.column("text"):
            hashes = text_set(text.as_py())
            p = prefix_length(len(hashes)) - extra_matches(len(hashes)) + 1
            others = [signed(hashes[np.argsort(mixed(hashes ^ np.uint64(k)))[:p]]) for k in MORE_ORDERS]
            rows.append((set_name(hashes), len(hashes), signed(hashes), *others))
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["node", "n", "tokens", "prefix_2", "prefix_3"],
        )

    schema = "node long, n long, tokens array<long>, prefix_2 array<long>, prefix_3 array<long>"
    return map_rows(docs.select("text"), schema, run).dropDuplicates(["node"])


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets pass the filters of the further orders and have similarity 0.8 or more."""

    def with_sides(rows: DataFrame, *columns: str) -> DataFrame:
        for s in "ab":
            rows = rows.join(sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", *columns)]), F.col(s) == F.col(f"node_{s}"))
        return rows

    filtered = with_sides(pairs, "prefix_2", "prefix_3").where(F.arrays_overlap("prefix_2_a", "prefix_2_b"))
    filtered = filtered.where(F.arrays_overlap("prefix_3_a", "prefix_3_b")).select("a", "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    whole = with_sides(filtered, "n", "tokens")
    return whole.where(100 * common >= 80 * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def behind_prefix(n):
    """Tokens of a set of ``n`` that are not in its prefix; see ``prefix_length``."""
    return F.floor((4 * n + 4) / 5) - F.greatest(F.lit(1), F.floor((n + 19) / 20))


def can_be_similar(n_x, shared_x, at_x, n_y, shared_y, at_y):
    """Whether sizes allow similarity 0.8, and so do the shared tokens and the place of this one.

    A link needs 4/9 of both sizes together in common. All but the tokens behind one of the prefixes
    must be among the shared ones of both. The first token that two linked sets share, at places at_x and
    at_y of the first order, has all others behind it in both sets; this holds for one bucket of each link.
    """
    common = F.ceil(4 * (n_x + n_y) / 9)
    enough = F.least(shared_x, shared_y) >= common - F.greatest(behind_prefix(n_x), behind_prefix(n_y))
    return (5 * F.least(n_x, n_y) >= 4 * F.greatest(n_x, n_y)) & enough & (F.least(n_x - at_x, n_y - at_y) >= common)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs))
    index = stored(prefix_index(docs, classes), "index")

    # A bucket is all sets with one shingle in their prefix; those with one set only are of no use.
    rows = index.where("prefix is not null").select("node", F.posexplode("prefix").alias("at", "bucket"))
    bucket = Window.partitionBy("bucket")
    shared = rows.withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket))
    shared = shared.where("low <> high").select("bucket", "node", "at").distinct()
    shared = stored(shared, "shared")
    # Sets that share too few prefix tokens with all others together have no link at all.
    sizes = index.where("prefix is not null").select("node", "n").distinct()
    counted = shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "node")
    counted = counted.where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.col("n") / 25)))
    # Tokens behind the first fifth count as shared, but no link has its first shared token there.
    early = F.col("n") - F.col("at") >= F.ceil(4 * F.col("n") / 5)
    buckets = stored(shared.join(counted, "node").where(early).select("bucket", "node", "n", "shared", "at"), "buckets")

    # Whole sets are made again for the documents that are in a bucket, one for each set.
    nodes = buckets.select("node").distinct()
    wanted = index.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    # They lie in buckets of their name, so every round moves its pairs and not the sets.
    sets, name = stored_by(full_sets(semi_join(docs, wanted, ["doc_id"])), "sets", "node")
    groups = linked_groups(buckets, lambda pairs: similar_pairs(pairs, sets), can_be_similar, "shared", "at")

    # The smallest id of each set, then of each component, then back to every document.
    named = index.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"))
    placed = named.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stored(placed, "placed")
    least = placed.groupBy("comp").agg(F.min("doc").alias("component_id"))
    labels = stored(placed.join(least, "comp").select("node", "component_id"), "labels")
    full = index.where("n > 0").select("doc_id", "node", F.col("n").alias("n_shingles")).join(labels, "node")
    empty = index.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    dropped(shared, buckets, sets, placed, groups)
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return full.select("doc_id", "n_shingles", "component_id").union(empty)


def one_per_component(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their component, with their own columns.

    Rows that share this id stay together: only documents with different ids are told apart.
    """
    parts = jaccard_components(docs)
    return semi_join(docs, parts.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), ["doc_id"], key_bytes=16)
