"""From shared buckets to connected groups without listing all pairs of a bucket.

``linked_groups`` takes rows (bucket, node): two nodes may be linked if they share a bucket. In the
first rounds every node meets one representative of each of its buckets, the same one wherever
possible. Nodes that are thereby known to be connected need no further comparison with each other.
In the last round each bucket that still holds several components compares its nodes across
components, the nodes of its largest component never among themselves. The components are those of
all links: a pair is left out only if both ends are already known to be connected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillview.llm.common import dropped, stored
from tillview.session import shuffles_dropped

# Rounds with representatives before all remaining pairs are compared.
STARS = 2
Verify = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); ``comp`` is the smallest node reachable.

    Alternates hooking every neighbour to the smallest one around a node and halving the way to it,
    so rounds grow with the logarithm of the longest path. Each round is one job, which writes its edges
    out and takes their fingerprint on the way.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(both.where("a <> b").distinct(), "edges")
    signature = None
    while True:
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        sym = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        # Order-free fingerprint of the edge set; it settles when every node points at its root.
        seen = Observation()
        after = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges")
        now = seen.get
        dropped(current)
        current = after
        if now == signature:
            break
        signature = now
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)


def with_component(rows: DataFrame, comps: DataFrame, node: str = "node") -> DataFrame:
    """``rows`` with ``comp``, which is the node itself where it has no link."""
    named = comps.select(F.col("node").alias("_n"), "comp")
    joined = rows.join(named, rows[node] == named["_n"], "left").drop("_n")
    return joined.withColumn("comp", F.coalesce("comp", F.col(node)))


def distinct_buckets(buckets: DataFrame, place: str | None = None) -> DataFrame:
    """One of all buckets that hold the same nodes; the others would only repeat its pairs.

    With ``place`` it is the one that its nodes hold at the smallest places.
    """
    held = buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min(place or F.lit(0)).alias("place"),
    )
    first = F.min_by("bucket", F.struct("place", "bucket")).alias("bucket")
    chosen = held.where("n > 1").groupBy("n", "x", "y").agg(first).select("bucket")
    return buckets.join(chosen, "bucket", "left_semi")


def linked_groups(
    buckets: DataFrame, verify: Verify, near: Callable | None = None, central: str | None = None,
    place: str | None = None, weight: Callable | None = None, most: float = 0,
) -> DataFrame:
    """(node, comp) for all nodes that have a verified link.

    ``buckets``: (bucket, node, *extra), read several times, so pass a stored table. ``near(extra of a,
    extra of b)`` is a cheap necessary condition on the extra columns. ``verify`` takes distinct pairs
    (a, b) with a < b and returns the links. ``central`` names an extra column that is large for nodes
    likely to be linked to many others; these are the first representatives. ``place`` names an extra
    column with the place of the bucket among all buckets of its node, in an order that is the same for
    all nodes; it says which of several buckets with the same nodes is kept. ``weight(extra of a, extra of
    b)`` is what ``verify`` moves for a pair: where the pairs of a round weigh more than ``most``, they are made
    and compared in slices by a hash of the pair, each deleted before the next. The tables of a round are
    deleted when the next has been written.
    """
    extra = [c for c in buckets.columns if c not in ("bucket", "node")]
    buckets = stored(distinct_buckets(buckets, place), "buckets")
    placed = buckets.withColumn("comp", F.col("node"))
    links = tested = comps = None
    kept: list[DataFrame] = [buckets]

    def side(df: DataFrame, mark: str, *more: str) -> DataFrame:
        return df.select("bucket", *more, *[F.col(c).alias(f"{c}_{mark}") for c in ("node", "comp", *extra)])

    for turn in range(STARS + 1):
        # As long as nothing is linked all buckets are open; they hold two nodes or more.
        open_rows = placed
        if comps is not None or turn == STARS:
            # Buckets with nodes of two or more components; the largest component of each.
            sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
            several = sizes.groupBy("bucket").agg(
                F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main")
            ).where("comps > 1").select("bucket", "main")
            open_rows = stored(placed.join(several, "bucket"), "open")
        if open_rows.isEmpty():
            break
        if turn == STARS:
            # Of two nodes outside the largest component one meets the other, not both each other.
            x = side(open_rows.where("comp <> main"), "x")
            y = side(open_rows, "y", "main")
        else:
            # The same representative wherever it is in the bucket, another one in each round.
            order = F.xxhash64(F.lit(turn), "node") if turn or not central else F.struct(central, "node")
            heads = open_rows.groupBy("bucket").agg(F.max_by(F.struct("node", "comp", *extra), order).alias("h"))
            x, y = side(open_rows, "x"), side(heads.select("bucket", "h.*"), "y")
        joined = x.join(y, "bucket").where("comp_x <> comp_y")
        if turn == STARS:
            joined = joined.where("comp_y = main or node_x < node_y")
        if near is not None:
            joined = joined.where(near(*[joined[f"{c}_{s}"] for s in "xy" for c in extra]))
        slices = 1
        if weight is not None:
            weighed = joined.select(weight(*[joined[f"{c}_{s}"] for s in "xy" for c in extra]).alias("w"))
            with shuffles_dropped(buckets.sparkSession):
                slices = max(1, math.ceil((weighed.agg(F.sum("w")).first()[0] or 0) / most))
        ends = joined.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
        compared, verified = [], []
        for k in range(slices):
            pairs = ends.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k) if slices > 1 else ends
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs")
            if not pairs.isEmpty():
                verified.append(stored(verify(pairs).select("a", "b"), "links"))
            if turn == STARS:
                dropped(pairs)
            else:
                compared.append(pairs)
        if open_rows is not placed:
            dropped(open_rows)
        kept += compared + verified
        if compared:
            tested = reduce(DataFrame.union, compared, *([tested] if tested is not None else []))
        if not verified:
            continue
        found = reduce(DataFrame.union, verified)
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        before = [] if comps is None else [comps, placed]
        reached = components(links)
        comps = stored(reached, "components")
        placed = stored(with_component(buckets, comps), "placed")
        dropped(reached, *before)
    if comps is None:
        nothing = stored(buckets.select("node", F.col("node").alias("comp")).limit(0), "components")
        dropped(*kept)
        return nothing
    dropped(placed, *kept)
    return comps
