"""Mixing sources to target weights in a drawn order, in DataFrame functions only.

Every source gets a target of words. In a source with ``target = 2.3 * size`` every document is taken
twice for certain. For the rest each has an inclusion probability of its own, 0.3 on average over the
words of the source and larger for longer documents (see ``inclusion``). Each draws a uniform number, its
odds are divided by the odds of the inclusion probability, and documents are taken in the order of this
ratio until the target is met: Pareto order sampling. Sizes differ, so "fixed size" is meant in words: a
document that would overshoot is passed over for smaller ones further on, and the last one taken is the
one that leaves the source nearest to its target.

No source is ever sorted as a whole. The ratio is mapped to 0..1 and cut into 4,096 bins whose sums
are added up per source; the bin in which the target is met is cut into 4,096 again. What is joined
back to the documents is one row per source.

Defined cases: a null text has size 0 and is taken as often as its source says; a null source is a
source of its own, the last; documents with the same id share one draw; an empty table gives no rows;
other columns pass through, and input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.common import dropped, stored, without, word_count

BINS = 4096
# Fillings of a source: one in order, and some with smaller documents for what is then missing.
ROUNDS = 4
CAP = 3
# A document of this many words is half way between the least and the most lift by length.
MIDDLE_WORDS = 200
WEIGHTS = (1, 2, 3)
SEED = 11
ADDED = ("size", "source_size", "target", "copies", "taken")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) drawn by a hash that other engines have too."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def lift(size: Column) -> Column:
    """0 for no words up to 4,096 for endlessly many: a whole number, so that sums do not depend on order."""
    return F.floor(F.lit(4096) * size / (size + F.lit(MIDDLE_WORDS))).cast("long")


def inclusion(part: Column, mean_lift: Column, size: Column) -> Column:
    """The chance of a further copy, larger for longer documents.

    ``mean_lift`` is the mean over the words of the source, so the expected words are exactly ``part`` of
    its words. The chance is above 0 and below 1 wherever ``part`` is.
    """
    return part + F.least(part, 1 - part) * (lift(size) - mean_lift) / F.lit(4096.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``, one row per source.

    Shares by weight stop at ``cap`` times the size; what is cut off is shared again. Sources are put
    in the order in which they reach their cap, so running sums give the final share directly. The
    windows hold one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = (cap * F.col("source_size")).cast("double")
    weighed = sizes.withColumn("weight", weight).withColumn("limit", limit)
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    numbered = weighed.withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    share = numbered.withColumn(
        "share",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    # The first source that its share does not overfill sets the share of all that follow.
    open_ended = F.when(F.col("limit") >= F.col("share") * F.col("weight"), F.struct("nth", "share"))
    share = share.withColumn("settled", F.coalesce(F.min(open_ended).over(everything)["share"], F.max("share").over(everything)))
    return share.select(*sizes.columns, F.least("limit", F.col("settled") * F.col("weight")).alias("target"))


def order_bin(u: Column, p: Column, scale: int) -> Column:
    """Odds of ``u`` over odds of ``p``, mapped to 0..1 and cut into ``scale`` bins."""
    top = u * (1 - p)
    whole = top + (1 - u) * p
    return F.floor(F.when(whole > 0, top / whole).otherwise(F.lit(1.0)) * F.lit(float(scale))).cast("long")


def mix_plan(rows: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per source: its target, the copies all its documents get, and which bins get one more.

    ``rows`` has (source, size, u), ``targets`` also ``mean_lift``. ``steps`` lists ranges of bins with the largest size taken there:
    a document that would overshoot is passed over, and smaller ones further on fill what is missing.
    The last round may overshoot if that is nearer than leaving the gap.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = targets.withColumn("whole", F.least(F.floor(ratio), F.lit(cap)).cast("long"))
    state = state.withColumn("part", ratio - F.col("whole"))
    state = state.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("at", F.lit(-1).cast("long"))
    state = stored(state.withColumn("steps", F.expr("cast(array() as array<struct<after:long,upto:long,most:double>>)")), "mix")
    for fill in range(1, ROUNDS + 1):
        last = fill == ROUNDS
        most = F.lit(float("inf")) if fill == 1 else F.col("_need") * (2 if last else 1)
        gain = F.col("upto") - F.col("n") / 2 if last else F.col("upto")
        side = state.select(*[F.col(c).alias(f"_{c}") for c in ("source", "part", "mean_lift", "need", "at")])
        binned = rows.join(side, rows["source"].eqNullSafe(side["_source"])).withColumn(
            "bin", order_bin(F.col("u"), inclusion(F.col("_part"), F.col("_mean_lift"), F.col("size")), BINS * BINS)
        ).where((F.col("bin") > F.col("_at")) & (F.col("size") <= most) & (F.col("size") > 0))

        def upto(part: DataFrame, key: Column) -> DataFrame:
            """Words up to the end of every bin of a source; at most ``BINS`` rows each."""
            sums = part.groupBy("_source", key.alias("b")).agg(F.sum("size").alias("n"), F.first("_need").alias("_need"))
            running = Window.partitionBy("_source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
            return sums.withColumn("upto", F.sum("n").over(running))

        coarse = upto(binned, F.floor(F.col("bin") / BINS)).groupBy("_source").agg(
            F.min(F.when(F.col("upto") > F.col("_need"), F.col("b"))).alias("open"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("_need"), F.col("upto"))), F.lit(0)).alias("done"),
        )
        coarse = stored(coarse, "mix")
        opened = coarse.select(F.col("_source").alias("_s"), "open", "done")
        fine = binned.join(opened, F.col("_source").eqNullSafe(F.col("_s"))).where(
            F.floor(F.col("bin") / BINS) == F.col("open")
        ).withColumn("_need", F.col("_need") - F.col("done"))
        fine = upto(fine, F.col("bin")).where(gain <= F.col("_need")).groupBy("_source").agg(
            F.max("b").alias("reached"), F.max("upto").alias("more")
        )
        found = opened.join(fine, F.col("_s").eqNullSafe(F.col("_source")), "left")
        found = found.select(
            "_s", F.coalesce("reached", F.col("open") * BINS - 1, F.lit(BINS * BINS)).alias("to"),
            (F.col("done") + F.coalesce("more", F.lit(0))).alias("got"),
        )
        step = F.struct(
            F.col("at").alias("after"), F.col("to").alias("upto"),
            (F.lit(float("inf")) if fill == 1 else F.col("need") * (2 if last else 1)).cast("double").alias("most"),
        )
        after = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "mean_lift", "whole", "part",
            (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.coalesce("to", "at").alias("at"),
            F.when(F.col("to").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(step))).alias("steps"),
        )
        after = stored(after, "mix")
        dropped(state, coarse)
        state = after
    return state


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target, copies and taken.

    ``copies`` is how often the mix holds the document, ``taken`` the words that makes.
    """
    docs = without(docs, *ADDED)
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_u", uniform(F.col("doc_id"), seed))
    rows = stored(sized.select("source", "size", F.col("_u").alias("u")), "sizes")
    mean_lift = F.coalesce(F.try_divide(F.sum(F.col("size") * lift(F.col("size"))), F.sum("size")), F.lit(0.0))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), mean_lift.alias("mean_lift"))
    plan = mix_plan(rows, source_targets(sizes, weights, cap), cap)
    dropped(rows)
    named = plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns])
    taken = F.exists(
        "_steps", lambda s: (F.col("_bin") > s["after"]) & (F.col("_bin") <= s["upto"]) & (F.col("size") <= s["most"])
    )
    copies = F.least(F.col("_whole") + F.when(taken & (F.col("size") > 0), 1).otherwise(0), F.lit(cap))
    joined = sized.join(named, sized["source"].eqNullSafe(named["_source"]), "left")
    joined = joined.withColumn("_bin", order_bin(F.col("_u"), inclusion(F.col("_part"), F.col("_mean_lift"), F.col("size")), BINS * BINS))
    return joined.withColumn("copies", copies.cast("long")).select(
        *[docs[c] for c in docs.columns], "size", F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    mixed = mix_sources(docs, **options)
    repeated = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[c for c in docs.columns])
