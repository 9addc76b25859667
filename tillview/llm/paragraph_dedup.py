"""Repeated passages: paragraphs with colliding MinHash bands, verified and clustered.

A text is cut into paragraphs where the two words at a place have the smallest hash of all places within four
words; ends of lines and sentences come before all other places. Where a cut falls depends only on the words
near it, so a passage is cut alike wherever it stands, and short lines are joined to paragraphs of five words
or more. Paragraphs have at most ``MOST_WORDS`` words. Bands are tuned from the similarity looked for: the fewest bands of the given rows whose
chance to miss a pair at that similarity is below one in fifty. Paragraphs that share a band are
compared exactly (Jaccard similarity of 5-word shingles) and connected groups are formed.

Reported, and marked for removal but for the first, are paragraphs of groups with two or more members,
if the run of such paragraphs in their document is long enough to be a passage and not a phrase.

Defined cases: null and empty texts have no paragraph; the first and the last paragraph of a
text take no part if they have fewer than ``LEAST_WORDS`` words; rows with equal ids count as one document; a document that repeats its own passage has it
reported, too; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.common import dropped, folded_words, map_rows, mixed, semi_join, stored, window_hashes, word_hashes
from tillview.llm.links import linked_groups
from tillview.llm.shingles import WIDTH, set_name, signed

SIMILARITY = 0.8
RECALL = 0.98
BAND_ROWS = 2
LEAST_WORDS = WIDTH
# A cut has the smallest hash among the possible ones this many words around it, so that every paragraph
# between two cuts has a shingle.
CUT_REACH = WIDTH - 1
# A reported run of repeated paragraphs has at least so many words.
RUN_WORDS = 16
# A longer stretch without a cut is cut again.
MOST_WORDS = 24
ENDS = (b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode())
# Quotes and brackets that may follow the end of a sentence.
CLOSING = "\"')]”’»」』".encode()
# A word that ends a sentence ends in one of these.
LAST_BYTES = frozenset(CLOSING) | {end[-1] for end in ENDS}


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Fewest bands of ``rows`` hashes that find a pair of this similarity with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def sentence_ends(words: list[bytes]) -> np.ndarray:
    """Whether each word ends a sentence; most words are settled by their last byte."""
    ends = np.zeros(len(words), dtype=bool)
    for k in [k for k, w in enumerate(words) if w[-1] in LAST_BYTES]:
        ends[k] = words[k].endswith(ENDS) or words[k].rstrip(CLOSING).endswith(ENDS)
    return ends


def cuts(words: list[bytes], hashes: np.ndarray, lines: np.ndarray) -> list[int]:
    """Word numbers before which a text is cut; ``lines`` marks words that start a line."""
    if len(words) < 2:
        return []
    pairs = mixed(hashes[:-1] + mixed(hashes[1:]))
    ends = sentence_ends(words[:-1]) | lines[1:]
    # Every place between two words may be a cut; ends of lines and sentences come before all others.
    marks = (pairs >> np.uint64(2)) + np.where(ends, np.uint64(0), np.uint64(1 << 62))
    padded = np.pad(marks, CUT_REACH, constant_values=np.uint64(2**64 - 1))
    least = np.lib.stride_tricks.sliding_window_view(padded, CUT_REACH).min(axis=1)
    n = len(marks)
    # Of equal hashes the first is the cut, so that repeated words are not cut everywhere.
    chosen = (marks < least[:n]) & (marks <= least[CUT_REACH + 1 :][:n])
    found, start = [], 0
    for end in [*(np.flatnonzero(chosen) + 1).tolist(), len(words)]:
        # Stretches without a cut are rare but for words that repeat.
        while end - start > MOST_WORDS:
            start += LEAST_WORDS + int(marks[start + LEAST_WORDS - 1 : start + MOST_WORDS - LEAST_WORDS].argmin())
            found.append(start)
        if end < len(words):
            found.append(end)
        start = end
    return found


def cut_text(text: str | None) -> tuple[list[bytes], np.ndarray, list[int]]:
    """Words of a text, their hashes, and where its paragraphs start and end."""
    lists = [folded_words(line) for line in (text or "").split("\n")]
    words = [w for line in lists for w in line]
    hashes = word_hashes().of(words)
    if not words:
        return words, hashes, []
    lines = np.zeros(len(words) + 1, dtype=bool)
    lines[np.cumsum([len(line) for line in lists])] = True
    return words, hashes, [0, *cuts(words, hashes, lines[:-1]), len(words)]


def paragraphs(text: str | None) -> list[tuple[int, list[bytes]]]:
    """(number of the first word, words) of every paragraph with words."""
    words, _, edges = cut_text(text)
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def shingle_rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lists of word hashes, one after the other, and where each list starts."""
    counts = np.array([len(x) for x in lists])
    windows = window_hashes(np.concatenate(lists), WIDTH)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[WIDTH - 1 :] == owner[: len(owner) - WIDTH + 1]
    sizes = counts - WIDTH + 1
    return windows[inside], np.cumsum(sizes) - sizes


def band_keys(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per list and band: the hash of ``rows`` minima under different hash functions."""
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        for row in range(rows):
            salt = mixed(np.array([band * rows + row + 1], dtype=np.uint64))
            least = np.minimum.reduceat(mixed(shingles ^ salt), starts)
            keys[:, band] = mixed(keys[:, band] + least + np.uint64(band))
    return keys


INDEX = "doc_id long, para int, first_word long, n_words int, node long, bands array<long>"


def paragraph_index(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per paragraph; copies within a batch list their bands once."""

    def run(batch):
        import pyarrow as pa

        for lo in range(0, batch.num_rows, 500):
            docs_, numbers, firsts, lists = [], [], [], []
            for doc, text in zip(batch.column(0).slice(lo, 500).to_pylist(), batch.column(1).slice(lo, 500), strict=True):
                _, hashes, edges = cut_text(text.as_py())
                for number, (first, end) in enumerate(zip(edges, edges[1:], strict=False)):
                    if end - first >= LEAST_WORDS:
                        docs_.append(doc)
                        numbers.append(number)
                        firsts.append(first)
                        lists.append(hashes[first:end])
            if not lists:
                continue
            shingles, starts = shingle_rows(lists)
            keys = signed(band_keys(shingles, starts, bands, rows))
            ends = np.append(starts[1:], len(shingles))
            names = [set_name(shingles[a:b]) for a, b in zip(starts, ends, strict=True)]
            seen: set[int] = set()
            fresh = [not (x in seen or seen.add(x)) for x in names]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_, pa.int64()), pa.array(numbers, pa.int32()), pa.array(firsts, pa.int64()),
                    pa.array([len(w) for w in lists], pa.int32()), pa.array(names, pa.int64()),
                    pa.array([k if f else None for k, f in zip(keys, fresh, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "para", "first_word", "n_words", "node", "bands"],
            )

    return map_rows(docs.select("doc_id", "text"), INDEX, run)


def paragraph_sets(docs: DataFrame) -> DataFrame:
    """(node, tokens): the distinct shingles of every paragraph."""

    def run(batch):
        import pyarrow as pa

        for text in batch.column("text"):
            _, hashes, edges = cut_text(text.as_py())
            lists = [hashes[a:b] for a, b in zip(edges, edges[1:], strict=False) if b - a >= LEAST_WORDS]
            if lists:
                shingles, starts = shingle_rows(lists)
                parts = [shingles[a:b] for a, b in zip(starts, np.append(starts[1:], len(shingles)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_name(p) for p in parts], pa.int64()), pa.array([signed(np.unique(p)) for p in parts], pa.list_(pa.int64()))],
                    names=["node", "tokens"],
                )

    return map_rows(docs.select("text"), "node long, tokens array<long>", run)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def set_bits(tokens: str) -> Column:
    """64 bits, one set by each token; sets that differ in n tokens differ in at most n of them."""
    return F.expr(f"aggregate({tokens}, 0L, (bits, t) -> bits | shiftleft(1L, cast(t & 63L as int)))")


def near_sets(x: Column, m: Column, y: Column, n: Column, similarity: float) -> Column:
    """Whether sets with these bits and sizes may be that similar; never false for sets that are.

    The union has at most ``least(m, n) / similarity`` tokens, and a share of ``1 - similarity`` of it may be in one set only.
    """
    return F.bit_count(x.bitwiseXOR(y)) * similarity <= (1 - similarity) * F.least(m, n) + 1e-9


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, para, first_word, n_words, kept_doc_id, kept) of all paragraphs that occur repeatedly."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = stored(paragraph_index(docs, tuned_bands(similarity), BAND_ROWS), "paragraphs")

    rows = index.where("bands is not null").select(F.explode("bands").alias("bucket"), "node")
    bucket = Window.partitionBy("bucket")
    shared = rows.withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket))
    buckets = stored(shared.where("low <> high").select("bucket", "node").distinct(), "buckets")
    nodes = stored(buckets.select("node").distinct(), "nodes")
    wanted = index.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    found = paragraph_sets(semi_join(docs, wanted, ["doc_id"]))
    sets = stored(semi_join(found, nodes, ["node"]).dropDuplicates(["node"]), "sets")
    # Most nodes of a bucket are far from similar; their bits tell before any pair is written.
    marked = sets.select("node", set_bits("tokens").alias("bits"), F.size("tokens").alias("size"))
    marked = stored(buckets.join(marked, "node").select("bucket", "node", "bits", "size"), "marked")
    groups = linked_groups(
        marked, lambda pairs: similar_pairs(pairs, sets, similarity), lambda *sides: near_sets(*sides, similarity)
    )

    # Occurrences are counted before they are joined, so a frequent paragraph is one row on this side.
    counted = index.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "para")).alias("first"))
    placed = counted.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stored(placed, "placed")
    clusters = placed.groupBy("comp").agg(F.sum("n").alias("n"), F.min("first").alias("kept_at")).where("n > 1")
    repeated = stored(placed.select("node", "comp").join(clusters.select("comp", "kept_at"), "comp").select("node", "kept_at"), "repeated")
    hits = index.drop("bands").join(repeated, "node")
    # Paragraphs that follow each other in one document form a run.
    place = Window.partitionBy("doc_id").orderBy("first_word")
    edge = F.coalesce(F.lag(F.col("first_word") + F.col("n_words")).over(place) != F.col("first_word"), F.lit(True))
    runs = hits.withColumn("edge", edge.cast("int")).withColumn("run", F.sum("edge").over(place))
    runs = runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "run")))
    dropped(buckets, nodes, sets, marked, placed, groups)
    return runs.where(F.col("run_words") >= RUN_WORDS).select(
        "doc_id", "para", "first_word", "n_words", F.col("kept_at.doc_id").alias("kept_doc_id"),
        ((F.col("kept_at.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("kept_at.para") == F.col("para"))).alias("kept"),
    )
