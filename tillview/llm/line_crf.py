"""Document quality from a linear-chain conditional random field over lines.

Every line of a text with a word in it is good or bad. Its features are its own shape, that of the lines
before and after it, and how far it differs from them; neighbouring labels depend on each other. Training
knows the quality of documents only: in a good one all lines are good, in a bad one at least one is bad,
whichever they are. The likelihood of that is exact, by the forward-backward recursion.

Scoring weighs the marginal probabilities of the lines by their length. A logistic curve, fitted to the
same training documents, turns the weighted mean into the probability that a document is of label 1.

The model is fitted on at most ``TRAIN_DOCS`` labelled documents of each label, those first in an order by
hash, and within each on at most ``TRAIN_LINES`` neighbouring lines from a place drawn by hash. Both are
parameters. Scores always come from all lines.

Defined cases: a text that is null, empty or blank has no lines; its score is the smoothed share of label 1
among such training documents. Labels that are neither 0 nor 1, and ids with labels of both kinds, are not
used; of several documents with one id the text that sorts first is learned from. Without labels of both
kinds every score is the smoothed share of label 1. Labels, languages, sources and ids are no features. An
empty table gives an empty table. Other columns pass through; input columns named like an added one are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.llm.common import add_columns, map_rows, mixed

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
TRAIN_DOCS, TRAIN_LINES = 1500, 256
STEPS, PENALTY = 60, 0.5
# Bytes of the texts that are measured together.
SLICE_BYTES = 1 << 20
ADDED = {"score": "double", "n_lines": "long", "line_good": "array<float>"}

# Classes of bytes: 0 control, then those named here; the bytes of other letters come last.
CLASSES = [b" \t\v\f\r\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:'\"()-", b"!?"]
SPACE, LOWER, UPPER, DIGIT, SYMBOL, MARK, LOUD, SIGN, LEAD, TRAIL = range(1, 11)
SHAPES = (
    "length", "words", "word_length", "lower", "upper", "digit", "symbol", "mark", "loud", "sign", "other", "space", "repeated",
    "distinct", "seen", "ends", "opens",
)


def byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[33:127] = SIGN
    table[0x80:0xC0] = TRAIL
    table[0xC0:] = LEAD
    for n, members in enumerate(CLASSES, SPACE):
        table[list(members)] = n
    return table


CLASS_OF = byte_classes()
HASH_OF = np.where(CLASS_OF == SPACE, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1))


@dataclass
class Lines:
    """Lines with a word of some texts: shapes, sizes in characters, and where each text begins."""

    shapes: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray  # one more than texts


def lines_of(texts: list[str | None]) -> Lines:
    """Measures of all lines of some texts, from their bytes."""
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buffer = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
    text_ends = np.cumsum([len(d) + 1 for d in data])
    kind = CLASS_OF[buffer]
    line_starts = np.concatenate([[0], np.flatnonzero(buffer == 10) + 1])[:-1].astype(np.int64)
    if not len(line_starts):
        return Lines(np.zeros((0, len(SHAPES))), np.zeros(0), np.zeros(len(texts) + 1, dtype=np.int64))

    def per_line(flags):
        return np.add.reduceat(flags, line_starts, dtype=np.int64)

    filled = per_line(kind != SPACE) > 0
    of_text = np.searchsorted(text_ends, line_starts, side="right")[filled]
    starts = np.searchsorted(of_text, np.arange(len(texts) + 1))
    if not filled.any():
        return Lines(np.zeros((0, len(SHAPES))), np.zeros(0), starts)
    count = {k: per_line(kind == k)[filled] for k in range(11)}
    # The line end counts as a space; it is no character of the line.
    chars = np.sum([count[k] for k in range(10)], axis=0) - 1
    firsts = (kind != SPACE) & np.concatenate([[True], kind[:-1] == SPACE])
    word_starts = np.flatnonzero(firsts)
    word_line = np.searchsorted(line_starts, word_starts, side="right") - 1
    number = (np.cumsum(filled) - 1)[word_line]
    n_words = np.bincount(number, minlength=len(chars))
    # Place in the word; what comes before the first word is space and has no part in any hash.
    bounds = np.concatenate([[0], word_starts])
    place = np.arange(len(buffer)) - np.repeat(bounds, np.diff(bounds, append=len(buffer)))
    hashes = mixed(np.add.reduceat(HASH_OF[buffer] * (2 * place.astype(np.uint64) + np.uint64(1)), word_starts))
    again = (hashes[1:] == hashes[:-1]) & (number[1:] == number[:-1])
    repeated = np.bincount(number[1:][again], minlength=len(chars))
    keys = mixed(hashes + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    distinct = np.bincount(number[order][fresh], minlength=len(chars))
    line_words = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    in_line = np.arange(len(number)) - np.repeat(line_words, n_words)
    whole = np.add.reduceat(hashes * (2 * in_line.astype(np.uint64) + np.uint64(1)), line_words)
    whole = mixed(whole + of_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen = np.ones(len(whole))
    seen[np.unique(whole, return_index=True)[1]] = 0
    visible = np.flatnonzero(kind != SPACE)
    line_of_visible = np.searchsorted(line_starts, visible, side="right") - 1
    last = kind[visible[np.flatnonzero(np.concatenate([line_of_visible[1:] != line_of_visible[:-1], [True]]))]]
    first = kind[word_starts[line_words]]
    whole_chars = np.maximum(chars, 1)
    shapes = np.stack(
        [
            np.log1p(chars), np.log1p(n_words), np.log1p((chars - count[SPACE] + 1) / n_words),
            *[count[k] / whole_chars for k in (LOWER, UPPER, DIGIT, SYMBOL, MARK, LOUD, SIGN)],
            (count[LEAD] + count[0]) / whole_chars, (count[SPACE] - 1) / whole_chars, repeated / n_words, distinct / n_words, seen,
            (last == MARK) | (last == LOUD), (first == UPPER) | (first == DIGIT) | (first == LEAD),
        ],
        axis=1,
    ).astype(np.float64)
    return Lines(shapes, chars.astype(np.float64), starts)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Features of each line: its shape, those of the lines around it, and the size of the differences."""
    shapes, n = lines.shapes, len(lines.shapes)
    opens = np.zeros(n, dtype=bool)
    opens[lines.starts[:-1][lines.starts[:-1] < lines.starts[1:]]] = True
    closes = np.concatenate([opens[1:], [True]])[:n]
    before = np.where(opens[:, None], shapes, np.roll(shapes, 1, axis=0))
    after = np.where(closes[:, None], shapes, np.roll(shapes, -1, axis=0))
    return np.hstack([
        shapes, before, after, np.abs(shapes - before), np.abs(shapes - after), opens[:, None], closes[:, None], np.ones((n, 1)),
    ])


class Chain:
    """Forward-backward sums over the labelings of many texts at once, two labels a line.

    Texts are ordered by length, so that the n-th lines of all texts that have one are neighbours in time.
    """

    def __init__(self, starts: np.ndarray):
        self.starts = starts
        self.sizes = np.diff(starts)
        order = np.argsort(-self.sizes, kind="stable")
        first, sizes = starts[:-1][order], self.sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        # The texts with more than t lines are the first of them.
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
        self.at = [first[:k] + t for t, k in enumerate(alive.tolist())]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def run(self, bad_good: np.ndarray, links: np.ndarray):
        """Log of the sum over labelings by text, marginals of good, and pair marginals by line.

        ``bad_good`` is the log odds of good by line alone, ``links`` the log weights of neighbours.
        """
        n = len(bad_good)
        top = np.maximum(bad_good, 0)
        own = np.stack([np.exp(-top), np.exp(bad_good - top)], axis=1)
        weight = np.exp(links - links.max())
        forward, backward, scale = np.ones((n, 2)), np.ones((n, 2)), np.ones(n)
        for t, at in enumerate(self.at):
            state = own[at] if t == 0 else (forward[at - 1] @ weight) * own[at]
            scale[at] = total = state.sum(axis=1)
            forward[at] = state / total[:, None]
        for t in range(len(self.at) - 1, 0, -1):
            at = self.at[t]
            backward[at - 1] = ((own[at] * backward[at]) @ weight.T) / scale[at][:, None]
        marginal = forward * backward
        marginal /= marginal.sum(axis=1, keepdims=True)
        sums = np.bincount(self.owner, np.log(scale) + top, len(self.sizes))
        sums += np.maximum(self.sizes - 1, 0) * links.max()
        later = np.ones(n, dtype=bool)
        later[self.starts[:-1][self.sizes > 0]] = False
        here = np.flatnonzero(later)
        pairs = forward[here - 1][:, :, None] * weight * (own[here] * backward[here])[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        return sums, marginal[:, 1], pairs, self.owner[here]


def minimised(function, start: np.ndarray, steps: int = STEPS, kept: int = 10) -> np.ndarray:
    """A low point of ``function`` (value and gradient) by limited-memory quasi-Newton steps."""
    x, (value, slope) = start, function(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, factors = slope.copy(), []
        for s, y in reversed(moves):
            factors.append((s @ step) / (s @ y))
            step -= factors[-1] * y
        step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), factor in zip(moves, reversed(factors), strict=True):
            step += (factor - (y @ step) / (s @ y)) * s
        length = 1.0
        while length > 1e-6:
            trial = x - length * step
            new, new_slope = function(trial)
            if np.isfinite(new) and new <= value - 1e-4 * length * (slope @ step):
                break
            length /= 2
        else:
            break
        s, y = trial - x, new_slope - slope
        if s @ y > 1e-10:
            moves = [*moves, (s, y)][-kept:]
        done = value - new < 1e-7 * abs(value)
        x, value, slope = trial, new, new_slope
        if done:
            break
    return x


@dataclass
class Model:
    """What scoring needs: feature scales, line weights, neighbour weights, and the curve of documents."""

    share: float
    empty: float
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    links: np.ndarray | None = None
    curve: tuple[float, float] = (0.0, 1.0)

    def features(self, lines: Lines) -> np.ndarray:
        return np.clip((with_neighbours(lines) - self.middle) / self.spread, -8, 8)

    def marginals(self, lines: Lines) -> np.ndarray:
        """Probability that a line is good, by line."""
        if not len(lines.shapes):
            return np.zeros(0)
        return Chain(lines.starts).run(self.features(lines) @ self.weights, self.links)[1]

    def weighted(self, lines: Lines, good: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted share of good, by text; only for texts with lines."""
        weights, texts = np.maximum(lines.sizes, 1), len(lines.starts) - 1
        owner = np.repeat(np.arange(texts), np.diff(lines.starts))
        bad = np.bincount(owner, weights * (1 - good), texts) / np.maximum(np.bincount(owner, weights, texts), 1)
        bad = np.clip(bad, 1e-4, 1 - 1e-4)
        return np.log((1 - bad) / bad)

    def scores(self, lines: Lines, good: np.ndarray) -> np.ndarray:
        none = np.diff(lines.starts) == 0
        if self.weights is None:
            return np.full(len(none), self.share)
        offset, slope = self.curve
        return np.where(none, self.empty, 1 / (1 + np.exp(-(offset + slope * self.weighted(lines, good)))))


def fit(lines: Lines, quality: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Model:
    """A model of texts of known quality; ``weight`` makes up for sampling the labels unequally."""
    total, ones = float(weight.sum()), float((weight * quality).sum())
    share = (ones + 1) / (total + 2)
    none = np.diff(lines.starts) == 0
    empty = (float((weight * quality)[none].sum()) + share) / (float(weight[none].sum()) + 1)
    model = Model(share, empty)
    if len(set(quality[~none].tolist())) < 2:
        return model
    features = with_neighbours(lines)
    model.middle, model.spread = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-3)
    model.middle[-1], model.spread[-1] = 0, 1
    x = model.features(lines)
    chain, sizes, width = Chain(lines.starts), np.diff(lines.starts), x.shape[1]
    good = quality == 1
    # Both labels weigh the same in training, the curve puts the true shares back.
    balance = np.where(none, 0, 1 / np.where(good, (good & ~none).sum(), (~good & ~none).sum())) * len(good) / 2

    def loss(theta):
        weights, links = theta[:width], theta[width:].reshape(2, 2)
        odds = x @ weights
        sums, marginal, pairs, pair_owner = chain.run(odds, links)
        all_good = np.bincount(chain.owner, odds, len(sizes)) + np.maximum(sizes - 1, 0) * links[1, 1]
        log_p = np.minimum(all_good - sums, -1e-9)
        log_rest = np.where(log_p > -0.7, np.log(-np.expm1(log_p)), np.log1p(-np.exp(log_p)))
        value = -(balance * np.where(good, log_p, log_rest)).sum() + PENALTY * (weights[:-1] @ weights[:-1] + (links**2).sum())
        pull = balance * np.where(good, -1, np.exp(np.minimum(log_p - log_rest, 12)))
        slope = x.T @ (pull[chain.owner] * (1 - marginal)) + 2 * PENALTY * np.append(weights[:-1], 0)
        of_links = -np.tensordot(pull[pair_owner], pairs, axes=1)
        of_links[1, 1] += (pull * np.maximum(sizes - 1, 0)).sum()
        return value, np.concatenate([slope, (of_links + 2 * PENALTY * links).ravel()])

    start = np.zeros(width + 4)
    # A line is good by default, so that long texts do not begin as surely bad.
    start[width - 1] = 3.0
    theta = minimised(loss, start, steps)
    model.weights, model.links = theta[:width], theta[width:].reshape(2, 2)
    z = model.weighted(lines, model.marginals(lines))[~none]
    w, q = weight[~none], quality[~none]

    def curve(v):
        t = v[0] + v[1] * z
        error = w * (1 / (1 + np.exp(-t)) - q)
        value = (w * (np.logaddexp(0, t) - q * t)).sum() + 1e-2 * (v[1] - 1) ** 2
        return value, np.array([error.sum(), (error * z).sum() + 2e-2 * (v[1] - 1)])

    model.curve = tuple(minimised(curve, np.array([0.0, 1.0]), 100).tolist())
    return model


def fold(doc_id: Column) -> Column:
    """Part of a document by its id: the CRC-32 of the id as text, modulo ``FOLDS``; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """Texts of up to ``most`` training ids of each label, and how many training ids have each label."""
    known = labels.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.where("quality = _most").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("quality") == label).orderBy(*order).limit(most) for label in (0, 1)]
    # At most twice ``most`` ids.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return texts, counts


def trained(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Model:
    """A model of the labelled documents outside the held-out part."""
    texts, counts = training_sample(docs, labels, most_docs)

    def run(batch):
        import pyarrow as pa

        ids, quality, rows = [], [], []
        for doc_id, label, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            lines = lines_of([text])
            table = np.hstack([lines.shapes, lines.sizes[:, None]])
            # A run of lines, if there are too many to learn from.
            room = len(table) - most_lines
            if room > 0:
                lo = int(mixed(np.array([doc_id & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0] % np.uint64(room + 1))
                table = table[lo : lo + most_lines]
            ids.append(doc_id)
            quality.append(label)
            rows.append(table.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "quality", "data"]
        )

    plain = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    # At most ``most_docs`` x 2 rows of ``most_lines`` lines each reach the driver.
    rows = sorted(map_rows(plain, "doc_id long, quality int, data binary", run).collect())
    tables = [np.frombuffer(r["data"], np.float32).reshape(-1, len(SHAPES) + 1).astype(np.float64) for r in rows]
    table = np.concatenate([np.zeros((0, len(SHAPES) + 1)), *tables])
    lines = Lines(table[:, :-1], table[:, -1], np.cumsum([0, *map(len, tables)]))
    quality = np.array([r["quality"] for r in rows], dtype=np.int64)
    taken = np.bincount(quality, minlength=2)
    weight = np.array([counts.get(q, 0) / taken[q] for q in quality.tolist()])
    return fit(lines, quality, weight)


def scored_lines(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the number of lines with a word, and the probability of good of each."""

    def run(texts):
        import pyarrow as pa

        scores, counts, good_lines = [], [], []
        held, size = [], 0

        def measure():
            lines = lines_of(held)
            good = model.marginals(lines) if model.weights is not None else np.full(len(lines.shapes), model.share)
            scores.append(model.scores(lines, good))
            counts.append(np.diff(lines.starts))
            good_lines.append(good)

        for value in texts.to_pylist():
            if held and size + len(value or "") > SLICE_BYTES:
                measure()
                held, size = [], 0
            held.append(value)
            size += len(value or "")
        if held:
            measure()
        n_lines = np.concatenate([np.zeros(0, np.int64), *counts])
        ends = pa.array(np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int32))
        good = pa.array(np.concatenate([np.zeros(0), *good_lines]).astype(np.float32))
        return [np.concatenate([np.zeros(0), *scores]), n_lines, pa.ListArray.from_arrays(ends, good)]

    return add_columns(docs, [text], ADDED, run)


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` scored by a model of ``labels``, with ``held_out`` and the label ``predicted``."""
    scored = scored_lines(docs, trained(docs, labels))
    scored = scored.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
