"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as those of another.

Both tokenizers read the whole text. Where a token of each ends at the same byte and both next tokens
begin with a space, the text is cut. Between two cuts lies a window: a few ids of each side, nearly
always one word. Its alignment depends on the ids alone, so it is worked out once per task and looked
up by the ids after that. A window of many tokens (text without spaces) is worked out every time.

How often an id pair is linked is counted over all documents. Pairs that many documents hold are
broadcast, up to ``HOT_PAIRS`` of them; documents meet the rest by a shuffled join, in which no key can
be as frequent as a broadcast one.

Defined cases: null and empty texts, and texts that one of the two does not give back byte for byte,
have no tokens: counts of 0 and empty groups. Rows with equal ids are documents of their own. An empty
table gives an empty table. Other columns pass through; input columns named like an added one are
replaced.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.common import add_columns, stored, without
from tillview.llm.subwords import BYTE_UNITS, vocabulary_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Windows of more ids are not kept.
LONGEST_KNOWN = 64
# Kept windows of one task; the table is emptied when it has more.
KNOWN_WINDOWS = 1 << 17
# Characters of the texts that are aligned together.
SLICE_CHARS = 1 << 19
# Most pairs that are broadcast, at 17 bytes each.
HOT_PAIRS = 1 << 18
# Marks ids of B in the key of a window.
B_MARK = np.uint32(1 << 31)

ALIGNED = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
    "pairs": "array<long>", "times": "array<int>",
}


class ByteLevel:
    """The byte-level tokenizer of a vocabulary file; its ids are in the order of its merges.

    Names of special tokens in a text are plain text.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["content"] for t in told["added_tokens"]}
        byte_of = {chr(unit): byte for byte, unit in BYTE_UNITS.items()} | {chr(b): b for b in range(256) if b not in BYTE_UNITS}
        ranks = {bytes(map(byte_of.__getitem__, name)): n for name, n in told["model"]["vocab"].items() if name not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for data, n in ranks.items():
            self.bytes[n] = data
        self.coding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.coding.encode_to_numpy(text, disallowed_special=())


class Pieces:
    """The sentence-piece tokenizer of a model file, which puts a space before every text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if model.is_byte(n) else name.replace("▁", " ").encode()
            for n, name in enumerate(names)
        ]
        self.model = model

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Side:
    """One tokenizer with the bytes of its tokens."""

    def __init__(self, tokenizer):
        self.encode, self.bytes = tokenizer.encode, tokenizer.bytes
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.spaced = np.array([b.startswith(b" ") for b in self.bytes])

        # The bytes of all tokens in one row, and where each begins.
        self.pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or ends[-1] != len(data):
            return False
        at = np.repeat(self.places[ids] - ends + sizes, sizes) + np.arange(len(data))
        return self.pool[at].tobytes() == data


class Windows:
    """Alignments of windows by the packed ids of both sides: texts, numbers of groups, linked pairs."""

    def __init__(self, a: Side, b: Side, most: int = KNOWN_WINDOWS):
        self.a, self.b, self.most = a, b, most
        # What follows an id in the text of its group, for ids of A and then of B.
        self.written = [f"{n}{mark}" for side, last in ((a, "|"), (b, ";")) for mark in (",", last) for n in range(len(side.bytes))]
        self.lengths = np.array([len(w) for w in self.written], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.n_groups = np.zeros(0, dtype=np.int64)
        self.link_ends = np.zeros(1, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """Numbers of windows; those met for the first time are aligned in one go."""
        found = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = dict.fromkeys(keys[k] for k in missing)
            new = dict(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
            self.align(list(new))
            found[missing] = [new[keys[k]] for k in missing]
            self.known.update((key, number) for key, number in new.items() if len(key) <= 4 * LONGEST_KNOWN)
        return found

    def align(self, keys: list[bytes]) -> None:
        """Append the alignments of windows, which are laid one behind the other."""
        ids = np.frombuffer(b"".join(keys), dtype=np.uint32)
        from_b = ids >= B_MARK
        a, b = ids[~from_b].astype(np.int64), (ids[from_b] ^ B_MARK).astype(np.int64)
        tokens = np.cumsum([len(key) // 4 for key in keys])
        tokens_a = np.cumsum(~from_b)[tokens - 1]
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        # Between two neighbouring ends lies one token of each side: one link.
        ends = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        windows = ends_a[tokens_a - 1]
        groups = np.searchsorted(shared, windows) + 1
        # Tokens of A that a group starts after, and the same for B, place every id in the text.
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        codes = np.zeros(len(ids), dtype=np.int64)
        before_b = np.concatenate([[0], last_b + 1])
        codes[np.arange(len(a)) + before_b[group_a]] = a + len(self.a.bytes) * (last_a[group_a] == np.arange(len(a)))
        ids_b = b + len(self.b.bytes) * (last_b[group_b] == np.arange(len(b))) + 2 * len(self.a.bytes)
        codes[np.arange(len(b)) + last_a[group_b] + 1] = ids_b
        text = "".join(map(self.written.__getitem__, codes.tolist()))
        at = np.cumsum(self.lengths[codes])[tokens - 1].tolist()
        self.texts += [text[p:q] for p, q in zip([0, *at], at, strict=False)]
        self.n_groups = np.concatenate([self.n_groups, np.diff(groups, prepend=0)])
        self.link_ends = np.concatenate([self.link_ends, len(self.links) + np.searchsorted(ends, windows) + 1])
        self.links = np.concatenate([self.links, links])


class Aligner:
    """Both tokenizers and the known windows of one task."""

    def __init__(self, a_path: str, b_path: str, most: int = KNOWN_WINDOWS):
        self.a, self.b = Side(ByteLevel(a_path)), Side(Pieces(b_path))
        self.windows = Windows(self.a, self.b, most)

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of some texts, one side after the other; none unless both give the text back."""
        none = np.zeros(0, dtype=np.uint32)
        data = [f" {text}".encode() if text else b"" for text in texts]
        of_b = [np.array(self.b.encode(text), dtype=np.uint32) if text else none for text in texts]
        fine = [self.b.spells(b, d) for b, d in zip(of_b, data, strict=True)]
        of_a = [self.a.encode(f" {text}") if ok else none for text, ok in zip(texts, fine, strict=True)]
        # Byte-level tokens are pieces of the text itself, so their sizes tell whether they are all of it.
        fine = [ok and int(self.a.sizes[a].sum()) == len(d) for a, ok, d in zip(of_a, fine, data, strict=True)]
        return [(a, b) if ok else (none, none) for a, b, ok in zip(of_a, of_b, fine, strict=True)]

    def keys(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Packed ids of every window of a text, in order."""
        if not len(a):
            return []
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        before_a = ends_a[:-1][self.a.spaced[a[1:]]]
        before_b = ends_b[:-1][self.b.spaced[b[1:]]]
        anchors = np.intersect1d(before_a, before_b, assume_unique=True)
        cuts_a = np.concatenate([np.searchsorted(ends_a, anchors) + 1, [len(a)]])
        cuts_b = np.concatenate([np.searchsorted(ends_b, anchors) + 1, [len(b)]])
        # The ids of A of a window come before those of B, so an id of B has all of A up to the cut before it.
        from_b = np.zeros(len(a) + len(b), dtype=bool)
        from_b[np.arange(len(b)) + np.repeat(cuts_a, np.diff(cuts_b, prepend=0))] = True
        laid = np.empty(len(from_b), dtype=np.uint32)
        laid[from_b], laid[~from_b] = b | B_MARK, a
        packed, ends = laid.tobytes(), (4 * (cuts_a + cuts_b)).tolist()
        return [packed[p:q] for p, q in zip([0, *ends], ends, strict=False)]

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Values of the added columns for some texts."""
        if len(self.windows.texts) > self.windows.most:
            self.windows.clear()
        ids = self.ids(texts)
        keys = [self.keys(a, b) for a, b in ids]
        numbers = self.windows.numbers([key for part in keys for key in part])
        lo, rows = 0, []
        for (a, b), part in zip(ids, keys, strict=True):
            at = numbers[lo : lo + len(part)]
            lo += len(part)
            starts, sizes = self.windows.link_ends[at], self.windows.link_ends[at + 1] - self.windows.link_ends[at]
            total = int(sizes.sum())
            places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
            pairs, times = np.unique(self.windows.links[places], return_counts=True)
            groups = "".join(map(self.windows.texts.__getitem__, at.tolist()))
            rows.append((len(a), len(b), int(self.windows.n_groups[at].sum()), total, groups[:-1], pairs, times))
        return rows


def text_slices(texts: list[str | None], most: int = SLICE_CHARS):
    """Neighbouring texts of up to ``most`` characters together, or a single longer one."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def align_tokens(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with the alignment of both tokenizers.

    ``groups`` lists the smallest spans in which both sides begin and end together, as ids in order:
    ``a1,a2|b1;a3|b2,b3``. ``pairs`` holds the distinct linked id pairs ``a << 32 | b``, ``times`` how often
    each is linked in the text.
    """
    a_path, b_path = a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)

    def run(aligner, texts):
        import pyarrow as pa

        rows = [row for part in text_slices(texts.to_pylist()) for row in aligner.align(part)]
        n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*rows, strict=True) if rows else [()] * 7
        ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        flat = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind))
        return [
            n_a, n_b, n_groups, n_links, groups, pa.ListArray.from_arrays(ends, flat(pairs, np.int64)),
            pa.ListArray.from_arrays(ends, flat(times, np.int32)),
        ]

    return add_columns(docs, [text], ALIGNED, run, start=lambda: Aligner(a_path, b_path))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """For each id pair the documents that hold it linked, and whether its A id has no pair in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = stored(counts, "pair-counts").withColumn("_a", F.shiftright("pair", 32))
    # One row per id of A at most, so the vocabulary bounds what is broadcast.
    most = counts.groupBy("_a").agg(F.max("n_docs").alias("_most"))
    joined = counts.join(F.broadcast(most), "_a")
    return joined.select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def hot_limit(counts: DataFrame, most: int) -> int:
    """The least power of two of documents that at most ``most`` pairs are found in."""
    # At most 64 rows reach the driver.
    steps = counts.groupBy(F.floor(F.log2("n_docs")).alias("step")).count().collect()
    held, limit = 0, 1 << 62
    for step, n in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        held += n
        if held > most:
            return limit
        limit = 1 << step
    return 1


def link_scores(aligned: DataFrame, counts: DataFrame, most_hot: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair no other pair of the A id beats) and ``count_sum``.

    ``counts`` comes from ``pair_counts``; both tables are read twice, so they should be stored ones.
    """
    spark = aligned.sparkSession
    least = hot_limit(counts, most_hot)
    hot = counts.where(F.col("n_docs") >= least).orderBy("pair").toPandas()
    held = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n_docs"].to_numpy(np.int64), hot["best"].to_numpy(bool)))

    def run(pairs, times):
        known, n_docs, best = held.value
        import pyarrow as pa

        ends = pairs.offsets.to_numpy().astype(np.int64)
        flat = pairs.values.to_numpy()[ends[0] : ends[-1]]
        links = times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()].astype(np.int64)
        ends = ends - ends[0]
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        found = known[at] == flat if len(known) else np.zeros(len(flat), dtype=bool)
        sums = []
        for value in (best, n_docs):
            part = np.where(found, value[at] * links, 0) if len(known) else np.zeros(len(flat), np.int64)
            total = np.concatenate([[0], np.cumsum(part)])
            sums.append(total[ends[1:]] - total[ends[:-1]])
        left = pa.array(np.concatenate([[0], np.cumsum(~found)])[ends].astype(np.int32))
        rest = [pa.ListArray.from_arrays(left, pa.array(x[~found])) for x in (flat, links)]
        return [*sums, *rest]

    added = {"n_best": "long", "count_sum": "long", "_rest": "array<long>", "_rest_times": "array<long>"}
    scored = add_columns(aligned, ["pairs", "times"], added, run)
    if least == 1:
        return scored.drop("_rest", "_rest_times")
    # Rows of a stored table have a place of their own to be put together by.
    scored = stored(without(scored, "pairs", "times").withColumn("_row", F.monotonically_increasing_id()), "pair-scores")
    links = scored.select("_row", F.explode(F.arrays_zip("_rest", "_rest_times")).alias("x"))
    links = links.select("_row", F.col("x._rest").alias("pair"), F.col("x._rest_times").alias("times"))
    more = links.join(counts.where(F.col("n_docs") < least), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("_sum"),
    )
    whole = scored.join(more, "_row", "left")
    for name, extra in (("n_best", "_best"), ("count_sum", "_sum")):
        whole = whole.withColumn(name, F.col(name) + F.coalesce(extra, F.lit(0)))
    return whole.drop("_row", "_rest", "_rest_times", "_best", "_sum")
