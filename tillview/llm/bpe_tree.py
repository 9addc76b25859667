"""BPE encoding and decoding: long unsplit text is encoded in pieces and put together as a tree.

A stretch without white space has no place where it may safely be cut, and plain encoders slow down
on long ones. So it is halved until pieces are short, all pieces are encoded in one batch, and
neighbours are joined from the bottom up: a window around the join is encoded again and grows until
its tokens agree with both sides. What lies left of the agreement comes from the left half, what
lies right of it from the right half.

Why agreement is exact: the pre-tokenizer reads from left to right, so two readings that both start
a pre-token at the same place stay together from there on. Inside a pre-token, a token sequence is
the encoding of its text exactly if every two neighbouring tokens are the encoding of theirs; all
neighbours of the joined sequence are neighbours in one of the three encodings. A token counts as
shared only where no cut can have changed how the pre-tokenizer reads the characters before it.

Defined cases: a null text is an empty one and has no ids; an unknown id raises; equal texts get equal
ids; other columns pass through, and input columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tillview.llm.common import add_columns, byte_words, worker_value
from tillview.llm.subwords import PackedCoder, SubwordCoder, vocabulary_path, whole_tokenizer

# Stretches up to this many bytes are encoded as they are.
LEAF_BYTES = 256
WINDOW_BYTES = 32
# Known stretches of one task: of texts with a stretch beyond a leaf, and of all others, parts of stretches included.
KNOWN_WORDS = 1 << 17
PACKED_WORDS = 1 << 19


@dataclass
class Piece:
    """Ids of the bytes ``lo`` to ``hi`` of a stretch, encoded as if they stood alone."""

    lo: int
    hi: int
    ids: list[int]
    starts: list[int]


def bare_tokenizer(path: str):
    """The tokenizer of a file without its normalizer; names of its ids, whether they end a word, and their bytes."""
    from tokenizers import normalizers

    bare = whole_tokenizer(path)
    bare.normalizer = normalizers.Sequence([])
    names = [bare.id_to_token(i) or "" for i in range(bare.get_vocab_size(with_added_tokens=True))]
    return bare, names, [name.endswith("</w>") for name in names], [len(name.removesuffix("</w>")) for name in names]


class TreeCoder:
    """Encodes and decodes texts with a tokenizer file; see the module text for the method."""

    def __init__(self, path: str, leaf: int = LEAF_BYTES):
        import regex

        self.leaf = leaf
        # The tables of known words belong to this coder and go with it.
        self.words = SubwordCoder(path, KNOWN_WORDS)
        self.packed = PackedCoder(self.words, PACKED_WORDS)
        self.normal = self.words.tokenizer.normalizer
        self.bare, self.names, self.ends, self.bytes = worker_value(f"bare:{path}", lambda: bare_tokenizer(path))
        self.letters = regex.compile(r"\p{L}+")
        self.marks = regex.compile(r"[^\s\p{L}\p{N}']+")

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        stretches = byte_words(text)
        if max(map(len, stretches), default=0) <= self.leaf:
            return self.packed.ids(stretches)
        ids: list[int] = []
        for stretch in stretches:
            if len(stretch) <= self.leaf:
                ids += self.words[stretch]
            else:
                ids += self.long(stretch.decode("utf-8", "replace"))
        return np.array(ids, dtype=np.uint32)

    def long(self, stretch: str) -> list[int]:
        """Ids of a stretch; names of added tokens in it, and rare spaces, split it further."""
        ids, at = [], 0
        for name in self.words.added.finditer(stretch):
            ids += self.long(stretch[at : name.start()]) if name.start() > at else []
            ids.append(self.bare.token_to_id(name.group()))
            at = name.end()
        for part in self.normal.normalize_str(stretch[at:]).split(" "):
            ids += self.tree(part.encode())
        return ids

    def tree(self, data: bytes) -> list[int]:
        """Ids of a normalised stretch."""
        if not data:
            return []
        cuts = [0, len(data)]
        while any(b - a > self.leaf for a, b in zip(cuts, cuts[1:], strict=False)):
            cuts = sorted({*cuts, *(self.whole(data, (a + b) // 2) for a, b in zip(cuts, cuts[1:], strict=False))})
            if len(cuts) > len(data):
                break
        spans = list(zip(cuts, cuts[1:], strict=False))
        batch = self.bare.encode_batch_fast([data[a:b].decode() for a, b in spans], add_special_tokens=False)
        pieces = [self.piece(a, b, e.ids) for (a, b), e in zip(spans, batch, strict=True)]
        while len(pieces) > 1:
            odd = pieces[len(pieces) // 2 * 2 :]
            pieces = [self.join(data, x, y) for x, y in zip(pieces[::2], pieces[1::2], strict=False)] + odd
        return pieces[0].ids

    @staticmethod
    def whole(data: bytes, at: int) -> int:
        """The start of the character that holds byte ``at``."""
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def piece(self, lo: int, hi: int, ids: list[int]) -> Piece:
        starts, at = [], lo
        for i in ids:
            starts.append(at)
            at += self.bytes[i]
        if at != hi:
            raise ValueError("tokens do not cover the text they come from")
        return Piece(lo, hi, list(ids), starts)

    def join(self, data: bytes, left: Piece, right: Piece) -> Piece:
        """The encoding of two neighbouring spans as one."""
        width = WINDOW_BYTES
        while True:
            lo = self.whole(data, max(left.lo, left.hi - width))
            hi = self.whole(data, min(right.hi, right.lo + width))
            window = self.piece(lo, hi, self.bare.encode(data[lo:hi].decode(), add_special_tokens=False).ids)
            p = (0, 0) if lo == left.lo else self.left_agreement(data, left, window)
            q = (len(window.ids), len(right.ids)) if hi == right.hi else self.right_agreement(data, window, right)
            if p and q and p[1] <= q[0]:
                return Piece(
                    left.lo, right.hi,
                    left.ids[: p[0]] + window.ids[p[1] : q[0]] + right.ids[q[1] :],
                    left.starts[: p[0]] + window.starts[p[1] : q[0]] + right.starts[q[1] :],
                )
            width *= 2

    def inside(self, data: bytes, start: int, end: int, floor: int, ceiling: int) -> bool:
        """Whether all from three characters before ``start`` to one after ``end`` is of one class."""
        a = start
        for _ in range(3):
            if a <= floor:
                return False
            a = self.whole(data, a - 1)
        if a < floor or end >= ceiling:
            return False
        b = end + 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        if b > ceiling or self.whole(data, start) != start or self.whole(data, end) != end:
            return False
        text = data[a:b].decode()
        return bool(self.letters.fullmatch(text) or self.marks.fullmatch(text))

    def left_agreement(self, data: bytes, left: Piece, window: Piece) -> tuple[int, int] | None:
        """Numbers of the last shared token before the join, in the left part and in the window."""
        known = {}
        for k in range(len(left.ids) - 1, -1, -1):
            if left.starts[k] < window.lo:
                break
            known[left.starts[k]] = k
        for w in range(len(window.ids) - 1, 0, -1):
            k = known.get(window.starts[w])
            if not k or left.ids[k] != window.ids[w]:
                continue
            start = window.starts[w]
            end = start + self.bytes[window.ids[w]]
            opens = self.ends[left.ids[k - 1]], self.ends[window.ids[w - 1]]
            if all(opens) and start + 8 <= left.hi:
                return k, w
            if not any(opens) and self.inside(data, start, end, window.lo, left.hi):
                return k, w
        return None

    def right_agreement(self, data: bytes, window: Piece, right: Piece) -> tuple[int, int] | None:
        """Numbers of the tokens after the first shared one behind the join."""
        known = {s: k for k, s in enumerate(right.starts) if s < window.hi}
        for w in range(len(window.ids)):
            k = known.get(window.starts[w])
            if k is None or right.ids[k] != window.ids[w] or k + 1 >= len(right.ids):
                continue
            start = window.starts[w]
            end = start + self.bytes[window.ids[w]]
            closes = self.ends[window.ids[w]]
            if closes and end + 16 <= window.hi and start >= right.lo + 4:
                return w + 1, k + 1
            if not closes and self.inside(data, start, end, right.lo, window.hi - 16):
                return w + 1, k + 1
        return None

    def decode(self, ids) -> str:
        """The library's ``decode(ids, skip_special_tokens=False)``; this vocabulary has no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def packed_lists(parts: list[np.ndarray]):
    """Ids of many texts as an Arrow list column."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def bpe_encode(docs: DataFrame, text: str = "text", path: str | None = None, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the whole text.

    ``packed`` adds ``ids_packed``, the ids as little-endian unsigned 32-bit integers; ``decoded`` adds
    ``decoded``, the text that the ids decode to. All come from one pass with one tokenizer.
    """
    path = path or vocabulary_path()
    added = {"ids": "array<int>"} | ({"ids_packed": "binary"} if packed else {}) | ({"decoded": "string"} if decoded else {})

    def run(coder, texts):
        parts = [coder.encode(t.as_py()).astype("<u4") for t in texts]
        columns = {"ids": packed_lists(parts)}
        if packed:
            columns["ids_packed"] = [p.tobytes() for p in parts]
        if decoded:
            columns["decoded"] = [coder.decode(p.tolist()) for p in parts]
        return list(columns.values())

    return add_columns(docs, [text], added, run, start=lambda: TreeCoder(path))


def id_lists(column) -> list[np.ndarray]:
    """Rows of an Arrow list column as numpy arrays; a null row is empty."""
    return [np.asarray(row.values, dtype=np.int64) if row.is_valid else np.zeros(0, np.int64) for row in column]


def bpe_decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text that the tokenizer makes of ``ids``."""
    path = path or vocabulary_path()

    def run(coder, column):
        return [[coder.decode(row.tolist()) for row in id_lists(column)]]

    return add_columns(encoded, [ids], {"decoded": "string"}, run, start=lambda: TreeCoder(path))
