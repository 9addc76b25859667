"""Subword ids of whole texts, made word by word with a public tokenizer file.

In the tokenizers used here a word never holds white space, normalisation does not reach across it
and no token comes from it. So the ids of a text are those of its white-space-free stretches, one
after the other, and a stretch met before need not be encoded again.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np

from tillview.llm.common import worker_value

VOCABULARY = "word_bpe_49k.json"
# Stretches longer than this are not kept in the table of known ones.
LONGEST_KNOWN = 64
# Marks that a word may end in; together they are one pre-token. Not among them: the apostrophe, which can
# start a contraction, and the sign that starts the name of an added token.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
MARK_BYTES = MARKS.encode()
# Letters before this one are in normal form by themselves and have one-to-one or plain lower case.
PLAIN_BELOW = "\u0180"
# Byte-level vocabularies write printable bytes as themselves and all others as letters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_UNITS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_tokenizer(path: str):
    """The tokenizer of a file, which neither cuts nor pads."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class SubwordCoder(dict):
    """Ids by white-space-free stretch (UTF-8). Emptied when it grows too large."""

    def __init__(self, path: str, most: int = 1 << 18):
        import regex

        super().__init__()
        # Kept by the worker, as reading the file takes a tenth of a second; the tables of known stretches are not.
        self.tokenizer = worker_value(f"tokenizer:{path}", lambda: whole_tokenizer(path))
        self.most = most
        self.model = self.tokenizer.model
        self.parts: dict[str, tuple[int, ...]] = {}
        # Names of added tokens are one token each, wherever they stand in a raw text.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")

    def __missing__(self, stretch: bytes) -> tuple[int, ...]:
        ids = self.encode(stretch)
        if len(stretch) <= LONGEST_KNOWN:
            if len(self) >= self.most:
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, stretch: bytes) -> tuple[int, ...]:
        """Ids of one stretch. Latin letters with marks after them need no normaliser but lower case."""
        text = stretch.decode("utf-8", "replace")
        if len(stretch) <= LONGEST_KNOWN:
            low = text.lower()
            word = low.rstrip(MARKS)
            if word.isalpha() and max(word) < PLAIN_BELOW:
                marks = low[len(word) :]
                return self.part(word) + self.part(marks) if marks else self.part(word)
        return tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token in its normal form."""
        ids = self.parts.get(word)
        if ids is None:
            if len(self.parts) >= 2 * self.most:
                self.parts.clear()
            ids = self.parts[word] = tuple(self.part_ids(word))
        return ids

    def part_ids(self, word: str) -> list[int]:
        """Ids of one pre-token in its normal form, from the model."""
        units = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_UNITS)
        return [t.id for t in self.model.tokenize(units)]

    def ids(self, stretches: list[bytes]) -> np.ndarray:
        """Ids of all stretches as 32-bit numbers."""
        return np.fromiter(chain.from_iterable(map(self.__getitem__, stretches)), dtype=np.uint32)


class PackedCoder(dict):
    """Packed ids (unsigned, 32 bits, native order) by white-space-free stretch: a text's ids are its stretches' bytes joined.

    Emptied when it grows too large. Bytes take less memory than tuples of numbers, and joining them needs no
    loop over ids.
    """

    def __init__(self, words: SubwordCoder, most: int = 1 << 18):
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, stretch: bytes) -> bytes:
        if len(stretch) > LONGEST_KNOWN:
            return array("I", self.words.encode(stretch)).tobytes()
        packed = self.made(stretch)
        if len(self) >= self.most:
            self.clear()
        self[stretch] = packed
        return packed

    def made(self, stretch: bytes) -> bytes:
        """Packed ids of one stretch: those of its letters in lower case, then those of the marks after them."""
        low = stretch.lower()
        if not low.isalpha():
            word = low.rstrip(MARK_BYTES)
            if word.isalpha():
                return self[word] + self[low[len(word) :]]
            # Not letters of ASCII alone, for which the bytes would do.
            text = stretch.decode("utf-8", "replace").lower()
            word = text.rstrip(MARKS)
            if not word.isalpha() or max(word) >= PLAIN_BELOW:
                return array("I", self.words.encode(stretch)).tobytes()
            low = word.encode()
            if len(word) < len(text):
                return self[low] + self[text[len(word) :].encode()]
        if low != stretch:
            return self[low]
        return array("I", self.words.part_ids(low.decode())).tobytes()

    def ids(self, stretches: list[bytes]) -> np.ndarray:
        """Ids of all stretches as 32-bit numbers."""
        return np.frombuffer(b"".join(map(self.__getitem__, stretches)), dtype=np.uint32)


def subword_coder(path: str) -> SubwordCoder:
    return worker_value(f"subwords:{path}", lambda: SubwordCoder(path))
