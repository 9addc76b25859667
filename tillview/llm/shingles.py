"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tillview.llm.common import folded_words, window_hashes, word_hashes

WIDTH = 5


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Distinct shingles of a word list, sorted by hash; a short list is one shingle as a whole."""
    return np.unique(window_hashes(word_hashes().of(words), WIDTH))


def text_set(text: str | None) -> np.ndarray:
    return shingle_set(folded_words(text))


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def extra_matches(n: int) -> int:
    """How many tokens more than one similar sets must share in their prefixes; makes these longer."""
    return max(1, (n + 19) // 20)


def prefix_length(n: int) -> int:
    """How many first tokens, in any order of all tokens, are indexed of a set of ``n``.

    Two sets of similarity 0.8 have at least ``ceil(0.8 n)`` tokens in common, where n is the size of
    either. Of the set whose prefix ends first in the order, ``ceil(0.8 n) - extra_matches(n)`` tokens lie
    behind the prefix, so the prefixes share at least ``extra_matches(n)``.
    """
    return n - (4 * n + 4) // 5 + extra_matches(n) if n else 0


def batch_windows(texts) -> np.ndarray:
    """Hashes of all shingles of many texts, repeats included; texts of fewer words have none."""
    known = word_hashes()
    lists = [known.of(folded_words(text)) for text in texts]
    lists = [x for x in lists if len(x) >= WIDTH]
    if not lists:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    windows = window_hashes(np.concatenate(lists), WIDTH)
    return windows[owner[WIDTH - 1 :] == owner[: len(owner) - WIDTH + 1]]


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
