"""Quality rules: compression ratios of whole texts and of fixed chunks must lie in a band.

Text that repeats itself compresses too well, noise and encoded data hardly at all. How well clean
text compresses depends on its length, so each band holds for a range of lengths. A text is rejected
if its own ratio leaves the band of its length, or if too many of its chunks, the last partial one
included, leave theirs.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; texts too
short to compress have no band; equal rows get equal verdicts; other columns pass through, and input
columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tillview.llm.common import add_columns, byte_words, mixed, window_hashes, word_hashes

# (bytes from, lowest ratio): ratio is compressed size over size at zstandard level 3.
LOWEST = ((0, 0.0), (96, 0.35), (256, 0.25), (1024, 0.20), (8192, 0.15))
# (bytes, highest ratio), straight lines over the logarithm of the length between them; no limit below the
# first. Each is the highest ratio of 6,000 pieces of that length cut from test texts in en, fr, de and es, plus
# 0.02 (0.026 at 4 KB, 0.047 from 8 KB on). Random base64 has 0.95 at 192 bytes, 0.84 at 512, 0.79 at 1 KB and
# 0.75 at 4 KB; hex digits have 0.52 there and are above the limit from 4 KB on.
HIGHEST = (
    (96, 1.115), (128, 1.005), (192, 0.905), (256, 0.86), (384, 0.78), (512, 0.737), (768, 0.675), (1024, 0.62),
    (2048, 0.55), (3072, 0.526), (4096, 0.51), (8192, 0.50),
)
CHUNK_BYTES = 4096
# Lowest ratio of a full chunk.
CHUNK_LOWEST = 0.15
# A text may have this share of chunks outside the band (tables, quoted data).
CHUNK_SHARE = 0.25
LEVEL = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Words handled at once; a longer text is handled alone.
SLICE_WORDS = 1 << 19

ADDED = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "ratio": "double", "n_chunks": "long", "n_chunks_out": "long",
    "base_failed": "boolean", "kept": "boolean",
}


def repeated_words(word_lists: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a 5-word window found twice or more in that text."""
    counts = np.array([len(w) for w in word_lists], dtype=np.int64)
    known = word_hashes()
    parts = [known.of(w) for w in word_lists]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(hashes) < 6:
        return np.zeros(len(counts), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    windows = window_hashes(hashes, 5)
    start = np.flatnonzero(owner[4:] == owner[: len(owner) - 4])
    keys = mixed(windows[start] ^ mixed(owner[start].astype(np.uint64)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, start[twice], 1)
    np.add.at(edge, start[twice] + 5, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(counts))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def band_of(size: int) -> tuple[float, float]:
    low = next(low for start, low in reversed(LOWEST) if size >= start)
    if size < HIGHEST[0][0]:
        return low, float("inf")
    return low, float(np.interp(np.log(size), *zip(*[(np.log(n), high) for n, high in HIGHEST], strict=True)))


def compression(data: bytes, compressor) -> tuple[float, int, int]:
    """Ratio of the whole text, its number of chunks and how many of them leave the band.

    What is left after the last full chunk is a chunk with the band of its length, if that has one. A text
    below one chunk has none, as it is measured whole.
    """
    if not data:
        return 1.0, 0, 0
    chunks = out = 0
    if len(data) >= CHUNK_BYTES:
        for k in range(0, len(data), CHUNK_BYTES):
            chunk = data[k : k + CHUNK_BYTES]
            if len(chunk) < HIGHEST[0][0]:
                continue
            low, high = FULL_BAND if len(chunk) == CHUNK_BYTES else band_of(len(chunk))
            chunks += 1
            out += not low <= len(compressor.compress(chunk)) / len(chunk) <= high
    return len(compressor.compress(data)) / len(data), chunks, out


FULL_BAND = (CHUNK_LOWEST, band_of(CHUNK_BYTES)[1])


def measured(texts: list[str | None]) -> list[list]:
    """The added columns for a list of texts."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    columns: dict[str, list] = {name: [] for name in ADDED}
    held: list[list[bytes]] = []
    waiting = 0
    repeats: list[int] = []
    for text in texts:
        text = text or ""
        words = byte_words(text)
        held.append(words)
        waiting += len(words)
        if waiting >= SLICE_WORDS:
            repeats += repeated_words(held).tolist()
            held, waiting = [], 0
        data = text.encode("utf-8", "surrogatepass")
        ratio, chunks, out = compression(data, compressor)
        columns["n_words"].append(len(words))
        columns["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        columns["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        columns["n_dup_lines"].append(duplicate_lines(text))
        columns["ratio"].append(ratio)
        columns["n_chunks"].append(chunks)
        columns["n_chunks_out"].append(out)
        low, high = band_of(len(data))
        columns["kept"].append(low <= ratio <= high and out <= CHUNK_SHARE * chunks)
    repeats += repeated_words(held).tolist()
    columns["n_repeat_words"] = repeats
    columns["base_failed"] = [
        n < 10 or 100 * r > 20 * n for n, r in zip(columns["n_words"], repeats, strict=True)
    ]
    columns["kept"] = [k and not f for k, f in zip(columns["kept"], columns["base_failed"], strict=True)]
    return list(columns.values())


def quality_bands(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and verdicts of ``ADDED``."""
    return add_columns(docs, [text], ADDED, lambda texts: measured(texts.to_pylist()))
