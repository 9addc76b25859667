"""Parts that run without Spark, against the tokenizers library, numpy or plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import zstandard

from tillview.llm import attention_lm, paragraph_dedup, plane_files, quality_bands, shingles, token_counts
from tillview.llm.bpe_tree import TreeCoder
from tillview.llm.subwords import PackedCoder, vocabulary_path


@pytest.fixture(scope="module")
def coder():
    return TreeCoder(vocabulary_path(), leaf=16)


ALPHABETS = ("abcdefghij", "ab", "a='s", "éèßÀİΣς", "日本語漢字", "==--''!!", "'s't're", "0189a", "🙂é́̂", "  　ab ")


def test_tree_encoding_equals_library(coder):
    draw = random.Random(3)
    library = coder.words.tokenizer
    texts = ["", " \n", "<|endoftext|>", "x<|startoftext|>y " + "ab" * 200 + "<|endoftext|>" + "c" * 90, "\x1c\x85\x7f"]
    for _ in range(300):
        letters = "".join(draw.sample(ALPHABETS, draw.choice([1, 2, 3])))
        texts.append("".join(draw.choice(letters) for _ in range(draw.choice([3, 40, 200, 600]))))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert coder.encode(None).tolist() == []


def test_packed_ids_equal_library(coder):
    """Ids as bytes, with tables so small that they are emptied many times."""
    draw, library, packed = random.Random(8), coder.words.tokenizer, PackedCoder(coder.words, 8)
    for _ in range(200):
        letters = "".join(draw.sample((*ALPHABETS, "AbcZ", "ÿĀſƀ", "<|endoftext|>"), 2))
        stretches = ["".join(draw.choice(letters) for _ in range(draw.choice([1, 5, 20, 90]))).strip() for _ in range(9)]
        stretches = " ".join([*stretches, "The", "the,", "<|endoftext|>"]).encode().split()
        assert packed.ids(stretches).tolist() == [i for s in stretches for i in library.encode(s.decode(), add_special_tokens=False).ids]
    assert len(packed) <= 8 and packed.ids([]).tolist() == []


@pytest.mark.parametrize("bits", [16, 32])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << min(bits, 31), 5001).astype(np.uint32)
    data, ends = plane_files.to_planes(ids, bits, zstandard.ZstdCompressor())
    assert len(ends) == bits
    assert (plane_files.from_planes(data, ends, len(ids), zstandard.ZstdDecompressor()) == ids).all()


def test_chunks_list_documents_that_cross_borders():
    sizes = [3, 250, 1, 0, 96, 100]
    documents = [(n, np.arange(size, dtype=np.uint32)) for n, size in enumerate(sizes)]
    rows = list(plane_files.chunk_rows(iter(documents), 0, 100, 16))
    assert [r[3] for r in rows] == [100, 100, 100, 100, 50]
    assert [r[2] for r in rows] == [0, 100, 200, 300, 400]
    assert {d for r in rows for d in r[5]} >= {0, 1, 2, 4, 5}
    assert [1 in r[5] for r in rows] == [True, True, True, False, False]


def test_edits_keep_counts_right(coder):
    draw = random.Random(5)
    count = lambda text: len(coder.words.tokenizer.encode(text, add_special_tokens=False).ids)
    text = " ".join("".join(draw.choice("abcé,.") for _ in range(draw.randint(1, 9))) for _ in range(900))
    tree = token_counts.CountTree(text, lambda part: sum(len(coder.words[w]) for w in part.encode().split()))
    assert tree.tokens[1] == count(text)
    for _ in range(60):
        a = draw.randint(0, len(text))
        b = min(len(text), a + draw.choice([0, 1, 30, 900]))
        new = draw.choice(["", "x", " new words ", "y" * 50])
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text() == text
        assert tree.tokens[1] == count(text)


def test_overlapping_edits_are_left_out():
    assert token_counts.applicable(10, [4, 2, 9], [6, 5, 99], ["a", "b", None]) == [(2, 5, "b"), (9, 10, "")]
    assert token_counts.applicable(10, None, None, None) == []


def test_repeated_words_and_lines():
    draw = random.Random(2)
    lists = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.choice([0, 3, 5, 40]))] for _ in range(50)]
    for words, found in zip(lists, quality_bands.repeated_words(lists).tolist(), strict=True):
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert found == len(covered)
    assert quality_bands.duplicate_lines("a\n\nb\na\n \na") == 2


def test_bands_reject_repeats_and_noise():
    draw = random.Random(4)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8))) for _ in range(4000)]
    clean, again = " ".join(words[:1500]), "the same words again and once more so on " * 300
    noise = " ".join("".join(chr(draw.randint(33, 126)) for _ in range(60)) for _ in range(200))
    rows = dict(zip(quality_bands.ADDED, quality_bands.measured([clean, again, noise, None, ""]), strict=True))
    assert rows["kept"] == [True, False, False, False, False]
    assert rows["n_words"][3:] == [0, 0]


def test_bands_reject_short_noise_and_noisy_tails():
    import base64

    draw = random.Random(9)
    parts = "the of and in re er on th an en es st ion ing at or nd ti it is as".split()
    clean = " ".join("".join(draw.choices(parts, range(22, 1, -1), k=draw.choice([1, 1, 2, 2, 3]))) for _ in range(4000))
    spaced = lambda s: " ".join(s[i : i + 12] for i in range(0, len(s), 12))
    noise = spaced(base64.b64encode(draw.randbytes(9000)).decode())
    digits = spaced(draw.randbytes(9000).hex())
    texts = [noise[k : k + n] for k, n in enumerate((150, 400, 900, 3000))] + [clean[:4096] + noise[:3000], digits]
    whole = [clean[:n] for n in (150, 400, 900, 3000, 7096, 9000)]
    rows = dict(zip(quality_bands.ADDED, quality_bands.measured(texts + whole), strict=True))
    assert rows["kept"] == [False] * 6 + [True] * 6
    assert rows["n_chunks"][4] == 2 and rows["n_chunks_out"][4] == 1


def test_prefixes_of_similar_sets_share_tokens():
    draw = np.random.default_rng(6)
    for _ in range(300):
        base = draw.choice(1 << 30, draw.integers(2, 200), replace=False)
        other = np.union1d(base[draw.random(len(base)) < 0.9], draw.integers(0, 1 << 30, draw.integers(0, 20)))
        common = len(np.intersect1d(base, other))
        if 100 * common >= 80 * (len(base) + len(other) - common):
            ranks = [np.sort(s)[: shingles.prefix_length(len(s))] for s in (base, other)]
            least = min(shingles.extra_matches(len(base)), shingles.extra_matches(len(other)))
            assert len(np.intersect1d(*ranks)) >= least


def test_paragraph_cuts_depend_on_near_words_only():
    draw = random.Random(8)
    make = lambda n: [("w%d" % draw.randint(0, 999)) + draw.choice(["", "", "", "."]) for _ in range(n)]
    passage = make(120)
    texts = [" ".join(make(n) + passage + make(n)) for n in (30, 77)]
    found = [{tuple(w) for _, w in paragraph_dedup.paragraphs(t)} for t in texts]
    assert sum(len(w) for w in found[0] & found[1]) >= 60
    assert paragraph_dedup.paragraphs(None) == []
    assert paragraph_dedup.tuned_bands(0.8, 0.98, 2) == 4


def test_unpunctuated_passages_are_cut_alike():
    draw = random.Random(13)
    make = lambda n: ["w%d" % draw.randint(0, 999) for _ in range(n)]
    found = 0
    for _ in range(200):
        passage = make(50)
        cut = [paragraph_dedup.paragraphs(" ".join(make(n) + passage + make(40))) for n in (30, 41)]
        assert all(len(w) <= paragraph_dedup.MOST_WORDS for part in cut for _, w in part)
        assert all(len(w) >= paragraph_dedup.LEAST_WORDS for part in cut for _, w in part[1:-1])
        both = {tuple(w) for _, w in cut[0]} & {tuple(w) for _, w in cut[1]}
        found += sum(len(w) for w in both) >= paragraph_dedup.RUN_WORDS
    assert found >= 194
    assert max(len(w) for _, w in paragraph_dedup.paragraphs("ab " * 500)) <= paragraph_dedup.MOST_WORDS
    assert paragraph_dedup.paragraphs("one two three four five.\" one two three four five six seven")[0][1][-1] == b'five."'


def test_sentence_ends_by_last_byte():
    draw = random.Random(9)
    words = ["".join(draw.choice("ab.!?。！？\"')]”’»」』,é日") for _ in range(draw.randint(1, 5))).encode() for _ in range(3000)]
    ends = [w.endswith(paragraph_dedup.ENDS) or w.rstrip(paragraph_dedup.CLOSING).endswith(paragraph_dedup.ENDS) for w in words]
    assert paragraph_dedup.sentence_ends(words).tolist() == ends and 500 < sum(ends) < 2900



def test_attention_gradients_and_windows():
    draw = np.random.default_rng(0)
    model = attention_lm.Attention.fresh(np.zeros(attention_lm.CLASSES))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    shape = (2, attention_lm.WINDOW)
    classes, targets = draw.integers(0, attention_lm.CLASSES, (2, *shape))
    lasts, weight = draw.integers(0, attention_lm.LASTS, shape), np.ones(shape)

    def loss():
        states, _ = model.hidden(classes, lasts)
        return -model.log_probabilities(states.reshape(-1, attention_lm.WIDTH), targets.ravel()).mean()

    grads = model.gradients(classes, lasts, targets, weight)
    for name in ("query", "value", "out", "head", "place", "last"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        model.w[name][at] += 1e-5
        up = loss()
        model.w[name][at] -= 2e-5
        down = loss()
        model.w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5
    lengths = np.array([1, 32, 33, 100])
    owner, start, fresh = attention_lm.windows_of(lengths)
    for n, length in enumerate(lengths):
        spans = [(s + f, min(s + attention_lm.WINDOW, length)) for o, s, f in zip(owner, start, fresh, strict=True) if o == n]
        assert [x for a, b in spans for x in range(a, b)] == list(range(length))


def test_crc_matches_contract():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\x00\x00\x00")
