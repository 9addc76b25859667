"""Whitening, line labels and token alignment on small tables, against numpy and brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillview.llm import line_crf, token_alignment, whitening
from tillview.llm.common import stored
from tillview.llm.queries import QUERIES
from tillview.llm.subwords import vocabulary_path


def spectra():
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.normal(size=(24, 24)))[0]
    yield from (turn @ np.diag(v) @ turn.T for v in (
        np.arange(24.0), np.repeat([1.0, 2, 3, 4], 6), 1 + 1e-13 * np.arange(24), 1 + 1e-8 * np.arange(24), 10.0 ** -np.arange(24),
        np.r_[np.ones(4), np.zeros(20)],
    ))
    yield from (np.zeros((3, 3)), np.ones((5, 5)), np.diag([1.0, 1, 1, 5]), np.array([[7.0]]), np.eye(9) + 1e6 * np.ones((9, 9)))


def test_eigenvectors():
    for matrix in spectra():
        scale = np.linalg.norm(matrix) or 1.0
        values, vectors = whitening.eigen(matrix)
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() <= 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-13
        assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale


def test_polar_factor_is_orthogonal_and_symmetric():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(30, 30))
    x = x + x.T
    sign = whitening.polar(x)
    values, vectors = np.linalg.eigh(x)
    assert np.abs(sign - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-11


def expected_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    return x, n, total, covariance, values, axes


def test_whitening(spark):
    draw = np.random.default_rng(7)
    vectors = (draw.normal(size=(300, 20)) * np.linspace(0.5, 3, 20) + 9).round(2).tolist()
    vectors += vectors[:40] * 3
    rows = [(i % 200, v, "mine", 1.0) for i, v in enumerate(vectors)]
    rows += [(None, vectors[5], None, None), (900, None, "x", 2.0), (901, [None] * 20, "x", 2.0), (902, [float("nan")] * 20, "x", 2.0)]
    rows += [(903, [float("inf")] * 20, "x", 2.0), (904, [], "x", 2.0), (905, [1e300] * 20, "x", 2.0), (906, [1.0, 2.0], "x", 2.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n double").repartition(5)
    got = whitening.whiten(table).collect()
    alone = [r for r in got if r.vec_id == 906]
    assert len(alone) == 1 and alone[0].n == 1 and alone[0].whitened == [] and alone[0].deviation == 0
    got = [r for r in got if r.vec_id != 906]
    assert len(got) == len(vectors) + 1 and not any(r.vec_id and r.vec_id >= 900 for r in got)
    x, n, total, covariance, values, axes = expected_whitening([r.embedding for r in got])
    assert {r.n for r in got} == {n} and n < len(vectors)
    assert [r.deviation for r in got] == ((n * x - total) ** 2).sum(axis=1).tolist()
    want = ((x - total / n) @ axes[:, :16]) / np.sqrt(values[:16])
    have = np.array([r.whitened for r in got])
    assert have.shape == want.shape and np.abs(have - want * np.sign((have * want).sum(axis=0))).max() < 1e-9
    assert np.abs(np.array(got[0].explained) - values[:16] / np.trace(covariance)).max() < 1e-12
    assert 0 <= got[0].identity_error < 1e-10


def test_whitening_without_spread(spark):
    rows = [(1, [2.0, 3.0, 4.0]), (2, [2.0, 3.0, 4.0]), (3, [2.0, 5.0, 4.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    assert [len(r.whitened) for r in got] == [1, 1, 1] and got[0].n == 2 and got[0].explained == [1.0]
    assert sorted(abs(r.whitened[0]) for r in got) == [1.0, 1.0, 1.0]
    one = whitening.whiten(spark.createDataFrame(rows[:2], "vec_id int, embedding array<float>")).collect()
    assert [r.whitened for r in one] == [[], []]
    assert whitening.whiten(spark.createDataFrame([], "vec_id int, embedding array<float>")).count() == 0


def test_large_deviations_are_exact_or_null():
    axes = whitening.Axes(3, np.zeros(2, np.int64), np.array([1, -1]), np.eye(2), np.ones(2))
    whole = np.array([[1 << 29, -(1 << 29)], [1 << 61, 0], [5, 7]])
    got = axes.deviations(whole).tolist()
    assert got == [(3 * (1 << 29) - 1) ** 2 + (-3 * (1 << 29) + 1) ** 2, None, 14**2 + 22**2]


def test_chain_against_all_labelings():
    draw = np.random.default_rng(8)
    sizes = [3, 0, 1, 5, 2]
    chain = line_crf.Chain(np.cumsum([0, *sizes]))
    odds, links = draw.normal(size=sum(sizes)), draw.normal(size=(2, 2))
    sums, good, pairs, owner = chain.run(odds, links)
    at = 0
    for text, n in enumerate(sizes):
        total, marginal, pair = 0.0, np.zeros(n), np.zeros((max(n - 1, 0), 2, 2))
        for code in range(2**n):
            labels = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(odds[at + k] for k in range(n) if labels[k]) + sum(links[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += w
            marginal += w * np.array(labels)
            for k in range(n - 1):
                pair[k, labels[k], labels[k + 1]] += w
        assert sums[text] == pytest.approx(np.log(total))
        assert np.allclose(good[at : at + n], marginal / total) and np.allclose(pairs[owner == text], pair / total)
        at += n


def test_line_shapes():
    texts = ["Hello big big World.\n\n  \nab 12 !!", None, "", "x\nx", " \n", "Éa ### $$$\té"]
    lines = line_crf.lines_of(texts)
    assert np.diff(lines.starts).tolist() == [2, 0, 0, 2, 0, 1] and lines.sizes.tolist() == [20, 8, 1, 1, 12]
    column = dict(zip(line_crf.SHAPES, lines.shapes.T, strict=True))
    assert np.allclose(column["words"], np.log1p([4, 3, 1, 1, 4])) and np.allclose(column["repeated"], [0.25, 0, 0, 0, 0])
    assert np.allclose(column["distinct"], [0.75, 1, 1, 1, 1]) and column["seen"].tolist() == [0, 0, 0, 1, 0]
    assert np.allclose(column["upper"], [0.1, 0, 0, 0, 0]) and np.allclose(column["symbol"], [0, 0, 0, 0, 0.5])
    assert column["ends"].tolist() == [1, 1, 0, 0, 0] and column["opens"].tolist() == [1, 0, 0, 0, 1]
    # How texts are put together changes nothing.
    apart = [line_crf.lines_of([t]).shapes for t in texts]
    assert np.array_equal(np.concatenate(apart), lines.shapes)


def prose(draw, bad):
    word = lambda: "".join(draw.choice(list("etaoinshrdlu"), draw.integers(2, 9)))
    lines = [" ".join(word() for _ in range(draw.integers(6, 20))).capitalize() + "." for _ in range(draw.integers(2, 9))]
    for _ in range(2 * bad):
        lines.insert(draw.integers(len(lines) + 1), " ".join(f"{word()}%%%" for _ in range(12)))
    return "\n".join(lines)


def test_document_quality(spark):
    draw = np.random.default_rng(9)
    truth = {i: int(i % 4 > 0) for i in range(400)}
    rows = [(i, prose(draw, 1 - q), "p%d" % (i % 3), 0.5) for i, q in truth.items()]
    rows += [(1000, None, None, None), (1001, "", "p", 0.0), (None, rows[0][1], "p", 0.0), (1002, "one line " * 30000, "p", 0.0), (3, rows[3][1], "p", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double").repartition(4)
    known = [(i, q, "?") for i, q in truth.items() if i < 300] + [(7, 0, "?"), (7, 1, "?"), (None, 1, "?"), (9, None, "?"), (8, 5, "?"), (4000, 0, "?")]
    labels = spark.createDataFrame(known, "doc_id long, quality int, text string")
    got = line_crf.document_quality(docs, labels).collect()
    assert len(got) == len(rows) and {"source", "text"} <= set(got[0].asDict())
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and len(r.line_good) == r.n_lines
    unseen = [r for r in got if r.doc_id in truth and (r.held_out or r.doc_id >= 300)]
    assert len(unseen) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in unseen]) >= 0.97
    # Lines are told apart although only documents are labelled.
    marks = [("%%%" in line, p) for r in unseen for line, p in zip(r.text.split("\n"), r.line_good, strict=True)]
    assert np.mean([p for junk, p in marks if junk]) < 0.2 < 0.8 < np.mean([p for junk, p in marks if not junk])
    again = {(r.doc_id, r.text, round(r.score, 9)) for r in line_crf.document_quality(docs.repartition(7), labels).collect()}
    assert again == {(r.doc_id, r.text, round(r.score, 9)) for r in got}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in line_crf.document_quality(docs, labels).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in line_crf.document_quality(docs, one).collect()} == {2 / 3}
    assert line_crf.document_quality(docs.limit(0), one).count() == 0


def aligned_by_hand(text, library, pieces):
    nothing = (0, 0, 0, ""), Counter()
    if not text:
        return nothing
    names = {n: name for name, n in library.get_vocab().items()}
    data = f" {text}".encode()

    def spans(ids, of):
        at, out = 0, []
        for n in ids:
            out.append((at, at + len(of(n)), n))
            at += len(of(n))
        return out, b"".join(map(of, ids))

    units = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in units} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in units)}
    a, bytes_a = spans(library.encode(f" {text}", add_special_tokens=False).ids, lambda n: bytes(decode[c] for c in names[n]))
    b, bytes_b = spans(
        pieces.encode(text),
        lambda n: bytes([int(pieces.id_to_piece(n)[3:5], 16)]) if pieces.is_byte(n) else pieces.id_to_piece(n).replace("▁", " ").encode(),
    )
    if bytes_a != data or bytes_b != data:
        return nothing
    links = Counter((x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
    groups, lo = [], 0
    for hi in sorted({x[1] for x in a} & {y[1] for y in b}):
        groups.append("|".join(",".join(str(n) for p, _, n in side if lo <= p < hi) for side in (a, b)))
        lo = hi
    return (len(a), len(b), len(groups), ";".join(groups)), links


ODD = [
    "a b", "  ", "hello world\n\n x", "日本語 テキスト text", "é" * 40 + " x", "▁ab", "<0x41> <s> <unk> <|endoftext|>", "don't   stop\t\tnow ",
    "a" * 900, "\x00 \x85 x", " lead", None, "", "👍🏽 ok", "don't   stop\t\tnow ",
]


@pytest.mark.parametrize("most_hot", [token_alignment.HOT_PAIRS, 40, 0])
def test_alignment(spark, folder, most_hot):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(token_alignment.A_FILE))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(token_alignment.B_FILE))
    prose = spark.read.parquet(f"{folder}/documents.parquet").select(F.substring("text", 1, 300)).limit(40).collect()
    texts = [*ODD, *[r[0] for r in prose]]
    rows = [(None if i == 3 else i // 2, t, "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3)
    aligned = stored(token_alignment.align_tokens(docs), "aligned")
    counts = stored(token_alignment.pair_counts(aligned), "counts")
    got = token_alignment.link_scores(aligned, counts, most_hot).collect()
    by_hand = [aligned_by_hand(t, library, pieces) for t in texts]
    held = Counter(pair for _, links in by_hand for pair in links)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): (r["n_docs"], r["best"]) for r in counts.collect()} == {
        pair: (n, n == best[pair[0]]) for pair, n in held.items()
    }
    want = Counter(
        (rows[i][0], *told[:3], sum(links.values()), told[3], sum(t for p, t in links.items() if held[p] == best[p[0]]),
         sum(t * held[p] for p, t in links.items()))
        for i, (told, links) in enumerate(by_hand)
    )
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got) == want


def test_windows_are_forgotten_in_time():
    paths = [vocabulary_path(f) for f in (token_alignment.A_FILE, token_alignment.B_FILE)]
    small, large = token_alignment.Aligner(*paths, most=3), token_alignment.Aligner(*paths)
    for text in [t for t in ODD if t] * 2:
        one, other = small.align([text])[0], large.align([text])[0]
        assert one[:5] == other[:5] and np.array_equal(one[5], other[5]) and np.array_equal(one[6], other[6])
    assert len(small.windows.known) < len(large.windows.known)


def test_empty_alignment(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = stored(token_alignment.align_tokens(docs), "aligned")
    counts = stored(token_alignment.pair_counts(aligned), "counts")
    assert counts.count() == 0 and token_alignment.link_scores(aligned, counts).count() == 0


def test_alignment_query_digests(spark, folder):
    rows = QUERIES["op13_anchor_alignment"](spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    told = token_alignment.Aligner(*[vocabulary_path(f) for f in (token_alignment.A_FILE, token_alignment.B_FILE)])
    assert len(rows) == len(docs)
    for r in rows[:50]:
        groups = told.align([docs[r.doc_id]])[0][4]
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
