"""Whitening, phrases and token counts against brute force, and on edge tables."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlab.llm import bpe_count, collocations, whitening
from tests.conftest import SF_SMALL
from tests.llm import helpers as H

VECTORS = "vec_id long, embedding array<float>, component string, n string, x int, c int, dims int"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in data], VECTORS)


def whitened_by_brute_force(data, k=16):
    """[(vec_id, deviation, whitened, explained)] for vectors of one length, in exact fractions up to the eigenvectors."""
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in data]
    fit = sorted({tuple(v) for _, v in x})
    n, dims = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(dims)]
    y = [[Fraction(n * v[d] - s[d], n) for d in range(dims)] for v in fit]
    cov = np.array([[float(sum(r[a] * r[b] for r in y) / n) for b in range(dims)] for a in range(dims)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [(i, sum((n * v[d] - s[d]) ** 2 for d in range(dims)),
             np.array([float(Fraction(n * v[d] - s[d], n)) for d in range(dims)]) @ q / np.sqrt(e), e / np.trace(cov))
            for i, v in x], n


def by_vector(df):
    out = {}
    for r in sorted(H.rows(df), key=lambda r: r["component"]):
        out.setdefault(r["vec_id"], []).append(r)
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 20)) @ np.diag(np.linspace(0.2, 6, 20)) + 40
    data = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(100)]
    want, n = whitened_by_brute_force(data)
    got = by_vector(whitening.whiten(vectors(spark, data).repartition(5)))
    assert len(got) == 250 and n == 150
    sign = None
    for vec_id, deviation, w, explained in want:
        rows = got[vec_id]
        assert [r["component"] for r in rows] == list(range(1, 17))
        assert {(r["n"], r["deviation"]) for r in rows} == {(n, deviation)}
        mine = np.array([r["whitened"] for r in rows])
        sign = np.sign(mine * w) if sign is None else sign
        assert np.allclose(mine, sign * w, rtol=1e-8, atol=1e-9)
        assert np.allclose([r["explained"] for r in rows], explained, rtol=1e-10)
        assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_whitening_of_a_table(spark):
    got = whitening.whiten(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))
    w = np.array([[r["whitened"] for r in rows] for rows in by_vector(got).values()])
    assert w.shape == (500, 16) and np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-9


def test_polarisation_is_exact():
    rng = random.Random(2)
    z = [[rng.randint(-10**12, 10**12) for _ in range(4)] for _ in range(30)]
    total, squares = {}, {}
    for i in range(4):
        for j in range(i, 4):
            p = [r[i] + r[j] if i != j else r[i] for r in z]
            total[i, j], squares[i, j] = sum(p), sum(v * v for v in p)
    got = whitening.covariance(30, total, squares, 4)
    mean = [Fraction(sum(r[i] for r in z), 30) for i in range(4)]
    for i in range(4):
        for j in range(4):
            assert got[i, j] == float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in z) / 30)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]),
            (6, [-inf, 1.0]), (7, [1.0]), (8, []), (9, [-3.0, 4.0]), (10, [1e30, 0.0, 1.0]), (11, [-1e30, 0.0, 1.0])]
    got = H.rows(whitening.whiten(vectors(spark, data)))
    assert Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 7: 1, 9: 2, 10: 3, 11: 3}
    assert {r["n"] for r in got if r["vec_id"] in (1, 9, None)} == {3}
    one = next(r for r in got if r["vec_id"] == 7)
    assert (one["n"], one["deviation"], one["whitened"], one["explained"]) == (1, 0, 0.0, 0.0)
    far = [r for r in got if r["vec_id"] in (10, 11)]
    assert {r["deviation"] for r in far} == {2**63 - 1}
    assert {r["whitened"] for r in far if r["component"] > 1} == {0.0}
    assert np.allclose(sorted(r["whitened"] for r in far if r["component"] == 1), [-1, 1])
    assert whitening.whiten(vectors(spark, data).limit(0)).count() == 0


def phrases_by_brute_force(docs, least, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", H.fold(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    kept = {k: a for k, a in f.items() if a >= least}
    inside = {(lang, w[i:i + k]) for (lang, w), a in kept.items() for k in range(2, len(w))
              for i in range(len(w) - k + 1) if a >= kept[lang, w[i:i + k]]}
    out = {}
    for (lang, w), a in kept.items():
        if len(w) > 1 and (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items()
                  for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def phrase_rows(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in H.rows(df))


def phrase_table(spark, docs):
    df = spark.createDataFrame([(t, lang, None, None, None, None, None) for t, lang in docs],
                               "text string, lang string, key string, words string, n long, f int, rank int")
    return df.repartition(4)


def prose(seed, rows):
    rng = random.Random(seed)
    parts = ["the", "The", "of", "cat", "CAT", "x\x01", "x", "x\x00y", "é", "É", "日本", "\x1f", "a-b", "\x08"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!", ";", ":?"]
    text = lambda: "".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
    return [(text(), rng.choice(["en", "en", "de", None, "", "und", "a\tb\n\x00"])) for _ in range(rows)]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (7, 5)])
def test_phrases_equal_brute_force(spark, least, top):
    docs = prose(least, 150) + [(None, "en"), ("", "en"), ("  \t", None), ("...", "de"), ("one", "fr")]
    docs += [("the common phrase of all, the common phrase", "en")] * 60
    got = phrase_rows(collocations.collocations(phrase_table(spark, docs), least, top))
    assert got == phrases_by_brute_force(docs, least, top) and len(got) > 10
    assert any(r[2] == "the common phrase of all" for r in got)


def test_phrases_over_chunk_ends(spark, monkeypatch):
    """Chunks of few tokens and slices of few bytes, ranges of few bytes, an overfull table of pairs: the same rows."""
    docs = prose(11, 80)
    want = phrases_by_brute_force(docs, 3, 2000)
    batch = [("und" if lang is None else lang, text) for text, lang in docs]
    import pyarrow as pa
    batches = lambda: iter([pa.RecordBatch.from_arrays(
        [pa.array([b[0] for b in batch]), pa.array([b[1] for b in batch])], names=["lang", "text"])])
    monkeypatch.setattr(collocations, "TOKENS", 7)
    monkeypatch.setattr(collocations, "SLICE", 5)
    table = np.full(collocations.FEWEST_BUCKETS // 8, 255, np.uint8)

    class Table:
        value = table
    windows = Counter()
    for b in collocations._windows(collocations.FEWEST_BUCKETS, Table)(batches()):
        for key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            windows[key] += n
    stream = sorted(windows.items())
    counts = Counter()
    for at in range(0, len(stream), 50):  # ranges of 50 rows
        part = pa.RecordBatch.from_arrays([pa.array([k for k, _ in stream[at:at + 50]]), pa.array([n for _, n in stream[at:at + 50]])],
                                          names=["key", "n"])
        for b in collocations._runs(3)(iter([part])):
            for key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts[key] += n
    for lang, _, phrase, a, left, right, n, _ in want:
        lang = collocations._escape(lang.encode())
        key = b"\t".join([lang, *(collocations._escape(w.encode()) for w in phrase.split(" "))])
        assert counts[key] == a and counts[lang] == n
    assert len(want) > 20


def test_no_phrases(spark):
    assert collocations.collocations(phrase_table(spark, [("a b a b", "en")])).count() == 0
    assert collocations.collocations(phrase_table(spark, [("a b", "en")]).limit(0)).count() == 0


PARTS = ["a", "the", "'s", "'re", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "日本", "́", "<|endoftext|>", "<|endoftext", "1", "23", "²",
         " ", " ", "\x1c", "\x85", "don't", "X", "😀", "ǅ", "՘", "\U00010940", ".", "--", "\x00", "ʼ"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["ab" * 20_000, "a" * 5000, "<|endoftext|>" * 600, "日本語" * 3000, " ".join(f"w{i}" for i in range(3000))]
    got = H.rows(bpe_count.token_counts(H.documents(spark, list(enumerate(texts)), "n_bytes n_tokens row over_limit")))
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        n = count(library, text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512), text[:80]


def test_token_counts_of_a_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r["doc_id"]: count(library, r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in H.rows(bpe_count.token_counts(docs))} == want


def test_token_counts_on_edges(spark, library):
    data = [(1, None), (2, ""), (2, ""), (None, "x y"), (5, " \n\t ")]
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in H.rows(bpe_count.token_counts(H.documents(spark, data))))
    assert got == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0), (5, 4, count(library, " \n\t "))]
    assert bpe_count.token_counts(H.documents(spark, [])).count() == 0


def test_slices_and_forgotten_pieces(library):
    """Small slices and a cache of two entries give the same counts."""
    import public_tokenizers
    counter = bpe_count.Counter(public_tokenizers.path("byte_bpe_50k.json"), remembered=2)
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 4))) for _ in range(20))
        parts = list(bpe_count.slices(text, 10))
        assert "".join(parts) == text
        assert sum(map(counter.count, parts)) == counter.count(text) == count(library, text)


def test_merges_pop_the_lowest_rank_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("abc", "abc"): 3}
    assert bpe_count.merged_length("abcabc", ranks) == 1
    assert bpe_count.merged_length("ababc", ranks) == 2
    assert bpe_count.merged_length("", ranks) == 0 and bpe_count.merged_length("z", ranks) == 1
    assert bpe_count.merged_length("aaa", {("a", "a"): 0}) == 2
