"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reachlab.llm import (
    bpe_count, collocations, fertility, html_text, line_dedup, markov_secrets, minhash, mixing, packing, token_files,
    topk, warc, whitening,
)
from tests.llm import helpers as H

LONG = " ".join(f"word{i} of" for i in range(30_000))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one two", "de", "b"),
    (5, "One TWO", "de", "b"), (None, "a text without an id", "en", "a"), (7, LONG, "en", "a"), (7, LONG, "en", "a"),
    (8, "tie tie tie tie", None, None), (9, "tie tie tie tie", "xx", "é"), (10, "日本語 テスト é́ <b>&amp;</b>", "ja", "Z"),
]
CLASH = "kept component_id n_shingles n_lines taken size target row uid piece start spans n_words row_2 key hub"


@pytest.fixture(scope="module")
def docs(spark):
    return H.documents(spark, ROWS, CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return H.documents(spark, [])


def test_packing(spark, docs, empty):
    got = H.rows(packing.pack(docs))
    assert sum(r["piece"] == 0 for r in got) == len(ROWS)
    one = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert [r["length"] for r in one] == [1, 1, 1]
    long = [r for r in got if r["doc_id"] == 7]
    assert len(long) % 2 == 0 and len({(r["sequence_id"], r["offset"]) for r in long}) == len(long)
    assert packing.pack(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    text = "a b\nc d\n\ne f\ng h"
    more = docs.unionByName(H.documents(spark, [(20, text), (21, "x\n" + text + "\ny"), (21, "x\n" + text + "\ny"),
                                                (22, "e f\ng h")], CLASH))
    got = line_dedup.drop_repeated_lines(more)
    assert set(got.columns) == set(docs.columns) | {"n_removed"} and got.schema["n_chars"] == docs.schema["n_chars"]
    by = {}
    for r in H.rows(got):
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0
    assert by[20][0]["text"] == text and by[22][0]["n_removed"] == 0
    assert [(r["text"], r["n_removed"], r["n_lines"], r["n_chars"]) for r in by[21]] == [("x\n\ny", 4, 7, 4)] * 2
    assert len(by[7]) == 2 and all(r["text"] == LONG for r in by[7])
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_near_duplicates(spark, docs, empty):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"])
                 for r in H.rows(minhash.near_duplicates(docs)))
    n = len(H.shingle_set(LONG))
    assert got == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True),
                   (5, 1, 4, False), (7, n, 7, True), (7, n, 7, True), (8, 1, 8, True), (9, 1, 8, False),
                   (10, 1, 10, True)]
    kept = minhash.keep_one_of_each_group(docs)
    # the second row of doc_id 7, equal to the first, goes as well
    assert kept.columns == docs.columns and kept.count() == 8
    assert [r["doc_id"] for r in H.rows(kept)].count(7) == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_a_repeated_id_ties_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = {r["doc_id"]: r["component_id"] for r in H.rows(minhash.near_duplicates(
        H.documents(spark, [(1, a), (2, b), (5, a), (5, b), (6, b)])))}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1}


def test_repeats_of_a_kept_row_go(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a), (2, b), (3, a), (4, None), (4, None), (5, ""), (5, ""), (None, a), (None, a), (6, "x"), (6, "y")]
    kept = H.rows(minhash.keep_one_of_each_group(H.documents(spark, rows)))
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept)) == [
        (0, a), (0, a), (1, a), (2, b), (4, ""), (5, ""), (6, "x"), (6, "y")]


@pytest.mark.parametrize("times", [2, 4])
def test_near_texts_on_repeated_rows(spark, times):
    """Chains of near texts, in which the first compared is too far from the last."""
    texts = {}
    for chain in range(40):
        w = [f"c{chain}_{i}" for i in range(80)]
        for step in range(4):
            texts[1000 * step + chain] = " ".join(w)
            w[15 * step + 3] = f"e{chain}_{step}"
            w[15 * step + 9] = f"f{chain}_{step}"
    got = H.rows(minhash.near_duplicates(H.documents(spark, list(texts.items()) * times)))
    assert len(got) == times * len(texts)
    want = H.near_groups(texts)
    assert {k: c for k, (_, c) in want.items()} == {r["doc_id"]: r["component_id"] for r in got}
    assert any(c % 1000 != k for k, (_, c) in want.items())


def test_mixing(spark, docs, empty):
    got = H.rows(mixing.mix_sources(docs).taken())
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(H.words(r[1]))
    for s, want in H.water_fill(sizes).items():
        of = {(r[0], len(H.words(r[1]))) for r in ROWS if r[3] == s}
        assert all(abs(r["target"] - want) < 1e-6 for r in got if (r["doc_id"], r["size"]) in of)
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    words = sum(len(H.words(r["text"])) for r in H.rows(mixed))
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix_sources(empty).taken().count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_no_words_to_mix(spark):
    got = H.rows(mixing.mix_sources(H.documents(spark, [(1, ""), (2, None, "en", None)])).taken())
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_top_k(spark):
    schema = "vec_id long, embedding array<float>, label int, score string, rank string"
    none = [float("nan"), 0.0]
    data = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, none),
            (6, None), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (100, []),
            (11, [3e18, -3e18]), (12, [0.5, -0.001])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in data], schema)
    got = {}
    for r in H.rows(topk.top_k(df, "vec_id % 50 = 0", 3)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0])[0] == (1, 11, 2**63 - 1)
    assert [v for _, v, _ in sorted(got[0])][1:] == [3, 4]
    assert [s for _, _, s in sorted(got[50])][1:] == [65536, 65536]
    assert 100 not in got
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0", 3).count() == 0


def test_quality(spark, docs, empty):
    got = H.rows(fertility.quality(docs))
    assert len(got) == len(ROWS)
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"])
        for name, value in H.quality_base(text).items():
            assert r[name] == value
    assert sum(r["kept"] for r in got) == 2  # the long text, twice
    kept = fertility.keep_good_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert fertility.quality(empty).count() == 0


def test_copies_do_not_set_the_bands(spark):
    """One atypical text on four fifths of a language's rows."""
    rng = random.Random(8)
    short, long = "the of and to in is it on at by as we he".split(), "government important different information".split()
    text = lambda share: " ".join(
        rng.choice(long if rng.random() < share else short) + f"{rng.choice('abcdefgh')}" * rng.randint(0, 1)
        for _ in range(150))
    clean = [(i, text(rng.uniform(0.3, 0.8))) for i in range(60)]
    odd = text(0.0)
    alone = {r["doc_id"]: r["kept"] for r in H.rows(fertility.quality(H.documents(spark, [*clean, (1000, odd)])))}
    got = H.rows(fertility.quality(H.documents(spark, clean + [(1000 + i, odd) for i in range(240)])))
    assert len(got) == 300 and sum(alone[i] for i, _ in clean) >= 58
    assert {r["doc_id"]: r["kept"] for r in got if r["doc_id"] <= 1000} == alone


def test_secrets(spark, docs, empty):
    more = docs.unionByName(H.documents(spark, [(30, 'x PASSWORD: "abc123" ſecret=abcdef AKIA' + "A" * 16 + " " + "f" * 24),
                                                (31, "password=abc12 AKIA123 " + "0123456789abcdef" * 2)], CLASH))
    got = {r["doc_id"]: r for r in H.rows(markov_secrets.find_secrets(more))}
    assert got[1]["spans"] == "" and got[1]["n_hex"] == 0
    assert (got[30]["n_assign"], got[30]["n_access"], got[30]["n_hex"]) == (1, 1, 1)
    assert got[30]["spans"].startswith("assign:2:19,access:") and got[31]["n_assign"] == 0 and got[31]["n_hex"] == 1
    assert markov_secrets.find_secrets(empty).count() == 0


def test_token_files(spark, docs, empty):
    got = sorted(H.rows(token_files.token_files(docs)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 5, 7, 7, 8, 9, 10, None]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 1
    assert token_files.token_files(empty).count() == 0


PAGES = [
    (1, None, None), (2, "u\r\nX-Evil: 1", ""), (3, "u", "<p>short</p>"), (4, "u", "<p>short</p>"),
    (5, "v", "<p>" + "long " * 40 + "</p>"), (6, "w", "<p>" + "long " * 40 + "</p>"), (6, "w", "<p>" + "long " * 40 + "</p>"),
    (None, "n", "<p>" + "long " * 40 + "</p>"), (8, "x", "WARC/1.1\r\n\r\n" * 30), (9, "y", "é" * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit(1)) \
        .withColumn("digest", F.lit(2)).withColumn("first", F.lit(3))


def test_archives(spark, pages):
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"])
                 for r in H.rows(warc.archived_pages(pages)))
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 12, "response", None),
                          (4, 12, "response", None), (5, 207, "response", None), (6, 207, "revisit", 5),
                          (6, 207, "revisit", 5), (0, 207, "revisit", 5), (8, 360, "response", None),
                          (9, 400_000, "response", None)], key=lambda r: (r[0], r[1], r[2], r[3] or 0))
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_html(spark, pages):
    got = H.rows(html_text.extract(pages))
    assert len(got) == len(PAGES) and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert next(r for r in got if r["page_id"] == 9)["n_chars"] == 200_000
    assert html_text.extract(pages.limit(0)).count() == 0


def internal_names() -> list[str]:
    """Every name that the package gives a column: what its sources alias, add or select as text."""
    found = set()
    for path in Path(minhash.__file__).parent.glob("*.py"):
        found |= set(re.findall(r"""["']([A-Za-z_][A-Za-z_0-9]{0,24})["']""", path.read_text()))
    keep = {"doc_id", "text", "lang", "source", "page_id", "url", "html", "vec_id", "embedding"}
    lower = {}
    for name in sorted(found | set(CLASH.split())):
        lower.setdefault(name.lower(), name)
    return [n for k, n in lower.items() if k not in keep]


WITH_TEXT = [(i, " ".join(f"w{i % 7}_{k} the of and" for k in range(40)) + "\na b\nc d\ne f", "en", "ab"[i % 2]) for i in range(30)]


@pytest.mark.parametrize("function", [
    fertility.keep_good_documents, line_dedup.drop_repeated_lines, minhash.keep_one_of_each_group,
    mixing.mixed_documents, packing.pack, markov_secrets.find_secrets, token_files.token_files,
    minhash.near_duplicates, fertility.quality, bpe_count.token_counts, collocations.collocations,
], ids=lambda f: f.__name__)
def test_columns_named_like_internal_ones(spark, function):
    names = [n for n in internal_names() if n != "n_chars"]
    assert {"gone", "_gone_id", "_repeated", "_ranges", "keep", "key"} & set(names)
    plain = H.documents(spark, WITH_TEXT)
    wide = plain.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    want, got = function(plain), function(wide)
    cols = [c for c in want.columns if c not in ("sequence_id", "offset")]
    same = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert same(got) == same(want)
    if function in (fertility.keep_good_documents, minhash.keep_one_of_each_group, mixing.mixed_documents):
        assert got.columns == wide.columns


def test_embeddings_and_pages_with_such_columns(spark, pages):
    names = internal_names()
    wide = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<double>") \
        .select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    assert topk.top_k(wide, "vec_id % 50 = 0", 3).count() == 6
    assert whitening.whiten(wide).count() == 180
    taken = {c.lower() for c in pages.columns}
    more = pages.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n.lower() not in taken])
    assert html_text.extract(more).count() == len(PAGES) and warc.archived_pages(more).count() == len(PAGES)


SPECIAL = [(1, "a <|endoftext|> b<|startoftext|>"), (2, "<|ENDOFTEXT|> <|endoftext|"), (3, "x<|endoftext|><|endoftext|>\n <| y"),
           (4, "no such string"), (5, "<|endoftext|>")]


def test_strings_of_added_tokens(spark):
    """Their ids are those of the library's plain call."""
    import zlib
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer
    docs = H.documents(spark, SPECIAL)
    crc = lambda name, text, end: (lambda ids: (len(ids), zlib.crc32(array("I", ids).tobytes())))(
        Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids + [end])
    files = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in H.rows(token_files.token_files(docs))}
    assert files == {i: crc("byte_bpe_50k.json", t, 2) for i, t in SPECIAL}
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in H.rows(packing.pack(docs))}
    assert packed == {i: crc("word_bpe_49k.json", t, 0) for i, t in SPECIAL}


@pytest.mark.parametrize("shape", [(7, 40, 5), (5, 3, 400), (4, 300, 60)])
def test_every_source_comes_near_its_target(spark, shape):
    sources, count, words = shape
    docs = H.documents(spark, [(s * 1000 + i, " ".join(f"w{s}_{i}_{j}" for j in range(words + i % 3)), "en", f"s{s}")
                               for s in range(sources) for i in range(count)])
    mix = mixing.mix_sources(docs, shard_slots=16)
    rows = H.rows(mix.taken())
    taken: dict = {}
    for r in rows:
        key = (r["source_size"], r["target"], r["doc_id"] // 1000)
        taken[key] = taken.get(key, 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"] and (r["first_shard"] is None) == (r["taken"] == 0)
    assert len(taken) == sources
    for (_, target, _), n in taken.items():
        assert abs(n - target) <= max(1, 0.02 * target)
    # the shards hold what is taken, and their block counts of a source are draws, not one number
    shards = H.rows(mix.shards())
    held: dict = {}
    for r in shards:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["words"]
    assert held == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    counts: dict = {}
    for r in H.rows(mix.slots):
        counts[r["place"], r["shard"]] = counts.get((r["place"], r["shard"]), 0) + 1
    assert len({n for (place, _), n in counts.items() if place == 0}) > 1
    first = {r["doc_id"]: min(x["shard"] for x in shards if x["doc_id"] == r["doc_id"]) for r in rows[:20] if r["taken"]}
    assert first == {r["doc_id"]: r["first_shard"] for r in rows[:20] if r["taken"]}
