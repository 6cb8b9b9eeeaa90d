"""The parts of the operators on their own."""

from __future__ import annotations

import time
import math
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reachlab.llm import components, hashing, html_text, markov_secrets, minhash, mixing, packing, token_files, tokens, topk, warc
from tests.llm import helpers as H


@given(st.lists(st.text(alphabet="ab B\n\té日"), max_size=6))
@settings(max_examples=200, deadline=None)
def test_shingles_match_words(texts):
    got = hashing.shingle_sets([t.encode() for t in texts], 5)
    assert [len(x) for x in got] == [len(H.shingle_set(t)) for t in texts]


@given(st.text(alphabet=st.sampled_from("ab,.' \n\t\r!09éßÑ  日́<|endoftext|>\0")))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.encoder(public_tokenizers.path(name))
        assert tokens.as_ids(e.ids([text])[0]).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        both, own = rng.integers(0, 2**63, 150, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
        a, b = np.concatenate([both, own[:50]]), np.concatenate([both, own[50:]])
        s = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), 2)
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 1.05 * (0.6 * 0.4 / minhash.SLOTS) ** 0.5  # not above plain MinHash


def test_signatures_depend_on_the_set_only():
    v = hashing.stream(9, 40)
    s = minhash.signatures(np.concatenate([v, v[::-1], v]), np.array([0] * 40 + [1] * 40 + [2] * 40), 4)
    assert (s[0] == s[1]).all() and (s[0] == s[2]).all() and (s[3] == s[3].max()).all()
    one = minhash.signatures(v[:1], np.zeros(1, int), 1)[0]
    assert sorted((one >> np.uint64(56)).tolist()) == list(range(minhash.SLOTS))  # a permutation of the slots


def test_strays_are_compared_with_all_others():
    import pandas as pd
    w = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(w[:k] + [f"x{k}_{i}" for i in range(60 - k)])
    rows = [(1, 1, False, text(60)), (2, 1, False, text(56)), (3, 3, True, text(53)), (4, 4, True, text(20)),
            (5, 5, True, text(20) + " z")]
    got = minhash._compare_strays(pd.DataFrame(rows, columns=["doc_id", "component", "stray", "text"]))
    groups = {r[0]: r[1] for r in rows}
    for a, b in got.itertuples(index=False):
        old, new = groups[a], groups[b]
        groups = {k: new if v == old else v for k, v in groups.items()}
    want = {k: c for k, (_, c) in H.near_groups({r[0]: r[3] for r in rows}).items()}
    assert len({groups[3], groups[1]}) == len({want[3], want[1]}) and groups[4] == groups[5] != groups[1]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 200)] + [(300, 300), (None, 1)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_buckets_are_searched_whole(spark, monkeypatch):
    """A group of near copies around a base text, and a passage in many texts, with small limits."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 3)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "CUT_STRAYS", 10)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), rng.randint(0, 9)):
            w[k] = f"e{i}_{k}"
        docs.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(60)]
    docs += [(100 + i, " ".join(passage + [f"q{i}_{k}" for k in range(rng.randint(5, 60))])) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in H.rows(minhash.near_duplicates(H.documents(spark, docs)))}
    assert got == {k: c for k, (_, c) in H.near_groups(dict(docs)).items()}


def test_rare_shingles_part_texts_that_share_a_passage(spark):
    """400 texts with one passage: the largest group shrinks, similar pairs still meet, short texts too."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join(passage + [f"q{i}_{k}" for k in range(rng.randint(30, 90))])) for i in range(360)]
    for i in range(40):  # near copies of the first ones, from equal to just below the limit
        w = docs[i][1].split()
        for k in rng.sample(range(len(w)), i % 6):
            w[k] = f"e{i}_{k}"
        docs.append((1000 + i, " ".join(w)))
    docs += [(2000, "one two"), (2001, "one two"), (2002, ""), (2003, None)]
    keys = H.rows(minhash.rare_shingles(H.documents(spark, docs).select("doc_id", "text")))
    held = {}
    for r in keys:
        held.setdefault(r["key"], set()).add(r["doc_id"])
    assert max(map(len, held.values())) < 40
    sets = {i: H.shingle_set(t) for i, t in docs}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
            and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(near) > 20 and (2000, 2001) in near
    assert all(any({a, b} <= m for m in held.values()) for a, b in near)


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_block_permutation_is_one(n, key):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
    assert sorted(got.tolist()) == list(range(n))


def _valid(sizes, bins, capacity):
    assert (bins >= 0).all() and np.bincount(bins, weights=sizes).max() <= capacity


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 900, 700)
    parents = []
    for noise in (0.0, 0.3):
        bins = np.full(len(sizes), -1)
        packing.best_fit(sizes, packing._by_size(sizes, np.arange(len(sizes)), rng, noise), bins, 0, 2048)
        _valid(sizes, bins, 2048)
        parents.append(bins)
    for _ in range(10):
        child = packing.crossover(sizes, parents[0], parents[1], 2048, rng)
        _valid(sizes, child, 2048)
        assert set(child) == set(range(child.max() + 1))


def test_every_shard_size_gets_the_same_generations(monkeypatch):
    """Children that beat what they replace are found in small and in full shards."""
    for n in (300, packing.SHARD_PIECES):
        made = []
        real = packing.crossover
        monkeypatch.setattr(packing, "crossover", lambda *a, real=real, made=made: made.append(real(*a)) or made[-1])
        sizes = np.random.default_rng(n).integers(500, 900, n)
        best = packing.evolve(sizes, 2048, np.random.default_rng(1))
        bins = np.full(n, -1)
        plain = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), bins, 0, 2048)
        assert len(made) == packing.GENERATIONS
        assert sum(x.max() + 1 < plain for x in made) > 0 and best.max() + 1 < plain
        monkeypatch.setattr(packing, "crossover", real)


def test_evolution_is_no_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(6)
    better = 0
    for seed in range(6):
        sizes = np.random.default_rng(seed).integers(400, 1200, 300)
        bins = np.full(len(sizes), -1)
        plain = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), bins, 0, 2048)
        best = packing.evolve(sizes, 2048, rng)
        _valid(sizes, best, 2048)
        assert best.max() + 1 <= plain
        better += best.max() + 1 < plain
    assert better


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values, kind):
    ids = np.array(values, dtype=np.uint32) % np.uint32([2**32 - 1, 50_000, 7, 1][kind])
    blocks = token_files.encode_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    assert (token_files.decode_blocks(b"".join(blocks), starts)[: len(ids)] == ids).all()


def test_token_file_ranges():
    with tempfile.TemporaryDirectory() as folder:
        rng = np.random.default_rng(1)
        parts = [rng.geometric(0.001, n).astype("<u4") for n in (0, 1, 5000, 3, 0, 1023, 1024, 70_000)]
        w = token_files._Writer(f"{folder}/x.pfor")
        for i, p in enumerate(parts):
            w.add(None if i == 4 else i * 10, p.tobytes())
        w.close()
        f = token_files.TokenFile(f"{folder}/x.pfor")
        whole = np.concatenate(parts)
        for a, b in ((0, 0), (0, 1), (1020, 1030), (4999, 70_001), (0, len(whole))):
            assert (f.ids(a, b) == whole[a:b]).all()
        got = list(f.documents())
        assert [g[0] for g in got] == [0, 10, 20, 30, None, 50, 60, 70]
        assert all((g[2] == p).all() for g, p in zip(got, parts, strict=True))


def test_foreign_archive_and_pushdown(spark, tmp_path):
    def rec(kind, uri, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n"
        return (head + "\r\n").encode() + body + b"\r\n\r\n"
    raw = rec("warcinfo", "a", b"x: y") + rec("response", "b", b"WARC/1.0\r\n\r\n" * 9) + rec("resource", "c", b"")
    (tmp_path / "one.warc").write_bytes(raw)
    import gzip
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(rec("resource", "d", b"z" * 300_000)))
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    got = sorted((r["record_type"], r["target_uri"], len(r["payload"])) for r in df.collect())
    assert got == sorted([("resource", "c", 0), ("response", "b", 108), ("warcinfo", "a", 4)] * 2 + [("resource", "d", 300_000)])
    some = df.where("record_type = 'resource' and target_uri in ('d', 'e')")
    assert [len(r["payload"]) for r in some.collect()] == [300_000]
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]


def test_unwanted_members_are_not_inflated(tmp_path, monkeypatch):
    big = bytes(np.random.default_rng(1).integers(0, 256, 2_000_000, dtype=np.uint8))
    with open(tmp_path / "x.warc.gz", "wb") as f:
        for i in range(3):
            f.write(warc.record(dict(record_type="response" if i else "other", record_id=f"<urn:x-page:{i}>",
                                     warc_date="d", payload=big, payload_length=len(big))))
    read = []
    more = warc._Plain.more
    monkeypatch.setattr(warc._Plain, "more", lambda self: read.append(1) or more(self))
    got = list(warc.records(str(tmp_path / "x.warc.gz"), lambda h: h["warc-type"] == "other", True))
    assert len(got) == 1 and got[0][1] == big
    assert len(read) < 14  # one record's bytes and two heads, not three records


def test_bounds_hold_and_top_k_is_exact():
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((400, 24)) * 300)
    x[50:80] = x[10]
    ids = np.arange(400) * 3
    for segments in topk.RESOLUTIONS:
        (n, m, d), _ = topk._statistics(x, segments), None
        bound = (m * n) @ m.T + (d * n) @ d.T
        assert (bound + 1e-3 >= x @ x.T).all()
    got = topk.block_top_k(ids[:40], x[:40], ids, x, 5)
    scores = (x @ x.T).astype(int)
    want = []
    for q in range(40):
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[q, i], ids[i]))[:5]
        want += [(ids[q], ids[i], scores[q, i]) for i in order]
    assert got == want


def test_blocks_of_queries_and_candidates(spark, monkeypatch):
    rows = [(i, [float(v) for v in np.random.default_rng(i % 70).standard_normal(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, topk.top_k(df, "vec_id % 7 = 0", 4).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    assert sorted(map(tuple, topk.top_k(df, "vec_id % 7 = 0", 4).collect())) == whole


def test_markov_models_tell_random_strings_from_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ordinary, drawn = markov_secrets.ordinary_model(docs, 100), markov_secrets.random_models()
    rng = random.Random(4)
    alphabets = markov_secrets._ALPHABETS
    secrets = ["".join(rng.choice(a) for _ in range(rng.randint(20, 40))) for a in alphabets for _ in range(200)]
    # held-out words: of documents that did not train
    seen = {r["doc_id"] for r in docs.collect()}
    assert len(seen) > 100
    words = sorted({m for r in docs.collect() for m in markov_secrets._WORD.findall(r["text"])})
    names = ["_".join(rng.sample(words, 3)) + str(rng.randint(0, 9)) for _ in range(800)]
    names = [x for x in names if len(x) >= 16]
    hit = np.mean([markov_secrets.log_ratio(x, drawn, ordinary) > markov_secrets.THRESHOLD for x in secrets])
    false = np.mean([markov_secrets.log_ratio(x, drawn, ordinary) > markov_secrets.THRESHOLD for x in names])
    assert hit > 0.97 and false < 0.03


def test_secrets_of_letters_and_behind_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ordinary, drawn = markov_secrets.ordinary_model(docs), markov_secrets.random_models()
    rng = random.Random(6)
    words = [w for w in sorted({m for r in docs.collect() for m in markov_secrets._WORD.findall(r["text"])})
             if w.isalpha() and w.islower() and 3 <= len(w) <= 9]
    some = lambda n: rng.sample(words, n)

    def found(make, n=150):
        hits = 0
        for _ in range(n):
            before, secret, after = make()
            text = f"{' '.join(some(3))} é {before}{secret}{after} {' '.join(some(3))}"
            at = text.index(before + secret) + len(before)
            spans = markov_secrets.random_runs(text, drawn, ordinary)
            hits += any(a <= at + 3 and at + len(secret) - 3 <= b for a, b in spans)
        return hits / n

    draw = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    upper, lower, base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", markov_secrets._SYMBOLS[:62]
    assert found(lambda: ("", draw(upper + lower, 24), "")) > 0.97
    assert found(lambda: ("", draw(upper, 24), "")) > 0.95 and found(lambda: ("", draw(lower, 24), "")) > 0.8
    assert found(lambda: ("", draw(base62, 14), "")) > 0.5
    for by in "-_/":
        assert found(lambda: (by.join(some(6)) + by, draw(base62, 24), "")) > 0.9  # noqa: B023
        assert found(lambda: (by.join(some(3)) + by, draw(base62, 24), by + by.join(some(3)))) > 0.9  # noqa: B023
    plain = [rng.choice("-_/").join(some(rng.randint(1, 7))) for _ in range(500)]
    plain += ["2024-01-15", "4390-6985-7587-3170", "order-4390698575873170", "43906985758731701234", "-" * 60, "_/+-" * 9]
    assert sum(bool(markov_secrets.random_runs(x, drawn, ordinary)) for x in plain) <= 5
    assert not any(markov_secrets.random_runs(x, drawn, ordinary) for x in plain[500:])


@pytest.mark.parametrize("source, want", [
    ("<body><nav><a href=x>Home, news.</a></nav><div id=content><p>First &amp; second, long sentence here.</p>"
     "<p>Another  one\n, with <b>bold</b> text.</p></div><div class='sidebar'><p>Other, things.</p></div>"
     "<div id='comments'><p>I like this, a lot. Really!</p></div></body>",
     "First & second, long sentence here. Another one , with bold text."),
    ("<article><h1>Title</h1><p>Text one<p>Text two.<ul><li>a<li>b</ul></article><footer>&copy; x, y.</footer>",
     "Title Text one Text two. a b"),
    ("<main><p>x &lt;b&gt; y</p><form><input><p>Mail, please.</p></form><script>if (a<b) {}</script></main>", "x <b> y"),
    ("plain text, without tags", "plain text, without tags"),
    ("<div hidden><p>no, no.</p></div><p>yes, yes.", "yes, yes."),
    ("<head><title>no</title><p>Open, head.</p><p>More, text.", "Open, head. More, text."),
    ("<html><head><meta x><body><p>a&nbsp;b, c.</p><div class='post-meta ad'>x, y.</div>", "a b, c."),
    ("", ""),
])
def test_main_text(source, want):
    assert html_text.main_text(source) == want


_ARTICLE = "".join(f"<p>Sentence one of {i}, which is long. {'And more of it, still. ' * 20}</p>" for i in range(10))
_SHORT = ("<ul><li>first item<li>second item</ul><table><tr><td>cell a<td>cell b</table>"
          "<blockquote>A quote</blockquote><figure><img src=x><figcaption>A caption</figcaption></figure>")


@pytest.mark.parametrize("before, after", [
    ('<body class="no-sidebar">', "</body>"), ('<body class="has-header"><div>', "</div></body>"),
    ('<body><div class="content-with-sidebar">', "</div>"), ('<body><div class="layout-sidebar">', "</div><p>Tail."),
    ('<article class="post comments-open">', "</article>"), ('<div class="overflow-hidden">', "</div>"),
    ('<div style="overflow:hidden"><article>', "</article></div>"), ("<body><form action=x><div>", "</div></form>"),
    ('<body style="display:none"><main>', "</main>"), ('<div class="menu-open"><h1>T</h1><div>', "</div></div>"),
])
def test_wrappers_hide_nothing(before, after):
    got = html_text.main_text(f"<html>{before}{_ARTICLE}{after}</html>")
    assert all(f"Sentence one of {i}," in got for i in range(10))


@pytest.mark.parametrize("before, after", [("<article>", "</article>"), ("<main><div>", "</div></main>"),
                                           ("<body><div>", "</div>")])
def test_short_blocks_of_an_article_stay(before, after):
    got = html_text.main_text(f"<html>{before}{_ARTICLE}{_SHORT}{_ARTICLE}{after}"
                              '<div class="sidebar"><p>Other, things. Here.</p></div><form><p>Mail, please.</p></form>')
    for part in ("first item second item", "cell a cell b", "A quote", "A caption"):
        assert part in got
    assert not any(x in got for x in ("Other", "Mail"))


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', "class=x hidden", 'style="a:b; display: none"',
                                       'aria-hidden="true"', "class=sidebar"])
def test_hidden_parts_of_an_article_go(attribute):
    got = html_text.main_text(f"<article>{_ARTICLE}<div {attribute}><p>Not, this. One.</p></div></article>")
    assert "Sentence one of 9," in got and "Not, this" not in got


@pytest.mark.parametrize("before, after", [
    ("<p title=it's>Odd, here.</p>", ""), ("<!-->", ""), ("<!--->", ""), ("<!-- a > b --!>", ""), ("<p a='1'b=\"2\">Odd, here.</p>", ""),
    ("<p =x y = 'z' class=\"o\"dd>Odd, here.</p>", ""), ("<p title=a/b?c='d>Odd, here.</p>", ""), ("</ bogus>", "</>"),
    ("", '<p class="never closed>Odd, here.</p>'),
])
def test_odd_markup_loses_no_text(before, after):
    got = html_text.main_text(f"<html><body><article>{before}{_ARTICLE}{after}</article></body></html>")
    assert all(f"Sentence one of {i}," in got for i in range(10)) and "<" not in got and "bogus" not in got
    assert ("Odd, here." in got) == ("Odd, here." in before + after)


@pytest.mark.parametrize("name", ["legal-analysis", "alert-level-guide", "social-history", "search-for-truth"])
def test_sections_of_an_article_stay_whatever_their_name(name):
    got = html_text.main_text(f"<article>{_ARTICLE}<section class={name}><p>Of its own, this.</p></section>"
                              f"<menu><li>Salt</li></menu><div class=share-buttons>Tell others.</div></article>")
    assert "Of its own, this." in got and "Salt" in got and "Tell others" not in got


@pytest.mark.parametrize("other", ["<article class=teaser><p>Not, this. One.</p></article>",
                                   "<section id=discussion><article class=comment><p>Not, this. One.</p></article></section>",
                                   "<ins class=adsbygoogle>Not, this. One.</ins>", "<div class=gdpr-bar><p>Not, this. One.</p></div>"])
def test_teasers_and_discussions_go(other):
    got = html_text.main_text(f"<body><article class='post comments-open'>{_ARTICLE}</article>{other}</body>")
    assert "Sentence one of 9," in got and "Not, this" not in got


@pytest.mark.parametrize("page", [
    '<a "" ' * 160_000 + "'", '<a x="' * 160_000, "<div>x" * 160_000, "".join(f"<x{i}><p>t</p></x{i}>" for i in range(30_000)),
    "<" * 1_000_000, "<!--" * 250_000, "<article class=comment>x" * 40_000, "<b>x" * 200_000, "<i><hr>" * 140_000,
], ids=["quotes", "unclosed", "deep", "paths", "angles", "comments", "articles", "inline", "rules"])
def test_hostile_markup_costs_by_its_length(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_smoothing_equals_all_pairs_of_paths():
    rng = random.Random(4)
    parents = [-1] + [rng.randrange(max(0, i - 6), i) for i in range(1, 120)]
    sums = {p: [rng.randint(1, 9), rng.randint(0, 900), rng.randint(0, 40), False] for p in rng.sample(range(120), 60)}

    def line(p):
        return [p] + (line(parents[p]) if parents[p] >= 0 else [])

    got = html_text.smoothed(sums, parents)
    for p in sums:
        total = [0.0, 0.0, 0.0]
        for q, (nodes, chars, marks, _) in sums.items():
            w = math.exp(-len(set(line(p)) ^ set(line(q))) ** 2 / (2 * html_text.SPREAD ** 2))
            total = [a + w * b for a, b in zip(total, (chars / nodes, marks / nodes, 1), strict=True)]
        assert got[p] == pytest.approx((total[0] / total[2], total[1] / total[2]), rel=1e-9)


def test_identifiers_are_no_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ordinary, drawn = markov_secrets.ordinary_model(docs), markov_secrets.random_models()
    for name in ("NullPointerException", "getElementsByClassName", "XMLHttpRequest", "ThisIsAnOrdinaryIdentifierName",
                 "kubectl-v1-28-linux-amd64", "HttpServletRequestWrapper", "handleMouseEnterEvent", "parseJSONResponse",
                 "AbstractSingletonProxyFactoryBean", "org/apache/spark/SQLContext", "PostgreSQL", "getUserById", "CLOWN"):
        assert markov_secrets.random_runs(f"see {name} for it", drawn, ordinary) == []
    rng = random.Random(8)
    base62 = markov_secrets._SYMBOLS[:62]
    hits = [bool(markov_secrets.random_runs("".join(rng.choice(base62) for _ in range(12)), drawn, ordinary)) for _ in range(400)]
    assert np.mean(hits) > 0.93


def test_secret_spans_against_a_direct_scorer(spark):
    """Whole runs: log ratios added up symbol by symbol from the models' probabilities."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ordinary, drawn = markov_secrets.ordinary_model(docs), markov_secrets.random_models()
    symbols = markov_secrets._SYMBOLS
    rng = random.Random(9)

    def likelihood(model, run):
        at, total = len(symbols), 0.0
        for c in run:
            total += model[at, symbols.index(c)]
            at = symbols.index(c)
        return total

    for _ in range(100):
        run = "a" + "".join(rng.choice(symbols[: rng.choice([36, 62, 66])]) for _ in range(rng.randint(15, 40)))
        best = max(likelihood(m, run) for m in drawn)
        want = (best - likelihood(ordinary[0], run)) / len(run) > markov_secrets.THRESHOLD and (
            (best - max(likelihood(m, run) for m in ordinary[1:])) / len(run) > markov_secrets.WHOLE)
        assert ((0, len(run)) in markov_secrets.random_runs(run, drawn, ordinary)) >= want
        assert markov_secrets.looks_random(run, drawn, ordinary) == want
