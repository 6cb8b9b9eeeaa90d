"""Every query against a brute-force version on the whole of its table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reachlab.llm import queries
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in H.rows(spark.read.parquet(f"{SF}/documents.parquet"))}


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r for r in H.rows(spark.read.parquet(f"{SF}/pages.parquet"))}


def _tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def _crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_op1_pieces_fill_sequences(spark, docs):
    got = H.rows(queries.op1_genetic_packing(spark, SF))
    t = _tokenizer("word_bpe_49k.json")
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(docs)
    total = 0
    for doc_id, d in docs.items():
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        for k, r in enumerate(mine):
            part = ids[2048 * k: 2048 * (k + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), _crc(part))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_op2_article(spark, pages):
    got = {r["page_id"]: r for r in H.rows(queries.op2_tag_path_text(spark, SF))}
    assert set(got) == set(pages)
    for k, p in pages.items():
        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        import html
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split())
                 for x in re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", body))]
        want = " ".join(x for x in parts if x)
        assert got[k]["text"] == want and got[k]["n_chars"] == len(want) and got[k]["url"] == p["url"]


def test_op3_archive(spark, pages):
    got = {r["page_id"]: r for r in H.rows(queries.op3_warc_pages(spark, SF))}
    first = {}
    for k in sorted(pages):
        raw = (pages[k]["html"] or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        refers = first.setdefault(digest, k) if len(raw) >= 100 else k
        assert got.pop(k) == dict(page_id=k, payload_bytes=len(raw), payload_digest=digest,
                                  record_type="response" if refers == k else "revisit",
                                  refers_to=None if refers == k else refers)
    assert not got


def test_op4_targets(spark, docs):
    got = {r["doc_id"]: r for r in H.rows(queries.op4_block_mix(spark, SF))}
    sizes = Counter()
    for d in docs.values():
        sizes[d["source"]] += len(H.words(d["text"]))
    target, taken = H.water_fill(sizes), Counter()
    for k, d in docs.items():
        r = got[k]
        assert r["size"] == len(H.words(d["text"])) and r["source_size"] == sizes[d["source"]]
        assert math.isclose(r["target"], target[d["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 256
    again = {r["doc_id"]: r for r in H.rows(queries.op4_block_mix(spark, SF))}
    assert again == got


def test_op5_windows(spark, docs):
    got = {r["doc_id"]: r for r in H.rows(queries.op5_line_windows(spark, SF))}
    want = H.line_windows([(k, d["text"]) for k, d in docs.items()])
    assert {k: r["text"] for k, r in got.items()} == want
    assert any(r["n_removed"] for r in got.values())


def test_op6_groups(spark, docs):
    got = {r["doc_id"]: r for r in H.rows(queries.op6_minhash_groups(spark, SF))}
    for k, (n, component) in H.near_groups({k: d["text"] for k, d in docs.items()}).items():
        assert got[k] == dict(doc_id=k, n_shingles=n, component_id=component, kept=k == component)


def test_op7_top_5(spark):
    vectors = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]]
               for r in H.rows(spark.read.parquet(f"{SF}/embeddings.parquet"))}
    want = []
    for q in sorted(v for v in vectors if v % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], x, strict=True)), v)
                      for v, x in vectors.items() if v != q)[:5]
        want += [dict(query_id=q, rank=i + 1, vec_id=v, score=-s) for i, (s, v) in enumerate(best)]
    got = sorted(H.rows(queries.op7_segment_top_k(spark, SF)), key=lambda r: (r["query_id"], r["rank"]))
    assert got == want


def test_op8_rules(spark, docs):
    got = {r["doc_id"]: r for r in H.rows(queries.op8_fertility(spark, SF))}
    labels = {r["doc_id"]: r["quality"] for r in H.rows(spark.read.parquet(f"{SF}/labels.parquet"))}
    kept, bad = Counter(), Counter()
    for k, d in docs.items():
        for name, value in H.quality_base(d["text"]).items():
            assert got[k][name] == value, (k, name)
        assert not (got[k]["base_failed"] and got[k]["kept"])
        if k in labels and not got[k]["base_failed"]:
            kept[labels[k]] += got[k]["kept"]
            bad[labels[k]] += 1
    assert kept[1] >= 0.98 * bad[1]


def test_op8_measures_and_bands(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in H.rows(queries.op8_fertility(spark, SF))}
    by = defaultdict(list)
    for k, d in docs.items():
        ids = [i for w in H.words(d["text"]) for i in sp.encode(w)]
        if not ids:
            continue
        n = Counter(ids).values()
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in n)
        assert math.isclose(got[k]["entropy"], entropy, abs_tol=1e-9)
        assert math.isclose(got[k]["chars_per_piece"], sum(map(len, H.words(d["text"]))) / len(ids))
        assert math.isclose(got[k]["byte_share"], sum(map(sp.is_byte, ids)) / len(ids))
        if not got[k]["base_failed"]:
            by[d["lang"]].append(got[k])
    from reachlab.llm.fertility import BANDS
    for lang, some in by.items():
        limits = {}
        for name, band in BANDS.items():
            grid = sorted(math.floor(r[name] / band.bin + 0.5) for r in some)
            q = [grid[math.ceil(len(grid) * s) - 1] * band.bin for s in (0.25, 0.5, 0.75)]
            half = max((q[2] - q[0]) / 1.349 * band.deviations, band.least * (q[1] if band.relative else 1))
            limits[name] = (q[1] - half if band.below else -math.inf, q[1] + half if band.above else math.inf)
        for r in some:
            assert r["kept"] == all(a <= r[name] <= b for name, (a, b) in limits.items())


def test_op9_base(spark, docs):
    kinds = ("assign", "access", "hex")
    patterns = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    got = {r["doc_id"]: r for r in H.rows(queries.op9_markov_secrets(spark, SF))}
    for k, d in docs.items():
        found = []
        for i, p in enumerate(patterns):
            for m in re.finditer(p, d["text"] or ""):
                if len(m[2] if i == 0 else m[0]) >= (6, 20, 24)[i]:
                    found.append((m.start(), i, m.end()))
        say = [f"{kinds[i]}:{a}:{b}" for a, i, b in sorted(found)]
        r = got[k]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(i == j for _, i, _ in found) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(say).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(say) <= set(spans) and len(spans) == len(say) + r["n_markov"]


def test_op10_files(spark, docs):
    got = {r["doc_id"]: r for r in H.rows(queries.op10_token_files(spark, SF))}
    t = _tokenizer("byte_bpe_50k.json")
    start = 0
    for k in sorted(docs):
        ids = t.encode(docs[k]["text"] or "", add_special_tokens=False).ids + [2]
        assert got[k] == dict(doc_id=k, start=start, n_tokens=len(ids), ids_crc32=_crc(ids))
        start += len(ids)
