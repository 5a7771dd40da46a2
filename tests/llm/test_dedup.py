"""Substring, suffix and near-duplicate operators against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridloom.llm import chunk_dedup, simhash_vptree, suffix_dedup
from gridloom.llm._common import connected_components

from .conftest import prose


def brute_suffix(docs, length):
    """``docs`` sorted pairs of id and bytes: bytes, removed, spans, digest of the rest."""
    seen, out = set(), {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            if k in seen:
                gone[s : s + length] = True
            seen.add(k)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def corpus():
    passage = prose(100, 60)
    line = prose(101, 9)
    docs = [prose(i, 50) + " " + (passage if i % 3 == 0 else line) + " " + prose(i + 50, 40) for i in range(24)]
    docs += [docs[0], docs[3][:200] + "!" + docs[3][200:], "ab " * 400, "", passage + passage, "é" * 300]
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("options", [{}, {"share": 0.0, "sample": 1.0, "buckets": 5}])
def test_suffix_dedup_is_exact(spark, options):
    docs = corpus()
    want = brute_suffix([(i, t.encode()) for i, t in docs], 100)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.deduplicated(df, **options).collect()}
    assert got == want


def test_suffix_dedup_odd_rows(odd_docs):
    rows = suffix_dedup.deduplicated(odd_docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == odd_docs.count()
    assert by[1][0]["n_removed"] == 0 and by[5][0]["n_removed"] == by[5][0]["n_bytes"]
    assert by[2][0]["n_bytes"] == 0 and by[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[6][0] == by[6][1] and by[6][0]["n_removed"] == 0
    assert suffix_dedup.deduplicated(odd_docs.limit(0)).count() == 0


def test_multikey_order_finds_all_ties():
    buf = np.frombuffer(b"abcdefghijkl" * 30 + b"zz", np.uint8)
    at = np.arange(0, 200)
    idx, group = suffix_dedup.multikey_ties(buf, at, np.full(200, 100), np.zeros(200, np.int64))
    assert set(idx.tolist()) == set(range(200)) and len(set(group.tolist())) == 12


def test_nothing_is_found_without_the_sort(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(suffix_dedup, "multikey_ties", lambda *a: (none, none))
    assert suffix_dedup.deduplicated(docs).where("n_removed > 0").count() == 0


def test_rows_without_an_id_are_told_apart(spark):
    text = prose(3, 60)
    docs = spark.createDataFrame([(None, text + " one"), (None, "two " + text), (1, text), (None, prose(4, 60))], "doc_id long, text string")
    rows = suffix_dedup.deduplicated(docs).collect()
    assert sorted(r["n_removed"] >= len(text) for r in rows) == [False, False, True, True]


def brute_chunks(docs, bits=5, least=16, most=256, min_run=64):
    g = np.random.default_rng(77).integers(0, 2**16, 256, np.uint16).astype(int).tolist()
    seen, out = set(), {}
    for i, t in docs:
        h = at = 0
        cuts = []
        for k, c in enumerate(t):
            h = ((h << 1) + g[c]) & 0xFFFF
            if k + 1 - at >= most or k + 1 - at >= least and h >> (16 - bits) == 0:
                cuts.append((at, k + 1))
                at = k + 1
        if at < len(t):
            cuts.append((at, len(t)))
        runs = []
        for a, b in cuts:
            if t[a:b] in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(t[a:b])
        runs = [r for r in runs if r[1] - r[0] >= min_run or r[1] - r[0] == len(t)]
        gone = np.zeros(len(t), bool)
        for a, b in runs:
            gone[a:b] = True
        out[i] = (len(t), int(gone.sum()), len(runs), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def test_chunk_dedup(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in chunk_dedup.deduplicated(df).collect()}
    assert got == brute_chunks([(i, t.encode()) for i, t in docs])


def test_chunks_survive_insertions(spark):
    a = prose(7, 400)
    rows = chunk_dedup.deduplicated(spark.createDataFrame([(1, a), (2, "shifted " + a)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] > 0.9 * len(a) for r in rows} == {1: False, 2: True}


def test_chunk_dedup_odd_rows(odd_docs):
    rows = chunk_dedup.deduplicated(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r["n_bytes"] == 0 for r in rows) == 2
    assert chunk_dedup.deduplicated(odd_docs.limit(0)).count() == 0


def test_simhash_by_definition():
    words = ("A b c d " * 3 + "E f").lower().split()
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert simhash_vptree.simhash64("A b\tc d " * 3 + "E f") == want
    assert simhash_vptree.simhash64(None) == simhash_vptree.simhash64(" \n") == 0
    assert simhash_vptree.simhash64("One two") == xxhash.xxh64(b"one two", seed=42).intdigest()


def brute_components(x, r):
    lab = list(range(len(x)))
    for i in range(len(x)):
        for j in range(i):
            if bin(int(x[i]) ^ int(x[j])).count("1") <= r:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if k in (a, b) else k for k in lab]
    return lab


@pytest.mark.parametrize("most", [10_000, 8])
def test_links_keep_every_component(spark, most):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 12, np.uint64)
    x = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            v = int(c)
            for k in rng.choice(64, rng.integers(1, 4), replace=False):
                v ^= 1 << int(k)
            x.append(v)
    x += list(range(200))  # a dense cluster around zero
    x = np.unique(np.array(x, np.uint64))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    star = {r["node"]: r["root"] for r in connected_components(simhash_vptree.links(df, 3, most)).collect()}
    got = [star.get(int(v), int(v)) for v in x.view(np.int64)]
    want = brute_components(x, 3)
    pairs = lambda lab: {(i, j) for i in range(len(lab)) for j in range(i) if lab[i] == lab[j]}
    assert pairs(got) == pairs(want)


def test_vp_links_equal_brute_force():
    rng = np.random.default_rng(4)
    x = np.unique(np.r_[rng.integers(0, 2**64, 300, np.uint64), rng.integers(0, 2**12, 300, np.uint64)])
    a, b = simhash_vptree.vp_links(x, 3)
    d = np.bitwise_count(x[:, None] ^ x[None])
    assert (d[a, b] <= 3).all() and (a != b).all()
    i, j = np.nonzero(d <= 3)
    want, got = simhash_vptree._labels(len(x), i, j), simhash_vptree._labels(len(x), a, b)
    assert (want == got).all()


def test_the_tree_brings_every_pair_together():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 4000, np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    nodes = simhash_vptree.vp_tree(x[:2000], 3, 5)
    assert len(nodes) > 10
    batch = pa.RecordBatch.from_arrays([pa.array(np.r_[x, y].view(np.int64))], ["fp"])
    leaf = {}
    for b in simhash_vptree._shards(nodes, 3)([batch]):
        for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            leaf.setdefault(f, set()).add(s)
    assert all(leaf[int(p)] & leaf[int(q)] for p, q in zip(x.view(np.int64), y.view(np.int64), strict=True))
    assert sum(map(len, leaf.values())) < 5 * len(leaf)


def test_links_come_through_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i // 2, 200) + (" x" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    rows = simhash_vptree.components(docs).collect()
    prints = len({r["fp"] for r in rows})
    assert len({r["component_id"] for r in rows}) < prints
    monkeypatch.setattr(simhash_vptree, "vp_links", lambda x, r: np.zeros((2, 0), np.int64))
    assert len({r["component_id"] for r in simhash_vptree.components(docs).collect()}) == prints


def test_components_of_odd_rows(odd_docs):
    rows = simhash_vptree.components(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by[5]["component_id"] == 1 and by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[2]["fp"] == 0 and simhash_vptree.components(odd_docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in connected_components(e).collect()} == {0}
