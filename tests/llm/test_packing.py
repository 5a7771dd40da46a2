"""Packing: tokens equal the tokenizer's, sequences are gapless and near the bound; and the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import packing_lp

from .conftest import prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return packing_lp.Encoder(packing_lp.default_tokenizer())


def test_ids_equal_the_tokenizers(encoder):
    r = random.Random(3)
    letters = "aZ'` tdéÉßÀ÷×ª²½ΩσΣ日本́­\x1c \t\n.,!?%09|<>—•İ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["x<|endoftext|>y", "I'll DON'T's", "Å", ""]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == want


def check_packing(rows, max_len):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= max_len
    return len(seqs)


def test_packing(spark, encoder):
    docs = [(i, prose(i, random.Random(i).randint(1, 120))) for i in range(400)] + [(900, prose(5, 9000)), (901, None), (902, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing_lp.packed(packing_lp.pieces(df, packing_lp.default_tokenizer(), max_len=512), 512).collect()
    n = check_packing(rows, 512)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 512) + 1
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in docs:
        ids = [*encoder.tok.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 512)) and sum(p["length"] for p in parts) == len(ids)
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_packing_of_odd_rows(odd_docs):
    rows = packing_lp.packed(packing_lp.pieces(odd_docs, packing_lp.default_tokenizer())).collect()
    check_packing(rows, 4096)
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1} and sum(r["doc_id"] == 6 for r in rows) == 2
    assert packing_lp.packed(packing_lp.pieces(odd_docs.limit(0), packing_lp.default_tokenizer())).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(129, np.int64)
    for s in rng.integers(1, 129, 60):
        hist[s] += int(rng.integers(1, 50))
    confs = packing_lp.configurations(hist, 128)
    back = np.zeros(129, np.int64)
    for c, k in confs:
        assert sum(s * n for s, n in c.items()) <= 128
        for s, n in c.items():
            back[s] += n * k
    assert (back == hist).all()
    total = sum(k for _, k in confs)
    bound = -(-int((hist * np.arange(129)).sum()) // 128)
    assert bound <= total <= 1.1 * bound + 2


def test_the_program_beats_best_fit_where_it_should():
    for lengths, copies in (((18, 23, 25), 68), ((28, 44, 46, 54), 58), ((26, 28, 36, 43), 56)):
        hist = np.zeros(101, np.int64)
        hist[list(lengths)] = copies
        confs = packing_lp.configurations(hist, 100)
        assert sum(k for _, k in confs) < sum(k for _, k in packing_lp.best_fit(hist.copy(), 100))


def test_the_fractional_packing_covers_and_its_bound_holds():
    rng = np.random.default_rng(4)
    hist = np.zeros(257, np.int64)
    np.add.at(hist, rng.integers(1, 129, 900), 1)
    columns, bound = packing_lp.solve(hist, 256)
    back = np.zeros(257)
    for key, x in columns.items():
        assert sum(s * k for s, k in key) <= 256
        for s, k in key:
            back[s] += k * x
    assert (back >= hist - 1e-6).all()
    assert (hist * np.arange(257)).sum() / 256 <= bound + 1e-6 and bound <= sum(columns.values()) <= 1.1 * bound


def test_nearly_all_pieces_come_from_the_program(monkeypatch):
    rng = np.random.default_rng(5)
    hist = np.zeros(1025, np.int64)
    np.add.at(hist, np.minimum(1024, rng.lognormal(5, 1, 5000).astype(int) + 1), 1)
    rest = []
    plain = packing_lp.best_fit
    monkeypatch.setattr(packing_lp, "best_fit", lambda left, cap: rest.append(int(left.sum())) or plain(left, cap))
    total = sum(k for _, k in packing_lp.configurations(hist, 1024))
    assert sum(rest) < 0.1 * hist.sum() and total <= -(-int((hist * np.arange(1025)).sum()) // 1024) + 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    good = [(i, prose(i, 60 + i % 50) + (f" mail u{i}@mail.org" if i % 9 == 0 else ""), "en", "s", 1) for i in range(450)]
    bench = prose(777, 20)
    extra = [
        (500, good[1][1], "en", "s", 1),  # an exact copy
        (501, prose(501, 70).upper().replace(" ", "!! "), "en", "s", 1),
        (502, prose(502, 40) + " " + bench + " " + prose(503, 30), "en", "s", 1),
        (503, prose(504, 50) + " write to some.body@mail.org now " + prose(505, 30), "en", "s", 1),
    ]
    junk = [(600 + i, prose(i, 50).upper().replace(" ", "!! "), "en", "s", 1) for i in range(40)]
    d = str(tmp_path)
    spark.createDataFrame(good + extra + junk, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(600 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert not {500, 501, 502} & set(kept)
    assert 503 in kept
    assert len(set(kept) & set(range(450))) >= 440
    assert "some.body" not in kept[503]["text"] and kept[503]["n_chars"] == len(kept[503]["text"])
    rows = cp.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in rows} == set(kept) and check_packing(rows, 4096)


def test_pipeline_keeps_rows_apart(spark, tmp_path):
    """Null, repeated and clashing ids and columns in each stage."""
    import corpus_pipeline as cp

    d, bench = str(tmp_path), prose(777, 20)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, pii_kinds string, row string, key string, th string, place string, at string"
    tail = ("en", "s", 1, "S", "P", "R", "K", "T", "L", "A")
    good = [(i, prose(i, 60), *tail) for i in range(300)]
    odd = [(None, prose(900, 60), *tail), (None, prose(901, 60), *tail), (2, prose(902, 60), *tail), (2, prose(903, 60), *tail), (3, prose(3, 60), *tail)]
    hits = [(None, prose(904, 40) + " " + bench, *tail), (5, prose(905, 40) + " " + bench, *tail)]
    junk = [(600 + i, prose(i, 50).upper().replace(" ", "!! "), *tail) for i in range(40)]
    spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(600 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame(good + odd + hits + junk, schema)
    texts = lambda df: sorted((r["text"] for r in df.collect()), key=str)
    out = cp.quality(spark, docs, d)
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} >= {r[1] for r in odd}
    docs = spark.createDataFrame(good[:9] + odd + hits + [(None, None, *tail), (9, "", *tail)], schema)
    out = cp.near_dedup(spark, docs, d)
    assert out.columns == docs.columns and texts(out) == sorted([r[1] for r in good[:9] + odd[:4] + hits] + [""], key=str)
    out = cp.decontamination(spark, docs, d)
    assert out.columns == docs.columns and texts(out) == sorted([r[1] for r in good[:9] + odd] + [None, ""], key=str)
    out = cp.pii(spark, docs, d)
    assert out.columns == docs.columns and texts(out) == texts(docs)
    assert {r["pii_kinds"] for r in out.collect()} == {"P"}
    assert cp.packing(spark, docs, d).count() == docs.count()
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name
