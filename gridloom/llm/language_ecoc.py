"""Language identification with error-correcting output codes (operator 6).

Each language has a codeword of +1 and -1. One linear classifier on hashed byte n-grams (orders 1 to 3, of
letters only) predicts each bit; decoding takes the codeword with the smallest sum of logistic losses,
each weighted by how well its bit is learnt. Texts whose two best codewords lie close are flagged.

Up to seven languages get the exhaustive code, more a dense random one of ``10 log2`` bits chosen for its
smallest distance. The fit uses a bounded sample of labelled rows, about ``max_rows`` in all and equally
many of each language where there are so many, and of each text the whole and two short cuts of it.
Prediction covers every row and its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled row all
are ``und``; one learnt language is predicted for all other texts; repeated rows get repeated results;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 4096
ASCII_LETTER = re.compile("[A-Za-z]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, of length one."""
    a = _KEEP[np.frombuffer(f" {text} ".lower().encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    out = np.zeros(DIM)
    step = 1 << 18
    for i in range(0, len(a), step):
        x = a[i : i + step + 2]
        two = x[:-1] * np.uint32(256) + x[1:]
        three = two[:-1] * np.uint32(256) + x[2:]
        for k, code in ((1, x[: min(step, len(a) - i)]), (2, two), (3, three)):
            code = code[code % 256 != 32] if k < 3 else code[(code >> 8) % 256 != 32]
            out += np.bincount((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    return (out / max(1e-9, np.linalg.norm(out))).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """An ``n`` by bits matrix of +1 and -1 with distinct, non-constant columns where it is exhaustive."""
    if not n:
        return np.zeros((0, 0))
    if n <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (n, int(np.ceil(10 * np.log2(n)))))
        d = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = code, d
    return best


class Model:
    """Bit classifiers, their weights and the codewords of the learnt languages."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, steps: int = 250):
        self.langs = sorted(set(lang.tolist()))
        self.code = codewords(len(self.langs))
        y = self.code[np.searchsorted(self.langs, lang)] if len(lang) else np.zeros((0, 0))
        bits = y.shape[1] if len(lang) else 0
        self.w, self.b, self.weight = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits)
        if not bits:
            return
        y = y.astype(np.float32)
        each = np.bincount(np.searchsorted(self.langs, lang))
        row = (1 / each[np.searchsorted(self.langs, lang)]).astype(np.float32)
        row /= row.sum()
        m, s = np.zeros_like(self.w), np.zeros_like(self.w)
        for step in range(1, steps + 1):
            g = -y / (1 + np.exp(np.clip(y * (x @ self.w + self.b), -30, 30))) * row[:, None]
            grad = x.T @ g + 1e-6 * self.w
            m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
            self.w -= (0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            self.b -= 2 * g.sum(axis=0)
        right = ((x @ self.w + self.b) * y > 0).T @ row
        self.weight = np.clip(2 * right - 1, 0.05, 1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its probability and the margin to the second best."""
        f = x @ self.w + self.b
        loss = (np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.weight).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else 0
        return p.argmax(axis=1), top[:, -1], top[:, -1] - second


def _training_rows(batches):
    for b in batches:
        xs, langs = [], []
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = t.split()
            for cut in (t, " ".join(words[:12]), " ".join(words[len(words) // 2 :][:4])):
                if has_letter(cut):
                    xs.append(ngrams(cut).astype(np.float16).tobytes())
                    langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(langs, pa.string())], ["x", "lang"])


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 4000) -> Model:
    """A model from the labelled rows where ``may_learn`` holds."""
    rows = docs.where(may_learn).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    share = max_rows / max(1, len(counts))
    pick = F.lit(False)
    for lang, n in counts.items():
        pick = pick | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1_000_000)) < min(1_000_000, round(1_000_000 * share / n))))
    got = rows.where(pick).select("text", "lang").mapInArrow(_training_rows, "x binary, lang string").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    lang = np.array(got["lang"].to_pylist(), object)
    order = np.lexsort((x[:, 1], x[:, 0], x.sum(axis=1), lang.astype(str))) if len(lang) else np.zeros(0, int)
    return Model(x[order], lang[order])


def identified(docs: DataFrame, model: Model, text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_ambiguous``."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts):
        import pandas as pd

        out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "ambiguous": True}, index=range(len(texts)))
        has = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if model.langs else []
        for i in range(0, len(has), 256):
            at = has[i : i + 256]
            best, p, gap = model.decode(np.stack([ngrams(texts.iloc[j]) for j in at]))
            out.loc[at, "lang_pred"] = np.array(model.langs, object)[best]
            out.loc[at, "score"] = p
            out.loc[at, "ambiguous"] = gap < margin
        return out

    p = predict(F.col(text_col).cast("string"))
    return docs.withColumn("_p", p).withColumns({"lang_pred": F.col("_p.lang_pred"), "lang_score": F.col("_p.score"), "lang_ambiguous": F.col("_p.ambiguous")}).drop("_p")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``, and ``ambiguous``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identified(docs.drop("lang"), fit(docs, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
