"""Text quality by positive-unlabelled learning (operator 5).

Trusted positives (label 1) and unlabelled web text train a small network on statistics of the whole
text by minimising the non-negative unbiased risk  pi R_p+ + max(0, R_u- - pi R_p-)  with the logistic
loss. The class prior pi is estimated from the two samples by the best-bin method: the smallest ratio of
the unlabelled to the positive share above a score threshold, with a confidence margin.

The fit uses bounded samples, chosen by a hash of the id: about ``max_rows`` positives and as many
unlabelled texts. Scoring covers every row and its whole text.

Defined results: null and empty texts are scored as empty texts; repeated rows get repeated scores; with
no positive or no unlabelled row the score is the prior 0.5 for all; an empty table gives an empty result;
label rows with a null or contradictory quality are not positives; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"!", b"?", b"|", b"*#%$&@^~=+", b"<>{}[]()", b"\\/_-", b"\"'`")
N_FEATURES = len(GROUPS) + 12


def features(text: str | None) -> list[float]:
    """Statistics of a whole text: character classes, repetition of words and lines, lengths."""
    b = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n = max(1, len(b))
    out = [float(hist[list(g)].sum()) / n for g in GROUPS]
    words = b.split()
    m = max(1, len(words))
    lines = b.split(b"\n")
    pairs = len(set(zip(words, words[1:], strict=False)))
    distinct = len(set(words))
    out += [
        float(hist[128:].sum()) / n,
        distinct / m,
        pairs / max(1, len(words) - 1),
        sum(map(bytes.__eq__, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        np.log1p(distinct) / np.log1p(m),
        np.log1p(len(words)) / 10,
        np.log1p(n / m) / 5,
        np.log1p(n / len(lines)) / 10,
        np.log1p(len(lines)) / 10,
        np.log1p(max(map(len, words), default=0)) / 5,
        float(not words),
    ]
    return out


def _rows(batches):
    for b in batches:
        x = [features(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "positive"])


class Model:
    """A one-hidden-layer network on standardised, clipped features."""

    def __init__(self, p: np.ndarray, u: np.ndarray, hidden: int = 16, steps: int = 1500, seed: int = 7):
        self.ok = len(p) > 0 and len(u) > 0
        if not self.ok:
            return
        self.mid, self.scale = u.mean(axis=0), u.std(axis=0) + 1e-3
        p, u = self._z(p), self._z(u)
        self.prior = 0.5
        self._fit(p, u, hidden, steps // 3, seed, plain=True)
        self.prior = best_bin_prior(self._g(p), self._g(u))
        self._fit(p, u, hidden, steps, seed, plain=False)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mid) / self.scale, -6, 6)

    def _g(self, z: np.ndarray) -> np.ndarray:
        w, b, v, c = self.par
        return np.tanh(z @ w + b) @ v + c

    def _fit(self, p, u, hidden, steps, seed, plain):
        """Adam on minibatches. ``plain``: positives against unlabelled rows, for the prior's scores."""
        rng = np.random.default_rng(seed)
        self.par = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(())]
        m, s = [np.zeros_like(x) for x in self.par], [np.zeros_like(x) for x in self.par]
        for step in range(1, steps + 1):
            zp, zu = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]
            z = np.concatenate([zp, zu])
            z = z + rng.normal(0, 0.5, z.shape)  # noise keeps a small sample from being learnt by heart
            w, b, v, c = self.par
            h = np.tanh(z @ w + b)
            g = h @ v + c
            plus, minus = -1 / (1 + np.exp(np.clip(g, -30, 30))), 1 / (1 + np.exp(np.clip(-g, -30, 30)))  # slopes of the loss for either label
            dg, k = np.zeros(len(z)), len(zp)
            if plain:
                dg[:k], dg[k:] = plus[:k] / k, minus[k:] / len(zu)
            else:
                negative = np.logaddexp(0, g[k:]).mean() - self.prior * np.logaddexp(0, g[:k]).mean()
                if negative >= 0:
                    dg[:k], dg[k:] = self.prior * (plus[:k] - minus[:k]) / k, minus[k:] / len(zu)
                else:  # the risk on negatives can't be below zero: step back from it
                    dg[:k], dg[k:] = self.prior * minus[:k] / k, -minus[k:] / len(zu)
            dh = np.outer(dg, v) * (1 - h * h)
            grads = [z.T @ dh + 1e-2 * w, dh.sum(axis=0), h.T @ dg + 1e-2 * v, dg.sum()]
            for i, x in enumerate(grads):
                m[i], s[i] = 0.9 * m[i] + 0.1 * x, 0.999 * s[i] + 0.001 * x * x
                self.par[i] = self.par[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._g(self._z(x)), -30, 30)))


def best_bin_prior(gp: np.ndarray, gu: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows from both samples' scores."""
    at = np.unique(np.quantile(gp, np.linspace(0, 0.99, 100)))
    qp, qu = (gp[None] >= at[:, None]).mean(axis=1), (gu[None] >= at[:, None]).mean(axis=1)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(gp)) + 1 / np.sqrt(len(gu)))
    best = np.argmin((qu + margin) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def sampled(col: Column, rows: int, most: int) -> Column:
    """Whether an id falls into a sample of about ``most`` of ``rows`` rows, by its hash."""
    return F.lit(True) if rows <= most else F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1_000_000)) < round(1_000_000 * most / rows)


def fit(docs: DataFrame, positives: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 15_000) -> Model:
    """A model from ``docs`` rows where ``may_learn`` holds; ``positives`` has the ids of trusted ones."""
    positives = positives.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    positives = positives.where(sampled(F.col("_id"), positives.count(), max_rows)).limit(2 * max_rows)  # a bound for the broadcast
    rows = docs.where(may_learn).select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    picked = rows.join(F.broadcast(positives), F.col("_d") == F.col("_id"), "left")
    web = sampled(F.concat(F.col("_d").cast("string"), F.lit("web")), total, max_rows)
    both = picked.where(F.col("_id").isNotNull() | web).select("text", F.when(F.col("_id").isNotNull() & web, 2).when(web, 0).otherwise(1).alias("positive"))
    got = both.mapInArrow(_rows, "x array<double>, positive int").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    kind = got["positive"].to_numpy()
    order = np.lexsort(x.T[::-1])  # the same fit in whatever order the rows arrive
    x, kind = x[order], kind[order]
    return Model(x[kind >= 1], x[kind != 1])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``score``."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)))

    return docs.withColumn("score", score(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` from a model of ``labels.quality`` outside the held-out quarter."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").where(~held_out())
    return scored(docs, fit(docs, good, ~held_out()))


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
