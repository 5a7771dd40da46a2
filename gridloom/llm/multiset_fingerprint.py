"""Document fingerprints by a homomorphic multiset hash (operator 7).

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector and the vectors
are summed modulo powers of two, so the sum doesn't depend on the order of the paragraphs, and a paragraph
is inserted or deleted by adding or subtracting its vector alone. The vector has two parts:

* four 64-bit lanes hashed from the paragraph as a whole, modulo 2**64: equality of multisets;
* 128 lanes, modulo 2**32, of +1 or -1 for each word shingle inside the paragraph: the inner product of two
  sums estimates how many shingles two texts share (error about 0.1), from the fingerprints alone.

Likeness is twice the inner product over the sum of the squared lengths, cut to 0..1; 1 if the sums are
equal.

Defined results: a null text is empty (one empty paragraph); repeated ids are ordered by text and follow
each other; null ids come before all others; the document after the last is the first, which for one
document is itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES, SHINGLE = 128, 3
#: A bound for what the driver holds of the ranges; beyond it ranges grow, which tasks read row by row.
MOST_BUCKETS = 20_000


class Sum:
    """The sum of paragraphs' vectors."""

    __slots__ = ("exact", "lanes")

    def __init__(self, exact: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.exact = np.zeros(4, np.uint64) if exact is None else exact
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes

    def __add__(self, o: Sum) -> Sum:
        return Sum(self.exact + o.exact, self.lanes + o.lanes)

    def __sub__(self, o: Sum) -> Sum:
        return Sum(self.exact - o.exact, self.lanes - o.lanes)

    def hex(self) -> str:
        return self.exact.astype(">u8").tobytes().hex() + self.lanes.astype(">u4").tobytes().hex()


def paragraphs_sum(paragraphs: list[str]) -> Sum:
    """The sum of the vectors of a multiset of paragraphs."""
    whole = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
    exact = b"".join(xxhash.xxh3_128_digest(p, 1) + xxhash.xxh3_128_digest(p, 2) for p in whole)
    shingles: list[bytes] = []
    for p in whole:
        words = p.split()
        if len(words) >= SHINGLE:
            shingles += map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        elif words:
            shingles.append(b" ".join(words))
    ones = np.zeros(LANES, np.int64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        bits = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, part)), np.uint8).reshape(len(part), LANES // 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    lanes = ((2 * ones - len(shingles)) % (1 << 32)).astype(np.uint32)
    return Sum(np.frombuffer(exact, ">u8").reshape(-1, 4).astype(np.uint64).sum(axis=0, dtype=np.uint64), lanes)


def fingerprint(text: str | None) -> Sum:
    return paragraphs_sum((text or "").split("\n"))


def edited(text: str, total: Sum, follower: str) -> tuple[str, Sum]:
    """The text with its last quarter replaced by the follower's start, and its sum by deletion and insertion."""
    k = len(text) // 4
    keep = text[: len(text) - k]
    new = keep + follower[:k]
    at = keep.rfind("\n") + 1  # paragraphs before this stay
    return new, total - paragraphs_sum(text[at:].split("\n")) + paragraphs_sum(new[at:].split("\n"))


def likeness(a: Sum, b: Sum) -> float:
    if (a.exact == b.exact).all():
        return 1.0
    x, y = a.lanes.view(np.int32).astype(float), b.lanes.view(np.int32).astype(float)
    size = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / size))) if size else 0.0


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc, text: str, total: Sum, follower: str, next_total: Sum) -> tuple:
    new, new_total = edited(text, total, follower)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, total.hex(), new_total.hex(), likeness(total, new_total), likeness(total, next_total)


def _chain(batches):
    """Rows sorted by bucket; within it documents in order, and last the one that follows the bucket."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in _OUT.split(", ")]
    held = None
    for b in batches:
        rows = []
        for bucket, ahead, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is not None and held[0] == bucket and held[1]:
                continue  # only the first that follows counts
            text = text or ""
            total = fingerprint(text)
            if held is not None and held[0] == bucket:
                rows.append(_row(*held[2:], text, total))
            held = (bucket, ahead, doc, text, total) if not ahead else (bucket, True, None, "", None)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 3000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and both likenesses.

    Ids are cut into ranges; a range's first document is dealt to the range before it as well, so that
    each task has the follower of its last document. Texts are shuffled once.
    """
    least = -(2**63)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = docs.count()
    ids = docs.select(F.coalesce("doc_id", F.lit(least)).alias("k"))
    cuts = max(1, min(n // rows_per_bucket, MOST_BUCKETS))
    found = ids.agg(F.percentile_approx("k", [i / cuts for i in range(1, cuts)] or [0.5], 100 * cuts)).first()[0] if cuts > 1 else []
    heads = [ids.agg(F.min("k")).first()[0]] if n else [least]
    if found:
        slot = _slot(sorted({int(c) for c in found}))
        heads = sorted(r[0] for r in ids.groupBy(slot("k").alias("s")).agg(F.min("k")).select("min(k)").collect())  # a row for each range
    place = _places([int(h) for h in heads])
    dealt = docs.withColumn("p", F.explode(place(F.coalesce("doc_id", F.lit(least))))).select("p.bucket", "p.ahead", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_chain, _OUT)


def _slot(cuts: list[int]):
    @F.pandas_udf("int")
    def slot(k):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, np.int64), k.to_numpy(), side="right").astype(np.int32))

    return slot


def _places(heads: list[int]):
    @F.pandas_udf("array<struct<bucket:int,ahead:boolean>>")
    def place(k):
        import pandas as pd

        at = np.array(heads, np.int64)
        b = np.searchsorted(at, k.to_numpy(), side="right") - 1
        return pd.Series([[{"bucket": int(i), "ahead": False}, *([{"bucket": int(i - 1) % len(at), "ahead": True}] if first else [])] for i, first in zip(b, at[b] == k.to_numpy(), strict=True)])

    return place


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``."""
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
