"""SimHash near-duplicate detection with vantage-point trees (operator 9).

Every text gets a 64-bit SimHash of its word shingles. A sample of the distinct fingerprints builds a vantage-point
tree: a node has a vantage point and a radius near the median distance to it; points within the radius go to the inner child,
the others to the outer one. Two fingerprints that differ in ``max_bits`` bits or fewer have distances to any vantage point
that differ by no more (the triangle bound), so points whose distance is over ``radius - max_bits`` but within the radius go to
the outer child as well: every linked pair meets in a leaf. Of a few vantage points and radii the one that copies
least is taken. The leaves are the shards: every fingerprint is sent to the leaves it reaches. In a shard the same splits go on
locally, with vantage points of its own, down to leaves of ``LEAF`` fingerprints whose pairs are compared exactly.
A shard yields a spanning star of each of its local components, never all pairs, which keeps every connection;
global components follow by the star algorithm on the edge list.

A split that would leave nearly all points on one side, as in a dense cluster, ends the descent, and that set is compared in
blocks of bounded size. The tree has a leaf for every ``shard`` distinct fingerprints, at least ``2 ** LEVELS`` of them; beyond
``SAMPLE / 16`` leaves the shards grow instead, and the local splits go deeper.

Defined results: a null text is an empty text; texts without words have fingerprint zero and are
linked like any other; equal fingerprints are one component; repeated rows give repeated results;
an empty table gives an empty result; columns beside the id and the text are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import connected_components, materialize

LEAF, LEVELS, SAMPLE = 128, 4, 200_000


def simhash64(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a text: a bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < ngram:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False)))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, len(shingles))
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = [simhash64(t, ngram, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _split(x: np.ndarray, r: int, rng) -> tuple[int, int] | None:
    """The vantage point and radius, of a few, that copy the fewest points for the halving; none if every split is lopsided."""
    best, found = 0.9, None
    for v in rng.choice(x, min(4, len(x)), replace=False).tolist():
        d = np.bincount(np.bitwise_count(x ^ np.uint64(v)), minlength=65)
        inner = np.cumsum(d)
        for mu in range(65 - 1):
            low = inner[mu]
            if not len(x) // 5 <= low <= len(x) - len(x) // 5:
                continue
            outer = len(x) - (inner[mu - r] if mu >= r else 0)
            cost = max(low, outer) / len(x)
            if cost < best:
                best, found = cost, (v, mu)
    return found


def vp_tree(sample: np.ndarray, r: int, levels: int) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage point, radius, inner child, outer child)`` over a sample; a negative child ``-1 - k`` is leaf k."""
    rng = np.random.default_rng(9)
    nodes: list = []
    leaves = 0

    def grow(x: np.ndarray, level: int) -> int:
        nonlocal leaves
        found = _split(x, r, rng) if level and len(x) > 1 else None
        if found is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        v, mu = found
        d = np.bitwise_count(x ^ np.uint64(v))
        nodes[at] = (v, mu, grow(x[d <= mu], level - 1), grow(x[d > mu - r if mu >= r else slice(None)], level - 1))
        return at

    grow(sample, levels)
    return nodes


def _shards(nodes: list[tuple], r: int):
    """A row for each leaf of the tree that a fingerprint reaches."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            todo = [(0 if nodes else -1, fp)]
            while todo:
                at, x = todo.pop()
                if not len(x):
                    continue
                if at < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), -1 - at, np.int32)), pa.array(x.view(np.int64))], ["shard", "fp"])
                    continue
                v, mu, inner, outer = nodes[at]
                d = np.bitwise_count(x ^ np.uint64(v)).astype(np.int16)
                todo += [(inner, x[d <= mu]), (outer, x[d > mu - r])]

    return run


def vp_links(x: np.ndarray, r: int) -> np.ndarray:
    """Index pairs of ``x`` (distinct uint64) at Hamming distance ``r`` or less that connect all such pairs."""
    rng = np.random.default_rng(3)
    out: list = []
    todo = [np.arange(len(x))]
    while todo:
        s = todo.pop()
        if len(s) < 2:
            continue
        found = _split(x[s], r, rng) if len(s) > LEAF else None
        if found is not None:
            d = np.bitwise_count(x[s] ^ np.uint64(found[0])).astype(np.int16)
            todo += [s[d <= found[1]], s[d > found[1] - r]]
            continue
        step = max(1, 2_000_000 // len(s))
        stars: list = []
        for i in range(0, len(s), step):
            at, to = np.nonzero(np.bitwise_count(x[s[i : i + step], None] ^ x[None, s]) <= r)
            keep = at + i < to
            stars.append(np.stack([at[keep] + i, to[keep]]))
            if sum(p.shape[1] for p in stars) > 4 * len(s) + 1000:  # a dense set: hold its components alone
                a, b = np.concatenate(stars, axis=1)
                lab = _labels(len(s), a, b)
                at = np.flatnonzero(lab != np.arange(len(s)))
                stars = [np.stack([lab[at], at])]
        a, b = np.concatenate(stars, axis=1)
        out.append(np.stack([s[a], s[b]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each index's component."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _join_shards(r: int):
    """From rows sorted by shard: edges ``(a, b)`` that connect the linked fingerprints of each shard."""

    def stars(held: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.unique(np.concatenate(held))
        a, b = vp_links(fps, r)
        lab = _labels(len(fps), a, b)
        at = np.flatnonzero(lab != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[lab[at]].view(np.int64))], ["a", "b"])

    def run(batches):
        last, held = None, []
        for b in batches:
            shard, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for s, x in zip(shard[np.r_[0, cuts]].tolist() if len(shard) else (), np.split(fp.view(np.uint64), cuts), strict=True):
                if s != last and held:
                    yield stars(held)
                    held = []
                last = s
                held.append(x)
        if held:
            yield stars(held)

    return run


def links(fps: DataFrame, max_bits: int = 3, shard: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` among distinct fingerprints ``fp`` that connect all that lie within ``max_bits`` bits.

    The edges are spanning stars: their components are those of the full link relation.
    """
    n = fps.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = fps.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in some.select("fp").collect()], np.int64).view(np.uint64))
    levels = max(LEVELS, int(np.ceil(np.log2(max(1, min(n / shard, SAMPLE / 16))))))
    nodes = vp_tree(sample, max_bits, levels)
    rows = fps.select("fp").mapInArrow(_shards(nodes, max_bits), "shard int, fp long")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_join_shards(max_bits), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, max_bits: int = 3, shard: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (signed long) and ``component_id``, the smallest reachable id."""
    hashed = materialize(fingerprints(docs, id_col, text_col, ngram))
    fps = hashed.groupBy("fp").agg(F.min("doc_id").alias("low"))
    star = connected_components(links(fps.select("fp"), max_bits, shard))
    member = fps.join(star, fps.fp == star.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    comp = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return hashed.join(member.join(comp, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
