"""Substring deduplication by content-defined chunks (operator 1).

A gear hash rolls over the last 16 bytes: each step shifts it left by a bit and adds a random number
for the byte. Where its top ``bits`` bits are zero a chunk ends, unless the chunk would be shorter than
``least`` bytes; a chunk of ``most`` bytes ends anyway. As a cut depends on the bytes before it alone, text that
moves keeps its chunks. Chunks with equal 128-bit digests are copies of the one that starts first: in the
document with the smallest id, then at the smallest offset. Runs of adjacent copies are removed where they
have ``min_run`` bytes or more, or are all of the document; shorter ones are left as chance.

Copies met in one task are merged before the shuffle, so that a chunk that a third of all documents hold
sends one row for each task and group of documents, and no text is shuffled until spans meet documents.

Defined results: a null text is empty and has no chunk; rows with equal id and equal text are one document
and get equal results; rows with equal id and different text are ordered by a hash of the text; null ids come
before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.suffix_dedup import KEPT, _groups, _kept, _texts, keyed_texts, with_spans

WINDOW = 16


def gear(x: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash that ends at each byte; the first ``WINDOW - 1`` have seen fewer bytes."""
    h, k = np.random.default_rng(77).integers(0, 2**16, 256, np.uint16)[x], 1
    while k < WINDOW:
        n = h.copy()
        n[k:] += h[:-k] << np.uint16(k)
        h, k = n, 2 * k
    return h


def chunk_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each chunk of the documents ``buf[start:end]``."""
    found = np.concatenate([np.flatnonzero(gear(buf[max(0, i - WINDOW) : i + (1 << 18)])[min(i, WINDOW) :] >> np.uint16(16 - bits) == 0) + i for i in range(0, len(buf), 1 << 18)] or [np.zeros(0, np.int64)]) + 1
    lo, hi = np.searchsorted(found, starts), np.searchsorted(found, ends)
    out_s, out_e, out_d = [], [], []
    for d, (a, z, i, j) in enumerate(zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True)):
        at = a
        for c in [*found[i:j].tolist(), z]:
            if c > z or c - at < least and c != z or c <= at:
                continue
            while c - at > most:
                out_s.append(at)
                at += most
                out_e.append(at)
                out_d.append(d)
            if c - at < least and c != z:
                continue
            out_s.append(at)
            out_e.append(c)
            out_d.append(d)
            at = c
    return np.array(out_s, np.int64), np.array(out_e, np.int64), np.array(out_d, np.int64)


_ROW = "k1 long, k2 long, doc long, th long, start int, end int, copy boolean"


def _split_copies(k1, k2, doc, th, start):
    """An order by digest and place, whether each in it is behind the first of its digest, and whether it is that first once
    more: the same document in another row."""
    order = np.lexsort((start, th, doc, k2, k1))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    a, b = k1[order], k2[order]
    late = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    first = order[np.maximum.accumulate(np.where(late, 0, np.arange(len(order))))]
    again = late & (doc[order] == doc[first]) & (th[order] == th[first]) & (start[order] == start[first])
    return order, late & ~again, again


def _batch(k1, k2, doc, th, start, end, copy: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, doc, th, start, end, np.full(len(k1), copy))], [c.split()[0] for c in _ROW.split(", ")])


def _chunks(bits: int, least: int, most: int):
    def run(batches):
        for batch in batches:
            doc, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, off = _texts(batch.column(2))
            for i, j in _groups(off):
                buf, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, d = chunk_ends(buf, at[:-1], at[1:], bits, least, most)
                raw = buf.tobytes()
                digests = b"".join(xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True))
                k1, k2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                s, e, dd, tt = (s - at[d]).astype(np.int32), (e - at[d]).astype(np.int32), doc[i + d], th[i + d]
                order, copy, again = _split_copies(k1, k2, dd, tt, s)  # what comes again gets the spans of the first row
                first, late = order[~copy & ~again], np.sort(order[copy])  # chunks come in order of place
                joins = (d[late][1:] == d[late][:-1]) & (s[late][1:] == e[late][:-1])
                head, tail = late[np.r_[True, ~joins][: len(late)]], late[np.r_[~joins, True][: len(late)]]
                yield _batch(k1[first], k2[first], dd[first], tt[first], s[first], e[first], False)
                spread = dd[head] * np.int64(-7046029254386353131) ^ s[head].astype(np.int64)  # known copies need no common task
                yield _batch(spread, np.zeros(len(head), np.int64), dd[head], tt[head], s[head], e[tail], True)

    return run


def _copies(batches):
    """Rows sorted by digest: the spans of all chunks but the first of each digest."""
    held: list[np.ndarray] = []
    names = ["doc", "th", "start", "end"]

    def emit(cols):
        k1, k2, doc, th, start, end = cols
        order, copy, _ = _split_copies(k1, k2, doc, th, start)
        at = order[copy]
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (doc, th, start, end)], names)

    for b in batches:
        *cols, known = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in cols[2:]], names)
            cols = [c[~known] for c in cols]
        cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
        k1, k2 = cols[0], cols[1]
        new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield emit([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held and len(held[0]):
        yield emit(held)


def _long_runs(min_run: int):
    """From (doc_id, text, spans): the spans of adjacent copies that are long enough to go."""

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s, e in sorted((s["start"], s["end"]) for s in spans or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                out.append([{"start": s, "end": e} for s, e in runs if e - s >= min_run or e - s == len(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "text", "spans"])

    return lambda batches: _kept(run(batches))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, least: int = 16, most: int = 256, min_run: int = 64) -> DataFrame:
    """Per row: id, ``n_bytes``, removed ``spans`` as byte ranges, ``n_removed`` and ``kept_sha256``."""
    keyed = keyed_texts(docs, id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = keyed.select("doc", "th", "text").mapInArrow(_chunks(bits, max(least, WINDOW), most), _ROW)
    spans = rows.repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_copies, "doc long, th long, start int, end int")
    return with_spans(keyed, spans).mapInArrow(_long_runs(min_run), KEPT)


def op1(spark, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
