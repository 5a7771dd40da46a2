"""Exact substring deduplication over sorted suffixes (operator 2).

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller
id, or earlier in the same one. The method sorts suffixes in range-partitioned buckets, but only those that
can matter:

1. Anchors. In each window of ``length`` bytes the ``GRAM``-byte string with the least hash (the leftmost
   of equals) is the window's anchor. Equal windows have equal anchors at equal offsets, so windows need only
   be compared with windows of the same anchor text, and anchors are about a 35th of all positions.
2. Anchor hashes that occur once are dropped: a shuffle of hash and row, no text.
3. Windows around the remaining anchors travel together as one segment of text, a suffix cut off behind its last
   window. The segments of a task are sorted by multikey quicksort; of neighbours that are equal the first goes on, and the
   later ones are repeats for certain. Segments are range-partitioned by their leading bytes from the anchor on,
   with splitters from a sample. All suffixes with equal leading bytes fall into one bucket, so that
   no match crosses a boundary.
4. Each bucket runs through in order of the leading bytes. Its segments are sorted again by multikey quicksort over 8-byte
   characters, and equal neighbours are repeats of their smallest position. The window suffixes of the others that share an
   anchor are sorted in the same way to ``length`` bytes; neighbours that agree on all bytes are repeats of their
   smallest position.
5. The repeats' spans return to their documents.

An anchor text with more than ``share`` of an average task's rows (by a sample; at least 4 rows of the sample) is hot: a line in a
third of all documents with different surroundings would bring all of them to one bucket. Hot anchors skip step 2, and
what is left of their segments after the task's own sort is cut into single windows, sorted once more and dealt by all ``length`` bytes, with
splitters of their own. Windows that are equal have met in their task already, so a bucket gets each
window once from a task at most.

Defined results: a null text is empty; documents shorter than ``length`` lose nothing; rows with equal id and
equal text are one document and get equal results; rows with equal id and different text are ordered by a
hash of the text; null ids come before all others; an empty table gives an empty result; other columns are
ignored. Rows without an id are told apart by the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import materialize

GRAM, BLOCK, GROUP = 32, 1 << 17, 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_hashes() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 2**64, 256, np.uint64)


def gram_hashes(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A polynomial hash of each ``GRAM`` bytes, by doubling."""
    h, m, k = table[x], np.uint64(0xD6E8FEB86659FD93), 1
    while k < GRAM:
        h = h[:-k] * m + h[k:]
        m, k = np.uint64(int(m) ** 2 % 2**64), 2 * k
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def anchor_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the documents ``buf[start:end]``: position, first and last window start, hash, document."""
    table, width, low = _byte_hashes(), length - GRAM + 1, np.uint64(BLOCK * 2 - 1)
    out: list[list[np.ndarray]] = [[], [], [], []]
    valid = np.zeros(len(buf) + 1, np.int8)
    long_ = ends - starts >= length
    np.add.at(valid, starts[long_], 1)
    np.add.at(valid, ends[long_] - length + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8).astype(bool)
    for at in range(0, max(0, len(buf) - length + 1), BLOCK):
        n = min(BLOCK, len(buf) - length + 1 - at)
        ok = valid[at : at + n]
        if not ok.any():
            continue
        h = gram_hashes(buf[at : at + n + length - 1], table)
        m, k = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * k <= width:
            m, k = np.minimum(m[:-k], m[k:]), 2 * k
        if k < width:
            m = np.minimum(m[: len(m) - (width - k)], m[width - k :])
        a = (m[:n] & low).astype(np.int64)
        new = ok.copy()
        new[1:] &= ~(ok[:-1] & (a[1:] == a[:-1]))
        first = np.flatnonzero(new)
        last = ok.copy()
        last[:-1] &= ~(ok[1:] & (a[1:] == a[:-1]))
        for col, v in zip(out, (a[first] + at, first + at, np.flatnonzero(last) + at, h[a[first]]), strict=True):
            col.append(v)
    p, s0, s1, h = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    if len(p) > 1:  # a run that a block's end has cut
        doc = np.searchsorted(starts, s0, side="right")
        cut = np.flatnonzero((p[1:] == p[:-1]) & (s0[1:] == s1[:-1] + 1) & (doc[1:] == doc[:-1]))
        s1[cut] = s1[cut + 1]
        keep = np.ones(len(p), bool)
        keep[cut + 1] = False
        p, s0, s1, h = p[keep], s0[keep], s1[keep], h[keep]
    return p, s0, s1, h.astype(np.uint64), np.searchsorted(starts, s0, side="right") - 1


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a non-null binary column and its offsets."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def _groups(off: np.ndarray, size: int = GROUP):
    """Row ranges of about ``size`` bytes."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j


def _runs(batch: pa.RecordBatch, column: int, length: int, rows: np.ndarray | None = None, size: int = GROUP):
    """Per group of rows: its bytes, the rows' starts and ends in them, the first row, and the anchors."""
    data, off = _texts(batch.column(column))
    for i, j in _groups(off, size):
        if rows is not None and not rows[i:j].any():
            continue
        buf, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield buf, at[:-1], i, anchor_runs(buf, at[:-1], at[1:], length)


def _anchors(length: int, heavy: np.ndarray, with_gram: bool):
    def run(batches):
        for b in batches:
            row = b.column(0).to_numpy(zero_copy_only=False)
            for buf, _, i, (p, _, _, h, d) in _runs(b, 1, length):
                if len(heavy):
                    keep = ~np.isin(h, heavy)
                    p, h, d = p[keep], h[keep], d[keep]
                cols = [pa.array(h.view(np.int64)), pa.array(row[i + d])]
                if with_gram:
                    cols.append(_binary(buf, p, np.full(len(p), GRAM)))
                yield pa.RecordBatch.from_arrays(cols, ["h", "row", "gram"][: len(cols)])

    return run


def _hot_windows(length: int, heavy: np.ndarray):
    """The windows of hot anchors, each once for a group of rows."""

    def run(batches):
        for b in batches:
            for buf, _, _, (_, s0, s1, h, _) in _runs(b, 1, length):
                hot = np.isin(h, heavy)
                at, _ = _windows(s0[hot], s1[hot])
                seen = np.unique(_fixed(buf, at, length))
                yield pa.RecordBatch.from_arrays([pa.array(seen.tolist(), pa.binary())], ["win"])

    return run


def _repeated(batches):
    """Of rows sorted by ``h``, those whose ``h`` occurs more than once."""
    h, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = None
    for b in batches:
        h = np.concatenate([h, b.column(0).to_numpy(zero_copy_only=False)])
        doc = np.concatenate([doc, b.column(1).to_numpy(zero_copy_only=False)])
        if len(h) < 2:
            continue
        same = h[1:] == h[:-1]
        more = np.r_[same, False] | np.r_[last is not None and last == h[0], same]
        last = h[-2]
        yield pa.RecordBatch.from_arrays([pa.array(h[:-1][more[:-1]]), pa.array(doc[:-1][more[:-1]])], ["h", "row"])
        h, doc = h[-1:], doc[-1:]
    if len(h) and last is not None and last == h[0]:
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc)], ["h", "row"])


_SEGMENT = "bucket int, doc long, th long, start int, shift int, seg binary"


def _ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``at[i] .. at[i] + size[i] - 1``, one after the other."""
    ends = np.cumsum(size)
    kind = np.int32 if len(ends) and ends[-1] + at.max() < 1 << 31 else np.int64
    out = np.repeat((at - (ends - size)).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


def _binary(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of ``buf`` at ``at`` as a binary column."""
    off = np.zeros(len(at) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(buf[_ragged(at, size)].tobytes())])


def _fixed(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The strings of ``size`` bytes of ``buf`` at ``at``, comparable by numpy."""
    return np.ascontiguousarray(buf[at[:, None] + np.arange(size)]).view(f"S{size}").ravel() if len(at) else np.zeros(0, f"S{size}")


def _windows(s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the runs, and the run of each."""
    n = s1 - s0 + 1
    return _ragged(s0, n), np.repeat(np.arange(len(n)), n)


def multikey_ties(buf: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``buf`` (position and size) that equal another of their group: indices into ``at`` and group numbers.

    Multikey quicksort with 8 bytes as a character: sort by the character at a depth, and go deeper only in
    ranges of equals. The sizes in a group are equal and 8 at least.
    """
    words = np.zeros(len(buf) + 8, np.uint64)
    for k in range(8):
        words[: len(buf) - k] |= buf[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    idx, depth, found, base = np.arange(len(at)), 0, [], 0
    while len(idx):
        w = words[at[idx] + np.minimum(depth, size[idx] - 8)]
        order = np.lexsort((w, group))
        idx, group, w = idx[order], group[order], w[order]
        number = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (w[1:] != w[:-1])]) - 1
        tied = np.bincount(number)[number] > 1
        idx, group = idx[tied], number[tied]
        ended = size[idx] <= depth + 8
        if ended.any():
            found.append((idx[ended], group[ended] + base))
            base += int(group.max()) + 1
            idx, group = idx[~ended], group[~ended]
        depth += 8
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (idx, idx)


def _later(idx: np.ndarray, group: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ties ``idx``: those that aren't the first place of their group, and which of these are another place than it."""
    if not len(idx):
        return idx, np.zeros(0, bool)
    order = np.lexsort((pos[idx], th[idx], doc[idx], group))
    idx, group = idx[order], group[order]
    new = np.r_[True, group[1:] != group[:-1]]
    first = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
    other = (doc[idx] != doc[first]) | (th[idx] != th[first]) | (pos[idx] != pos[first])
    return idx[~new], other[~new]


def _sorted_out(buf, at, size, shift, doc, th, start) -> tuple[np.ndarray, np.ndarray]:
    """Of segments: which go on as the first of their equals, and the indices of those that repeat another place."""
    if not len(at):
        return np.ones(0, bool), at
    _, group = np.unique(size * 4096 + shift, return_inverse=True)
    late, other = _later(*multikey_ties(buf, at, size, group), doc, th, start)
    keep = np.ones(len(at), bool)
    keep[late] = False
    return keep, late[other]


def _joined(doc: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans with those that touch or overlap made one."""
    order = np.lexsort((start, th, doc))
    doc, th, start, end = doc[order], th[order], start[order], end[order]
    if not len(doc):
        return [doc, th, start, end]
    row = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]) - 1
    far = np.maximum.accumulate(end + row * (1 << 32))  # ends seen so far in the row
    new = np.r_[True, start[1:] + row[1:] * (1 << 32) > far[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return [doc[first], th[first], start[first], far[last] - row[last] * (1 << 32)]


def _segments(length: int, heavy: np.ndarray, splitters: list[bytes], hot_splitters: list[bytes]):
    """From (doc, th, text, repeated hashes): the segments with their bucket; spans that are settled have no text but their length."""

    def run(batches):
        cuts, hot_cuts = np.array(splitters, f"S{GRAM}"), np.array(hot_splitters, f"S{length}")
        for b in batches:
            doc_, th_ = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            known = b.column(3)
            has = np.array(known.is_valid()) if not len(heavy) else np.ones(len(doc_), bool)
            for buf, starts, i, (p, s0, s1, h, d) in _runs(b, 2, length, has):
                part = known.slice(i, len(starts))
                lists = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(part) else np.zeros(0, np.uint64)
                hot = np.isin(h, heavy)
                keep = np.isin(h, lists) | hot  # the hashes of other rows of the group do no harm
                p, s0, s1, d, hot = p[keep], s0[keep], s1[keep], d[keep], hot[keep]
                doc, th, start = doc_[i + d], th_[i + d], s0 - starts[d]
                size = s1 - s0 + length
                on, late = _sorted_out(buf, s0, size, p - s0, doc, th, start)
                spans = [[x[late] for x in (doc, th, start)] + [start[late] + size[late]]]
                cold = on & ~hot
                lead = np.searchsorted(cuts, _fixed(buf, p[cold], GRAM), side="right")
                out = [[lead, doc[cold], th[cold], start[cold], (p - s0)[cold], s0[cold], size[cold]]]
                if hot.any():
                    at, of = _windows(s0[on & hot], s1[on & hot])
                    doc, th, d = doc[on & hot][of], th[on & hot][of], d[on & hot][of]
                    start, size, none = at - starts[d], np.full(len(at), length), np.zeros(len(at), np.int64)
                    on, late = _sorted_out(buf, at, size, none, doc, th, start)
                    spans.append([x[late] for x in (doc, th, start)] + [start[late] + length])
                    lead = len(cuts) + 1 + np.searchsorted(hot_cuts, _fixed(buf, at[on], length), side="right")
                    out.append([lead, doc[on], th[on], start[on], none[on], at[on], size[on]])
                bucket, doc, th, start, shift, at, size = (np.concatenate(c) for c in zip(*out, strict=True))
                cols = [bucket.astype(np.int32), doc, th, start.astype(np.int32), shift.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), _binary(buf, at, size)], _names(_SEGMENT))
                doc, th, start, end = _joined(*(np.concatenate(c) for c in zip(*spans, strict=True)))
                bucket = start % (len(cuts) + 1)  # these need no common task
                cols = [bucket.astype(np.int32), doc, th, start.astype(np.int32), (end - start).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(doc), pa.binary())], _names(_SEGMENT))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def repeats(buf, at, size, shift, doc, th, start, length: int) -> list[np.ndarray]:
    """Repeated spans ``doc, th, start, end`` among segments (position in ``buf``, size, anchor's offset, place) sorted by leading bytes."""
    on, late = _sorted_out(buf, at, size, shift, doc, th, start)
    whole = [doc[late], th[late], start[late], start[late] + size[late]]
    at, size, shift, doc, th, start = (x[on] for x in (at, size, shift, doc, th, start))
    lead = _fixed(buf, at + shift, GRAM)
    same = lead[1:] == lead[:-1]
    near = np.r_[same, False] | np.r_[False, same]  # a lone one has nothing to repeat
    at, size, doc, th, start = (x[near[: len(at)]] for x in (at, size, doc, th, start))
    win, of = _windows(at, at + size - length)
    if len(win):
        doc, th, pos = doc[of], th[of], start[of] + win - at[of]
        late, other = _later(*multikey_ties(buf, win, np.full(len(win), length), np.zeros(len(win), np.int64)), doc, th, pos)
        late = late[other]  # a document's own window may come twice
        whole = [np.concatenate([x, y]) for x, y in zip(whole, (doc[late], th[late], pos[late], pos[late] + length), strict=True)]
    return _joined(*whole)


def _resolve(length: int, size: int = 1 << 21):
    """Buckets in order of the leading bytes: the spans of repeated windows."""
    names = ["doc", "th", "start", "end"]

    def spans(cols) -> pa.RecordBatch:
        doc, th, start, end = cols
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names)

    def settled(b: pa.RecordBatch) -> pa.RecordBatch:
        """All the rows of whole leads in ``b``, in parts of about ``size`` bytes."""
        doc, th, start, shift = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5))
        buf, off = _texts(b.column(5))
        at, n = off[:-1], np.diff(off)
        lead = _fixed(buf, at + shift, GRAM)
        first = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        found, i = [], 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(at[first], at[first[i]] + size)))
            x, y = first[i], first[j] if j < len(first) else len(at)
            part = buf[off[x] : off[y]]
            found.append(repeats(part, at[x:y] - off[x], n[x:y], shift[x:y], doc[x:y], th[x:y], start[x:y], length))
            i = j
        return spans([np.concatenate(c) for c in zip(*found, strict=True)])

    def last_lead(b: pa.RecordBatch) -> int:
        """Where the last lead of ``b`` begins."""
        shift = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, off = _texts(b.column(5))
        lead = _fixed(buf, off[:-1] + shift, GRAM)
        return int(np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])[-1])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            known = b.column(5).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                done = b.filter(pa.array(known))
                doc, th, start, n = (done.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
                yield spans([doc, th, start, start + n])
                b = b.filter(pa.array(~known))
            if not len(b):
                continue
            cut = last_lead(b)
            if cut:
                yield settled(_one([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
            # the last lead before may end with it
            if cut == 0 and len(held) > 1 and last_lead(_one([held[-2].slice(len(held[-2]) - 1), held[-1].slice(0, 1)])):
                yield settled(_one(held[:-1]))
                held = held[-1:]
        if held:
            yield settled(_one(held))

    return run


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _kept(batches):
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for s, e in merged:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            for col, v in zip(out, (doc, len(text), merged, sum(e - s for s, e in merged), digest.hexdigest()), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "spans", "n_removed", "kept_sha256"])


NO_ID = -(2**63)
KEPT = "doc_id long, n_bytes long, spans array<array<int>>, n_removed long, kept_sha256 string"


def keyed_texts(docs: DataFrame, id_col: str, text) -> DataFrame:
    """``row`` (a hash of the two that follow), ``doc`` (the id, or ``NO_ID``), ``th`` (a hash of the text) and the text's bytes."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    return rows.select(F.xxhash64("doc", "th").alias("row"), "doc", "th", "text")


def with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row's text with its spans. Joined on ``row`` alone, as the texts are joined with other things
    before, so that Spark shuffles the texts once and reads that exchange again."""
    by_row = spans.groupBy(F.xxhash64("doc", "th").alias("_row")).agg(F.collect_list(F.struct("doc", "th", "start", "end")).alias("spans"))
    own = F.filter("spans", lambda s: (s["th"] == F.col("th")) & (s["doc"] == F.col("doc")))
    joined = keyed.join(by_row, F.col("row") == F.col("_row"), "left").select("doc", "th", "text", "spans")
    return joined.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", own.alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 100, buckets: int | None = None, share: float = 0.05, sample: float = 0.02) -> DataFrame:
    """Spans ``(doc, th, start, end)`` that repeat what starts earlier; ``docs`` is as ``keyed_texts`` makes it."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = docs.where(F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(10_000)) < max(1, round(10_000 * sample))).select("row", "text")
    found = some.mapInArrow(_anchors(length, np.zeros(0, np.uint64), True), "h long, row long, gram binary")
    counted = found.groupBy("h").agg(F.count("*").alias("n"), F.min("gram").alias("gram"))
    counted = materialize(counted)
    least = max(4.0, share * (counted.agg(F.sum("n")).first()[0] or 0) / tasks)
    got = counted.where((F.col("n") >= least) | (F.pmod("h", F.lit(64)) == 0)).orderBy(F.desc("n"), "h").limit(20_000).collect()
    hot = np.array([r["h"] for r in got if r["n"] >= least], np.int64).view(np.uint64)
    buckets = buckets or 4 * tasks
    splitters = _cuts(sorted(bytes(r["gram"]) for r in got), buckets)
    hot_splitters = []
    if len(hot):
        wins = some.mapInArrow(_hot_windows(length, hot), "win binary").distinct().orderBy(F.xxhash64("win")).limit(20_000).collect()
        hot_splitters = _cuts(sorted(bytes(r["win"]) for r in wins), buckets)
    rows = docs.select("row", "text").mapInArrow(_anchors(length, hot, False), "h long, row long")
    more = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "h long, row long")
    lists = more.groupBy(F.col("row").alias("_row")).agg(F.collect_set("h").alias("hashes"))
    joined = docs.join(lists, F.col("row") == F.col("_row"), "left").select("doc", "th", "text", "hashes")
    segments = joined.mapInArrow(_segments(length, hot, splitters, hot_splitters), _SEGMENT)
    in_order = segments.repartition("bucket").sortWithinPartitions("bucket", F.expr(f"substring(seg, shift + 1, {GRAM})"))
    return in_order.mapInArrow(_resolve(length), "doc long, th long, start int, end int")


def _cuts(leads: list[bytes], buckets: int) -> list[bytes]:
    """Splitters that cut the sorted leads into as many ranges."""
    return sorted({leads[i * len(leads) // buckets] for i in range(1, buckets)}) if leads else []


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, **options) -> DataFrame:
    """Per row: id, ``n_bytes``, removed ``spans`` as byte ranges, ``n_removed`` and ``kept_sha256``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = keyed_texts(docs, id_col, text)
    return with_spans(keyed, repeated_spans(keyed, length, **options)).mapInArrow(_kept, KEPT)


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
