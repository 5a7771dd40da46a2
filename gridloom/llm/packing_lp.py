"""Best-fit packing of tokenised documents into fixed-length sequences (operator 3).

Documents are tokenised, closed with an end id and, only where longer than ``max_len``, cut into pieces. The
histogram of piece lengths (at most ``max_len`` numbers) defines a configuration linear program: the least
number of sequences whose configurations hold every piece. It is solved by multiplicative weights. Every length
has a price, at first its size, which falls by a factor of ``1 - eps`` (``0.5 / r`` in later rounds r) each time the length is
covered once more. A step raises a configuration as far as its scarcest length allows. Configurations come from knapsack dynamic programs:
one over the longest length not covered and a random part of what else is left, accepted if it is worth ``1 - 2 eps`` of the dearest
configuration of all; else that one, from an unbounded knapsack over all lengths. Prices over the dearest
configuration's are a dual solution, which is a lower bound; the rounds end when the
fractional packing is within ``eps`` of the best bound seen, or after ``work`` steps of dynamic programming.

Rounding: configurations that waste no more than the fractional packing does on average are used as often as their count says, rounded up,
while their pieces last. The program is solved again for what remains; once that is less than a thousandth or four sequences, it is packed
best-fit, largest first. On the 0.1 tables 99.9 % of the pieces are in the program's configurations.

Only the histogram and the configurations reach the driver; both are bounded by ``max_len``, not by the
number of documents. Pieces get their slot from their rank among the pieces of their length, which comes
from counts by length and hash bucket, so that a length that a third of all pieces share is ranked in many
tasks.

Texts are tokenised word by word between white space, which is where this tokenizer always splits. Ids of words come
from the tokenizer and are kept in caches of bounded size. Words of plain Latin letters with or without closing
punctuation are looked up in lower case without it, as the tokenizer lowers letters and parts them from punctuation; this is
done only if the tokenizer's own description of its normalizer and splitter says so (``SPLITS``). All other words go through the
whole tokenizer, many at a time; texts with control characters that only Python takes for white space or with the
spelling of a special token are tokenised whole.

Defined results: null texts are empty ones: one piece with the end id alone; repeated rows give repeated
pieces, each with a place of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import materialize

#: Texts with one of these are tokenised whole.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")
CACHE = 400_000
#: Stands between words that are encoded together; has an id of its own.
MARK = "\N{BULLET}"
#: The splitting pattern and the normalizers under which words may be looked up by their lower-case letters.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
TAIL = ".,;:!?"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache = cache
        self.cached: dict[str, bytes] = {}
        said = json.loads(self.tok.to_str())
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        splits = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = (
            [n["type"] for n in steps] == NORMAL
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": SPLITS}
            and not splits[1]["add_prefix_space"]
            and said["model"]["type"] == "BPE"
        )
        mark = self._ids([MARK])[0]
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _bodies(self, lows: list[str]) -> None:
        """Put the ids of lower-case Latin words, each one part for the model, into the cache."""
        parts = [x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LETTERS) for x in lows]
        tokens = list(map(self.tok.model.tokenize, parts))
        ids = np.array([t.id for ts in tokens for t in ts], "<u4").tobytes()
        ends = np.cumsum([4 * len(ts) for ts in tokens]).tolist()
        self.cached.update(zip(lows, (ids[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def _others(self, words: list[str]) -> None:
        """Put the ids of any words without white space into the cache, by the whole tokenizer."""
        marked = [w for w in words if MARK not in w] if self.mark is not None else []
        for i in range(0, len(marked), 1000):  # many at a time are several times faster than each alone
            part = marked[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            b = ids.tobytes()
            self.cached.update(zip(part, (b[x:y] for x, y in zip([0, *(4 * (at + 1)).tolist()], [*(4 * at).tolist(), len(b)], strict=True)), strict=True))
        odd = [w for w in words if w not in self.cached]
        self.cached.update(zip(odd, self._ids(odd), strict=True))

    def _entries(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words. Of a full cache the younger half goes, as frequent words come early."""
        import pyarrow.compute as pc

        if len(self.cached) > self.cache:
            for w in list(self.cached)[self.cache // 2 :]:
                del self.cached[w]
        body = pc.utf8_rtrim(words, TAIL)
        plain = pc.match_substring_regex(body, LETTERS) if self.plain else pa.array(np.zeros(len(words), bool))
        keys = pc.if_else(plain, pc.utf8_lower(body), words).dictionary_encode()
        distinct = keys.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        new = [w for w in distinct if w not in self.cached]
        if new:
            light = pc.match_substring_regex(pa.array(new, pa.string()), LETTERS).to_numpy(zero_copy_only=False).tolist() if self.plain else [False] * len(new)
            self._bodies([w for w, x in zip(new, light, strict=True) if x])
            self._others([w for w, x in zip(new, light, strict=True) if w and not x])
        ids = [self.cached[w] if w else b"" for w in distinct]
        out = [ids[i] for i in keys.indices.to_numpy().tolist()]
        cut = np.flatnonzero(pc.and_(plain, pc.not_equal(pc.binary_length(body), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        if len(cut):
            tails = pc.replace_substring_regex(words.take(pa.array(cut)), LETTERS[:-1], "").to_numpy(zero_copy_only=False).tolist()
            known = {"": b""}
            for i, t in zip(cut.tolist(), tails, strict=True):
                if t not in known:
                    known[t] = self._ids([t])[0]
                out[i] += known[t]
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string array's texts, one after the other, and where each text begins."""
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for x in WHOLE:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        at = lists.offsets.to_numpy()
        flat = lists.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
        at = at - at[0]
        entries, idx = self._entries(flat.dictionary), flat.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, entries), np.int32, len(entries)) // 4
        base, ids = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(entries), "<u4")
        n = size[idx]
        before = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        if len(idx):
            where = np.repeat(base[idx] - before[:-1].astype(np.int32), n)
            where += np.arange(before[-1], dtype=np.int32)
            ids = ids[where]
        begin = before[at]
        if whole.any():
            parts = [ids[begin[i] : begin[i + 1]] for i in range(len(texts))]
            odd = np.flatnonzero(whole).tolist()
            for i, b in zip(odd, self._ids([texts[i].as_py() for i in odd]), strict=True):
                parts[i] = np.frombuffer(b, "<u4")
            ids, begin = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        return ids, begin

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        ids, begin = self.flat(pa.array(texts, pa.string()))
        return [ids[x:y].tobytes() for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _parts(batch: pa.RecordBatch, size: int = 1 << 24):
    """Slices of a batch with about ``size`` bytes of text in their second column, one row at least."""
    import pyarrow.compute as pc

    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + size, side="right")))
        yield batch.slice(i, j - i)
        i = j


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in (part for batch in batches for part in _parts(batch)):
            ids, begin = encode.flat(b.column(1))
            length = np.diff(begin) + 1
            count = -(-length // max_len)
            row = np.repeat(np.arange(len(length)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * max_len
            size = np.minimum(length[row] - start, max_len)
            lo = 4 * (begin[row] + start)
            hi = np.minimum(lo + 4 * size, 4 * begin[row + 1])
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            for i in np.flatnonzero(start + size == length[row]).tolist():  # the end id closes the last piece
                crc[i] = zlib.crc32(end, crc[i])
            crc = np.array(crc, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(left: np.ndarray, cap: int) -> list[tuple[dict, int]]:
    """Configurations ``({length: copies}, times)`` for a histogram ``left`` (used up), largest lengths first."""
    out = []
    while True:
        has = np.flatnonzero(left)
        if not len(has):
            return out
        room, conf = cap, {}
        avail = left
        while room:
            k = int(np.searchsorted(has, room, side="right")) - 1
            while k >= 0 and avail[has[k]] - conf.get(int(has[k]), 0) <= 0:
                k -= 1
            if k < 0:
                break
            size = int(has[k])
            n = min(room // size, int(avail[size]) - conf.get(size, 0))
            conf[size] = conf.get(size, 0) + n
            room -= n * size
        times = min(int(left[s]) // c for s, c in conf.items())
        for s, c in conf.items():
            left[s] -= times * c
        out.append((conf, times))


def _dearest(size: np.ndarray, price: np.ndarray, cap: int) -> tuple[float, dict[int, int]]:
    """The dearest configuration of all: an unbounded knapsack by dynamic programming over the room."""
    best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
    fits = np.searchsorted(size, np.arange(cap + 1), side="right").tolist()
    for c in range(int(size[0]), cap + 1):
        v = best[c - size[: fits[c]]] + price[: fits[c]]
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], pick[c] = v[k], k
        else:
            best[c] = best[c - 1]
    conf, c = {}, cap
    while c > 0:
        k = int(pick[c])
        if k >= 0:
            conf[k] = conf.get(k, 0) + 1
        c -= int(size[k]) if k >= 0 else 1
    return float(best[cap]), conf


def _dearest_with(first: int, some: np.ndarray, size: np.ndarray, price: np.ndarray, cap: int) -> tuple[float, dict[int, int]]:
    """The dearest configuration of ``first`` and of ``some`` items, each used once: a knapsack over the room that is left."""
    room = cap - int(size[first])
    best, took = np.zeros(room + 1), np.zeros((len(some), room + 1), bool)
    for i, k in enumerate(some.tolist()):
        s = int(size[k])
        put = best[: room + 1 - s] + price[k]
        np.greater(put, best[s:], out=took[i, s:])
        best[s:] = np.where(took[i, s:], put, best[s:])
    value, conf = float(best[room] + price[first]), {first: 1}
    for i in range(len(some) - 1, -1, -1):
        if took[i, room]:
            k = int(some[i])
            conf[k] = conf.get(k, 0) + 1
            room -= int(size[k])
    return value, conf


def _left_over(open_: np.ndarray, left: np.ndarray, sample: int, rng) -> np.ndarray:
    """Some of the items that are left to cover, drawn by how many there are of each, in random order."""
    sums = np.cumsum(left)
    if not len(sums) or sums[-1] <= 0:
        return open_[:0]
    drawn, copies = np.unique(np.searchsorted(sums, rng.random(min(sample, 4 * len(open_) + 8)) * sums[-1], side="right"), return_counts=True)
    out = open_[np.repeat(drawn, np.minimum(copies, np.ceil(left[drawn] - 1e-9).astype(int)))]
    rng.shuffle(out)
    return out


def solve(hist: np.ndarray, cap: int, eps: float = 0.03, rounds: int = 200, sample: int = 48, work: int = 200_000) -> tuple[dict[tuple, float], float]:
    """A fractional packing and a lower bound of any packing's number of sequences.

    The packing is a dict of configurations (pairs of length and copies) and counts that cover each length. It ends within
    ``1 + eps`` of the bound, or after ``work`` steps of the full dynamic program, ``rounds`` at most.
    """
    rng = np.random.default_rng(7)
    size = np.flatnonzero(hist)
    n, price = hist[size].astype(float), size.astype(float)
    top, conf = _dearest(size, price, cap)
    bound, done, forgotten = float(n @ price) / top, cap, 0
    covered, columns, total = np.zeros(len(size)), {}, 0.0
    best: tuple = (np.inf, {})
    for r in range(1, rounds + 1):
        rate = eps if r == 1 else max(eps, 0.5 / r)
        if r > 1 and r & (r - 1) == 0:  # at each power of two, what the prices of before gave is forgotten
            covered, columns, total, forgotten = np.zeros(len(size)), {}, 0.0, r - 1
        goal = r - forgotten
        while len(open_ := np.flatnonzero(covered < goal - 1e-9)):
            first = int(open_[-1])
            left = (goal - covered[open_]) * n[open_]
            left[-1] = max(0.0, left[-1] - 1)
            fit = int(np.searchsorted(size[open_], cap - size[first], side="right"))
            value, conf = _dearest_with(first, _left_over(open_[:fit], left[:fit], sample, rng), size, price, cap)
            if value < (1 - 2 * eps) * top and done <= work:  # prices only fall, so `top` is still a bound
                top, conf = _dearest(size, price, cap)
                bound, done = max(bound, float(n @ price) / top), done + cap
                conf = {k: min(c, int(n[k])) for k, c in conf.items()}  # more than there are would never be used
            rows, copies = np.array(list(conf)), np.array(list(conf.values()), float)
            step = float((np.maximum(goal - covered[rows], 0.25) * n[rows] / copies).min())
            covered[rows] += step * copies / n[rows]
            price[rows] *= (1 - rate) ** (step * copies / n[rows])
            key = tuple(sorted(zip(size[rows].tolist(), copies.astype(int).tolist(), strict=True)))
            columns[key] = columns.get(key, 0.0) + step
            total += step
        if total / covered.min() < best[0]:
            best = total / covered.min(), {key: x / covered.min() for key, x in columns.items()}
        if best[0] <= (1 + eps) * bound or done > work:
            break
    return best[1], bound


def configurations(hist: np.ndarray, cap: int, eps: float = 0.03, tail: float = 1e-3) -> list[tuple[dict, int]]:
    """Configurations and how often each is used; together they hold each length exactly ``hist`` times."""
    left, out, first = hist.copy(), [], 0.0
    while left.any():
        columns, bound = solve(left, cap, eps)
        first = max(first, bound)
        if out and bound < max(tail * first, 4):
            break
        waste = {key: cap - sum(s * k for s, k in key) for key in columns}
        mean = sum(x * waste[key] for key, x in columns.items()) / sum(columns.values())
        before = left.sum()
        for key in sorted(columns, key=lambda c: (waste[c], -columns[c], c)):
            if waste[key] > mean + 1e-6:
                break
            times = min([int(columns[key] + 1e-9) + 1, *(int(left[s]) // k for s, k in key)])
            if times:
                out.append((dict(key), times))
                for s, k in key:
                    left[s] -= times * k
        if left.sum() == before:
            break
    placed = int(hist.sum() - left.sum())
    logging.getLogger(__name__).info("%d of %d pieces are in the program's configurations, the rest is packed best-fit", placed, int(hist.sum()))
    return out + best_fit(left, cap)


def slots(confs: list[tuple[dict, int]]) -> dict[int, np.ndarray]:
    """For each length its runs of slots: first rank, first sequence, copies in a sequence, offset of the first."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    seq = 0
    for conf, times in confs:
        at = 0
        for s, k in sorted(conf.items(), reverse=True):
            runs.setdefault(s, []).append((used.get(s, 0), seq, k, at))
            used[s] = used.get(s, 0) + k * times
            at += s * k
        seq += times
    return {s: np.array(r, np.int64) for s, r in runs.items()}


def packed(cut: DataFrame, max_len: int = 4096) -> DataFrame:
    """``cut`` (see ``pieces``) with ``sequence_id`` and ``offset``."""
    cut = materialize(cut)
    hist = np.zeros(max_len + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most max_len rows
        hist[r[0]] = r[1]
    runs = slots(configurations(hist, max_len))
    buckets = int(max(1, min(100_000, hist.sum() // 2000)))
    dealt = cut.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "b").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("b")) - F.col("count"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before.select("length", "b", "before"), ["length", "b"]).withColumn("rank", F.col("before") + F.col("r") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        size, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            first, base, copies, start = runs[int(s)].T
            k = np.searchsorted(first, r[at], side="right") - 1
            i = r[at] - first[k]
            seq[at], off[at] = base[k] + i // copies[k], start[k] + (i % copies[k]) * s
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("p", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``."""
    return packed(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
