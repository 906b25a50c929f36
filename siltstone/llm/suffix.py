"""Exact removal of repeated byte strings by distributed prefix doubling over sparse suffixes.

A window is 200 bytes of one text. Ranks name strings: equal strings have equal ranks, and the rank of
a string of 2 L bytes is made of the ranks of its halves. Spark sorts (rank, position) pairs at
growing lengths and drops the positions whose rank is unique, as no longer string from there can
repeat:

1. 32 bytes, at anchors only: the position of least hash among those of a window. All windows
   with one anchor in a row are a stretch; equal windows have equal anchors at equal offsets, so the
   stretches of an anchor whose rank is unique are done.
2. Whole stretches, all bytes of their windows at once: equal ones repeat in every window, and one of
   them stands for all in what follows.
3. Single windows, only of stretches that share an anchor with a different stretch. Spark deals and sorts the
   stretches by anchor; there the windows' positions are ranked by their bytes at 1, 2, 4, ... 128, 200 bytes,
   each round sorting the pairs of ranks at a growing offset, until a window is unique or past the threshold.
   Where the stretches of an anchor are very many, their windows are dealt one by one by the ranks at 100
   bytes and the pairs of those at offsets 0 and 100.

Ranks of anchors and stretches are names computed where the text is, of 64 and 128 bits. An anchor's name only
selects; a removal is decided by the bytes, or by 128 bits of equal stretches and of windows dealt one by one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import content_key, shuffle_partitions, slices, stored
from siltstone.llm.superkmer import _merge, _mix, _sliding_min

LENGTH = 200
ANCHOR = 32
#: Bytes that a task handles at once; longer texts are cut into parts that overlap by a window.
BLOCK = 1_500_000
#: Different stretches of one anchor up to which they meet in one task.
TOGETHER = 10_000
#: Windows that such a task ranks at once, besides those of one anchor.
AT_ONCE = 500_000

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASE = _rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def ranks(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The rank of data[i : i + length] for every i, by doubling."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, done, base = _BYTE[which][data], 1, _BASE[which]
        out, have = None, 0
        rest = length
        while rest:
            if rest & 1:
                if out is None:
                    out, have = power, done
                else:  # what there is, then the next power of two
                    n = min(len(out), len(power) - have)
                    out = out[:n] * _pow(base, done) + power[have : have + n]
                    have += done
            rest >>= 1
            if rest:
                power = power[:-done] * _pow(base, done) + power[done:]
                done *= 2
        return _mix(out[: len(data) - length + 1])


def _pow(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rerank(pairs: np.ndarray) -> np.ndarray:
    """Sorts 64-bit pairs; the rank of each is how many different ones are smaller."""
    order = np.argsort(pairs)
    sorted_ = pairs[order]
    out = np.empty(len(pairs), np.int64)
    out[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]]) if len(pairs) else []
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows data[at : at + length] are equal to another one, by prefix doubling on the bytes themselves.

    A window of weight 2 counts as two. Positions are ranked by their first byte, then by 2, 4, 8, ... bytes: the
    pairs (rank here, rank as far ahead) are sorted and ranked again. After each round windows of a unique rank are
    done; after the round that reaches ``length`` those that are left repeat. No hash takes part.
    """
    live = np.arange(len(at))
    rank, have = data.astype(np.int64), 1
    while len(live):
        times = np.bincount(rank[at[live]], weight[live], minlength=int(rank.max(initial=0)) + 1)
        live = live[times[rank[at[live]]] > 1]
        if have == length:
            break
        step = min(have, length - have)
        # only what live windows reach is ranked further
        reach = np.zeros(len(data) + 1, np.int32)
        np.add.at(reach, at[live], 1)
        np.add.at(reach, at[live] + length - have - step + 1, -1)
        (use,) = np.nonzero(np.cumsum(reach)[: len(data)] > 0)
        now = np.zeros(len(data), np.int64)
        now[use] = rerank(rank[use] << 32 | rank[use + step]) if len(use) else 0
        rank, have = now, have + step
    out = np.zeros(len(at), bool)
    out[live] = True
    return out


class Part:
    """Some texts end to end, and the stretches of windows that share an anchor."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.raw, self.length = b"".join(texts), length
        self.data = np.frombuffer(self.raw, np.uint8)
        anchor = min(ANCHOR, length)
        self.start = self.n = np.zeros(0, np.int64)
        self.rank, self.twice = np.zeros(0, np.uint64), np.zeros(0, bool)
        if len(self.data) < length:
            return
        grams = ranks(self.data, anchor)
        least = _sliding_min(grams, length - anchor + 1)
        ok = sizes >= length
        whole = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(whole, self.first[:-1][ok], 1)
        np.add.at(whole, self.first[1:][ok] - length + 1, -1)
        inside = np.cumsum(whole)[: len(least)] > 0
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        new[self.first[:-1][ok]] = True
        edges = np.append(np.flatnonzero(new), len(least))
        use = inside[edges[:-1]]
        self.start, self.n = edges[:-1][use], np.diff(edges)[use]
        if len(self.start):
            self.rank = least[self.start]
            span = self.n + length - anchor
            to = np.cumsum(span)
            at = np.arange(to[-1]) + np.repeat(self.start - (to - span), span)
            same = grams[at] == np.repeat(self.rank, span)
            self.twice = np.add.reduceat(same, to - span, dtype=np.int64) > 1
            with np.errstate(over="ignore"):
                self.rank = _mix(self.rank * _SPREAD)

    def owner(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, start, "right") - 1

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each stretch: of all bytes of its windows."""
        raw, more, digest = self.raw, self.length - 1, xxhash.xxh3_128_digest
        out = b"".join(digest(raw[a : a + n + more]) for a, n in zip(self.start.tolist(), self.n.tolist(), strict=True))
        both = np.frombuffer(out, "<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[Part, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of bounded size with (k1, k2, offset) of each text in them; columns k1, k2, text."""
    texts: list[bytes] = []
    keys: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> tuple[Part, np.ndarray, np.ndarray, np.ndarray]:
        k = np.array(keys, np.int64).reshape(-1, 3)
        return Part(texts, length), k[:, 0], k[:, 1], k[:, 2]

    for batch in batches:
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            for at in range(0, max(1, len(data) - length + 1), BLOCK):
                piece = data[at : at + BLOCK + length - 1]
                texts.append(piece)
                keys.append((k1, k2, at))
                size += len(piece)
                if size >= BLOCK:
                    yield flush()
                    texts, keys, size = [], [], 0
    if texts:
        yield flush()


def _rows(docs: DataFrame, id_col: str, text_col: str, more: list[str]) -> DataFrame:
    k1 = F.coalesce(docs[id_col].cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(k1.alias("k1"), content_key(docs[text_col]).alias("k2"), docs[text_col].alias("text"), *[docs[c] for c in more])


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, first, stop): byte ranges covered by repeated windows, for rows (k1, k2, text)."""
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, k1, k2, offset in _parts(batches, length):
            own = part.owner(part.start)
            c0, c1 = part.names()
            columns = (k1[own], k2[own], part.start - part.first[own] + offset[own], part.n, part.rank.view(np.int64), c0, c1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(part.twice)], names=["k1", "k2", "start", "n", "anchor", "c0", "c1", "twice"])

    source = rows.select("k1", "k2", "text")
    every = stored(source.mapInArrow(stretches, "k1 bigint, k2 bigint, start bigint, n bigint, anchor bigint, c0 bigint, c1 bigint, twice boolean"))
    # 1. anchors whose rank isn't unique
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("t")).where("m > 1 or t").select("anchor")
    alive = stored(every.join(again, "anchor", "left_semi"))
    # 2. equal stretches; the first of each stands for them
    kinds = alive.groupBy("anchor", "c0", "c1").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("rep"), F.max("twice").alias("twice"))
    kinds = stored(kinds)
    whole = alive.join(kinds.where("times > 1").select("anchor", "c0", "c1"), ["anchor", "c0", "c1"], "left_semi")
    whole = whole.select("k1", "k2", F.col("start").alias("first"), (F.col("start") + F.col("n") + length - 1).alias("stop"))
    # 3. windows of stretches that differ but share an anchor, or that hold their anchor twice
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("low"), F.max(F.col("twice") & (F.col("times") == 1)).alias("t"))
    mixed = mixed.where("(m > 1 and low = 1) or t").select("anchor", (F.col("m") > TOGETHER).alias("big"))
    open_ = kinds.join(mixed, "anchor").select("rep.*", "anchor", (F.col("times") > 1).alias("settled"), "big")
    lists = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "anchor", "settled", "big")).alias("l"))
    names = ["l.start", "l.n", "l.anchor", "l.settled", "l.big"]
    given = rows.join(lists, ["k1", "k2"]).select("k1", "k2", "text", *names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, *lists in zip(*(c for c in batch.columns), strict=True):
                data = (text.as_py() or "").encode()
                for start, n, anchor, settled, big in zip(*(x.as_py() for x in lists), strict=True):
                    out.append((k1.as_py(), k2.as_py(), start, anchor, settled, big, data[start : start + n + length - 1]))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k1", "k2", "start", "anchor", "settled", "big", "data"])

    cuts = given.mapInArrow(cut, "k1 bigint, k2 bigint, start bigint, anchor bigint, settled boolean, big boolean, data binary")
    many = mixed.where("big").limit(1).count() > 0
    if many:
        cuts = stored(cuts)
    def joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings end to end; for each window its string and where in it it starts."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        n = sizes - length + 1
        own = np.repeat(np.arange(len(data)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.frombuffer(b"".join(data), np.uint8), own, inner + np.repeat(np.cumsum(sizes) - sizes, n)

    def settle(held: list[tuple]) -> pa.RecordBatch:
        k1, k2, start, done, data = zip(*held, strict=True)
        k1, k2, start, done = np.array(k1, np.int64), np.array(k2, np.int64), np.array(start, np.int64), np.array(done, bool)
        raw, own, at = joined(list(data))
        live = repeated_windows(raw, at, 1 + done[own], length) & ~done[own]
        own, at = own[live], at[live]
        begin = np.cumsum(np.fromiter(map(len, data), np.int64, len(data))) - np.fromiter(map(len, data), np.int64, len(data))
        where = start[own] + at - begin[own]
        return _merge(k1[own], k2[own], where, where + length)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, windows = None, 0
        for batch in batches:
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and windows > AT_ONCE:
                    yield settle(held)
                    held, windows = [], 0
                last = anchor
                held.append(tuple(row))
                windows += len(row[-1])
        if held:
            yield settle(held)

    small = cuts.where(~F.col("big")).select("anchor", "k1", "k2", "start", "settled", "data")
    small = small.repartition(shuffle_partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor")
    found = whole.unionByName(small.mapInArrow(meet, _RANGES))
    if many:
        found = found.unionByName(_one_by_one(cuts.where("big"), length))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _merge(*(c.to_numpy() for c in batch.columns))

    return found.mapInArrow(merge, _RANGES)


_RANGES = "k1 bigint, k2 bigint, first bigint, stop bigint"


def _one_by_one(cuts: DataFrame, length: int) -> DataFrame:
    """Step 3 for strings of very frequent anchors: a row for each window, counted by rank over all tasks."""
    half = length // 2

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, start, settled, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 6)), strict=True):
                raw = np.frombuffer(data, np.uint8)
                w, r = ranks(raw, length, 1).view(np.int64), ranks(raw, half).view(np.int64)
                n = len(w)
                columns = (np.full(n, k1), np.full(n, k2), start + np.arange(n), r[:n], r[length - half :][:n], w, np.full(n, settled))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "at", "a", "b", "w", "settled"])

    pairs = stored(cuts.mapInArrow(windows, "k1 bigint, k2 bigint, at bigint, a bigint, b bigint, w bigint, settled boolean"))
    for key in (["a"], ["a", "b", "w"]):  # ranks at half the length, then the pairs of them
        weight = F.sum(F.when(F.col("settled"), 2).otherwise(1)).alias("m")
        known = pairs.groupBy(*key).agg(weight).where("m > 1").select(*key)
        pairs = pairs.join(known, key, "left_semi")
    return pairs.where(~F.col("settled")).select("k1", "k2", F.col("at").alias("first"), (F.col("at") + length).alias("stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """A row for each row of ``docs``: n_bytes, n_removed, n_spans, kept_sha256, with ``with_kept`` kept (binary).

    Texts are UTF-8 bytes, null is empty. Each byte covered by a string of ``length`` bytes that starts
    anywhere else too (same text included) is removed, judged on the input; strings never cross
    texts. ``n_spans`` counts the maximal runs removed. Repeated rows repeat each other and get equal
    results; a null id is an id like any other.
    """
    rows = _rows(docs, id_col, text_col, [])
    spans = repeated_ranges(rows, length).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    joined = rows.join(spans, ["k1", "k2"], "left").select("k1", "text", "spans.first", "spans.stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
            for text, first, stop in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                data = (text.as_py() or "").encode()
                first, stop = first.as_py(), stop.as_py()
                n_bytes.append(len(data))
                pieces, at, gone, runs, reach = [], 0, 0, 0, -1
                for a, b in sorted(zip(first or (), stop or (), strict=True)):
                    if a > reach:
                        runs += 1
                        pieces.append(data[at:a])
                        gone, at = gone + b - a, b
                    elif b > reach:
                        gone, at = gone + b - reach, b
                    reach = max(reach, b)
                left = b"".join([*pieces, data[at:]])
                n_removed.append(gone)
                n_spans.append(runs)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=["k1", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = joined.mapInArrow(run, "k1 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.select(F.nullif("k1", F.lit(-(1 << 63))).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else []))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting every string."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out
