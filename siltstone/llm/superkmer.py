"""Exact removal of repeated passages of words by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the least hash among the runs of
``m`` words within it, so equal windows have equal minimisers. Consecutive windows that share a
minimiser travel as one packed string to the minimiser's bucket; there the windows of strings that
share a minimiser are sorted and counted, byte for byte.

First the minimisers alone are counted: strings whose minimiser occurs once hold no repeated window
and never travel. What repeats within one block of a map task is decided at once, and only one
representative travels. The windows of very frequent minimisers are dealt one by one, by a hash of the
whole window, so that they spread over all buckets.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import content_key, held, shuffle_partitions, slices, stored

WINDOW = 35
RUN = 6
#: Bytes of text that a map task handles at once, and windows that a bucket sorts at once.
BLOCK = 4_000_000
SORTED_AT_ONCE = 150_000
#: Windows of a string at most; longer runs that share a minimiser travel as several strings.
LONGEST = 2_000
#: Minimisers of more strings than this have their windows dealt one by one.
HOT = 20_000
_P, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i, by doubling."""
    n = len(x) - width + 1
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x[:n]


class Block:
    """The words of some documents, and their super-k-mers."""

    def __init__(self, texts: list[str | None], k: int = WINDOW, m: int = RUN):
        split = [(t or "").encode().split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        words = [w for ws in split for w in ws]
        self.start = self.n = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.uint64)
        self.twice = np.zeros(0, bool)
        if len(words) < k:
            return
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            runs = np.zeros(len(h) - m + 1, np.uint64)
            for j in range(m):
                runs = runs * _P + h[j : len(runs) + j]
            runs = _mix(runs)
            least = _sliding_min(runs, k - m + 1)
        whole = np.zeros(len(words) + 1, np.int64)  # windows that lie within one document
        ok = self.counts >= k
        np.add.at(whole, self.first[:-1][ok], 1)
        np.add.at(whole, self.first[1:][ok] - k + 1, -1)
        inside = np.cumsum(whole)[: len(least)] > 0
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        begins = np.zeros(len(least), bool)
        begins[self.first[:-1][ok]] = True
        self.start = np.flatnonzero((new | begins) & inside)
        # a super-k-mer ends before the next one or the next window that isn't whole
        stops = np.flatnonzero(new | begins | ~inside)
        after = np.searchsorted(stops, self.start, "right")
        ends = np.append(stops, len(least))[after]
        self.n, self.minimiser = ends - self.start, least[self.start]
        if len(self.n) and self.n.max() > LONGEST:  # a run of one word would be a single string
            parts = -(-self.n // LONGEST)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            n = np.repeat(self.n, parts) - step * LONGEST
            self.start, self.n, self.minimiser = np.repeat(self.start, parts) + step * LONGEST, np.minimum(n, LONGEST), np.repeat(self.minimiser, parts)
        if len(self.start):
            # only a string that holds its minimiser twice can hold a window twice
            length = self.n + k - m
            to = np.cumsum(length)
            at = np.arange(to[-1]) + np.repeat(self.start - (to - length), length)
            same = runs[at] == np.repeat(self.minimiser, length)
            self.twice = np.add.reduceat(same, to - length, dtype=np.int64) > 1
        with np.errstate(over="ignore"):
            self.minimiser = _mix(self.minimiser * _P)  # a minimum is small; spread it again

    def document(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, start, "right") - 1


def _blob(minimiser, k1, k2, start, n, known, strings: list[bytes]) -> bytes:
    count = len(strings)
    lengths = np.fromiter(map(len, strings), np.int32, count)
    parts = [np.asarray(a, t).tobytes() for a, t in ((minimiser, "<u8"), (k1, "<i8"), (k2, "<i8"), (start, "<i8"), (n, "<i4"), (known, "<i1"), (lengths, "<i4"))]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", count) + b"".join(parts) + b"\n".join(strings))


def _unblob(data: bytes):
    data = zstandard.ZstdDecompressor().decompress(data)
    (count,) = struct.unpack_from("<I", data)
    at, out = 4, []
    for t, size in (("<u8", 8), ("<i8", 8), ("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i1", 1), ("<i4", 4)):
        out.append(np.frombuffer(data, t, count, at))
        at += size * count
    ends = at + np.cumsum(out.pop().astype(np.int64) + 1)
    begins = np.concatenate([[at], ends[:-1]])
    return out, [data[a : b - 1] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def windows_of(packed: bytes, k: int) -> list[bytes]:
    words = packed.split()
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[:-1])]
    return [packed[begins[i] : ends[i + k - 1]] for i in range(len(words) - k + 1)]


def repeated(strings: dict[bytes, int], k: int, at_once: int = SORTED_AT_ONCE) -> dict[bytes, np.ndarray]:
    """For packed strings that occur once (count 1): which of their windows occur again among all strings.

    The windows are sorted; equal ones are neighbours then. Many windows are sorted in several passes,
    each over those of one remainder of a hash, so that memory stays bounded.
    """
    total = sum(max(1, len(s) // 8) for s in strings)
    passes = 1 + total // at_once
    out = {}
    sizes = {}
    for s, n in strings.items():
        if n == 1:
            sizes[s] = s.count(b" ") - k + 2
            out[s] = np.zeros(sizes[s], bool)
    for p in range(passes):
        rows = []
        for s, n in strings.items():
            for i, w in enumerate(windows_of(s, k)):
                if passes == 1 or xxhash.xxh32_intdigest(w) % passes == p:
                    rows.append((w, s, i, n))
        rows.sort(key=lambda r: r[0])
        for _, same in groupby(rows, key=lambda r: r[0]):
            same = list(same)
            if len(same) > 1 or same[0][3] > 1:
                for _, s, i, n in same:
                    if n == 1:
                        out[s][i] = True
    return out


_RANGES = "k1 bigint, k2 bigint, first bigint, stop bigint"


def _merge(k1, k2, first, stop) -> pa.RecordBatch:
    """Ranges of words, those that touch made one."""
    k1, k2, first, stop = (np.asarray(x, np.int64) for x in (k1, k2, first, stop))
    if len(k1):
        order = np.lexsort((first, k2, k1))
        k1, k2, first, stop = k1[order], k2[order], first[order], stop[order]
        group = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        base = np.cumsum(group) * (np.int64(1) << 40)  # makes the running end start afresh in each row's ranges
        reach = np.maximum.accumulate(base + stop)
        new = group | np.r_[True, (base + first)[1:] > reach[:-1]]
        begins = np.flatnonzero(new)
        stop = (reach - base)[np.append(begins[1:], len(k1)) - 1]
        k1, k2, first = k1[begins], k2[begins], first[begins]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, first, stop)], names=["k1", "k2", "first", "stop"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str | None], list[list]]]:
    """The texts (column 2) of some rows, up to BLOCK bytes or one row, and the other columns' values."""
    texts, rows, size = [], [], 0
    for batch in batches:
        others = [c for i, c in enumerate(batch.columns) if i != 2]
        for i in range(batch.num_rows):
            texts.append(batch.column(2)[i].as_py())
            rows.append([c[i].as_py() for c in others])
            size += len(texts[-1] or "")
            if size > BLOCK:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def repeated_ranges(docs: DataFrame, k: int = WINDOW, m: int = RUN) -> DataFrame:
    """(k1, k2, first, stop): ranges of words covered by repeated windows, for rows (k1, k2, text, ...)."""
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = partitions * 4

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("superkmer")
        for texts, rows in _texts(batches):
            block = Block(texts, k, m)
            own = block.document(block.start)
            key = np.array(rows, np.int64)
            columns = (key[own, 0], key[own, 1], block.start - block.first[own], block.n, block.minimiser.view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(block.twice)], names=["k1", "k2", "start", "n", "minimiser", "twice"])

    every = stored(docs.select("k1", "k2", "text").mapInArrow(find, "k1 bigint, k2 bigint, start bigint, n bigint, minimiser bigint, twice boolean"))
    known = every.groupBy("minimiser").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("t")).where("m > 1 or t")
    known = known.select("minimiser", (F.col("m") > HOT).alias("hot"))
    lists = every.join(known, "minimiser").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "minimiser", "twice", "hot")).alias("l"))
    names = ["l.start", "l.n", "l.minimiser", "l.twice", "l.hot"]
    # equal rows name equal strings, so a set of them is as large as the text allows, however often the row repeats
    # all columns of docs are read, so that the texts are dealt in the same way as for the join that follows
    given = docs.join(lists, ["k1", "k2"]).select("k1", "k2", "text", *names, *docs.columns[3:])

    def pack(texts: list[str | None], rows: list[list]) -> Iterator[tuple[int, bytes]]:
        where: dict[bytes, int] = {}
        strings: list[bytes] = []
        kept: list[list] = []  # minimiser, k1, k2, start, windows, 1 if known to repeat | 2 if its minimiser is in it twice
        again: list[tuple] = []

        def take(s: bytes, key: int, k1: int, k2: int, start: int, n: int, twice: int) -> None:
            j = where.setdefault(s, len(strings))
            if j == len(strings):
                strings.append(s)
                kept.append([key, k1, k2, start, n, twice])
            else:
                kept[j][5] |= 1
                again.append((k1, k2, start, start + n + k - 1))

        for text, (k1, k2, starts, ns, keys, twices, hots, *_) in zip(texts, rows, strict=True):
            words = (text or "").encode().split()
            joined = b" ".join(words)
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()
            for start, n, key, twice, hot in zip(starts, ns, keys, twices, hots, strict=True):
                if hot:
                    for i in range(start, start + n):
                        s = joined[at[i] : at[i + k] - 1]
                        take(s, xxhash.xxh64_intdigest(s), k1, k2, i, 1, 0)
                else:
                    take(joined[at[start] : at[start + n + k - 1] - 1], key & 0xFFFFFFFFFFFFFFFF, k1, k2, start, n, 2 * twice)
        again += [(k1, k2, start, start + n + k - 1) for _, k1, k2, start, n, mark in kept if mark & 1]
        if again:
            r = _merge(*zip(*again, strict=True))
            cols = [c.to_numpy() for c in r.columns]
            yield -1 - int(cols[1][0]) % buckets, zstandard.compress(b"".join(c.astype("<i8").tobytes() for c in cols))
        if not strings:
            return
        key = np.array([x[0] for x in kept], np.uint64)
        columns = [np.array(c, np.int64) for c in list(zip(*kept, strict=True))[1:]]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            js = order[a:b]
            yield int(bucket[js[0]]), _blob(key[js], *(c[js] for c in columns), [strings[j] for j in js.tolist()])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("superkmer")
        for texts, rows in _texts(batches):
            out = list(pack(texts, rows))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        """The repeated ranges of one bucket."""
        columns, strings = zip(*map(_unblob, blobs), strict=True)
        key, k1, k2, start, n, marks = (np.concatenate(c) for c in zip(*columns, strict=True))
        known, twice = (marks & 1).astype(np.int64), marks & 2
        strings = [s for part in strings for s in part]
        out: tuple[list, list, list, list] = ([], [], [], [])

        def found(i: int, first: int, windows: int) -> None:
            for column, x in zip(out, (k1[i], k2[i], start[i] + first, start[i] + first + windows + k - 1), strict=True):
                column.append(int(x))

        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
        many = np.flatnonzero((np.diff(edges) > 1) | (twice[order][edges[:-1]] > 0))
        for g in many:
            group: dict[bytes, list[int]] = defaultdict(list)
            for i in order[edges[g] : edges[g + 1]].tolist():
                group[strings[i]].append(i)
            times = {s: len(i) + sum(known[j] for j in i) for s, i in group.items()}
            for s, i in group.items():
                if times[s] > 1:
                    for j in i:
                        if not known[j]:  # others of it are decided where they were found
                            found(j, 0, int(n[j]))
            if len(group) > 1 or any(t == 1 and twice[group[s][0]] for s, t in times.items()):
                for s, flags in repeated(times, k).items():
                    (i,) = group[s]
                    for a in np.flatnonzero(flags).tolist():
                        found(i, a, 1)
        return _merge(*out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        at = None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    cols = np.frombuffer(zstandard.decompress(blob.as_py()), "<i8").reshape(4, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "first", "stop"])
                    continue
                if bucket != at and blobs:
                    yield settle(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield settle(blobs)

    sent = given.mapInArrow(send, "bucket bigint, blob binary")
    return sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _RANGES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = RUN, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs``: n_words, n_removed, kept_sha256, and with ``with_text`` kept_text.

    Words are runs of characters other than space and \\t to \\r. Each word covered by a window of ``k``
    words that starts anywhere else too (same document included) is removed, judged on the input.
    Null and empty texts have no words; repeated rows repeat each other's windows and get equal
    results; a null id is an id like any other. ``kept_text`` is the text as it was if nothing is removed,
    else the kept words joined by one space. ``keep`` names other columns to carry.
    """
    keep = keep or []
    null_id = F.lit(-(1 << 63))
    rows = docs.select(
        F.coalesce(docs[id_col].cast("bigint"), null_id).alias("k1"), content_key(docs[text_col]).alias("k2"), docs[text_col].alias("text"),
        *[docs[c].alias(f"_kept_{i}") for i, c in enumerate(keep)],
    )
    ranges = repeated_ranges(rows, k, m)
    spans = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    joined = rows.join(spans, ["k1", "k2"], "left").select("k1", "text", "spans.first", "spans.stop", *rows.columns[3:])
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    schema = "k1 bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string" + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, digests, kept = [], [], [], []
            for text, first, stop in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                text, first, stop = text.as_py(), first.as_py(), stop.as_py()
                words = (text or "").encode().split()
                total = len(words)
                if first:
                    gone = np.zeros(total + 1, np.int64)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, stop, -1)
                    covered = (np.cumsum(gone)[:-1] > 0).tolist()
                    words = [w for w, c in zip(words, covered, strict=True) if not c]
                n_words.append(total)
                n_removed.append(total - len(words))
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append((text if len(words) == total else left.decode()) if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()), *batch.columns[4:]],
                names=["k1", "n_words", "n_removed", "kept_sha256", "kept_text", *[f"_kept_{i}" for i in range(len(keep))]],
            )

    out = joined.mapInArrow(run, schema)
    return out.select(
        F.nullif("k1", null_id).alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []),
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)],
    )


def brute_force(texts: list[str | None], k: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text, by counting every window."""
    split = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(ws[i : i + k]) for ws in split for i in range(len(ws) - k + 1))
    out = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - k + 1):
            if times[tuple(ws[i : i + k])] > 1:
                gone.update(range(i, i + k))
        left = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(left).hexdigest()))
    return out
