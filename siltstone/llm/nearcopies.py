"""SimHash near-dedup for a similarity of shingle sets: the form of operator 10 that the pipeline uses.

Rows of equal shingle sets are one class, and each class has a SimHash fingerprint of its set, of 512 bits since 64
can't tell a similarity of 0.8 from one of 0.5. Sets of similarity 0.8 have fingerprints that differ in 78 bits on average,
in more than ``RADIUS`` with a chance of 3e-7. That is too wide for buckets of agreeing fingerprint bits, so
classes meet in buckets of min-hash bands instead: a pair of similarity 0.8 meets in none of the ``BANDS`` with
probability 5e-8, one of 0.9 with 1e-15. Pairs that meet are discarded by size and by pivot distance tables (largest
coordinate difference over the radius), the survivors' fingerprints are compared, and what is within the radius is
verified by exact Jaccard similarity.

First every class is tried against the smallest class that it meets most often, which is linear in the number of classes and
links most of a group of copies. What is left are buckets whose classes are still in different groups, such as a family of texts
of similarity 0.6 to 0.8, which no bands tell from one of 0.8. Their pairs are tried inside the task that a bucket comes to, each
pair in the first bucket that the two share: no row is made for a pair, only for the links that join two groups. Buckets whose
sets are more than ``TILE`` numbers are dealt in blocks, and a task holds two blocks. What the filter leaves
without a partner doesn't send its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import components
from siltstone.llm._common import durable, held, keep_rows, row_key, shuffle_partitions, slices, stored

SEED = 42
BANDS, ROWS = 32, 4
#: Bits of 512 that fingerprints of sets of similarity 0.8 may differ in: 77.6 and five deviations of 8.1; sets of under SMALL
#: shingles move by whole ties (96 and five deviations of 8.8).
RADIUS, RADIUS_SMALL, SMALL = 118, 140, 40
WORDS, N_PIVOTS = 8, 16
#: Numbers of the sets of a block, each set counting ``EACH`` besides its own.
TILE, EACH = 1 << 20, 512
_RNG = np.random.default_rng(20_113)
_FLIP, _ODD = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD |= np.uint64(1)
_MIX, _BAND = _RNG.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 64, BANDS, dtype=np.uint64)
_SALT, _TIMES = _RNG.integers(0, 1 << 64, (2, WORDS), dtype=np.uint64)
_TIMES |= np.uint64(1)
_PIVOTS = _RNG.integers(0, 1 << 64, (N_PIVOTS, WORDS), dtype=np.uint64)
_LANES = np.uint64(0x0101010101010101)
_AT_ONCE = 4_096
_F = [f"f{i}" for i in range(WORDS)]


def shingles(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of a shorter text the one of all its words, none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    k, h = words_per_shingle, xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], np.uint64))


def class_of(hashes: np.ndarray) -> int:
    """A signed 64-bit number that names the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of the set's min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, ((hashes[None, at : at + _AT_ONCE] ^ _FLIP) * _ODD).min(1), out=least)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) ^ _BAND).view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """512 bits of a set as 8 numbers: those set in over half of the hashes, each hashed again for every 64 of them."""
    rows = -(-len(hashes) // 255)
    counts = np.zeros((WORDS, 8, 8), np.int64)
    for i in range(WORDS):
        word = np.zeros(rows * 255, np.uint64)
        word[: len(hashes)] = (hashes ^ _SALT[i]) * _TIMES[i]
        word ^= word >> np.uint64(29)
        word[len(hashes) :] = 0
        for bit in range(8):  # eight sums of up to 255 side by side in each number
            sums = (word >> np.uint64(bit) & _LANES).reshape(rows, 255).sum(1, dtype=np.uint64)
            counts[i, :, bit] = sums.view(np.uint8).reshape(rows, 8).sum(0, dtype=np.int64)
    return np.packbits(counts.ravel() * 2 > len(hashes)).view(np.uint64)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: its Hamming distances to the pivots."""
    return np.stack([np.bitwise_count(prints ^ p).sum(1, dtype=np.int16) for p in _PIVOTS], 1)


def near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of fingerprints a[i], b[i] may be of sets of the similarity: by size, then by the tables, then by the bits."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    radius = np.where(low < SMALL, RADIUS_SMALL, RADIUS)
    (left,) = np.nonzero(low >= similarity * high - 1e-9)
    left = left[(np.abs(table_a[left] - table_b[left]) <= radius[left, None]).all(1)]
    out = np.zeros(len(a), bool)
    out[left[np.bitwise_count(a[left] ^ b[left]).sum(1, dtype=np.int64) <= radius[left]]] = True
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nearcopies")
        for batch in slices(batches):
            sets = [shingles(t, k) for t in batch.column(3).to_pylist()]
            found = np.concatenate([bands(s) for s in sets]) if sets else np.zeros(0, np.int64)
            prints = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(prints[:, i]) for i in range(WORDS)], lists],
                names=["id", "key", "row", "node", "size", *_F, "bands"],
            )

    rows = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id bigint, key bigint, row bigint, node bigint, size bigint, {', '.join(f'{f} bigint' for f in _F)}, bands array<bigint>")


def _sets(texts: DataFrame, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nearcopies")
        for batch in slices(batches):
            sets = [shingles(t, k) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s"])

    return texts.select(text_col).mapInArrow(run, "node bigint, s array<bigint>").dropDuplicates(["node"])


def _by_bucket(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make`` over whole buckets: rows (bucket, node, ...) arrive sorted, and columns as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last bucket may go on
            yield from make(*(c[:cut] for c in now))
            kept = [c[cut:] for c in now]
        if kept is not None:
            yield from make(*kept)

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, schema)


def _stars(bucket: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each class of a bucket with the smallest there."""
    first = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
    least = node[np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))] if len(node) else node
    yield pa.RecordBatch.from_arrays([pa.array(c[~first]) for c in (bucket, least, node)], names=["bucket", "a", "b"])


_ROW = "bucket bigint, lo bigint, hi bigint, block bigint, node bigint, group bigint, size bigint"
_CLASS = f"{_ROW}, {', '.join(f'{f} bigint' for f in _F)}, bands array<bigint>"


def _tiles(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets by pairs of blocks (lo, hi): each block meets each other one and itself once."""
    rows = rest.join(classes.select("node", "size", *_F, "bands"), "node")
    weight = rest.join(classes.select("node", "size"), "node").groupBy("bucket").agg(F.ceil(F.sum(F.col("size") + EACH) / TILE).alias("blocks"))
    rows = rows.join(weight, "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "group", "size", *_F, "bands")


def _by_tile(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make`` over the record batch of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], None
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[:3]], 1)
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if start == stop:
                    continue
                if parts and at != tuple(keys[start]):
                    yield from make(pa.concat_batches(parts))
                    parts = []
                parts.append(batch.slice(start, stop - start))
                at = tuple(keys[start])
        if parts:
            yield from make(pa.concat_batches(parts))

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node").mapInArrow(run, schema)


class _Tile:
    """The classes of a tile, with those that each may be a near copy of."""

    def __init__(self, batch: pa.RecordBatch, similarity: float):
        bucket, lo, hi, self.block, self.node, self.group, self.size, *words = (c.to_numpy() for c in batch.columns[: 7 + WORDS])
        self.bucket, self.one, self.similarity = bucket[0], lo[0] == hi[0], similarity
        self.prints = np.stack(words, 1).view(np.uint64)
        self.bands = batch.column(7 + WORDS).flatten().to_numpy().reshape(-1, BANDS)
        self.table = pivot_table(self.prints)

    def partners(self, i: int, group: np.ndarray) -> np.ndarray:
        """Later classes of other groups that the filter leaves and that meet class i in this tile first."""
        there = group[i + 1 :] != group[i]
        if not self.one:
            there &= self.block[i + 1 :] != self.block[i]
        j = np.flatnonzero(there) + i + 1
        j = j[self.size[j] >= self.similarity * self.size[i] - 1e-9]
        i = np.full(len(j), i)
        ok = near(self.prints[i], self.prints[j], self.size[i], self.size[j], self.table[i], self.table[j], self.similarity)
        i, j = i[ok], j[ok]
        same = self.bands[i] == self.bands[j]
        return j[self.bands[i, same.argmax(1)] == self.bucket]


def _with_partners(similarity: float):
    """The rows of a tile that have a partner there."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tile, use = _Tile(batch, similarity), np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows - 1):
            if len(j := tile.partners(i, tile.group)):
                use[i] = use[j] = True
        if use.any():
            yield batch.filter(pa.array(use))

    return make


def _links(similarity: float):
    """Pairs of the similarity that join two groups of a tile, as many as join all that can be joined."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tile = _Tile(batch, similarity)
        column = batch.column(batch.num_columns - 1)
        ends, flat = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy().view(np.uint64)
        group, a, b = tile.group.copy(), [], []
        for i in range(batch.num_rows - 1):
            j = tile.partners(i, group)
            if not len(j):
                continue
            own, others = flat[ends[i] : ends[i + 1]], np.concatenate([flat[ends[x] : ends[x + 1]] for x in j])
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            both = np.add.reduceat(hit, np.r_[0, np.cumsum(tile.size[j])[:-1]], dtype=np.int64)
            for x in j[both >= similarity * (tile.size[i] + tile.size[j] - both) - 1e-9]:
                if group[x] != group[i]:
                    group[group == group[x]] = group[i]
                    a.append(tile.node[i])
                    b.append(tile.node[x])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return make


def _sifted(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that size, tables and fingerprints leave."""
    left, right = (prints.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("size", *_F)]) for c in "ab")
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", *[f"a_{f}" for f in _F], *[f"b_{f}" for f in _F])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, *words = (c.to_numpy() for c in batch.columns)
            fa, fb = (np.stack(w, 1).view(np.uint64) for w in (words[:WORDS], words[WORDS:]))
            ok = near(fa, fb, na, nb, pivot_table(fa), pivot_table(fb), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where(F.col("n") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("n")) - 1e-9).select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies.

    Two rows are linked if the Jaccard similarity of their shingle sets is ``similarity`` or more; groups are
    what is connected over links. Texts without words are one group, null among them. Of each group one
    row stays: smallest id, rows without an id last, then the smallest key of the text and of all columns.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the bands find pairs of similarity 0.8 and more")
    sketches = stored(_sketches(docs, id_col, text_col, words_per_shingle))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "row")).alias("best")
    classes = stored(sketches.groupBy("node").agg(best, *[F.first(c).alias(c) for c in ("size", *_F, "bands")]))
    prints = classes.select("node", "size", *_F)
    dealt = classes.select(F.explode("bands").alias("bucket"), "node")
    star = stored(_by_bucket(dealt, _stars, "bucket bigint, a bigint, b bigint"))
    met = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = keep_rows(docs, classes.join(met, "node", "left_semi").select("best.*"), id_col, text_col)
    sets = stored(_sets(texts, text_col, words_per_shingle))
    member = stored(star.select("bucket", F.col("b").alias("node")).unionByName(star.select("bucket", F.col("a").alias("node")).distinct()))

    # of the smallest classes of its buckets each class is first tried against the one it meets most often
    met = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", F.col("a"))).alias("a"))
    label = components.connect(_confirmed(_sifted(met.select("a", "b"), prints, similarity), sets, similarity))
    grouped = durable(member.join(label, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("group")))
    mixed = grouped.groupBy("bucket").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("bucket")
    rest = grouped.join(mixed, "bucket", "left_semi").select("bucket", "node", "group")
    left = _by_tile(_tiles(rest, classes), _with_partners(similarity), _CLASS)
    sent = left.join(sets, "node").select("bucket", "lo", "hi", "block", "node", "group", "size", *_F, "bands", "s")
    links = _by_tile(sent, _links(similarity), "a bigint, b bigint")
    # what is linked so far goes in as stars, which take no rounds
    label = components.connect(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    grouped = classes.join(label, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    return keep_rows(docs, grouped.groupBy("root").agg(F.min("best").alias("best")).select("best.*"), id_col, text_col)
