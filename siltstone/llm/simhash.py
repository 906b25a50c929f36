"""SimHash fingerprints, and near duplicates by pivot distance tables.

Fingerprints are 64 bits; two texts are linked if theirs differ in at most ``radius`` bits. Pairs
are looked for among distinct fingerprints only. Of six blocks of bits at least three agree in any
pair that differs in up to three bits, so each fingerprint is dealt to the 20 buckets its triples of
blocks name. In a bucket each fingerprint has a row in the pivot table, its Hamming distances to
reference fingerprints: by the triangle inequality a pair whose rows differ by more than
the radius in any coordinate can't be linked, and is discarded before any comparison of bits. A
bucket gives a spanning set of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import components
from siltstone.llm._common import durable, held, keep_rows, row_key, shuffle_partitions, slices

SEED = 42
N_PIVOTS = 16
_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Masks of the three agreeing blocks of each of the 20 tables.
TABLES = [sum(((1 << n) - 1) << at for at, n in triple) for triple in itertools.combinations(_BLOCKS, 3)]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread at random."""
    return np.random.default_rng(20_111).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fingerprints: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: its distances to the pivots."""
    return np.stack([np.bitwise_count(fingerprints ^ p) for p in pivots()], 1).astype(np.int16)


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of the text's shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only
    if not words:
        return 0
    k = words_per_shingle
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return h(b" ".join(words), SEED)
    # shingles are slices of the words joined by one space
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, keyed: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed 64-bit number. Null counts as empty.

    ``keyed`` adds (key, row) of ``row_key``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *names])

    id_, *keys = row_key(docs, id_col, text_col)
    names = ["key", "row"] if keyed else []
    rows = docs.select(id_, docs[text_col].alias("text"), *(keys if keyed else []))
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["id", "fp", *names]))


def _links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within each run of equal keys; ``key`` is sorted."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edges)
    a, b = [], []
    small = np.repeat((size > 1) & (size <= 32), size)
    at = np.flatnonzero(small)
    if len(at):
        k, f = key[at], fp[at]
        table = pivot_table(f)
        for lag in range(1, int(size[(size > 1) & (size <= 32)].max())):
            (i,) = np.nonzero(k[lag:] == k[:-lag])
            i = i[(np.abs(table[i] - table[i + lag]) <= radius).all(1)]
            i = i[np.bitwise_count(f[i] ^ f[i + lag]) <= radius]
            a.append(f[i])
            b.append(f[i + lag])
    for start, n in zip(edges[:-1][size > 32], size[size > 32], strict=True):
        x, y = _spanning(fp[start : start + n], radius)
        a.append(x)
        b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _spanning(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one large bucket.

    Sorted by the first pivot's distance; each fingerprint is compared only with the later ones within
    the radius there, in blocks, and only those of other pieces so far.
    """
    table = pivot_table(fp)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    root = np.arange(len(fp))
    stop = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    a, b = [], []
    for i in range(len(fp) - 1):
        for at in range(i + 1, int(stop[i]), 65_536):
            j = np.arange(at, min(int(stop[i]), at + 65_536))
            j = j[root[j] != root[i]]
            j = j[(np.abs(table[j] - table[i]) <= radius).all(1)]
            j = j[np.bitwise_count(fp[j] ^ fp[i]) <= radius]
            if len(j):
                _, first = np.unique(root[j], return_index=True)
                j = j[first]
                a.append(np.repeat(fp[i], len(j)))
                b.append(fp[j])
                root[np.isin(root, root[j])] = root[i]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all within ``radius`` <= 3."""
    if not 0 <= radius <= 3:
        raise ValueError("the blocks find pairs of up to 3 differing bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in TABLES]
    buckets = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))
    dealt = distinct.select(buckets.alias("bucket"), "fp")
    n = shuffle_partitions(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            x, y = _links(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            yield emit(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        yield emit(held_key, held_fp)

    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a bigint, b bigint")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) for each distinct fingerprint of ``prints`` (id, fp): its smallest id, and a fingerprint that names its component."""
    # a row for each distinct fingerprint takes part in the search, whatever the number of copies
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = durable(links(distinct.select("fp"), radius))
    label = components.connect(found)  # fp -> root, for linked fingerprints only
    return durable(distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links.

    A null or empty text has fingerprint 0 and is linked like any other. Repeated rows are rows of their
    own with equal results; rows with a null id get a component but never name one, unless all of the
    component's ids are null. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words_per_shingle))
    named = _rooted(prints, radius)
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    of_print = named.join(smallest, "root").select("fp", "component")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates.

    The row of smallest id stays, rows with a null id last; of several rows with that id the one of smallest
    key of the text, then of all columns. Rows of equal ids are rows of their own.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words_per_shingle, keyed=True))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "row")).alias("best")
    kept = prints.groupBy("fp").agg(best).join(_rooted(prints, radius).select("fp", "root"), "fp")
    kept = kept.groupBy("root").agg(F.min("best").alias("best")).select("best.*")
    return keep_rows(docs, kept, id_col, text_col)
