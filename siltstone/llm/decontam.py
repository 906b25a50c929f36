"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over nine consecutive words that looks at five of them; a changed word
under an ignored position leaves the seed's hash as it was. Hashes of the benchmark's seeds meet those of
the documents in an equi-join. Each hit names a document, an item and an alignment (the difference
of word positions); around it the words of both are compared, and the overlap counts if enough of a
long enough stretch agrees, wherever the changed words are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import content_key, durable

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 7), (0, 2, 3, 6, 8), (0, 1, 5, 7, 8))
SPAN = 9
#: Items of fewer words than LEAST never match; those of fewer than SPAN match whole and unchanged only; those of fewer
#: than MEDIUM have the runs of CHUNK words at 0, CHUNK and 2 CHUNK as seeds, one of which any two changed words leave alone.
LEAST, MEDIUM, CHUNK = 5, 12, 3
#: Seeds of a benchmark of up to this many are broadcast (24 bytes each); those of a larger one are joined
#: by a shuffle.
MAX_BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _hashes(words: Column | str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(column: Column) -> Column:
    """The column, evaluated once for each row: the optimizer doesn't move it into lambdas above."""
    return F.explode(F.array(column))


def _seeds(hashes: Column) -> Column:
    """An array with, for each start of a span, its position and the hash under each mask."""
    starts = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("at"), *[F.xxhash64(F.lit(m), *[hashes[i + p] for p in mask]).alias(f"h{m}") for m, mask in enumerate(MASKS)]),
    )


def _runs(hashes: Column, n: int) -> Column:
    """An array with, for each run of n words, its position and its hash under the mask number 100 + n."""
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(100 + n).alias("mask"), F.xxhash64(F.lit(100 + n), *[hashes[i + p] for p in range(n)]).alias("h")))


def _short_seeds(bench: DataFrame) -> DataFrame:
    """(item, mask, h, item_at) of items that are too short for the spaced masks to find every permitted change."""
    hashes = bench.where(F.size("item_words") < MEDIUM).select("item", _hashes("item_words").alias("hashes"))
    runs = F.flatten(F.array(*[_runs(F.col("hashes"), m) for m in (CHUNK, *range(LEAST, SPAN))]))
    every = hashes.select("item", F.size("hashes").alias("size"), F.explode(runs).alias("s")).select("item", "size", "s.*")
    whole = (F.col("size") < SPAN) & (F.col("mask") == 100 + F.col("size"))
    chunk = (F.col("size") >= SPAN) & (F.col("mask") == 100 + CHUNK) & F.col("at").isin(0, CHUNK, 2 * CHUNK)
    return every.where(whole | chunk).select("item", "mask", "h", F.col("at").alias("item_at"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stretch: int = 20, agree: float = 0.8) -> DataFrame:
    """(id, item, n_overlap, n_matched, doc_word): documents that hold a benchmark item or part of one.

    An alignment counts if among some ``stretch`` consecutive words of the item (all of it, if it is
    shorter) at least the share ``agree`` equals the document's words at the same places. The row
    tells the item's best alignment in the document: most matched words, then the earliest. Items
    of five to eight words count only where they stand whole and unchanged; shorter ones and null and empty
    texts are no evidence and never match. Repeated items or documents give equal results; a null id is an id like any other.
    """
    judged = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, stretch, agree)
    best = judged.where("ok").groupBy("id", "item").agg(F.max_by(F.struct("n", "matched", "shift"), F.struct("matched", -F.col("shift"))).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.n").cast("bigint").alias("n_overlap"),
        F.col("b.matched").cast("bigint").alias("n_matched"), F.col("b.shift").cast("bigint").alias("doc_word"),
    )


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, stretch: int, agree: float) -> DataFrame:
    """(id, key, item, shift, n, matched, ok): every alignment that a seed names; ``key`` is that of the document's text."""
    bench = benchmark.select(benchmark[item_col].alias("item"), words(benchmark[item_text_col]).alias("item_words"))
    bench = bench.where(F.size("item_words") >= LEAST).distinct()
    seed = bench.select("item", _hashes("item_words").alias("hashes")).select("item", F.explode(_seeds(F.col("hashes"))).alias("s")).select("item", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(f"s.h{m}").alias("h"), F.col("s.at").alias("item_at")) for m in range(len(MASKS))])).alias("e")).select("item", "e.*")
    seed = durable(seed)
    brief = durable(_short_seeds(bench))
    lengths = sorted(r["mask"] - 100 for r in brief.select("mask").distinct().collect())  # at most 5 numbers
    small = seed.count() + brief.count() <= MAX_BROADCAST_SEEDS
    hint = F.broadcast if small else (lambda df: df)

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), content_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    found = rows.select("id", "key", _once(_hashes(words(F.col("text")))).alias("hashes"))
    found = found.select("id", "key", F.explode(_seeds(F.col("hashes"))).alias("s")).select("id", "key", "s.*")
    if small:
        # one probe for each mask, all within one pass; few rows are left for the join that tells the items
        for m in range(len(MASKS)):
            known = seed.where(F.col("mask") == m).select(F.col("h").alias(f"k{m}")).distinct()
            found = found.join(hint(known), F.col(f"h{m}") == F.col(f"k{m}"), "left")
        found = found.where(F.coalesce(*[F.col(f"k{m}") for m in range(len(MASKS))]).isNotNull())
    hit = found.select("id", "key", "at", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(f"h{m}").alias("h")) for m in range(len(MASKS))])).alias("e")).select("id", "key", "at", "e.*")
    hit = hit.join(hint(seed), ["mask", "h"]).select("id", "key", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    if lengths:
        held = rows.select("id", "key", _once(_hashes(words(F.col("text")))).alias("hashes"))
        runs = held.select("id", "key", F.explode(F.flatten(F.array(*[_runs(F.col("hashes"), n) for n in lengths]))).alias("s")).select("id", "key", "s.*")
        hit = hit.unionByName(runs.join(hint(brief), ["mask", "h"]).select("id", "key", "item", (F.col("at") - F.col("item_at")).alias("shift")))
    hit = hit.distinct()

    # hits are few for each document; its words are compared where they are
    sides = rows.join(hit.withColumnsRenamed({"id": "hit_id", "key": "hit_key"}), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")))
    near = sides.join(hint(bench) if small else bench, "item").select(
        "id", "key", "item", "shift", "item_words",
        _once(F.slice(words(F.col("text")), F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item_words"))).alias("own"),
    )
    skipped = F.greatest(-F.col("shift"), F.lit(0))  # words of the item before the document's start
    same = F.transform("item_words", lambda w, i: F.when((i >= skipped) & (F.get("own", i - skipped) == w), 1).otherwise(0))
    near = near.select("id", "key", "item", "shift", F.size("item_words").alias("n"), _once(same).alias("same"))
    width = F.least(F.lit(stretch), F.col("n"))
    sums = F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x))
    return near.select("id", "key", "item", "shift", "n", F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("matched"), ((F.array_max(sums) >= F.ceil(width * agree)) & ((F.col("n") >= SPAN) | (F.array_min("same") == 1))).alias("ok"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stretch: int = 20, agree: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows that share an id, null too, are told apart by their texts."""
    judged = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, stretch, agree)
    bad = judged.where("ok").select("id", "key").distinct()
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(bad["id"]) & (content_key(docs[text_col]) == bad["key"]), "left_anti")
