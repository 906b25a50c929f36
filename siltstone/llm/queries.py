"""The thin queries ``opN_<name>`` over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, chroma, decontam, htmlmain, langid, licenses, simhash, suffix, superkmer, toxicity
from siltstone.llm._common import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs.where(~out))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), rank_path())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no audio; each row of ``embeddings`` is played as a recording of 16 seconds. Queries: ids divisible by 50."""
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.melody)
    return chroma.align(prints, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.remove_repeats(table(spark, sf_dir, "documents"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    known = docs.select("doc_id", "text").join(labels.where(~langid.held_out(F.col("doc_id"), 5, 0)), "doc_id")
    found = toxicity.score(docs, toxicity.train(docs, known))
    return found.select(
        "doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_byte_bpe, op4_html_text, op5_chroma, op6_superkmer_dedup, op7_spaced_seeds, op8_toxicity, op9_license_scan, op10_simhash)}


#: Every alignment of a document and an item with enough equal words, found by joining the words themselves.
_OP7_SQL = """
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place
           FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place
      FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 5),
m AS (SELECT doc_id, item_id, n, d.place - i.place AS shift, count(*) AS matched, list(i.place) AS hit
      FROM d JOIN i USING (word) GROUP BY ALL HAVING count(*) >= ceil(least(20, n) * 0.8)),
ok AS (SELECT * FROM m WHERE (n >= 9 OR matched = n) AND
       list_max(list_transform(range(0, n - least(20, n) + 1), lambda s: len(list_filter(hit, lambda p: p >= s AND p < s + least(20, n))))) >= ceil(least(20, n) * 0.8))
SELECT doc_id, item_id, n AS n_overlap, matched AS n_matched, shift AS doc_word FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_spaced_seeds": _OP7_SQL}
