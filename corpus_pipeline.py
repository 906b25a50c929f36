"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontam, langid, nearcopies, superkmer
from siltstone.llm._common import checkpoint_dir, numbered, table
from siltstone.llm.queries import rank_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null, or without any letter. The others' missing ``lang`` becomes the predicted one.

    Where no document has a ``lang`` there is nothing to learn from, and it stays missing.
    """
    model = langid.train(docs)
    if model is None:
        return docs.where(langid.has_letter(docs["text"]))
    columns, names = numbered(docs, docs.columns)
    found = langid.identify(docs.select(docs["doc_id"], docs["text"], *columns), model, keep=names).where(F.col("lang_pred") != langid.UNDETERMINED)
    own = dict(zip(docs.columns, names, strict=True))
    return found.select(*[F.coalesce(own[c], "lang_pred").alias(c) if c == "lang" else F.col(own[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a document of each group of near copies (SimHash of five-word shingles, verified similarity 0.8): the smallest id, rows without one last."""
    return nearcopies.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words of repeated passages out of the texts; ``n_chars`` follows. No document goes, even if all of its words do."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    columns, names = numbered(docs, others)
    kept = superkmer.remove_repeats(docs.select(docs["doc_id"], docs["text"], *columns), with_text=True, keep=names)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    own |= {c: F.col(name) for c, name in zip(others, names, strict=True)}
    return kept.select(*[own[c].alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a stretch of one."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them again."""
    return bpe.encode_documents(docs, rank_path(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("decontaminated", decontaminated), ("tokens", tokens)]

#: The stages train models, link fingerprints and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``; the tables in between are in the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
