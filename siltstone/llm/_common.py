"""Helpers shared by the operators: reading tables, durable cuts of lineage, row keys, word splits."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract: space and \t \n \v \f \r. ``bytes.split()``
#: splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``.

    Only where driver and tasks are one process (tests, notebooks) and none is named, a temporary folder is made;
    on a cluster without one RuntimeError is raised, since executors don't share the driver's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it from there from then on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``durable``, as Parquet: smaller for large tables, and columns can be read one by one.

    The files stay in the shared folder, which is scratch space, since results that are still to be
    computed read them.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict = {}


def held(key, make=dict):
    """What a Python worker keeps from task to task. Workers outlive stages, so a worker lets go of one operator's
    tables when another operator starts in it."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches, rows: int = 256):
    """Arrow batches in parts of a few rows, so that what is made of a batch at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def content_key(text: Column) -> Column:
    """64 bits of the text. With the id it names a row; repeated equal rows share a key on purpose."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """(id, key, row): what names a row: its id, 64 bits of its text and 64 of all its columns."""
    cells = [c for name in docs.columns for c in (docs[f"`{name}`"], docs[f"`{name}`"].isNull())]  # nulls alone leave no trace in a hash
    return [docs[id_col].cast("bigint").alias("id"), content_key(docs[text_col]).alias("key"), F.xxhash64(*cells).alias("row")]


def keep_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``named`` (id, key, row) names, each once.

    ``row`` covers the id and ``key`` the text once more, so the two of them name a row; one exchange serves the join and the
    choice among equal rows.
    """
    key, row = fresh(docs, "key"), fresh(docs, "row")
    _, own_key, own_row = row_key(docs, id_col, text_col)
    rows = docs.select("*", own_key.alias(key), own_row.alias(row))
    rows = rows.join(named.select(F.col("key").alias(key), F.col("row").alias(row)), [key, row], "left_semi")
    return rows.dropDuplicates([key, row]).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, names: list[str]) -> tuple[list[Column], list[str]]:
    """Columns of ``docs`` under names that no operator gives a result, and those names."""
    aliases = [f"_col_{i}" for i in range(len(names))]
    return [docs[f"`{c}`"].alias(a) for c, a in zip(names, aliases, strict=True)], aliases


def parse_schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
