"""Cutting large texts into shards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.batches import parts

TEXT_BYTES, CSV_ROWS, CONFIG_BYTES = 8_000, 10_000, 51_200


def cut(text: str, kind: str, limit: int | None = None) -> list[str]:
    """Shards of a text whose concatenation is the text again.

    ``text`` by paragraphs, ``markdown`` and ``html`` by lines and before headings, ``config`` by lines;
    a shard ends after the piece that takes it beyond the limit in bytes.
    """
    if kind == "text":
        pieces = [p + "\n\n" for p in text.split("\n\n")]
        pieces[-1] = pieces[-1][:-2]
    else:
        pieces = text.splitlines(keepends=True)
    most = limit or (CONFIG_BYTES if kind == "config" else TEXT_BYTES)
    before = {"markdown": ("# ", "## "), "html": ("<h1", "<h2", "<article", "<section")}.get(kind, ())
    out: list[str] = []
    now: list[str] = []
    size = 0
    for p in pieces:
        head = p.lower() if kind == "html" else p
        opens = any(b in head for b in before) if kind == "html" else head.startswith(before) if before else False
        if now and (size > most or opens):
            out.append("".join(now))
            now, size = [], 0
        now.append(p)
        size += len(p.encode())
    if now and (text or not out):
        out.append("".join(now))
    return out if text else []


def shards(docs: DataFrame, id_col: str, text_col: str, kind: str, limit: int | None = None) -> DataFrame:
    """(id, shard, n_bytes, start_byte, text): a row for each shard. Null and empty texts have none. Rows stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = 0
                for i, s in enumerate(cut(text.as_py() or "", kind, limit)):
                    n = len(s.encode())
                    rows.append((key, i, n, at, s))
                    at += n
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["id", "shard", "n_bytes", "start_byte", "text"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, shard bigint, n_bytes bigint, start_byte bigint, text string").withColumnRenamed("id", id_col)


def csv_shard(row: Column, rows: int = CSV_ROWS) -> Column:
    """The shard of a data row counted from 0."""
    return F.floor(row / rows).cast("bigint")


def csv_shards(table: DataFrame, row_col: str, rows: int = CSV_ROWS) -> DataFrame:
    """(shard, row_start, row_end, n_rows) of a table whose rows are numbered from 0; one partial sum for each shard and task is moved."""
    s = table.groupBy(csv_shard(F.col(row_col), rows).alias("shard"))
    return s.agg(F.min(row_col).alias("row_start"), F.max(row_col).alias("row_end"), F.count(F.lit(1)).alias("n_rows"))
