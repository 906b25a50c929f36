"""File collections: scanning, limits, and the text of office formats."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone import registry as R
from siltstone.functions import paths as P
from siltstone.functions import shards as S
from siltstone.functions import text as T


def scan(spark: SparkSession, root: str, globs: list[str] | None = None) -> DataFrame:
    """(path, relative, name, length, modified, content): the files below ``root`` that no ignore pattern names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"/+$", "", root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rel = P.relative_path(path, base)
    out = files.select(path.alias("path"), rel.alias("relative"), P.name_of(path).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")
    return out.where(~P.ignored(F.col("relative"), globs))


def staging_info(files: DataFrame) -> DataFrame:
    """One row: files, bytes and newest modification."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.max("modified").alias("newest"))


def recent(files: DataFrame, now: Column, most_bytes: int = 5 * 1024**2, days: int = 14) -> DataFrame:
    """Files that are small and new enough to be worth reading again."""
    return files.where((F.col("length") <= most_bytes) & (F.col("modified") >= now - F.expr(f"interval {days} days")))


def bounds(files: DataFrame, path_col: str = "path", size_col: str = "length") -> DataFrame:
    """One row: whether files, bytes or depth pass the limits of a collection; plain sums, no ordering."""
    depth = F.size(F.split(path_col, "/"))
    sums = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(size_col), F.lit(0)).alias("n_bytes"), F.max(depth).alias("depth"))
    return sums.withColumn("problem", F.when(F.col("depth") > R.REPO_DEPTH, "depth").when(F.col("n_files") > R.REPO_FILES, "files").when(F.col("n_bytes") > R.REPO_BYTES, "bytes"))


def first_beyond(files: DataFrame, group: str, order: str, size_col: str, limit: int) -> DataFrame:
    """For each group the first row, in order, at which the running size passes the limit."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = files.select(group, order, F.sum(size_col).over(w).alias("so_far")).where(F.col("so_far") > limit)
    return over.groupBy(group).agg(F.min(F.struct(order, "so_far")).alias("x")).select(group, "x.*")


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, joined by blank lines; empty for what isn't one."""
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return ""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    found = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n\n".join(t for t in found if t.strip())


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"BT(.*?)ET", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
# What marks streams without text; how a file of an extension is cut (all others as plain text).
_NO_TEXT = (b"/Subtype /Image", b"/Type /Font", b"/Type /FontDescriptor", b"/Type /Metadata")
SHARDED = {
    "pdf": "pdf", "docx": "docx", "md": "markdown", "markdown": "markdown", "mdx": "markdown", "html": "html", "htm": "html", "csv": "table", "tsv": "table",
    "json": "config", "jsonl": "config", "ndjson": "config", "yaml": "config", "yml": "config", "toml": "config", "xml": "config",
}


def _unpacked(raw: bytes) -> bytes:
    for attempt in (lambda b: zlib.decompress(b), lambda b: zlib.decompress(b, -15)):
        try:
            return attempt(raw)
        except zlib.error:
            continue
    return raw


def _shown(body: bytes) -> list[str]:
    """Literal strings of a stream's text objects, of printable ASCII and over two characters."""
    out = []
    for block in _SHOWN.findall(body):
        for s in _LITERAL.findall(block):
            s = re.sub(rb"\\([()\\])", rb"\1", s)
            t = "".join(chr(c) for c in s if 32 <= c < 127)
            if len(t) > 2:
                out.append(t)
    return out


def pdf_text(data: bytes) -> str:
    """Literal strings of a PDF's text objects, of printable ASCII and over two characters, joined by spaces."""
    return " ".join(t for raw in _STREAM.findall(data) for t in _shown(_unpacked(raw)))


def pdf_pages(data: bytes) -> list[tuple[int, str]]:
    """(page, text) of the streams that show text, counted from 1 over all streams with text objects.

    Streams of images, fonts and metadata are passed over, and what has over seven bits of entropy a byte once unpacked.
    Pages without strings, or of mostly signs, are counted but left out.
    """
    out, page = [], 0
    for m in _STREAM.finditer(data):
        head = data[max(0, m.start() - 512) : m.start()].rpartition(b"endstream")[2]
        body = b"" if any(x in head for x in _NO_TEXT) else _unpacked(m[1])
        if not body or T.entropy(body) > 7 or not (b"BT" in body and b"ET" in body):
            continue
        page += 1
        text = " ".join(_shown(body)).strip()
        letters, signs = (sum(map(f, text)) for f in (str.isalpha, lambda c: not c.isalnum() and c != " "))
        if text and not (letters < 0.2 * len(text) and signs > 0.3 * len(text)):
            out.append((page, text))
    return out


def docx_parts(data: bytes) -> list[str] | None:
    """The markup of a DOCX file by lines, cut after the line of a section's end or the one that passes the limit in bytes; None for what isn't such a file."""
    try:
        markup = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, zlib.error):
        return None
    out, now, size = [], [], 0
    for line in re.split(r"\r\n|\r|\n", markup):
        now.append(f"{line}\n")
        size += len(now[-1].encode())
        if "w:sectPr" in line or size > S.TEXT_BYTES:
            out.append("".join(now))
            now, size = [], 0
    return [p for p in [*out, "".join(now)] if p.strip()]


def table_parts(text: str, rows: int = S.CSV_ROWS) -> list[tuple[int, int, str]]:
    """(row_start, row_end, text): a table of up to ``rows`` + 1 lines whole, from line 0; else ``rows`` lines each, the header before them. row_end is excluded."""
    lines = re.split(r"\r\n|\r|\n", text)
    if len(lines) <= rows + 1:
        return [(0, len(lines), text)]
    return [(a, min(a + rows, len(lines)), "\n".join([lines[0], *lines[a : a + rows]])) for a in range(1, len(lines), rows)]


def _parts(data: bytes, kind: str) -> list[tuple]:
    """(page, row_start, row_end, note, text) of a file's shards."""
    if kind == "pdf":
        return [(page, None, None, None, text) for page, text in pdf_pages(data)] or [(None, None, None, "fallback", data.decode("utf-8", "replace"))]
    if kind == "docx":
        found = docx_parts(data)
        return [(None, None, None, None, p) for p in found] if found is not None else [(None, None, None, "unreadable", "")]
    text = data.decode("utf-8", "replace")
    if kind == "table":
        return [(None, a, b, None, p) for a, b, p in table_parts(text)]
    return [(None, None, None, None, p) for p in S.cut(text, kind) or [text]]


def file_shards(files: DataFrame) -> DataFrame:
    """(relative, shard, content_type, page, row_start, row_end, note, text): the shards of each file of (relative, content), cut as its extension asks.

    Null contents count as empty. A PDF without readable pages is one shard of note "fallback", a file that isn't the DOCX it claims to be an empty
    one of note "unreadable". Rows stay in their partition; a task holds one file's shards at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = _parts(data.as_py() or b"", kind)
                columns = [[name] * len(found), list(range(len(found))), [kind] * len(found), *map(list, zip(*found, strict=True))] if found else [[]] * 8
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["relative", "shard", "kind", "page", "row_start", "row_end", "note", "text"])

    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for e, k in SHARDED.items() for x in (e, k)]), P.extension(F.col("relative"))), F.lit("text"))
    cut = files.select("relative", "content", kind.alias("kind")).mapInArrow(run, "relative string, shard bigint, kind string, page bigint, row_start bigint, row_end bigint, note string, text string")
    fixed = F.when(F.col("note") == "unreadable", "unknown").when((F.col("note") == "fallback") | F.col("kind").isin("markdown", "html"), "text").when(F.col("kind").isin("table", "config"), F.col("kind"))
    return cut.select("relative", "shard", F.coalesce(fixed, T.content_type(F.col("text"))).alias("content_type"), "page", "row_start", "row_end", "note", "text")


@F.pandas_udf(StringType())
def file_text(content: pd.Series, kind: pd.Series) -> pd.Series:
    """Text of file contents by format: DOCX and PDF are unpacked, all else is read as UTF-8 with replacements."""
    read = {"docx": docx_text, "pdf": pdf_text}
    return pd.Series([None if c is None else read[k](bytes(c)) if k in read else bytes(c).decode("utf-8", "replace") for c, k in zip(content, kind, strict=True)], dtype=object)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or, by its extension, tab-separated file with a header; all values stay strings."""
    return spark.read.csv(path, header=True, sep="\t" if path.lower().endswith(".tsv") else ",", inferSchema=False, multiLine=True, escape='"')
