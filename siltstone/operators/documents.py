"""Document structure: plain text, Markdown and HTML as nodes with hashed identities, and what is read off them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.batches import parts

NODES = "id bigint, ord bigint, node_type string, node_hash string, parent_hash string, level bigint, text string"
HEADING_BYTES = 80


def node_hash(kind: str, text: str, parent: str) -> str:
    return hashlib.sha1(f"{kind}|{text}|{parent}".encode()).hexdigest().upper()


class _Graph:
    """Nodes in document order; equal ones (same type, text and parent) are one."""

    def __init__(self, title: str):
        self.nodes: dict[str, tuple] = {}
        self.root = self.put("root", title, "", 0)

    def put(self, kind: str, text: str, parent: str, level: int) -> str:
        h = node_hash(kind, text, parent)
        self.nodes.setdefault(h, (kind, h, parent, level, text))
        return h


_HEAD = re.compile(r"^(#{1,6})(?!#)\s*(.*)")
_BULLET = re.compile(r"^(?:[-*+] |\d[.)])\s*(.*)")
_LINK = re.compile(r"\]\(([^)]+)\)")


def markdown(text: str, name: str = "") -> list[tuple]:
    """Nodes of a Markdown text: root, section, paragraph, list, list_item, reference. Fenced lines are left out."""
    lines = text.split("\n")
    title = next((m[2].strip() for line in lines if (m := _HEAD.match(line)) and len(m[1]) == 1), name)
    g = _Graph(title)
    stack, para, run, fenced = [(0, g.root)], [], "", False

    def flush() -> None:
        if para:
            g.put("paragraph", " ".join(para), stack[-1][1], stack[-1][0] + 1)
            para.clear()

    for line in lines:
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        head, item = _HEAD.match(line), _BULLET.match(bare) if len(bare) > 2 or bare[:1] in "-*+" else None
        if head:
            flush()
            run = ""
            level = len(head[1])
            while stack[-1][0] >= level:
                stack.pop()
            stack.append((level, g.put("section", head[2].strip(), stack[-1][1], level)))
        elif not bare:
            flush()
            run = ""
        elif item:
            flush()
            run = run or g.put("list", "", stack[-1][1], stack[-1][0] + 1)
            g.put("list_item", item[1], run, stack[-1][0] + 2)
            if link := _LINK.search(item[1]):
                g.put("reference", link[1], stack[-1][1], stack[-1][0] + 1)
        else:
            run = ""
            para.append(line)
    flush()
    return list(g.nodes.values())


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.open: list[list] = []
        self.titles: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        if tag in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "title"):
            if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
                self.handle_endtag(tag)
            self.open.append([tag, []])
        elif tag == "a" and not any(x[0] in ("p", "li") or x[0][0] == "h" for x in self.open):
            if href := dict(attrs).get("href"):
                self.out.append(("reference", 1, href))
        elif tag in ("ul", "ol"):
            self.out.append(("list", 1, ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag in ("ul", "ol") and self.open and self.open[-1][0] == "li":
            tag = "li"
        if not any(x[0] == tag for x in self.open):
            return
        while self.open:
            kind, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if kind == "title" or kind == "h1":
                self.titles.append(text)
            if text and kind != "title":
                node = "section" if kind[0] == "h" and kind[1:].isdigit() else {"p": "paragraph", "li": "list_item"}.get(kind, "table_cell")
                self.out.append((node, int(kind[1]) if node == "section" else 1, text))
            if kind == tag:
                return

    def handle_data(self, data):
        if not self.silent:
            for x in self.open[-1:]:
                x[1].append(data)


def html(text: str, first_title: bool = True) -> list[tuple]:
    """Nodes of an HTML page, read leniently: sections (headings, all below the document), paragraphs, lists, items, cells and
    links outside of those. The title is the first title or h1, or the last one."""
    walk = _Walk()
    walk.feed(text)
    walk.close()
    for kind, _ in list(walk.open):
        walk.handle_endtag(kind)
    titles = [t for t in walk.titles if t]
    g = _Graph((titles[0] if first_title else titles[-1]) if titles else "")
    for kind, level, t in walk.out:
        g.put(kind, t, g.root, level)
    return list(g.nodes.values())


def nodes(docs: DataFrame, id_col: str, text_col: str, kind: str = "markdown") -> DataFrame:
    """A row for each node, in document order, of ``markdown`` or ``html`` texts. Null text has none; an empty one only the document. Rows stay in their partition."""
    read = {"markdown": markdown, "html": html}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    rows += [(key, i, kind, h, parent, level, t) for i, (kind, h, parent, level, t) in enumerate(read(text.as_py()))]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "ord", "node_type", "node_hash", "parent_hash", "level", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, NODES).withColumnRenamed("id", id_col)


def is_heading(part: Column) -> Column:
    """A plain-text heading: one short line that starts with an ASCII capital and ends with neither stop nor comma."""
    return ~part.contains("\n") & (F.octet_length(part) <= HEADING_BYTES) & ~part.rlike(r"[.,]\z") & part.rlike("^[A-Z]")


def plain_nodes(docs: DataFrame, id_col: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """(id, ord, node_type, node_hash, section, text): parts of plain text as sections and paragraphs, each with the heading it stands under."""
    # a bare F.trim would be given each part's index as the characters to trim
    rows = docs.select(F.col(id_col), F.posexplode(F.transform(F.split(text_col, separator), lambda x: F.trim(x))).alias("ord", "text"))
    rows = rows.where("text <> ''").withColumn("head", is_heading(F.col("text")))
    from pyspark.sql import Window

    so_far = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(so_far), F.lit("")))
    kind = F.when(F.col("head"), "section").otherwise("paragraph")
    parent = F.when(F.col("head"), F.lit("")).otherwise(F.col("section"))
    return rows.select(id_col, F.col("ord").cast("bigint").alias("ord"), kind.alias("node_type"), F.upper(F.sha1(F.concat_ws("|", kind, "text", parent))).alias("node_hash"), parent.alias("section"), "text")


def capital_words(text: Column, most: int = 20) -> Column:
    """Distinct words of over two bytes that start with an ASCII capital, in document order."""
    return F.slice(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: (F.octet_length(w) > 2) & w.rlike("^[A-Z]"))), 1, most)


def topics(headings: Column) -> Column:
    return F.array_distinct(headings)


def synthesis_class(line: Column) -> Column:
    """question, risk, decision, assumption or constraint, the first that fits; null for other lines."""
    low = F.lower(line)
    return (
        F.when(F.rtrim(line).endswith("?"), "question").when(low.contains("risk"), "risk").when(low.contains("decision"), "decision")
        .when(low.contains("assum"), "assumption").when(low.contains("constraint"), "constraint")
    )


def reference_class(target: Column) -> Column:
    """api_endpoint, url, related_file, or url for the rest."""
    web = target.startswith("http")
    api = target.contains("/api/") | target.contains("/v1/") | target.contains("/v2/")
    return F.when(web & api, "api_endpoint").when(web, "url").when(target.contains(".") & ~target.contains(" "), "related_file").otherwise("url")


def doc_fields(nodes: DataFrame, id_col: str) -> DataFrame:
    """A row for each document with its fields as arrays, in document order; duplicates of a value are dropped."""

    def pick(condition: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("ord", "text"))))
        return F.array_distinct(F.transform(rows, lambda r: r["text"]))

    kind, text = F.col("node_type"), F.col("text")
    section = kind.isin("section", "heading")
    return nodes.groupBy(id_col).agg(
        F.first(F.when(kind == "root", text), ignorenulls=True).alias("title"),
        pick(section).alias("sections"),
        pick(section & (F.col("level") <= 2)).alias("key_requirements"),
        pick((kind == "reference") & (reference_class(text) == "url")).alias("urls"),
        pick((kind == "reference") & (reference_class(text) == "related_file")).alias("related_files"),
        pick((kind == "reference") & (reference_class(text) == "api_endpoint")).alias("api_endpoints"),
        *[pick(section & (synthesis_class(text) == c)).alias(f"{c}s") for c in ("question", "risk", "decision", "assumption", "constraint")],
    )
