"""From files to snapshots: one lazy plan that routes, reads, parses, maps, redacts and fingerprints; then one merge."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone import registry as R
from siltstone.functions import fingerprint, redact
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.operators import code, config, documents, findings
from siltstone.plans import store as S
from siltstone.sources.files import file_text

_CODE_START = {
    "code.file": ("language", "loc", "package"), "code.imports": ("modules", "from_files", "external", "internal"),
    "code.exports": ("functions", "classes", "constants", "types"), "code.functions": ("names", "signatures", "async", "decorators"),
    "code.classes": ("names", "inheritance", "methods", "properties", "interfaces", "method_signatures", "docstring"), "code.connections": ("depends_on",),
}


def plain(text: str, name: str) -> list[tuple]:
    """Nodes of plain text: parts between blank lines, headings as sections."""
    out, section = [("root", "", "", 0, name)], ""
    for part in (p.strip() for p in text.split("\n\n")):
        if part:
            head = "\n" not in part and len(part.encode()) <= documents.HEADING_BYTES and part[-1] not in ".," and "A" <= part[0] <= "Z"
            kind = "section" if head else "paragraph"
            out.append((kind, documents.node_hash(kind, part, "" if head else section), section, 1, part))
            section = part if head else section
    return out


def _doc(text: str, name: str, kind: str) -> dict:
    read = {"markdown": lambda t: documents.markdown(t, name), "html": documents.html}
    nodes = read.get(kind, lambda t: plain(t, name))(text)
    out: dict[str, list | str] = {"doc.title": next((n[4] for n in nodes if n[0] == "root"), "") or name}

    def add(field: str, value: str) -> None:
        out.setdefault(field, [])
        if value not in out[field]:
            out[field].append(value)

    for node, _, _, level, t in nodes:
        if node == "section":
            add("doc.sections", t)
            if level <= 2:
                add("doc.key_requirements", t)
            low = t.lower()
            for word, field in (("?", "questions"), ("risk", "risks"), ("decision", "decisions"), ("assum", "assumptions"), ("constraint", "constraints")):
                if low.rstrip().endswith("?") if word == "?" else word in low:
                    add(f"doc.{field}", t)
                    break
        elif node == "reference":
            web = t.startswith("http")
            add("doc.references", t)
            field = "api_endpoints" if web and any(x in t for x in ("/api/", "/v1/", "/v2/")) else "urls" if web or "." not in t or " " in t else "related_files"
            add(f"doc.{field}", t)
        elif node in ("paragraph", "list_item"):
            for w in t.split():
                if len(w.encode()) > 2 and "A" <= w[0] <= "Z" and len(out.get("doc.entities", ())) < 20:
                    add("doc.entities", w)
    return out


def _code(text: str, path: str) -> dict:
    found = code.fields_of(text, path.rsplit(".", 1)[-1])
    out = {f"{start}.{f}": found["classes"] if (start, f) == ("code.classes", "names") else found[f] for start, names in _CODE_START.items() for f in names}
    return out | {"code.file.path": path}


def _config(text: str, path: str, kind: str) -> dict:
    top, keys, nested, env = config._READ.get(kind, lambda _: ([], [], [], []))(text)
    return {"config.file.path": path, "config.file.format": kind, "config.structure.toplevel_keys": top, "config.settings.parameter_names": keys, "config.settings.env_vars": env, "config.structure.nested_paths": nested}


def _csv(text: str, path: str) -> dict:
    import csv
    import io
    import re

    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if path.endswith(".tsv") else ","))
    if not rows:
        return {}
    head, body = rows[0], rows[1:]
    columns = [[(r[i].strip() if i < len(r) else "") for r in body] for i in range(len(head))]

    def kind(values: list[str]) -> str:
        some = [v for v in values if v]
        number = "float" if all(re.match(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", v) for v in some) else "string"
        return "null" if not some else "integer" if all(re.match(r"^[+-]?\d+$", v) for v in some) else number

    return {
        "csv.schema.column_names": head, "csv.schema.column_types": [kind(c) for c in columns], "csv.schema.column_count": len(head), "csv.stats.row_count": len(body),
        "csv.stats.null_counts": {h: sum(not v for v in c) for h, c in zip(head, columns, strict=True)}, "csv.stats.unique_counts": {h: len(set(c)) for h, c in zip(head, columns, strict=True)},
        "csv.sample.first_rows": [",".join(r) for r in body[:5]],
    }


def parse_one(text: str, path: str, kind: str, fmt: str) -> dict:
    """Field ids to values of one file; empty values are left out."""
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = _code(text, path) if kind == "code" else _config(text, path, fmt) if kind == "config" else _csv(text, path) if kind == "csv" else _doc(text, name, fmt)
    return {k: v for k, v in out.items() if v not in ("", [], {}, None)}


@F.pandas_udf(StringType())
def parsed(text: pd.Series, path: pd.Series, kind: pd.Series, fmt: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(parse_one(t or "", p, k, f)) for t, p, k, f in zip(text, path, kind, fmt, strict=True)])


def _clean_value(value: Column, kind: Column) -> Column:
    """A field's value as JSON with secrets and injected instructions taken out of strings and list items; maps stay as they are."""
    text = F.to_json(F.array(redact.clean(value)))
    bare = F.substring(text, F.lit(2), F.length(text) - 2)
    items = F.from_json(value, "array<string>")
    return F.when(kind == "string", bare).when(kind == "list", F.to_json(redact.clean_items(items))).otherwise(value)


def fields(files: DataFrame) -> DataFrame:
    """(source_file, source_hash, snapshot_type, field_id, value): the registered fields of each file as JSON values.

    ``files`` has (relative, content). Files that nothing reads or that are too large are left out. Findings of the
    rule scan join in for code, URLs and database strings for configuration.
    """
    routed = files.withColumn("kind", P.field_type(F.col("relative"))).where(F.col("kind").isNotNull() & P.size_problem(F.col("relative"), F.length("content")).isNull())
    routed = routed.withColumn("fmt", P.file_format(F.col("relative"))).withColumn("text", file_text("content", "fmt"))
    routed = routed.where(T.size_tag(F.col("kind"), F.col("text")) != "rejected")
    read = routed.select("relative", "kind", "text", F.sha2("content", 256).alias("source_hash"), parsed("text", "relative", "kind", "fmt").alias("json"))
    entries = read.select(F.col("relative").alias("source_file"), "source_hash", F.explode(F.from_json("json", "map<string,string>")).alias("field_id", "raw"))
    config_rows = routed.where("kind = 'config'")
    u = config.urls(F.col("text"))
    extra = F.map_filter(
        F.create_map(F.lit("config.api.endpoints"), u, F.lit("config.api.hosts"), config.hosts(u), F.lit("config.database.connection_strings"), config.database_strings(F.col("text"))), lambda k, v: F.size(v) > 0
    )
    of_config = config_rows.select(F.col("relative").alias("source_file"), F.sha2("content", 256).alias("source_hash"), F.explode(extra).alias("field_id", "v"))
    found = findings.scan(routed.where("kind = 'code'"), "relative", "text")
    where = F.when(F.col("severity") == "INFO", "code.quality.").otherwise("code.security.")
    each = found.select(F.col("relative").alias("source_file"), F.concat(where, findings.category(F.col("severity"), F.col("rule_id"), F.col("message"))).alias("field_id"), F.concat_ws(" ", "rule_id", F.concat(F.lit("(line "), "line", F.lit(")"))).alias("said"), "line")
    of_code = each.groupBy("source_file", "field_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"])).alias("raw"))
    of_code = of_code.join(read.select(F.col("relative").alias("source_file"), "source_hash"), "source_file")
    every = entries.unionByName(of_config.select("source_file", "source_hash", "field_id", F.to_json("v").alias("raw"))).unionByName(of_code.select("source_file", "source_hash", "field_id", "raw"))
    registry = F.broadcast(R.field_registry(files.sparkSession).where("registered").select("snapshot_type", "field_id", "value_type"))
    mapped = every.join(registry, "field_id")
    secret = F.col("field_id") == "code.security.hardcoded_secrets"
    hidden = F.to_json(F.transform(F.from_json("raw", "array<string>"), redact.mask))
    value = F.when(secret, hidden).otherwise(_clean_value(F.col("raw"), F.col("value_type")))
    return mapped.select("source_file", "source_hash", "snapshot_type", "field_id", value.alias("value"))


def snapshots(files: DataFrame, project_id: str, run_id: str) -> DataFrame:
    """The snapshots of some files, ready to be merged into the store. Ids follow from the content, so that a repeated run makes the same rows."""
    rows = fields(files).groupBy("source_file", "source_hash", "snapshot_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "value")))).alias("field_values"))
    template = R.field_registry(files.sparkSession).groupBy("snapshot_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", F.lit("null"))))).alias("blank"))

    def as_json(m: Column) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}"))

    rows = rows.join(F.broadcast(template), "snapshot_type")
    full = F.map_concat("field_values", F.map_filter("blank", lambda k, _: ~F.map_contains_key("field_values", k)))
    text = fingerprint.canonical_json(as_json(full))
    hashed = rows.select("*", fingerprint.content_hash(F.col("snapshot_type"), F.col("source_file"), as_json(F.col("field_values"))).alias("content_hash"), text.alias("text"))
    return hashed.select(
        F.sha2(F.concat_ws("|", F.lit(project_id), "source_file", "snapshot_type", "content_hash"), 256).alias("snapshot_id"), F.lit(run_id).alias("run_id"), F.lit(project_id).alias("project_id"),
        "snapshot_type", "source_file", "field_values", "source_hash", "content_hash", fingerprint.simhash_signed("text").alias("simhash"),
        fingerprint.minhash(F.col("text")).alias("minhash"), F.current_timestamp().alias("created_at"),
    )


def ingest(spark: SparkSession, store: S.Store, files: DataFrame, project_id: str, ingest_source: str = "local", source_ref: str = "", run_id: str | None = None, keep_others: bool = False) -> str:
    """Runs a whole ingestion and returns the run's id. If it fails, the run is marked failed and none of its rows are seen.

    The run takes the place of the source's active one. With ``keep_others`` the snapshots of files that ``files`` doesn't have move on to it, so
    that ``files`` may be a part of the source. Should the run be lost between the merge and its promotion, running it again under the same id completes it.
    """
    run_id = run_id or uuid.uuid4().hex
    now = F.current_timestamp()
    of_source = (F.col("project_id") == project_id) & (F.col("ingest_source") == ingest_source)
    before = S.active_pointers(store.read("runs")).where(of_source).first()
    opened = spark.createDataFrame([(run_id, project_id, ingest_source, source_ref, "running")], "run_id string, project_id string, ingest_source string, source_ref string, status string")
    none = {"created_at": now, "completed_at": F.lit(None).cast("timestamp"), "snapshot_count": F.lit(0).cast("bigint"), "file_count": F.lit(0).cast("bigint")}
    # a run of this id that was begun before is begun anew; it never has two rows
    store.update("runs", lambda runs: runs.where(F.col("run_id") != run_id).unionByName(opened.withColumns(none)))

    def merged(old: DataFrame) -> DataFrame:
        if keep_others and before is not None:
            old = S.moved_on(old, before["active_run_id"], run_id, files.select(F.col("relative").alias("source_file")))
        return S.upsert(old, snapshots(files, project_id, run_id))

    try:
        store.update("snapshots", merged)
        n = store.read("snapshots").where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_file").alias("f")).first()
        store.update("runs", lambda runs: S.promote(S.complete(runs, run_id, n["f"], n["n"], now), run_id))
    except Exception:
        store.update("runs", lambda runs: S.fail(runs, run_id, now))
        raise
    return run_id
