"""Snapshot types, their fields, and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Field names of each snapshot type below the common start, and who fills them.
_TYPES = {
    ("file_metadata", "code.file", "tree_sitter"): "path language loc package",
    ("imports", "code.imports", "tree_sitter"): "modules from_files external internal",
    ("exports", "code.exports", "tree_sitter"): "functions classes constants types",
    ("functions_core", "code", "tree_sitter"): "functions.names content.bodies content.constants",
    ("functions", "code.functions", "tree_sitter"): "signatures async decorators",
    ("classes", "code.classes", "tree_sitter"): "names inheritance methods properties interfaces",
    ("classes_detail", "code.classes", "tree_sitter"): "decorators method_signatures docstring",
    ("connections", "code.connections", "tree_sitter"): "depends_on depended_by function_calls instantiates",
    ("security", "code.security", "semgrep"): "vulnerabilities hardcoded_secrets sql_injection_risks xss_risks",
    ("quality", "code.quality", "semgrep"): "antipatterns code_smells todos deprecated_usage",
    ("doc_metadata", "doc", "nim_parser"): "title author date version language",
    ("doc_content", "doc", "nim_parser"): "sections urls code_snippets",
    ("doc_analysis", "doc", "nim_parser"): "key_requirements entities references related_files api_endpoints",
    ("doc_synthesis", "doc", "nim_parser"): "questions risks decisions assumptions constraints",
    ("csv_schema", "csv", "nim_parser"): "schema.column_names schema.column_types schema.column_count stats.row_count stats.null_counts stats.unique_counts sample.first_rows",
    ("csv_data", "csv", "nim_parser"): "file.path file.rows table_data",
    ("config_metadata", "config", "nim_parser"): "file.path file.format structure.toplevel_keys settings.parameter_names settings.env_vars database.connection_strings",
    ("config_structure", "config", "nim_parser"): "structure.nested_paths structure.depth",
    ("config_api", "config.api", "nim_parser"): "endpoints hosts",
}
_STRINGS = frozenset("code.file.path code.file.language code.file.package doc.title doc.author doc.date doc.version doc.language config.file.path config.file.format".split())
_INTEGERS = frozenset("code.file.loc csv.schema.column_count csv.stats.row_count".split())
_MAPS = frozenset("code.content.bodies code.content.constants csv.stats.null_counts csv.stats.unique_counts".split())
#: Fields of templates that no parser may fill.
UNREGISTERED = frozenset("csv.file.path csv.file.rows csv.table_data config.structure.depth".split())
_REQUIRED_GROUPS = frozenset(("file_metadata", "connections", "quality", "doc_metadata"))
_REQUIRED = frozenset(
    "code.imports.modules code.imports.from_files code.classes.decorators code.classes.docstring config.file.path config.file.format "
    "config.structure.toplevel_keys config.settings.parameter_names doc.urls doc.sections doc.entities doc.references doc.related_files "
    "doc.questions doc.risks".split()
)


@dataclass(frozen=True)
class Field:
    snapshot_type: str
    field_id: str
    value_type: str
    multi: bool
    required: bool
    parser: str
    registered: bool


def fields() -> list[Field]:
    out = []
    for (kind, start, parser), names in _TYPES.items():
        for name in names.split():
            f = f"{start}.{name}"
            value = "string" if f in _STRINGS else "integer" if f in _INTEGERS else "dict" if f in _MAPS else "list"
            out.append(Field(kind, f, value, value == "list", kind in _REQUIRED_GROUPS or f in _REQUIRED, parser, f not in UNREGISTERED))
    return out


def snapshot_types() -> list[str]:
    return sorted({f.snapshot_type for f in fields()})


def field_registry(spark: SparkSession) -> DataFrame:
    """The fields as a table of about 80 rows; small enough to broadcast whatever the data."""
    schema = "snapshot_type string, field_id string, value_type string, multi boolean, required boolean, parser string, registered boolean"
    return spark.createDataFrame([tuple(vars(f).values()) for f in fields()], schema)


# Limits.
REPO_BYTES, REPO_FILES, REPO_DEPTH = 2 * 1024**3, 100_000, 12
PDF_BYTES, TEXT_BYTES, CODE_BYTES = 50 * 1024**2, 10 * 1024**2, 5 * 1024**2
LOC_SOFT, LOC_GOD, LOC_HARD = 1_500, 4_000, 5_000
BYTES_SOFT, BYTES_GOD, BYTES_HARD = 500_000, 5_000_000, 10_000_000
CSV_HARD_MB, CSV_HARD_ROWS, CSV_SOFT_MB, CSV_SOFT_ROWS, CSV_CELL = 50, 500_000, 5, 50_000, 5_000
FIELD_CHARS, TOTAL_CHARS, ENTROPY_CHARS, ENTROPY_HIGH = 50_000, 500_000, 500, 0.85
NOTEBOOK_MB, SNAPSHOTS_PER_FILE = 500, 15
