"""Notebooks, statistics and metrics over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_file(snapshots: DataFrame) -> DataFrame:
    """(source_file, n_types, types): a file's snapshot types in order. A file has one row for each type at most, so arrays are short."""
    return snapshots.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_types"), F.array_sort(F.collect_set("snapshot_type")).alias("types"))


def by_type(snapshots: DataFrame) -> DataFrame:
    """(snapshot_type, source_file, n_of_type): the files of each type as rows, since a type may have any number."""
    sizes = snapshots.groupBy("snapshot_type").agg(F.count(F.lit(1)).alias("n_of_type"))
    return snapshots.select("snapshot_type", "source_file").join(sizes, "snapshot_type")


def file_notebook(snapshots: DataFrame, file: str) -> DataFrame:
    """One row: snapshot type -> values of a file, the last of each type."""
    last = snapshots.where(F.col("source_file") == file).groupBy("snapshot_type").agg(F.max_by("field_values", "created_at").alias("v"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("snapshot_type", "v"))).alias("snapshots"))


def summary(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count(F.lit(1)).alias("n_snapshots"), F.countDistinct("source_file").alias("n_files"), F.countDistinct("snapshot_type").alias("n_types"))


def stats(snapshots: DataFrame, type_col: str, file_col: str, size_col: str) -> DataFrame:
    """(kind, name, n, kb): by type, by file and over all, in one pass of grouping sets."""
    g = snapshots.groupingSets([[F.col(type_col)], [F.col(file_col)], []], F.col(type_col), F.col(file_col))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(size_col).alias("bytes"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "file").otherwise("total")
    name = F.when(F.col("g") == 1, F.col(type_col).cast("string")).when(F.col("g") == 2, F.col(file_col).cast("string")).otherwise("")
    return out.select(kind.alias("kind"), name.alias("name"), "n", F.round(F.col("bytes") / 1024, 6).alias("kb"))


def ingest_stats(files: DataFrame) -> DataFrame:
    """One row over (status, tag, size): attempted, processed, failed, bytes, and a count for each size tag."""
    tags = [F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("normal", "large", "potential_god", "rejected")]
    return files.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes"), *tags,
    )


def size_ratio(source_bytes, snapshot_bytes):
    """Snapshot bytes by source bytes, to three places; 0 without source."""
    return F.when(source_bytes > 0, F.round(snapshot_bytes / source_bytes, 3)).otherwise(0.0)


def search(snapshots: DataFrame, status: str = "active", snapshot_type: str | None = None, fragment: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The first rows after ``offset`` by file and type that match: ``status`` may be all; a fragment occurs anywhere in the file's name."""
    out = snapshots if status == "all" else snapshots.where(F.col("status") == status)
    out = out if snapshot_type is None else out.where(F.col("snapshot_type") == snapshot_type)
    out = out if fragment is None else out.where(F.col("source_file").contains(fragment))
    return out.orderBy("source_file", "snapshot_type").offset(offset).limit(limit)


def missing_required(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_file, snapshot_type, field_id): required fields that a snapshot lacks."""
    need = registry.where("required and registered").select("snapshot_type", "field_id")
    rows = snapshots.join(F.broadcast(need), "snapshot_type")
    return rows.where(F.col("field_values")[F.col("field_id")].isNull()).select("source_file", "snapshot_type", "field_id")


def timing(rows: DataFrame, stage: str, ms: str) -> DataFrame:
    return rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ms), 6).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


def slowest(rows: DataFrame, ms: str, tie: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(ms), tie).limit(n)
