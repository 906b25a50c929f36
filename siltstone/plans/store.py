"""Snapshots and the ledger of runs: reads see active runs only; writes merge and then swap in a new version.

Runs go running -> draft -> active -> superseded, or failed. The functions are plans over tables given as
DataFrames; ``Store`` keeps the tables as Parquet, a directory for each version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOTS = (
    "snapshot_id string, run_id string, project_id string, snapshot_type string, source_file string, field_values map<string,string>, "
    "source_hash string, content_hash string, simhash bigint, minhash array<bigint>, created_at timestamp"
)
RUNS = "run_id string, project_id string, ingest_source string, source_ref string, status string, created_at timestamp, completed_at timestamp, snapshot_count bigint, file_count bigint"
STATUSES = ("running", "draft", "active", "superseded", "failed")
KEY = ["project_id", "source_file", "snapshot_type", "content_hash"]


def newest(runs: DataFrame, by: list[str], status: str | None = "active") -> DataFrame:
    """The latest run of each group, ties by the larger id. A partial maximum for each group and task is all that moves."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    rest = [c for c in runs.columns if c not in ("created_at", "run_id")]
    best = rows.groupBy(*by).agg(F.max(F.struct("created_at", "run_id", *[c for c in rest if c not in by])).alias("x"))
    return best.select(*by, "x.*")


def active_pointers(runs: DataFrame) -> DataFrame:
    return newest(runs, ["project_id", "ingest_source"]).select("project_id", "ingest_source", F.col("run_id").alias("active_run_id"), F.col("created_at").alias("updated_at"))


def list_projects(runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Each active source of each project with its run's counts."""
    own = runs.select("run_id", "status", "source_ref", "completed_at", "snapshot_count", "file_count")
    return pointers.join(own, pointers["active_run_id"] == own["run_id"]).drop("run_id")


def project_totals(runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Every project that ever ran with the sums over its active runs, zero where there are none."""
    sums = list_projects(runs, pointers).groupBy("project_id").agg(F.sum("snapshot_count").alias("snapshots"), F.sum("file_count").alias("files"), F.count(F.lit(1)).alias("sources"))
    return runs.select("project_id").distinct().join(sums, "project_id", "left").na.fill(0, ["snapshots", "files", "sources"])


def visible(snapshots: DataFrame, pointers: DataFrame) -> DataFrame:
    """Snapshots of active runs."""
    return snapshots.join(pointers.select(F.col("active_run_id").alias("run_id")), "run_id", "left_semi")


def history(runs: DataFrame) -> DataFrame:
    """Runs with their place from the newest (1) within project and source."""
    w = Window.partitionBy("project_id", "ingest_source").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(w))


def purgeable(runs: DataFrame, keep: int = 2) -> DataFrame:
    """Superseded and failed runs beyond the ``keep`` newest of each project."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    old = runs.where(F.col("status").isin("superseded", "failed")).withColumn("place", F.row_number().over(w))
    return old.where(F.col("place") > keep).drop("place")


def stale(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    return runs.where((F.col("status") == "running") & (F.col("created_at") < now - F.expr(f"interval {hours} hours")))


def health(runs: DataFrame) -> DataFrame:
    """(project_id, status, n_runs, n_issues): an issue is a failed or draft run, or an active one without files or snapshots."""
    empty = (F.col("status") == "active") & ((F.coalesce("file_count", F.lit(0)) == 0).cast("int") + (F.coalesce("snapshot_count", F.lit(0)) == 0).cast("int") > 0)
    issues = F.when(F.col("status").isin("failed", "draft"), 1).when(empty, (F.coalesce("file_count", F.lit(0)) == 0).cast("int") + (F.coalesce("snapshot_count", F.lit(0)) == 0).cast("int")).otherwise(0)
    return runs.groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(issues).cast("bigint").alias("n_issues"))


def issues(runs: DataFrame) -> DataFrame:
    """A row for each thing that is wrong with a run."""
    no = lambda c: (F.col("status") == "active") & (F.coalesce(c, F.lit(0)) == 0)
    each = F.array_compact(F.array(F.when(F.col("status") == "failed", "failed"), F.when(F.col("status") == "draft", "not promoted"), F.when(no("file_count"), "no files"), F.when(no("snapshot_count"), "no snapshots")))
    return runs.select("project_id", "run_id", F.explode(each).alias("issue"))


def complete(runs: DataFrame, run_id: str, n_files: int, n_snapshots: int, at: Column) -> DataFrame:
    return _change(runs, run_id, {"status": F.lit("draft"), "file_count": F.lit(n_files), "snapshot_count": F.lit(n_snapshots), "completed_at": at})


def fail(runs: DataFrame, run_id: str, at: Column) -> DataFrame:
    return _change(runs, run_id, {"status": F.lit("failed"), "completed_at": at})


def _change(runs: DataFrame, run_id: str, values: dict[str, Column]) -> DataFrame:
    own = F.col("run_id") == run_id
    return runs.select(*[F.when(own, values[c]).otherwise(F.col(c)).cast(runs.schema[c].dataType).alias(c) if c in values else F.col(c) for c in runs.columns])


def promote(runs: DataFrame, run_id: str) -> DataFrame:
    """Makes a run active; the run that was active for its project and source is superseded."""
    mine = F.broadcast(runs.where(F.col("run_id") == run_id).select(F.col("project_id").alias("_p"), F.col("ingest_source").alias("_s")))
    joined = runs.join(mine, (F.col("project_id") == F.col("_p")) & (F.col("ingest_source") == F.col("_s")), "left")
    status = F.when(F.col("run_id") == run_id, "active").when(F.col("_p").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return joined.select(*[status.alias(c) if c == "status" else F.col(c) for c in runs.columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``old`` and the rows of ``new`` whose key is new; known rows move to the run that saw them last. Null keys equal each other."""
    key = key or KEY
    fresh = new.groupBy(*key).agg(F.max(F.struct(*[c for c in new.columns if c not in key])).alias("x")).select(*key, "x.*") if not _has_map(new) else new.dropDuplicates(key)
    seen = fresh.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("run_id").alias("_run"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    kept = old.join(seen, same, "left").select(*[F.coalesce("_run", "run_id").alias(c) if c == "run_id" else F.col(c) for c in old.columns])
    had = old.select(*[F.col(k).alias(f"_{k}") for k in key])
    return kept.unionByName(fresh.join(had, same, "left_anti").select(*old.columns))


def moved_on(snapshots: DataFrame, before: str, run_id: str, files: DataFrame) -> DataFrame:
    """``snapshots`` with those of the run ``before`` under ``run_id``, but for the ones of ``files`` (source_file)."""
    here = files.select(F.col("source_file").alias("_file")).distinct()
    run = F.when((F.col("run_id") == before) & F.col("_file").isNull(), F.lit(run_id)).otherwise(F.col("run_id"))
    joined = snapshots.join(here, F.col("source_file") == F.col("_file"), "left")
    return joined.select(*[run.alias(c) if c == "run_id" else F.col(c) for c in snapshots.columns])


def _has_map(df: DataFrame) -> bool:
    return any(t.startswith("map") for _, t in df.dtypes)


def replace_payload(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with the given columns taken from the row of ``new`` with the same key, where there is one."""
    fresh = new.select(F.col(key).alias("_k"), F.lit(True).alias("_in"), *[F.col(c).alias(f"_new_{c}") for c in columns]).dropDuplicates(["_k"])
    both = old.join(fresh, old[key] == fresh["_k"], "left")
    return both.select(*[F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def last_wins(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of all layers, of equal keys the one of the latest layer. Null keys equal each other."""
    every = None
    for i, layer in enumerate(layers):
        one = layer.withColumn("_layer", F.lit(i))
        every = one if every is None else every.unionByName(one)
    rest = [c for c in every.columns if c not in (*key, "_layer")]
    best = every.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("_layer")).alias("x"))
    return best.select(*key, "x.*").select(*layers[0].columns)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    had = old.select(F.col(key).alias("_k"))
    return old.unionByName(new.join(had, new[key] == had["_k"], "left_anti").select(*old.columns))


def delete_where(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def diff(before: DataFrame, after: DataFrame, key: list[str], hash_col: str = "content_hash") -> DataFrame:
    """(key, status): new, deleted, changed or unchanged, between two runs."""
    a = before.select(*key, F.col(hash_col).alias("_a"), F.lit(1).alias("_in_a"))
    b = after.select(*key, F.col(hash_col).alias("_b"), F.lit(1).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def validate(differences: DataFrame) -> DataFrame:
    """One row: how many snapshots are new, deleted, changed and unchanged, and whether that is plausible (not everything gone)."""
    one = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    sums = differences.agg(*[one(s) for s in ("new", "deleted", "changed", "unchanged")])
    return sums.withColumn("ok", (F.col("n_deleted") == 0) | (F.col("n_new") + F.col("n_changed") + F.col("n_unchanged") > 0))


def version_events(known: DataFrame, files: DataFrame, file_col: str, hash_col: str) -> DataFrame:
    """(file, event): V001 new, V002 same, V003 changed, against the hashes of the active run."""
    k = known.select(F.col(file_col), F.col(hash_col).alias("_known"), F.lit(1).alias("_in"))
    event = F.when(F.col("_in").isNull(), "V001").when(F.col("_known").eqNullSafe(F.col(hash_col)), "V002").otherwise("V003")
    return files.join(k, file_col, "left").select(file_col, event.alias("event"))


def versions(files: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Numbers the versions of each file, with the one before and whether it is current."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = files.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(order[-1]).over(w))
    return out.withColumn("is_current", F.lead(order[-1]).over(w).isNull())


def transfer(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of another store that this one lacks: runs and snapshots by id; pointers by project and source, the other's winning."""
    pointers = delete_where(target["pointers"], source["pointers"], ["project_id", "ingest_source"]).unionByName(source["pointers"])
    return {"runs": insert_if_absent(target["runs"], source["runs"], "run_id"), "snapshots": insert_if_absent(target["snapshots"], source["snapshots"], "snapshot_id"), "pointers": pointers}


class Changed(RuntimeError):
    """Another writer made a version of the table first."""


class Store:
    """Tables under a folder that Spark can write.

    The rows of a version are in a folder of their own. The version exists once a file ``<number>.version`` that names the folder has been renamed
    into place, which only one of several writers can do; a writer that is lost before leaves nothing but a folder that no version names.
    (On a local disk the rename looks first and then moves, so that writers there should be one process.)
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, table: str, name: str = ""):
        """A path of the table and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}/{name}".rstrip("/"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.makeQualified(path), fs

    def _versions(self, table: str) -> list[int]:
        path, fs = self._path(table)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".version")) for n in names if n.endswith(".version"))

    def _folder(self, table: str, number: int) -> str:
        path, fs = self._path(table, f"{number}.version")
        file = fs.open(path)
        try:
            return file.readUTF()
        finally:
            file.close()

    def version(self, table: str) -> int:
        """The newest version, 0 before the first."""
        return max(self._versions(table), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        schema = {"snapshots": SNAPSHOTS, "runs": RUNS}[table]
        at = self.version(table) if version is None else version
        if not at:
            return self.spark.createDataFrame([], schema)
        columns = [x.split()[0] for x in schema.split(", ")]
        return self.spark.read.schema(schema).parquet(f"{self.base}/{table}/{self._folder(table, at)}").select(*columns)

    def write(self, table: str, rows: DataFrame, after: int | None = None) -> None:
        """Writes the version that follows ``after``, the newest by default; readers go on with the one they have.

        Raises ``Changed`` if that version exists by then. Older ones than the last two are left to ``vacuum``.
        """
        number = (self.version(table) if after is None else after) + 1
        folder = f"rows-{uuid.uuid4().hex}"
        by = ["project_id", "snapshot_type"] if table == "snapshots" else []
        rows.write.partitionBy(*by).parquet(f"{self.base}/{table}/{folder}")
        draft, fs = self._path(table, f"{folder}.draft")
        out = fs.create(draft, True)
        out.writeUTF(folder)
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._path(table, f"{number}.version")[0], plainly)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(draft, False)
            fs.delete(self._path(table, folder)[0], True)
            raise Changed(f"{table} has a version {number} already") from None

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> None:
        """Writes what ``change`` makes of the table's rows; where another writer came first, what it makes of the rows since."""
        for left in reversed(range(tries)):
            at = self.version(table)
            try:
                return self.write(table, change(self.read(table, at)), after=at)
            except Changed:
                if not left:
                    raise

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Removes all versions but the newest ``keep``."""
        for n in self._versions(table)[:-keep]:
            folder, fs = self._path(table, self._folder(table, n))
            fs.delete(self._path(table, f"{n}.version")[0], False)
            fs.delete(folder, True)

    def active(self) -> DataFrame:
        return visible(self.read("snapshots"), active_pointers(self.read("runs")))

    def query(self, project_id: str, snapshot_type: str | None = None, file: str | None = None) -> DataFrame:
        """Snapshots of a project's active runs; project and type prune partitions."""
        from siltstone.registry import snapshot_types

        if snapshot_type is not None and snapshot_type not in snapshot_types():
            raise ValueError(f"no such snapshot type: {snapshot_type}")
        out = self.active().where(F.col("project_id") == project_id)
        out = out if snapshot_type is None else out.where(F.col("snapshot_type") == snapshot_type)
        return (out if file is None else out.where(F.col("source_file") == file)).orderBy("source_file", "snapshot_type")
