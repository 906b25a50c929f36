"""Continuous ingestion: new files of a folder become snapshots batch by batch; windows over event streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import paths as P
from siltstone.plans import ingest as I
from siltstone.plans.store import Store


def watch(spark: SparkSession, root: str, store: Store, project_id: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingests files as they appear; the folder is one source, and a file of a batch takes the place of its earlier version.

    A batch is a run named after the query and the batch, so that one that is run again after a failure completes the same run, and one that
    was completed is passed over. Spark takes a path once for each checkpoint, and doesn't report files that are gone.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = files.select(P.relative_path(path, root).alias("relative"), "content").where(~P.ignored(F.col("relative")))

    def merge(batch: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        run_id = f"{project_id}-{query}-{number}"
        if store.read("runs").where((F.col("run_id") == run_id) & F.col("status").isin("active", "superseded")).isEmpty():
            I.ingest(batch.sparkSession, store, batch, project_id, f"watch:{root}", root, run_id=run_id, keep_others=True)

    start = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if once else start).start()


def event_windows(events: DataFrame, ts_col: str, kind_col: str, value_col: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind in tumbling windows; events later than ``late`` are left out."""
    timed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late)
    return timed.groupBy(F.window(ts_col, width), kind_col).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"))


def distinct_events(events: DataFrame, id_col: str, ts_col: str, late: str = "10 minutes") -> DataFrame:
    """The first of events that repeat an id within the watermark."""
    return events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late).dropDuplicatesWithinWatermark([id_col])
