"""Exact rate limits: a request passes if fewer than ``most`` of its host's passed in the window before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accepted(seconds, most: int, window: float, past: deque) -> list[bool]:
    out = []
    for t in seconds:
        while past and past[0] <= t - window:
            past.popleft()
        out.append(ok := len(past) < most)
        if ok:
            past.append(t)
    return out


def limit(requests: DataFrame, id_col: str, key_col: str, ts_col: str, most: int = 100, window: int = 60) -> DataFrame:
    """(id, key, accepted) for each request, in order of time, then id.

    Rejected requests don't count. A pause as long as the window makes a key start afresh, so each
    key is dealt by such pauses; a task streams its rows and holds at most ``most`` times of one key.
    """
    seconds = F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6
    rows = requests.select(F.col(id_col).alias("id"), F.col(key_col).cast("string").alias("key"), seconds.alias("t"))
    w = Window.partitionBy("key").orderBy("t", "id")
    rows = rows.withColumn("gap", (F.col("t") - F.lag("t").over(w) >= window).cast("int"))
    rows = rows.withColumn("session", F.coalesce(F.sum("gap").over(w), F.lit(0)))
    dealt = rows.repartition("key", "session").sortWithinPartitions("key", "session", "t", "id").select("id", "key", "session", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, past = None, deque()
        for batch in batches:
            out = []
            for key, session, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if (key, session) != at:
                    at, past = (key, session), deque()
                out += accepted([t], most, window, past)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["id", "key", "accepted"])

    return dealt.mapInArrow(run, "id bigint, key string, accepted boolean").withColumnsRenamed({"id": id_col, "key": key_col})


def limit_stream(requests: DataFrame, id_col: str, key_col: str, ts_col: str, most: int = 100, window: int = 60) -> DataFrame:
    """The same on a stream; a key's state is the times of its accepted requests within the window."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = deque(state.get[0]) if state.exists else deque()
        for frame in frames:
            frame = frame.sort_values(["t", "id"])
            yield pd.DataFrame({"id": frame["id"], "key": key[0], "accepted": accepted(frame["t"], most, window, past)})
        state.update((list(past),))

    rows = requests.select(F.col(id_col).cast("bigint").alias("id"), F.col(key_col).cast("string").alias("key"), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("t"))
    out = rows.groupBy("key").applyInPandasWithState(run, "id bigint, key string, accepted boolean", "past array<double>", "append", "NoTimeout")
    return out.withColumnsRenamed({"id": id_col, "key": key_col})


def sliding_counts(requests: DataFrame, key_col: str, ts_col: str, id_col: str, most: int = 100, window: int = 60) -> DataFrame:
    """An approximation in SQL alone: counts all requests of the window, rejected ones too."""
    w = Window.partitionBy(key_col).orderBy(F.unix_micros(F.col(ts_col).cast("timestamp"))).rangeBetween(-(window * 1_000_000 - 1), 0)
    return requests.select(id_col, key_col, F.count(F.lit(1)).over(w).alias("in_window")).withColumn("within", F.col("in_window") <= most)
