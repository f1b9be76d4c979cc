"""Streaming forms: incremental ingest, exact dedup within a watermark, sessions, bounded memory by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracking import STATE, check_files, to_process, upsert_state
from ..session import materialise


def watch_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of new files below a folder."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def incremental(state: DataFrame | None, spark: SparkSession, process: Callable[[DataFrame], None]):
    """A foreachBatch function: checks each batch's files against the state, processes new and updated ones, keeps the state."""
    held = {"state": state if state is not None else spark.createDataFrame([], STATE)}

    def batch(files: DataFrame, _: int) -> None:
        from ..sources.files import with_fingerprints

        seen = with_fingerprints(files.select("path", "content", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size")))
        todo = to_process(check_files(seen, held["state"]))
        process(todo)
        held["state"] = materialise(upsert_state(held["state"], todo.select("path", "content_hash", "file_hash", "size", "mtime", F.lit(0).alias("chunk_count"))), "file-state")

    batch.held = held
    return batch


def dedup_stream(rows: DataFrame, time: str, text: str, delay: str = "1 hour") -> DataFrame:
    """First rows of each text within the watermark."""
    hashed = rows.withColumn(time, F.col(time).cast("timestamp")).withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n_events, total): works on streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if events.isStreaming else timed
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def last_items(rows: DataFrame, key: str, value: str, most: int = 100) -> DataFrame:
    """(key, n, items): the last items of each key, at most ``most``, as state that the stream keeps."""

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items = list(state.get[0]) if state.exists else []
        for f in frames:
            items = (items + f[value].astype(str).tolist())[-most:]
        state.update((items,))
        yield pd.DataFrame({"key": [str(k[0])], "n": [len(items)], "items": [items]})

    return rows.groupBy(key).applyInPandasWithState(run, "key string, n int, items array<string>", "items array<string>", "update", "NoTimeout")
