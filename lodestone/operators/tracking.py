"""File tracking: which files are new, updated, unchanged or duplicates, and the state's upkeep."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

STATE = "path string, content_hash string, file_hash string, size long, mtime double, chunk_count int"


def check_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Adds status and reason; the state holds earlier runs only, so files of one batch don't see each other."""
    known = state.select("path", F.col("file_hash").alias("_hash"), F.col("mtime").alias("_mtime"))
    first = state.groupBy("content_hash").agg(F.min("path").alias("_first"))
    joined = files.join(known, "path", "left").join(first, "content_hash", "left")
    same, newer, seen = F.col("file_hash") == F.col("_hash"), F.col("mtime") > F.col("_mtime"), F.col("_hash").isNotNull()
    status = F.when(seen & same, "UNCHANGED").when(seen, "UPDATED").when(F.col("_first").isNotNull(), "DUPLICATE").otherwise("NEW")
    reason = F.when(seen & same & newer, "timestamp_only").when(seen & same, "identical").when(seen, "content_changed").when(F.col("_first").isNotNull(), F.concat(F.lit("duplicate_of:"), "_first")).otherwise("not_seen_before")
    return joined.withColumn("status", status).withColumn("reason", reason).drop("_hash", "_mtime", "_first")


def to_process(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("status").isin("NEW", "UPDATED"))


def upsert_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """State with the processed files' rows in place of their old ones."""
    names = state.columns
    return state.join(done.select("path"), "path", "left_anti").select(names).unionByName(done.select(names))


def remove_files(state: DataFrame, paths: DataFrame) -> DataFrame:
    return state.join(paths.select("path"), "path", "left_anti")


def ingest_counters(checked: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s)
    return checked.agg(F.count("*").alias("total_files"), one("NEW").alias("new_files"), one("UPDATED").alias("updated_files"), one("UNCHANGED").alias("unchanged_files"), one("DUPLICATE").alias("duplicate_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


#: parts of a stored chunk table, by a hash of the source
STORE_PARTS = 256


def load_chunks(spark, path: str) -> DataFrame | None:
    """The stored chunk table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def store_chunks(path: str, chunks: DataFrame, emptied: DataFrame | None = None, source: str = "source_document") -> None:
    """Puts chunks in place of those of their sources, and removes those of the ``emptied`` paths.

    Only the parts that hold such a source are read and written again.
    """
    spark = chunks.sparkSession
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(STORE_PARTS)).cast("int")
    gone = chunks.select(F.col(source).alias("_gone")).distinct()
    if emptied is not None:
        gone = gone.union(emptied.toDF("_gone")).distinct()
    new = chunks.withColumn("part", part(source))
    old = load_chunks(spark, path)
    if old is not None:
        parts = F.broadcast(gone.select(part("_gone").alias("part")).distinct())  # at most STORE_PARTS rows
        kept = old.join(parts, "part", "left_semi").join(gone, F.col(source) == F.col("_gone"), "left_anti")
        empty = old.join(parts, "part", "left_semi").select("part").distinct()
        new = materialise(kept.unionByName(new, allowMissingColumns=True), "store-parts")
        # a part that loses its last chunk has no row to overwrite it with
        dropped = [r["part"] for r in empty.join(new.select("part").distinct(), "part", "left_anti").collect()]
        for p in dropped:
            files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}")
            files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def replace_chunks(store: DataFrame, new: DataFrame, source: str = "source_document") -> DataFrame:
    """The store without the changed sources' chunks, with the new ones."""
    return store.join(new.select(source).distinct(), source, "left_anti").select(store.columns).unionByName(new.select(store.columns))
