"""Tiered memory: interactions, facts with upsert, recency and keyword recall, bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERACTIONS = "user_input string, response string, intent string, timestamp double"
FACTS = "fact_key string, fact_value string, source string, confidence double, metadata_json string, created_at double, updated_at double"


def recent(rows: DataFrame, limit: int, order: str, tie: str, newest_first: bool = False) -> DataFrame:
    """The newest ``limit`` rows, oldest first unless asked otherwise; none for a limit of 0 or less."""
    newest = rows.orderBy(F.desc(order), F.desc(tie)).limit(max(0, limit))
    return newest if newest_first else newest.orderBy(order, tie)


def last_per_key(rows: DataFrame, key: str, order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), n)


def flush_short_to_long(short: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Long-term rows with the short-term ones appended in order of time, an emptied short term, and the count."""
    n = short.count()
    moved = short.withColumn("intent", F.coalesce("intent", F.lit(""))).orderBy("timestamp")
    return long.unionByName(moved), short.limit(0), n


def clean_facts(facts: DataFrame) -> DataFrame:
    """Trimmed facts with a key and a value; a confidence that is no number is 0.7."""
    trimmed = facts.withColumn("fact_key", F.trim("fact_key")).withColumn("fact_value", F.trim("fact_value")).withColumn("confidence", F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.7)))
    return trimmed.filter("fact_key <> '' and fact_value <> ''")


def upsert_facts(stored: DataFrame, new: DataFrame, seq: str = "seq", at: str = "at") -> DataFrame:
    """Stored facts with the new ones: by (key, value), the last row's fields win and the first creation stays."""
    old = stored.withColumn("_seq", F.lit(-1).cast("long"))
    fresh = clean_facts(new).select("fact_key", "fact_value", "source", "confidence", "metadata_json", F.col(at).alias("created_at"), F.col(at).alias("updated_at"), F.col(seq).cast("long").alias("_seq"))
    last = F.max_by(F.struct("source", "confidence", "metadata_json", "updated_at"), "_seq")
    merged = old.unionByName(fresh).groupBy("fact_key", "fact_value").agg(last.alias("l"), F.min_by("created_at", "_seq").alias("created_at"))
    return merged.select("fact_key", "fact_value", "l.source", "l.confidence", "l.metadata_json", "created_at", "l.updated_at")


def upsert_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(stored, updated): new pairs once each; pairs that exist, and repeats in the batch, are updates."""
    pairs = clean_facts(new).groupBy("fact_key", "fact_value").agg(F.count("*").alias("n"))
    known = stored.select("fact_key", "fact_value", F.lit(1).alias("known"))
    joined = pairs.join(known, ["fact_key", "fact_value"], "left")
    return joined.agg(F.coalesce(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)), F.lit(0)).alias("stored"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("updated"))


def keyword_match(query: str, columns: list[str], escape: bool = False) -> Column:
    """Any of the query's first six words of over two letters (or else its first 40 characters) lies in a column, by LIKE."""
    low = query.lower()
    tokens = [t for t in low.split() if len(t) > 2][:6] or [low[:40]]
    out = F.lit(False)
    for t in tokens:
        t = t.replace("\\", "\\\\")
        t = t.replace("%", "\\%").replace("_", "\\_") if escape else t
        for c in columns:
            out = out | F.lower(F.col(c)).like(f"%{t}%")
    return out


def recall_facts(facts: DataFrame, query: str, limit: int = 5) -> DataFrame:
    hits = facts.filter(keyword_match(query, ["fact_key", "fact_value"]))
    parsed = F.coalesce(F.try_parse_json("metadata_json"), F.parse_json(F.to_json(F.struct(F.col("metadata_json").alias("raw_metadata")))))
    ordered = hits.orderBy(F.desc("confidence"), F.desc("updated_at"), "fact_key", "fact_value").limit(max(0, limit))
    return ordered.withColumn("metadata", F.when(F.coalesce("metadata_json", F.lit("")) != "", parsed.cast("string")).otherwise("{}"))


def add_episodic(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Appends episodes whose summary is not blank."""
    return stored.unionByName(new.filter(F.trim("summary") != ""))


def recall_episodic(hits: DataFrame, episodes: DataFrame, limit: int = 5) -> DataFrame:
    """Episodic ones of the 2 * limit best hits; without any, the newest episodes."""
    near = hits.orderBy(F.desc("score"), "id").limit(2 * max(0, limit)).filter("memory_type = 'episodic'").limit(max(0, limit)).select("id", "summary")
    newest = episodes.orderBy(F.desc("timestamp"), "id").limit(max(0, limit)).select("id", "summary")
    return near if not near.isEmpty() else newest


class WorkingMemory:
    """Keyed values as a small table: set, get, append within a bound, clear."""

    def __init__(self, state: DataFrame):
        self.state = state  # key string, seq long, value string

    def set(self, key: str, value: str, seq: int) -> WorkingMemory:
        spark = self.state.sparkSession
        return WorkingMemory(self.state.filter(F.col("key") != key).unionByName(spark.createDataFrame([(key, seq, value)], "key string, seq long, value string")))

    def append(self, key: str, value: str, seq: int, most: int = 100) -> WorkingMemory:
        spark = self.state.sparkSession
        return WorkingMemory(last_per_key(self.state.unionByName(spark.createDataFrame([(key, seq, value)], "key string, seq long, value string")), "key", ["seq"], most))

    def get(self, key: str) -> DataFrame:
        return self.state.filter(F.col("key") == key).orderBy("seq").select("value")

    def clear(self, key: str | None = None) -> WorkingMemory:
        return WorkingMemory(self.state.limit(0) if key is None else self.state.filter(F.col("key") != key))
