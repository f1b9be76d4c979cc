"""Vector search, filters, per-source dedup, context assembly and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import spread

MAX_CONTEXT_TOKENS = 2048


def inner_product(column: str, query: Sequence[float]) -> Column:
    """Inner product with a literal vector, summed in order, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(F.col(column), q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def extract_source(document: Column, file: Column) -> Column:
    return F.coalesce(F.nullif(document, F.lit("")), F.nullif(file, F.lit("")), F.lit("unknown"))


def matches_filters(filters: dict[str, str], metadata: str = "metadata", extra: str | None = "extra_metadata") -> Column:
    """All equalities hold; a key that the metadata lacks is looked up in the extra ones."""
    out = F.lit(True)
    for k, v in filters.items():
        own = F.element_at(F.col(metadata), k)
        value = F.when(F.map_contains_key(F.col(metadata), F.lit(k)), own).otherwise(F.element_at(F.col(extra), k)) if extra else own
        out = out & value.eqNullSafe(F.lit(v))
    return out


def parse_filters(text: str | None) -> dict:
    """A JSON object of filters; anything else is no filter."""
    import json

    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def search(rows: DataFrame, query: Sequence[float], top_k: int = 5, score_threshold: float = 0.5, condition: Column | None = None, dedupe_source: str | None = None, key: str = "chunk_id", embedding: str = "embedding", post_filter: bool = True) -> DataFrame:
    """The best rows by inner product, ties by key.

    With ``post_filter`` the condition applies to the 5 * top_k best candidates, otherwise before the
    limit. Both limits are ordered ones, which Spark takes without a full sort.
    """
    scored = rows.withColumn("score", inner_product(embedding, query))
    if top_k <= 0:
        return scored.limit(0)
    best = [F.desc("score"), F.asc(key)]
    if condition is not None and not post_filter:
        scored = scored.filter(condition)
    out = scored.orderBy(*best).limit(5 * top_k).filter(F.col("score") >= score_threshold)
    if condition is not None and post_filter:
        out = out.filter(condition)
    if dedupe_source:
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(dedupe_source).orderBy(*best))).filter("_rank = 1").drop("_rank")
    return out.orderBy(*best).limit(top_k)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def best_pairs(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, ties to the row that comes first.

    A matrix product finds the rows that may be among them, within its rounding error; their scores are
    then summed in order, as ``inner_product`` does.
    """
    dims = queries.shape[1]
    near = queries @ rows.T
    slack = 8 * (dims + 1) * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0)
    least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if k < len(rows) else np.full(len(queries), -np.inf)
    q, r = np.nonzero(near >= (least - slack)[:, None])
    score = np.zeros(len(q))
    for j in range(dims):
        score += rows[r, j] * queries[q, j]
    order = np.lexsort((r, -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], r[first], score[first]


def search_batch(rows: DataFrame, queries: DataFrame, top_k: int = 5, key: str = "chunk_id", embedding: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """(query_id, key, score, rank) for a table of queries; more than ``most_queries`` are dealt by a hash of their ids to blocks of about half as many, each broadcast on its own.

    Every row meets every query, in blocks of 512 queries and 4096 rows that give their best. Vectors
    with null or non-finite components, or of another length than the first query's, are scored in Spark.
    """
    spark, rows = rows.sparkSession, spread(rows.select(key, embedding))
    queries = queries.select("query_id", embedding)
    n = queries.count()
    first = queries.filter(F.size(embedding) > 0).select(F.size(embedding)).first()
    dims = first[0] if first else 0
    value = F.col(embedding).cast("array<double>")
    usual = F.coalesce((F.size(embedding) == dims) & (F.lit(dims) > 0) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150)), F.lit(False))
    blocks = 1 if n <= most_queries else -(-2 * n // most_queries)
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(key, rows.schema[key].dataType), StructField("score", DoubleType())])
    score = F.aggregate(F.zip_with(F.col(embedding), F.col("_q"), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)

    def in_blocks(held):
        def run(batches):
            asked = pa.ipc.open_stream(held.value).read_all().combine_chunks()
            ids = asked.column("query_id").combine_chunks()
            own = _matrix(asked.column(embedding).combine_chunks(), dims)
            for b in batches:
                for lo in range(0, len(b), 4096):
                    part = b.slice(lo, 4096)
                    part = part.take(pc.sort_indices(part.column(key)))
                    vectors = _matrix(part.column(embedding), dims)
                    for at in range(0, len(own), 512):
                        q, r, s = best_pairs(own[at : at + 512], vectors, top_k)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + at)), part.column(key).take(pa.array(r)), pa.array(s)], ["query_id", key, "score"])

        return run

    def one_by_one(some: DataFrame, own: DataFrame) -> DataFrame:
        return some.join(F.broadcast(own.select("query_id", F.col(embedding).alias("_q")))).select("query_id", key, score.alias("score"))

    out = None
    for k in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries
        asked = own.filter(usual).select("query_id", value.alias(embedding)).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, asked.schema) as stream:
            stream.write_table(asked)
        found = rows.filter(usual).select(key, value.alias(embedding)).mapInArrow(in_blocks(spark.sparkContext.broadcast(sink.getvalue().to_pybytes())), schema)
        scored = found.unionByName(one_by_one(rows.filter(~usual), own)).unionByName(one_by_one(rows.filter(usual), own.filter(~usual)))
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).filter(F.col("rank") <= top_k)
        out = best if out is None else out.unionByName(best)
    return out


def build_context(hits: DataFrame, max_chunks: int = 3, max_tokens: int = MAX_CONTEXT_TOKENS, rank: str = "rank", source: str = "source_file", content: str = "content", by: list[str] | None = None) -> DataFrame:
    """(context_text, total_length, sources) of the first chunks, stopping at the first that would pass 4 characters a token.

    ``by`` names columns of a query, each with its own context.
    """
    by = by or []
    name = F.regexp_extract(F.col(source), r"([^/]*)/?$", 1)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(rank) if by else Window.orderBy(rank))
    top = (hits if by else hits.orderBy(rank).limit(max_chunks)).withColumn("_nth", nth).filter(F.col("_nth") <= max_chunks)
    text = F.concat(F.lit("[Source "), F.col("_nth"), F.lit(": "), name, F.lit("]\n"), F.col(content), F.lit("\n"))
    run = Window.partitionBy(*by).orderBy("_nth") if by else Window.orderBy("_nth")
    kept = top.withColumn("_text", text).withColumn("_total", F.sum(F.length("_text")).over(run)).filter(F.col("_total") <= 4 * max_tokens)
    rows = F.sort_array(F.collect_list(F.struct(F.col("_nth").alias("n"), F.col("_text").alias("t"), F.col(source).alias("s"))))
    listed = kept.groupBy(*by).agg(rows.alias("_rows"), F.max("_total").alias("total_length"))
    return listed.select(*by, F.array_join(F.transform("_rows", lambda x: x["t"]), "\n").alias("context_text"), "total_length", F.transform("_rows", lambda x: x["s"]).alias("sources"))


def preview(content: Column, n: int = 300) -> Column:
    return F.when(F.length(content) > n, F.concat(F.substring(content, 1, n), F.lit("..."))).otherwise(content)


def sources_rollup(rows: DataFrame, source: str, kind: str, order: str) -> DataFrame:
    """(source, chunk_count, file_type): the kind first seen in the given order."""
    return rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("chunk_count"), F.min_by(kind, order).alias("file_type"))


def distinct_sources(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(F.col(source).alias("source")).distinct().orderBy("source")


def store_stats(rows: DataFrame, source: str, embedding: str) -> DataFrame:
    return rows.agg(F.count("*").alias("total_chunks"), F.countDistinct(source).alias("total_sources"), F.max(F.size(embedding)).alias("dimensions"))
