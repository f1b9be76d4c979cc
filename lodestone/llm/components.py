"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima and joins on Spark, written to the shared folder; nothing is
collected but three numbers that tell whether the links have changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    hung = both.join(least, "u")
    if small:
        out = hung.select(F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.a", "e.b")
    else:
        out = hung.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; links has long columns a and b."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, f"{name}-links")
    before = _state(edges)
    while before[0]:
        edges = materialise(_star(_star(edges, small=False), small=True), f"{name}-star")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
