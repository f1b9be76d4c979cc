"""Exact top-k inner product search by columnar branch and bound.

Vectors are turned to whole numbers and laid out by dimension, in blocks of rows. For a query, the
partial scores of a candidate block grow dimension block by dimension block; what remains can add at
most the product of the two vectors' remaining lengths, so candidates whose bound is below the
query's k-th best score are dropped, and the survivors are compacted before the next dimensions.
Dimension blocks are taken in the order of their spread in the queries' block, largest first.

Queries and candidates are packed into blocks of bounded size and every pair of blocks is one row of
work; each yields at most k candidates for each of its queries, and these few are ranked by query.
Blocks of queries meet blocks of candidates by an equi-join on the query block's number, for which
candidate blocks are repeated; this is the stated query set against all rows.

Scores are exact: partial sums are whole numbers in double precision below 2**53; larger components
are summed as Python integers. The bounds, which are no whole numbers, are widened by more than
their rounding. A score beyond 64 bits is given as the largest or smallest 64-bit number and ranks as
that. Ties go to the smaller vec_id.

Rows that repeat a vec_id with one vector are removed before the blocks are laid, by a shuffle of the
vectors, so none takes a second place among a block's k; a hot vector of many ids is spread by id.

Defined cases: vectors that are null, empty or hold a component that is null, or not finite after
scaling, take no part, nor do rows with a null vec_id; vectors are compared with those of the same length only; rows that
repeat a vec_id with one vector count once, those with different vectors each; no row is a candidate
for a query of its own vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, partitions

SCALE, K, QUERIES, CANDIDATES, DIMS = 256, 5, 512, 8192, 16
#: more than the rounding of a sum of two numbers below 2**53
SLACK = 4.0
LARGEST = 2**63 - 1


def floored(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors as arrays of floor(scale * x), as doubles."""
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)  # beyond, doubles are whole
    usable = cast.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return usable.select("vec_id", F.transform("v", whole).alias("v"))


def _blocks(size: int):
    """Rows (dim, ids, data) of up to ``size`` vectors of one length, data by dimension."""

    def run(batches):
        held: dict[int, list] = {}

        def flush(dim):
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(np.array(vectors, np.float64).T).tobytes()], pa.binary())],
                ["dim", "ids", "data"],
            )

        for b in batches:
            lists = b.column("v")
            flat, offsets = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            for name, lo, hi in zip(b.column("vec_id").to_pylist(), (offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True):
                ids, vectors = held.setdefault(hi - lo, ([], []))
                ids.append(name)
                vectors.append(flat[lo:hi])
                if len(ids) == size:
                    yield flush(hi - lo)
        for dim in list(held):
            yield flush(dim)

    return run


def best_of_block(query: np.ndarray, vertical: np.ndarray, tails: list[np.ndarray], query_tails: list[float], parts: list[np.ndarray], k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``vertical`` that may be among the k best, and their scores; ``floor`` is a score below which none counts."""
    alive = None
    score = np.zeros(vertical.shape[1])
    for i, dims in enumerate(parts):
        cols = vertical[dims] if alive is None else vertical[np.ix_(dims, alive)]
        score = score + query[dims] @ cols
        if i + 1 == len(parts):
            break
        rest = query_tails[i + 1] * (tails[i + 1] if alive is None else tails[i + 1][alive]) * (1 + 1e-9)
        if len(score) > k:
            # k candidates have at least their lower bound, so the k-th best score is no less
            floor = max(floor, np.partition(score - rest, len(score) - k)[len(score) - k] - SLACK)
        stay = np.flatnonzero(score + rest >= floor - SLACK)
        if len(stay) < len(score):
            alive = stay if alive is None else alive[stay]
            score = score[stay]
    return (np.arange(vertical.shape[1]) if alive is None else alive), score


def _search(k: int, dims: int):
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for dim, qids, qdata, cids, cdata in zip(*(b.column(c).to_pylist() for c in ("dim", "q_ids", "q_data", "c_ids", "c_data")), strict=True):
                q_names, c_names = np.frombuffer(qids, np.int64), np.frombuffer(cids, np.int64)
                queries, vertical = np.frombuffer(qdata).reshape(dim, -1).T, np.frombuffer(cdata).reshape(dim, -1)
                order = np.argsort(c_names, kind="stable")
                c_names, vertical = c_names[order], np.ascontiguousarray(vertical[:, order])
                exact = float(np.abs(queries).max()) * float(np.abs(vertical).max()) * dim < 2.0**52
                spread = np.argsort(-(queries**2).sum(axis=0), kind="stable")
                parts = [spread[i : i + dims] for i in range(0, dim, dims)]
                tails = [np.sqrt((vertical[np.concatenate(parts[i:])] ** 2).sum(axis=0)) for i in range(len(parts))]
                for name, query in zip(q_names.tolist(), queries, strict=True):
                    if exact:
                        mine = [float(np.sqrt((query[np.concatenate(parts[i:])] ** 2).sum())) for i in range(len(parts))]
                        # a query's own row is set aside after the search, so one more is sought
                        own = int((c_names == name).sum())
                        at, score = best_of_block(query, vertical, tails, mine, parts, k + own, -np.inf)
                    else:
                        at = np.arange(len(c_names))
                        mine = [int(x) for x in query]
                        score = np.array([max(-LARGEST - 1, min(LARGEST, sum(x * int(y) for x, y in zip(mine, col, strict=True)))) for col in vertical.T], object)
                    other = c_names[at] != name
                    at, score = at[other], score[other]
                    top = sorted(range(len(at)), key=lambda i: (-score[i], at[i]))[:k] if not exact else np.lexsort((at, -score))[:k]
                    out += [(name, int(c_names[at[i]]), int(score[i])) for i in top]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, k: int = K, every: int = 50, scale: int = SCALE, queries: int = QUERIES, candidates: int = CANDIDATES, dims: int = DIMS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose vec_id is divisible by ``every``."""
    whole = floored(vectors, scale).dropDuplicates(["vec_id", "v"])
    kind = "dim int, ids binary, data binary"
    asked = whole.filter(F.col("vec_id") % every == 0)
    asked = asked.repartition(max(1, -(-asked.count() // queries))).mapInArrow(_blocks(queries), kind)
    asked = materialise(asked.withColumn("q_block", F.monotonically_increasing_id()), "topk-queries")
    # candidates of one length are many: they are salted, and the query blocks' numbers repeated for each salt
    salts = partitions(vectors.sparkSession)
    numbers = asked.select("dim", "q_block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = asked.select("dim", "q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    laid = whole.mapInArrow(_blocks(candidates), kind).select("dim", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    laid = laid.withColumn("salt", F.pmod(F.xxhash64("c_ids"), F.lit(salts)).cast("int"))
    pairs = laid.join(numbers, ["dim", "salt"]).join(asked, ["dim", "q_block"])
    found = pairs.mapInArrow(_search(k, dims), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
