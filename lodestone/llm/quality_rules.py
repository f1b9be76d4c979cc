"""Quality rules of documents, with verdicts of their hosts.

Each document is measured against base rules. Failures are counted by host (the domain of a URL, or
any other key column), and each host's failure rate is shrunk towards the corpus by a beta prior
whose two parameters are fitted to the hosts' rates by moments. Documents of a host whose shrunk
rate exceeds ``host_rate`` are rejected with it; all others keep their own verdict.

Counts by host are summed before the shuffle, so a hot host costs no more than any other. The prior
comes from one row of sums. Host verdicts go back by a join of one small row a host, which the
planner broadcasts below its own threshold and otherwise splits where it is skewed.

Defined cases: null or empty texts have no words and fail; documents with a null host share one
host of their own; rows that repeat are measured, counted and returned each; other columns are kept
by ``quality_filter`` and ignored by ``quality_rules``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import Scan, runs, slices, utf8

#: fixed values: symbols that count
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
HOST_RATE = 0.8
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated_words(scan: Scan, k: int) -> np.ndarray:
    """By row: words covered by windows of ``k`` words that the row holds twice or more."""
    begin, hashes = scan.windows(k)
    out = np.zeros(scan.n_rows, np.int64)
    if not len(begin):
        return out
    row = np.searchsorted(scan.first, begin, "right") - 1
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    same = np.append(False, (h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    alike = np.flatnonzero(same)
    if len(alike):  # the windows' words are compared too
        place = np.arange(k)
        same[alike] = (scan.hashes[begin[order[alike]][:, None] + place] == scan.hashes[begin[order[alike - 1]][:, None] + place]).all(axis=1)
    twice = same.copy()
    twice[:-1] |= same[1:]
    if not twice.any():
        return out
    at = begin[order[twice]]
    depth = np.zeros(len(scan.starts) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(depth)[:-1] > 0)))
    return covered[scan.first[1:]] - covered[scan.first[:-1]]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.split():
            seen.add(line)
    return n


def metrics(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = [np.zeros(len(column), np.int64) for _ in range(5)]
    if not len(column):
        return out
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part, rows = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        scan = Scan(part, rows, lower=False)
        inside = np.zeros(len(part) + 1, np.int64)
        inside[scan.starts] = 1
        inside[scan.ends] -= 1
        in_word = np.cumsum(inside)[: len(part)] > 0
        per_row = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[rows])  # noqa: B023, E731
        out[0][lo:hi] = np.diff(scan.first)
        out[1][lo:hi] = per_row(in_word & ((part & 0xC0) != 0x80))
        out[2][lo:hi] = per_row(_IS_SYMBOL[part])
        raw = part.tobytes()
        out[3][lo:hi] = [duplicate_lines(raw[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        out[4][lo:hi] = repeated_words(scan, WINDOW)
    return out


def _measure(batches):
    for b in runs(batches):
        found = metrics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *map(pa.array, found)], ["doc_id", "host", *(x.split()[0] for x in METRICS.split(", "))])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _failed(found: list[np.ndarray]) -> np.ndarray:
    return (found[0] < LEAST_WORDS) | (100 * found[4] > MOST_REPEATED * found[0])


def host_verdicts(hosts: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, host_docs, host_failed, shrunk_rate, host_kept) from the hosts' counts.

    The prior's mean m is the corpus's failure rate; its strength s comes from the spread v of the
    hosts' rates (weighted by size) about it: s = m (1 - m) / v - 1, at least 1. Without spread the
    strength is that of the whole corpus, so every host gets the corpus's rate.
    """
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_failed") * rate).alias("q"))
    mean = F.col("f") / F.col("n")
    spread = F.col("q") / F.col("n") - mean * mean
    strength = F.when(spread > 1e-12, F.greatest(F.lit(1.0), mean * (1 - mean) / spread - 1)).otherwise(F.col("n").cast("double"))
    prior = total.select(mean.alias("mean"), strength.alias("strength"))
    shrunk = (F.col("host_failed") + F.col("mean") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    judged = hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", shrunk)  # the prior is one row
    return judged.select("host", "host_docs", "host_failed", "shrunk_rate", (F.col("shrunk_rate") <= host_rate).alias("host_kept"))


def _host(host: Column | str) -> Column:
    key = F.col(f"`{host}`") if isinstance(host, str) else host
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def _counts(measured: DataFrame) -> DataFrame:
    return measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))


def quality_rules(docs: DataFrame, host: Column | str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Per document: its base measures, base_failed, its host's shrunk failure rate, and kept."""
    named = docs.select("doc_id", _host(host).alias("host"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    measured = named.mapInArrow(_measure, f"doc_id {kind}, host string, {METRICS}").withColumn("base_failed", base_failed())
    measured = materialise(measured, "quality-measures")
    verdicts = host_verdicts(_counts(measured), host_rate).select("host", "shrunk_rate", "host_kept")
    out = measured.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("shrunk_rate").alias("host_fail_rate"))


def _flag(batches):
    for b in runs(batches):
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(_failed(metrics(b.column("text"))))], ["host", "base_failed"])


def _sift(batches):
    for b in runs(batches):
        yield b.filter(pa.array(~_failed(metrics(b.column("text")))))


def quality_filter(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Texts are judged where they are read, once for the hosts' counts and once for the result, which
    costs less than a shuffle of texts; only the rejected hosts are joined to them.
    """
    measured = docs.select(_host(host).alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(_flag, "host string, base_failed boolean")
    rejected = materialise(host_verdicts(_counts(measured), host_rate).filter(~F.col("host_kept")).select(F.col("host").alias("rejected_host_key")), "quality-hosts")
    sifted = docs.mapInArrow(_sift, docs.schema)
    return sifted.join(rejected, _host(host) == F.col("rejected_host_key"), "left_anti")
