"""Best-fit packing of token pieces into fixed-length sequences.

Texts are tokenised whole; only documents longer than a sequence are cut, into full pieces and a
shorter last one. Full pieces are sequences of their own. The others are packed by bounded-space
online best fit: a task takes its pieces as they come, keeps at most ``open_bins`` open bins, keyed
in a bitset by their free space, and puts each piece into the bin with the least free space that
holds it. When no bin holds it and all are open, the fullest is closed. Bins left open at a task's
end are the pieces of the next round, with an eighth of the tasks, until one task is left; so only
one task's bins stay unfilled. Pieces are dealt to tasks by a hash of the document, so each sees the
corpus's mix of lengths. Only lengths move in these rounds, never texts or ids.

Where the documents have an order (a column of places from 0, each given once), tasks get contiguous
ranges of places instead and take their pieces in that order; a round joins neighbouring tasks' bins.
A sequence then begins with its piece of least place and is numbered by it, so sequences in the
order of their numbers follow the documents' order.

Defined cases: a null or empty text is the one id that ends a document; rows that repeat are packed
each; a null doc_id is kept as null; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, partitions
from .tokens import default_path, encoder
from .words import runs

CAPACITY, OPEN_BINS, END_ID = 4096, 512, 1
ROWS = 512
#: a document of 2 GB has fewer pieces of 64 ids or more
PIECE_BITS = 25


class BestFit:
    """Bounded-space best fit; bins are numbered from 0 in the order in which they are opened."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.n_open, self.n = 0, {}, 0, 0
        self.free: dict[int, int] = {}

    def _take(self, free: int) -> int:
        own = self.bins[free]
        name = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.n_open -= 1
        return name

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of at most ``capacity``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.n_open == self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self._take(fullest)
            free, name = self.capacity, self.n
            self.n += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(name)
            self.bits |= 1 << left
            self.n_open += 1
        return name, self.capacity - free

    def left_open(self) -> Iterator[tuple[int, int]]:
        """(bin, filled length) of the bins still open."""
        for free, own in self.bins.items():
            for name in own:
                yield name, self.capacity - free


def token_pieces(path: str, capacity: int, end_id: int, order: str | None = None):
    """Rows (doc_id, piece, start, length, ids_crc32) of a batch of documents, and their place if there is an order."""

    def run(batches):
        for b in runs(batches, ROWS):
            ids, offsets = encoder(path).encode(b.column("text"))
            raw, end = ids.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = raw[4 * a : 4 * z] + end
                for p, at in enumerate(range(0, len(own) // 4, capacity)):
                    cut = own[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            took = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(took), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([b.column(order).take(took)] if order else [])],
                ["doc_id", "piece", "start", "length", "ids_crc32", *([order] if order else [])],
            )

    return run


def _pack(capacity: int, open_bins: int):
    """Adds bin, at, the bin's first deal, and state to the rows of one task: bins are numbered within it."""

    def run(table: pa.Table) -> pa.Table:
        fit = BestFit(capacity, open_bins)
        order = np.argsort(table.column("deal").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        placed = [fit.add(n) for n in table.column("length").to_pylist()]
        filled = dict(fit.left_open())
        bins = np.array([p[0] for p in placed], np.int64)
        open_ = np.array([filled.get(p[0], 0) for p in placed], np.int64)
        # bins are numbered as they are opened, so the first row of each is where its number first comes
        first = table.column("deal").to_numpy()[np.unique(bins, return_index=True)[1]]
        out = table.append_column("bin", pa.array(bins)).append_column("at", pa.array([p[1] for p in placed], pa.int64()))
        return out.append_column("first_deal", pa.array(first[bins], pa.int64())).append_column("open_length", pa.array(open_))

    return run


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None, order: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a long column length between 1 and ``capacity``.

    ``order`` names a long column that packing follows; the result leaves it out.
    """
    tasks = tasks or partitions(pieces.sparkSession)
    names = [c for c in pieces.columns if c != order]
    stride = 1 << 40
    if order:
        places = (pieces.agg(F.max(order)).first()[0] or 0) + 1
        key = F.shiftleft(F.col(order), PIECE_BITS) + F.col("piece")
        dealt_to = lambda n: F.expr(f"shiftright(deal, {PIECE_BITS}) * {n}L div {places}L").cast("int")
        own_name = lambda ahead: F.col("first_deal")
    else:
        key = F.xxhash64("doc_id", *[c for c in names if c in ("piece", "ids_crc32")], F.monotonically_increasing_id())  # so equal rows part
        dealt_to = lambda n: F.pmod(F.shiftright("deal", 20), F.lit(n)).cast("int")
        own_name = lambda ahead: F.lit(ahead * (1 << 56)) + F.col("task").cast("long") * stride + F.col("bin")
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", key if order else -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(*names, "sequence_id", "offset")
    rest = pieces.filter(F.col("length") < capacity).withColumn("deal", key).select(*names, "deal").withColumn("task", dealt_to(tasks))
    added = "bin long, at long, first_deal long, open_length long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields) + f", {added}"
    first = rest.groupBy("task").applyInArrow(_pack(capacity, open_bins), schema)
    first = materialise(first.withColumn("bin_id", own_name(0)).select(*names, "bin_id", "at", "open_length"), "packing-first")
    # bins left open are pieces of the next round; moves maps a round's bins to their places in the next
    moves, still, ahead = None, first.filter("open_length > 0").select("bin_id", F.col("open_length").alias("length")).distinct(), 1
    while tasks > 1:
        tasks = -(-tasks // 8)
        ahead += 1
        dealt = still.withColumn("deal", F.col("bin_id") if order else F.xxhash64("bin_id")).withColumn("task", dealt_to(tasks))
        packed = dealt.groupBy("task").applyInArrow(_pack(capacity, open_bins), f"bin_id long, length long, deal long, task int, {added}")
        packed = packed.select("bin_id", own_name(ahead).alias("into"), "at", "open_length")
        packed = materialise(packed, "packing-round")
        step = packed.select("bin_id", "into", F.col("at").alias("shift"))
        if moves is None:
            moves = step
        else:
            on = step.select(F.col("bin_id").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(on, "into", "left").select("bin_id", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moves = materialise(moves, "packing-moves")
        still = packed.filter("open_length > 0").select(F.col("into").alias("bin_id"), F.col("open_length").alias("length")).distinct()
    if moves is not None:
        first = first.join(moves, "bin_id", "left").withColumn("bin_id", F.coalesce("into", "bin_id")).withColumn("at", F.col("at") + F.coalesce("shift", F.lit(0)))
    packed = first.select(*names, F.col("bin_id").alias("sequence_id"), F.col("at").alias("offset"))
    # without an order, sequences of full pieces get negative numbers, those of bins positive ones
    return packed.unionByName(full)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([order] if order else []))
    pieces = texts.mapInArrow(token_pieces(path or default_path(), capacity, end_id, order), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (f", `{order}` long" if order else ""))
    return pack_lengths(materialise(pieces, "packing-pieces"), capacity, open_bins, order=order)
