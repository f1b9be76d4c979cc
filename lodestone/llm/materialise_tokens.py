"""Token ids as binary shards in training order.

Texts are tokenised whole and cut into sequences of ``stride`` ids; the ids are stored once, unpadded,
compressed by runs of documents. Sequences are numbered densely from the counts of the stored tasks. A keyed Feistel
permutation, walked along its cycle until it lands below the number of sequences, gives each number a
global slot, so the order is a function of the key alone and can be inverted. Slots below the number
of sequences are all taken once, so their ranges need no sampling: a partition gets ``PART_BYTES`` of
successive shards by arithmetic, sorts them by slot and writes their files. A shard of ``shard_rows``
sequences is one file at a fixed stride, where the last sequence of a document is padded; slot s lies
in shard s // shard_rows at byte (s % shard_rows) * stride * width, and a reader resumes anywhere by
arithmetic. A shard is written under a name of its own attempt, whose manifest rows alone count; a
lost executor's shards are written again and its old files are unused.

Ids are 16 bits wide where the vocabulary allows, else 32, little-endian; the manifest gives each
sequence's bytes.

Defined cases: null and empty texts are one sequence with the end id; rows that repeat get sequences
each; a null doc_id is kept; other columns are ignored; an empty table writes no shard; a very long
text is tokenised whole, in memory of some tens of bytes for each of its bytes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, work_path
from .tokens import default_path, encoder
from .words import U, gather, mix, release, runs

STRIDE, SHARD_ROWS, END_ID, PAD_ID, KEY, ROUNDS = 512, 8192, 1, 0, 20240101, 6
#: documents whose ids are stored together, bytes of ids that are dealt to parts at once, and bytes of shards that one task writes
ROWS, DEALT_BYTES, PART_BYTES = 1024, 32 << 20, 64 << 20


def feistel(values: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(n): a balanced Feistel network over the next even number of bits, with cycle-walking."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    out = np.asarray(values, U).copy()
    keys = [U((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & (2**64 - 1)) for r in range(ROUNDS)]
    left_to_do = np.arange(len(out))
    while len(left_to_do):
        x = out[left_to_do]
        a, b = x >> U(half), x & mask
        for k in reversed(keys) if inverse else keys:
            a, b = (b ^ (mix(a + k) & mask), a) if inverse else (b, a ^ (mix(b + k) & mask))
        out[left_to_do] = a << U(half) | b
        left_to_do = left_to_do[out[left_to_do] >= U(n)]
    return out.astype(np.int64)


def _squeeze(ids: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(ids.tobytes(), asbytes=True)


def _expand(blob: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True) if n else b"", kind)


def _sequences(path: str, stride: int, end_id: int, kind: str):
    """A row a run of documents: the task's name, the number of its first sequence there, and its sequences' ids end to end."""

    def run(batches):
        task, at = uuid.uuid4().hex, 0
        for b in runs(batches, ROWS):
            ids, offsets = encoder(path).encode(b.column("text"))
            counts = np.diff(offsets) + 1
            flat = np.full(int(counts.sum()), end_id, kind)
            flat[np.arange(len(ids)) + np.repeat(np.arange(b.num_rows), counts - 1)] = ids
            seqs = -(-counts // stride)
            row = np.repeat(np.arange(b.num_rows), seqs)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(seqs) - seqs, seqs)
            used = np.minimum(stride, counts[row] - seq * stride)
            docs = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), b.column("doc_id").take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task]), pa.array([at], pa.int64()), docs, *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (seq, used)), pa.array([_squeeze(flat)], pa.binary())],
                ["task", "at", "docs", "seqs", "used", "ids"],
            )
            at += len(row)

    return run


def _dealt(n: int, key: int, rows: int, kind: str):
    """The sequences of a run by part, ``rows`` successive slots each, with their slots."""

    def deal(held: list) -> pa.RecordBatch:
        numbers, seqs, used, ids = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        docs = pa.concat_arrays([h[0] for h in held])
        slots = feistel(numbers, n, key)
        part, begin = slots // rows, np.cumsum(used) - used
        order = np.argsort(part, kind="stable")
        names, cuts = np.unique(part[order], return_index=True)
        own = [order[a:z] for a, z in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)), pa.int32()), docs.take(pa.array(order))),
                *(pa.array([x[o].astype("<u4").tobytes() for o in own], pa.binary()) for x in (seqs, used)),
                pa.array([slots[o].astype("<i8").tobytes() for o in own], pa.binary()),
                pa.array([_squeeze(gather(ids, begin[o], used[o])) for o in own], pa.binary()),
            ],
            ["part", "docs", "seqs", "used", "slots", "ids"],
        )

    def run(batches):
        held, size = [], 0
        for b in batches:
            for r in range(b.num_rows):
                seqs, used = (np.frombuffer(b.column(c)[r].as_py(), "<u4").astype(np.int64) for c in ("seqs", "used"))
                ids = _expand(b.column("ids")[r].as_py(), int(used.sum()), kind)
                held.append((b.column("docs")[r].values, b.column("number")[r].as_py() + np.arange(len(used)), seqs, used, ids))
                size += ids.nbytes
                if size > DEALT_BYTES:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)
        release()

    return run


def _write(folder: str, shard_rows: int, stride: int, pad_id: int, kind: str):
    """Writes one part's shards, whole files of padded sequences in slot order, and gives back their places."""

    def run(batches):
        docs, seqs, used, slots, ids = [], [], [], [], []
        for b in batches:
            docs.append(b.column("docs").flatten())
            for r in range(b.num_rows):
                n, some = (np.frombuffer(b.column(c)[r].as_py(), "<u4").astype(np.int64) for c in ("used", "seqs"))
                used.append(n)
                seqs.append(some)
                slots.append(np.frombuffer(b.column("slots")[r].as_py(), "<i8"))
                ids.append(_expand(b.column("ids")[r].as_py(), int(n.sum()), kind))
        if not used:
            return
        names = pa.concat_arrays(docs)
        seqs, used, slots, ids = (np.concatenate(x) for x in (seqs, used, slots, ids))
        begin, order = np.cumsum(used) - used, np.argsort(slots)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        size = stride * np.dtype(kind).itemsize
        shards = slots[order] // shard_rows
        for shard in np.unique(shards).tolist():
            own = order[shards == shard]
            n = used[own]
            block = np.full(len(own) * stride, pad_id, kind)
            block[np.repeat(np.arange(len(own)) * stride - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = gather(ids, begin[own], n)
            raw, name = block.tobytes(), f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(raw)
            place = np.arange(len(own)) * size
            crcs = [zlib.crc32(raw[i : i + size]) for i in place.tolist()]
            whole = lambda x: pa.array([x] * len(own), pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(own)), pa.array(seqs[own].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(slots[own]), whole(shard), pa.array([f"{folder}/{name}"] * len(own), pa.string()), pa.array(place), whole(size), pa.array(crcs, pa.int64())],
                ["doc_id", "seq", "n_tokens", "slot", "shard", "file", "byte_offset", "n_bytes", "ids_crc32"],
            )
        release()

    return run


def write_shards(docs: DataFrame, path: str | None = None, stride: int = STRIDE, shard_rows: int = SHARD_ROWS, key: int = KEY, end_id: int = END_ID, pad_id: int = PAD_ID, folder: str | None = None) -> DataFrame:
    """Writes the shards; returns (doc_id, seq, n_tokens, slot, shard, file, byte_offset, n_bytes, ids_crc32) of every sequence, already stored."""
    spark = docs.sparkSession
    path = path or default_path()
    code = "<u2" if encoder(path).full.get_vocab_size() <= 1 << 16 else "<u4"
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    seqs = materialise(texts.mapInArrow(_sequences(path, stride, end_id, code), f"task string, at long, docs array<{kind}>, seqs binary, used binary, ids binary"), "shards-sequences")
    tasks = seqs.groupBy("task").agg(F.sum(F.size("docs")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(tasks.select("task", before.alias("before"), "n"), "shards-offsets")  # a row a task
    n = offsets.agg(F.sum("n")).first()[0] or 0
    numbered = seqs.join(offsets.select("task", "before"), "task").select((F.col("before") + F.col("at")).alias("number"), "docs", "seqs", "used", "ids")
    rows = shard_rows * max(1, PART_BYTES // (shard_rows * stride * np.dtype(code).itemsize))
    dealt = numbered.mapInArrow(_dealt(n, key, rows, code), f"part int, docs array<{kind}>, seqs binary, used binary, slots binary, ids binary")
    laid = dealt.repartitionById(max(1, -(-n // rows)), "part")
    written = laid.mapInArrow(_write(folder or work_path(spark, "shards"), shard_rows, stride, pad_id, code), f"doc_id {kind}, seq int, n_tokens int, slot long, shard long, file string, byte_offset long, n_bytes long, ids_crc32 long")
    return materialise(written, "shards-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(slot, ids_crc32, n_bytes) of the manifest's sequences, read back from the shards in slot order."""

    def run(batches):
        name, stream = None, None
        for b in batches:
            out = []
            for slot, file, offset, size in zip(*(b.column(c).to_pylist() for c in ("slot", "file", "byte_offset", "n_bytes")), strict=True):
                if file != name:
                    if stream is not None:
                        stream.close()
                    fs, path = pafs.FileSystem.from_uri(file)
                    name, stream = file, fs.open_input_file(path)
                data = stream.read_at(size, offset)
                out.append((slot, zlib.crc32(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["slot", "ids_crc32", "n_bytes"])
        if stream is not None:
            stream.close()

    laid = manifest.select("slot", "file", "byte_offset", "n_bytes").repartitionByRange("slot").sortWithinPartitions("slot")
    return laid.mapInArrow(run, "slot long, ids_crc32 long, n_bytes long")
