"""Removal of repeated word passages by compaction of a de Bruijn graph of word k-mers.

Every window of ``k`` words is an edge between its first and last ``k`` - 1 words. An edge's minimizer
is the least hash of ``M`` words within it; a run of neighbouring edges with one minimizer is a
segment, the unit in which edges travel.

1. Segments' minimizers are counted, and their places within a segment. A segment whose minimizer comes
   only once holds no repeated edge and goes no further; the others are marked in one small bitmap a document.
2. The marked segments go, with their words and source coordinates (document, place), to buckets by
   minimizer, so all occurrences of an edge meet. There nodes' degrees decide: two edges in a row
   belong to one path if the node between them has no other way in or out, at any occurrence. Each
   repeated nonbranching path is compacted to one record an occurrence, with the coordinates of its first
   occurrence, its source; its words are compared with the words at the source.
3. Spark joins the paths' ends: a path that ends where another begins, in the document and in the
   source alike, is one longer path. The compacted spans are joined to the texts and cut out.

A segment that equals an earlier one of the same task (by a 128-bit digest of its words) is no work for
a bucket: it is a repeated span with that source at once. So a passage that very many documents hold
sends one segment a task to its bucket, not one a document.

Buckets' number follows the bytes of the texts and the number of marked segments, counted first.

Defined cases: null or empty texts have no words, nothing is removed and the kept text is empty;
texts of fewer than ``k`` words have no window; rows with a null doc_id take no part and are kept
whole; rows that share a doc_id share coordinates, so the same place in them is no earlier place, and
each is cut by its own text; other columns are ignored; an empty table gives an empty result. Memory
follows the longest single text (some 40 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, partitions
from .words import Scan, U, chained, gather, release, runs, scans, utf8

K, M = 20, 8
#: bytes of descriptors, and of segments' words, that a bucket is meant to hold
BUCKET_BYTES, SEGMENT_BYTES = 4 << 20, 200
#: segments that a task remembers; beyond it starts anew, and the buckets find the same repeats
REMEMBERED = 100_000


def minimizers(values: np.ndarray, span: int) -> np.ndarray:
    """The least of ``span`` consecutive values from each position on, by doubling."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(scan: Scan, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Row, number within the row, first word, edges and minimizer of each segment of a scan, and its m-word grams' hashes."""
    begin = scan.begins(k)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    grams = chained(scan.hashes, m)
    least = minimizers(grams, k - m + 1)[begin]
    new = np.append(True, (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1))
    row = np.searchsorted(scan.first, begin, "right") - 1
    new[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(new)
    row = row[at]
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    number = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
    return row, number, begin[at], np.diff(np.append(at, len(begin))), least[at], grams


def _bucket(least: np.ndarray, buckets: int) -> np.ndarray:
    return ((least >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return begins, np.append(begins[1:], len(values))


def _counted(k: int, m: int, buckets: int):
    """Rows (bucket, docs, rids, counts, numbers, mins, known): a run's segments by bucket of their minimizer.

    A minimizer that the run holds twice is known to be repeated: its segments go back at once, in rows
    of a negative bucket, and the bucket hears of the minimizer alone.
    """

    def run(batches):
        for b in runs(batches):
            ids, rids = b.column("doc_id").to_numpy(), b.column("rid").to_numpy()
            found = []
            for lo, scan in scans(b.column("text")):
                row, number, first, n, least, grams = segments(scan, k, m)
                if len(row):
                    span = n + (k - m)
                    places = np.add.reduceat(gather(grams, first, span) == np.repeat(least, span), np.cumsum(span) - span, dtype=np.int64)
                    found.append((lo + row, number, least, places))
            if not found:
                continue
            row, number, least, places = (np.concatenate(x) for x in zip(*found, strict=True))
            distinct, which = np.unique(least, return_inverse=True)
            times = np.bincount(which, places, len(distinct))
            again = times[which] > 1
            bucket = np.where(again, -1 - ids[row] % buckets, _bucket(least, buckets))
            known = distinct[times > 1]
            known_in = _bucket(known, buckets)
            order = np.lexsort((number, row, bucket))
            row, number, least, bucket = row[order], number[order], least[order], bucket[order]
            cols: dict[str, list] = {c: [] for c in ("bucket", "docs", "rids", "counts", "numbers", "mins", "known")}
            for name in np.union1d(bucket, known_in).tolist():
                lo, hi = np.searchsorted(bucket, [name, name + 1])
                edge, ends = _stretches(row[lo:hi])
                own = row[lo:hi][edge]
                cols["bucket"].append(name)
                cols["docs"].append(ids[own].astype("<i8").tobytes())
                cols["rids"].append(rids[own].astype("<i8").tobytes())
                cols["counts"].append((ends - edge).astype("<u4").tobytes())
                cols["numbers"].append(number[lo:hi].astype("<u4").tobytes())
                cols["mins"].append(least[lo:hi].astype("<u8").tobytes() if name >= 0 else b"")
                cols["known"].append(known[known_in == name].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cols["bucket"], pa.int64())] + [pa.array(v, pa.binary()) for c, v in cols.items() if c != "bucket"], list(cols))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: (doc_id, rid, numbers) of the segments whose minimizer comes twice or more."""
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    docs, rids, counts, numbers = join("docs", "<i8"), join("rids", "<i8"), join("counts", "<u4"), join("numbers", "<u4")
    owner = np.repeat(np.arange(len(docs)), counts)
    if table.column("bucket")[0].as_py() >= 0:
        mins, known = join("mins", "<u8"), join("known", "<u8")
        distinct, which, times = np.unique(np.concatenate([mins, known]), return_inverse=True, return_counts=True)
        sure = times > 1
        sure[which[len(mins) :]] = True
        keep = sure[which[: len(mins)]]
        owner, numbers = owner[keep], numbers[keep]
    edge, ends = _stretches(owner)
    out = pa.table({"doc_id": docs[owner[edge]], "rid": rids[owner[edge]], "numbers": pa.array([numbers[a:z].tobytes() for a, z in zip(edge.tolist(), ends.tolist(), strict=True)], pa.binary())})
    release()
    return out


def _bitmaps(batches):
    for b in batches:
        bits, n = [], []
        for lists in b.column("numbers").to_pylist():
            numbers = np.frombuffer(b"".join(lists), "<u4")
            held = np.zeros(int(numbers.max()) + 1, np.uint8)
            held[numbers] = 1
            bits.append(np.packbits(held, bitorder="little").tobytes())
            n.append(int(held.sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(bits, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "rid", "marks", "n_marks"])


EDGES = "bucket long, doc_id long, rid long, start long, n long, src_doc long, src_start long, words string"
PATHS = "doc_id long, rid long, start long, stop long, src_doc long, src_start long"


def _edges(k: int, m: int, buckets: int):
    """The marked segments with their words, by bucket; those met before in the task as spans, in negative buckets."""

    def run(batches):
        seen: dict[bytes, tuple[int, int, int]] = {}
        for b in runs(batches):
            ids, rids, marks = b.column("doc_id").to_pylist(), b.column("rid").to_pylist(), b.column("marks").to_pylist()
            out: list = []
            for lo, scan in scans(b.column("text")):
                row, number, first, n, least, _ = segments(scan, k, m)
                if not len(row):
                    continue
                rows = np.unique(row)
                bits = [np.unpackbits(np.frombuffer(marks[lo + r], np.uint8), bitorder="little") for r in rows.tolist()]
                base = np.zeros(scan.n_rows, np.int64)
                size = np.zeros(scan.n_rows, np.int64)
                size[rows] = [len(x) for x in bits]
                base[rows] = np.cumsum(size[rows]) - size[rows]
                marked = number < size[row]
                marked[marked] = np.concatenate(bits)[(base[row] + number)[marked]] > 0
                row, first, n, least = row[marked], first[marked], n[marked], least[marked]
                if not len(row):
                    continue
                # words, each with one space after it
                length = scan.ends - scan.starts
                place = np.concatenate(([0], np.cumsum(length + 1)))
                flat = np.full(int(place[-1]), 32, np.uint8)
                flat[np.repeat(place[:-1] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = gather(scan.data, scan.starts, length)
                raw = flat.tobytes()
                begin, end = place[first].tolist(), (place[first + n + (k - 1)] - 1).tolist()
                start, bucket = (first - scan.first[row]).tolist(), _bucket(least, buckets).tolist()
                last: list = []  # the span written last, which its neighbour lengthens
                for r, a, z, s, size_, name in zip((lo + row).tolist(), begin, end, start, n.tolist(), bucket, strict=True):
                    words = raw[a:z]
                    key = hashlib.blake2b(words, digest_size=16).digest()
                    doc, rid = ids[r], rids[r]
                    before = seen.get(key)
                    if before is not None and before[:2] < (doc, s):
                        if last and last[1:3] == [doc, rid] and last[3] + last[4] == s and last[5] == before[0] and last[6] + last[4] == before[1]:
                            last[4] += size_
                        else:
                            last = [-1 - doc % buckets, doc, rid, s, size_, before[0], before[1], None]
                            out.append(last)
                    elif before != (doc, s, rid):
                        seen[key] = (doc, s, rid)
                        out.append((name, doc, rid, s, size_, None, None, words))
            if len(seen) > REMEMBERED:
                seen.clear()
            kinds = [pa.int64()] * 7 + [pa.string()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            words = pa.array(cols[7], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:7], kinds, strict=False)] + [words], [x.split()[0] for x in EDGES.split(", ")])

    return run


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Whether the spans of ``data`` from a and from b on, of equal positive sizes, hold the same bytes."""
    out, ends = np.ones(len(a), bool), np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        own = size[lo:hi]
        differ = gather(data, a[lo:hi], own) != gather(data, b[lo:hi], own)
        out[lo:hi] = ~(np.add.reduceat(differ, np.cumsum(own) - own) > 0)
        lo = hi
    return out


def _paths(k: int):
    """Of one bucket: its repeated nonbranching paths, one row an occurrence that has an earlier source."""

    def run(table: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in PATHS.split(", ")]
        doc, rid, start, n = (table.column(c).to_numpy() for c in ("doc_id", "rid", "start", "n"))
        if table.column("bucket")[0].as_py() < 0:
            return pa.table(dict(zip(names, (doc, rid, start, start + n, table.column("src_doc"), table.column("src_start")), strict=True)))
        data, offsets = utf8(table.column("words").combine_chunks())
        scan = Scan(data, offsets, lower=False)
        begin, code = scan.windows(k)
        row = np.searchsorted(scan.first, begin, "right") - 1
        doc, rid, place = doc[row], rid[row], start[row] + begin - scan.first[row]
        # edges: number, first occurrence and count of each
        order = np.lexsort((place, doc, code))
        head = np.append(True, code[order][1:] != code[order][:-1])
        edge = np.empty(len(code), np.int64)
        edge[order] = np.cumsum(head) - 1
        first, times = order[head], np.diff(np.append(np.flatnonzero(head), len(code)))
        # a node between two edges of a row is passed by if neither edge has, anywhere, another neighbour or none
        inside = np.flatnonzero(row[1:] == row[:-1])
        a, b = edge[inside], edge[inside + 1]
        _, which, both = np.unique(a * len(times) + b, return_inverse=True, return_counts=True)
        through = np.zeros(len(code), bool)
        through[inside + 1] = (both[which] == times[a]) & (both[which] == times[b])
        cut = np.flatnonzero(~through)
        size = np.diff(np.append(cut, len(code)))
        source = first[edge[cut]]
        later = (times[edge[cut]] > 1) & ((doc[cut] != doc[source]) | (place[cut] != place[source]))
        cut, size, source = cut[later], size[later], source[later]
        if not len(cut):
            release()
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        # the words themselves, at the occurrence and at its source
        own_lo, own_hi = scan.starts[begin[cut]], scan.ends[begin[cut] + size + (k - 2)]
        src_lo, src_hi = scan.starts[begin[source]], scan.ends[np.minimum(begin[source] + size + (k - 2), len(scan.ends) - 1)]
        equal = own_hi - own_lo == src_hi - src_lo
        equal[equal] = _same(data, own_lo[equal], src_lo[equal], (own_hi - own_lo)[equal])
        out = [np.array(x, np.int64) for x in (doc[cut][equal], rid[cut][equal], place[cut][equal], (place[cut] + size)[equal], doc[source][equal], place[source][equal])]
        rest = []
        words = lambda i: data[scan.starts[begin[i]] : scan.ends[begin[i] + k - 1]].tobytes()
        for i, many in zip(cut[~equal].tolist(), size[~equal].tolist(), strict=True):  # two edges of one hash: told apart by their words
            for w in range(i, i + many):
                group = np.flatnonzero(edge == edge[w])
                like = min((doc[x], place[x]) for x in group.tolist() if words(x) == words(w))
                if like < (doc[w], place[w]):
                    rest.append((doc[w], rid[w], place[w], place[w] + 1, *like))
        if rest:
            out = [np.concatenate([x, np.array(y, np.int64)]) for x, y in zip(out, zip(*rest, strict=True), strict=True)]
        release()
        return pa.table(dict(zip(names, out, strict=True)))

    return run


def compacted(paths: DataFrame) -> DataFrame:
    """(doc_id, rid, start, stop, src_doc, src_start): paths that adjoin in their document and in their source made one.

    A path begins a chain if no path ends where it begins, with the same source diagonal; chains are
    told by the number of beginnings up to each path, within one document and diagonal.
    """
    keyed = paths.withColumn("diagonal", F.col("start") - F.col("src_start")).distinct()
    ends = keyed.select("doc_id", "rid", "src_doc", "diagonal", F.col("stop").alias("start"), F.lit(False).alias("begins"))
    joined = keyed.join(ends.distinct(), ["doc_id", "rid", "src_doc", "diagonal", "start"], "left").withColumn("begins", F.coalesce("begins", F.lit(True)))
    along = Window.partitionBy("doc_id", "rid", "src_doc", "diagonal").orderBy("start")
    chained_ = joined.withColumn("chain", F.sum(F.col("begins").cast("long")).over(along))
    spans = chained_.groupBy("doc_id", "rid", "src_doc", "diagonal", "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select("doc_id", "rid", "start", "stop", "src_doc", (F.col("start") - F.col("diagonal")).alias("src_start"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("rid"))


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, buckets: int | None = None) -> DataFrame:
    """(doc_id, rid, start, stop, src_doc, src_start): runs of windows that occur earlier, from window start to before stop.

    rid is a hash of the row's text, which tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    texts = _texts(docs).filter("doc_id is not null and text is not null")
    by_size = lambda size: buckets or max(partitions(spark), -(-int(size) // BUCKET_BYTES))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = texts.mapInArrow(_counted(k, m, by_size(total * 0.3)), "bucket long, docs binary, rids binary, counts binary, numbers binary, mins binary, known binary")
    marked = counted.groupBy("bucket").applyInArrow(_repeated, "doc_id long, rid long, numbers binary")
    marks = marked.groupBy("doc_id", "rid").agg(F.collect_list("numbers").alias("numbers"))  # as many as the document has segments
    marks = materialise(marks.mapInArrow(_bitmaps, "doc_id long, rid long, marks binary, n_marks long"), "substrings-marks")
    n = marks.agg(F.sum("n_marks")).first()[0] or 0
    edges = texts.join(marks, ["doc_id", "rid"]).select("doc_id", "rid", "marks", "text").mapInArrow(_edges(k, m, by_size(n * SEGMENT_BYTES)), EDGES)
    return compacted(materialise(edges.groupBy("bucket").applyInArrow(_paths(k), PATHS), "substrings-paths"))


def _kept(k: int):
    def run(batches):
        for b in runs(batches):
            texts, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, own in zip(texts, spans, strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                parts, at = [], 0
                for s in own or []:
                    lo, hi = s["start"], s["stop"] + (k - 1)
                    if hi > len(words):
                        raise ValueError("a repeated span does not lie inside its text")
                    if lo > at:
                        parts += words[at:lo]
                    at = max(at, hi)
                parts += words[at:]
                n_removed.append(len(words) - len(parts))
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without the words that earlier passages hold, joined by a space."""
    found = repeated_spans(docs, k).groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    found = materialise(found, "substrings-spans")
    joined = _texts(docs).join(found, ["doc_id", "rid"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept(k), "doc_id long, n_words long, n_removed long, kept_text string")
