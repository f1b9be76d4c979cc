"""Exact n-gram Jaccard self-join of documents by PartEnum signatures.

A document is the set of its distinct ``k``-word shingles. Sizes are cut into bands by powers of
1 / threshold t, so similar sets lie in one band or in neighbours, and each set takes part in its
own band's instance and in the next one's. In an instance whose largest size is r, similar sets
differ in at most 2 r (1 - t) / (1 + t) features, and a set of n features differs from any similar
one in at most n (1 - t) / t. The feature domain is cut into groups of ``PARTS`` parts. Two sets that
differ in d features differ in at most ``SPARE`` features in at least groups - d // (SPARE + 1) groups,
and there agree on some subset of PARTS - SPARE parts: the contents of each such subset are one
signature. Subsets without features say nothing and are left out; a group is thin for a set if it has at
most ``SPARE`` parts with features. So a set shares a signature with any similar one in at least
groups - d // (SPARE + 1) - thin groups, its surplus. A set without surplus repeats the cut with
another hash until it has one; of a similar pair the first to have one has it for both.

Signatures travel as packed arrays, one row a bucket and batch, and each bucket is sorted in memory.
Sets that share a signature are a group. The surplus then thins the groups exactly:

* a set that shares fewer signatures, of all its groups, than its surplus has no similar set;
* every set leaves its largest groups, up to (surplus - 1) // 2 signatures: of a similar pair's common
  signatures, at least the larger surplus, both together leave fewer.

What a very common passage lends to many documents is so left behind, without a limit on any group.
The groups that remain give links to their first member, which is linear in a group's size. A verified
link joins components. Groups that still span several components afterwards are compared in blocks
across components, so that no link between components is missed. Before shingles are compared, bits by
feature class bound the intersection from above, which drops chance candidates and can't drop a link.
Links are verified on whole shingle sets, hashed anew by another function than the signatures' features;
texts that are equal but for case, met in one task, are linked by a 128-bit digest.

Defined cases: a document without words or with null text has an empty set and no link; one with
fewer than ``k`` words has its whole word sequence as its only shingle; rows with a null doc_id keep
their size and are their own (null) component; rows that share a doc_id are one node of the graph,
with a row each in the result; other columns are ignored; an empty table gives an empty result; memory
follows the longest single text.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, partitions
from .components import components
from .words import U, gather, lowered, mix, release, runs, scans, utf8

PARTS, SPARE = 3, 1
_SUBSETS = list(combinations(range(PARTS), PARTS - SPARE))
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
SEEDS = 64
#: members of a group that are compared in one block, and rows sent to the driver's broadcast at most
BLOCK, BROADCAST_ROWS = 4096, 1_000_000
#: rows of groups that a task compares at once, and pairs that it holds before it drops those it has twice
TASK_ROWS, GIVEN = 1_000_000, 1_000_000
#: classes a feature, at least, of the sketches that decide pairs across components
FINE = 16
#: bytes of texts whose signatures a bucket is meant to hold; with fewer buckets, fewer groups come twice
BUCKET_BYTES = 32 << 20


class Sizes:
    """Bands of set sizes and their PartEnum parameters, in whole numbers; the threshold is a percentage."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops: list[int] = []

    def band(self, n: int) -> int:
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(low * 100 // self.percent)
        return int(np.searchsorted(self.tops, n))

    def cut(self, band: int) -> tuple[int, int]:
        """Groups and greatest difference of a band's instance; no groups if its similar sets are equal."""
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1 if self.tops else 1)
        far = 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)
        lost = far // (SPARE + 1)
        return (lost + lost * 30 // 100 + 2 if far else 0), far


def _cells(features: np.ndarray, groups: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The features in the order of an instance's hash, and the bounds of its parts."""
    h = np.sort(mix(features ^ U(seed * 0x9E3779B9))) if seed else features
    cells = groups * PARTS
    return h, np.searchsorted((h >> U(32)) * U(cells) >> U(32), np.arange(cells + 1, dtype=U))


def _surplus(bounds: np.ndarray, groups: int, far: int) -> int:
    full = (np.diff(bounds) > 0).reshape(groups, PARTS)
    return groups - far // (SPARE + 1) - int((full.sum(axis=1) <= SPARE).sum())


def surplus(features: np.ndarray, sizes: Sizes) -> int:
    """The least number of signatures, of the first hash, that the set shares with any similar one; at least 1."""
    n = len(features)
    own, out = sizes.band(n), []
    for band in (own, own + 1):
        groups, far = sizes.cut(band)
        if groups:
            out.append(_surplus(_cells(features, groups, 0)[1], groups, min(far, n * (100 - sizes.percent) // sizes.percent)))
        else:
            out.append(1)
    return max(1, min(out))


def signatures(features: np.ndarray, sizes: Sizes) -> np.ndarray:
    """64-bit signatures of a non-empty set of distinct, sorted 64-bit features."""
    n = len(features)
    own = sizes.band(n)
    own_far = n * (100 - sizes.percent) // sizes.percent
    out = []
    for band in (own, own + 1):
        groups, far = sizes.cut(band)
        for seed in range(SEEDS if groups else 0):
            h, bounds = _cells(features, groups, seed)
            sums = np.zeros(n + 1, U)
            np.cumsum(mix(h + U(1)), dtype=U, out=sums[1:])
            content = (sums[bounds[1:]] - sums[bounds[:-1]]).reshape(groups, PARTS)
            full = (np.diff(bounds) > 0).reshape(groups, PARTS)
            for k, subset in enumerate(_SUBSETS):
                some = full[:, subset].any(axis=1)
                value = sum(content[:, p] * _ODD[i] for i, p in enumerate(subset))
                salt = mix(np.arange(groups, dtype=U) * U(PARTS) + U(k) + U((band << 40) + (seed << 34) + 7))
                out.append(mix(value + salt)[some])
            if _surplus(bounds, groups, min(far, own_far)) > 0:
                break
        else:  # equal sets only, or a set that no cut suits: it meets all such sets of the instance
            out.append(mix(np.array([(band << 40) + 1], U) + (U(0) if groups else np.sum(mix(features), dtype=U))))
    return np.concatenate(out)


def sketch(features: np.ndarray, fine: int = 2) -> bytes:
    """A bit for each hash class that holds a feature, of ``fine`` to twice as many classes a feature."""
    classes = 1 << max(6, (fine * len(features) - 1).bit_length())
    held = np.zeros(classes, np.uint8)
    held[(features & U(classes - 1)).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def _fold(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch over ``size`` words that the same features would have."""
    return np.bitwise_or.reduce(words.reshape(*words.shape[:-1], -1, size), axis=-2)


def _most_common(p: np.ndarray, q: np.ndarray, n, m):
    """A bound of the intersections: a class held by one set alone is a feature that the other lacks."""
    lacks = lambda x, y: np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - lacks(p, q), m - lacks(q, p))


def feature_sets(column: pa.Array, k: int, salt: int = 0):
    """For each row of a text column: its number and its sorted distinct shingle hashes."""
    for lo, scan in scans(column, lower=True, salt=salt):
        begin, hashes = scan.windows(k)
        bounds, whole = np.searchsorted(begin, scan.first), scan.shorter(k)
        for i in range(scan.n_rows):
            if i in whole:
                yield lo + i, np.array([whole[i]], U)
            else:
                own = np.sort(hashes[bounds[i] : bounds[i + 1]])
                yield lo + i, own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def _nodes(k: int, percent: int):
    def run(batches):
        sizes = Sizes(percent)
        for b in runs(batches):
            n, extra, sk = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for i, own in feature_sets(b.column("text"), k):
                n[i] = len(own)
                if len(own):
                    extra[i], sk[i] = surplus(own, sizes), sketch(own)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(extra), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "surplus", "sketch"])

    return run


def _packed(k: int, percent: int, buckets: int):
    """Rows (bucket, docs, counts, sigs) of packed arrays; a set met before in the task gives a copy row instead."""

    def run(batches):
        sizes, seen = Sizes(percent), {}
        for b in runs(batches):
            ids = b.column("doc_id")
            docs, sets, copies = [], [], []
            data, offsets = utf8(b.column("text"))
            data = lowered(data)
            for i, own in feature_sets(b.column("text"), k):
                if not len(own) or not ids[i].is_valid:
                    continue
                doc, key = ids[i].as_py(), hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                if key in seen:
                    copies.append((seen[key], doc))
                    continue
                seen[key] = doc
                docs.append(doc)
                sets.append(signatures(own, sizes))
            out = {"bucket": [], "docs": [], "counts": [], "sigs": []}
            if sets:
                sigs = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                bucket = ((sigs >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                order = np.lexsort((owner, bucket))
                sigs, owner, bucket = sigs[order], owner[order], bucket[order]
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                names = np.array(docs, np.int64)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    who, count = np.unique(owner[lo:hi], return_counts=True)
                    out["bucket"].append(int(bucket[lo]))
                    out["docs"].append(names[who].tobytes())
                    out["counts"].append(count.astype("<u4").tobytes())
                    out["sigs"].append((sigs[lo:hi] & U(0xFFFFFFFF)).astype("<u4").tobytes())
            if copies:
                pairs = np.array(copies, np.int64)
                out["bucket"].append(-1 - int(pairs[0, 0]) % buckets)
                out["docs"].append(pairs[:, 0].tobytes())
                out["counts"].append(pairs[:, 1].tobytes())
                out["sigs"].append(b"")
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64())] + [pa.array(out[c], pa.binary()) for c in ("docs", "counts", "sigs")], ["bucket", "docs", "counts", "sigs"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The groups of documents that share a signature of this bucket, each distinct group once, with its number of signatures."""
    bucket = table.column("bucket")[0].as_py()
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    if bucket < 0:
        a, b = join("docs", np.int64), join("counts", np.int64)
        return pa.table({"members": pa.array(list(np.stack([a, b], axis=1)), pa.list_(pa.int64())), "times": pa.array([0] * len(a), pa.int64())})
    names, rank = np.unique(join("docs", np.int64), return_inverse=True)
    # a signature and the rank of its document in one number, sorted in place
    keys = join("sigs", "<u4").astype(U)
    keys <<= U(32)
    keys |= np.repeat(rank.astype(U), join("counts", "<u4"))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    sig = (keys >> U(32)).astype(np.uint32)
    same = sig[1:] == sig[:-1]
    grouped = np.append(same, False) | np.append(False, same) if len(sig) else np.zeros(0, bool)
    sig, rank = sig[grouped], (keys[grouped] & U(0xFFFFFFFF)).astype(np.int64)
    del keys, same, grouped
    if not len(sig):
        release()
        return pa.table({"members": pa.array([], pa.list_(pa.int64())), "times": pa.array([], pa.int64())})
    starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    sizes = np.diff(np.append(starts, len(sig)))
    # equal groups are found by a sum of hashes and told apart by their members
    sums = np.add.reduceat(mix(mix(names.view(U) + U(1)))[rank], starts) + sizes.astype(U)
    _, first, which, times = np.unique(sums, return_index=True, return_inverse=True, return_counts=True)
    like = first[which]
    other = sizes != sizes[like]
    full = np.flatnonzero(~other)
    differ = gather(rank, starts[full], sizes[full]) != gather(rank, starts[like[full]], sizes[full])
    other[full] = np.add.reduceat(differ, np.cumsum(sizes[full]) - sizes[full]) > 0
    odd = np.flatnonzero(other)
    pick = np.concatenate([first, odd])
    times = np.concatenate([times - np.bincount(which[odd], minlength=len(first)), np.ones(len(odd), np.int64)])
    values = names[gather(rank, starts[pick], sizes[pick])]
    members = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[pick]))), pa.int32()), pa.array(values))
    release()
    return pa.table({"members": members, "times": pa.array(times, pa.int64())})


def _may_link(percent: int):
    """Keeps the pairs whose sketches allow the threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")), strict=True):
                keep.append(bool(allows(x, y, n, m, percent)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def allows(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    if not x or not y:
        return True
    p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    size = min(len(p), len(q))
    both = int(_most_common(_fold(p, size), _fold(q, size), n, m))
    return 100 * both >= percent * (n + m - both)


def _met(which: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: np.ndarray, n: int, most: int = 1 << 22):
    """Pairs (x < y) of ``n`` members that stand in one group, each once, in arrays of bounded size.

    which: the members of consecutive groups, ascending in each; side: 0, or in a group of two blocks
    0 for the first block's and another number for the second's, and then only pairs of both count.
    """
    sizes = ends - starts
    if int((sizes * sizes).sum()) * 8 < n * n:
        keys = []
        for size in np.unique(sizes[sizes > 1]).tolist():
            left, right = np.triu_indices(size, 1)
            at = starts[sizes == size][:, None]
            p, q = (at + left).ravel(), (at + right).ravel()
            keys.append(which[p] * n + which[q])
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield key // n, key % n
        return
    meets = np.zeros((n, n), bool)
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        own, second = which[lo:hi], side[lo:hi] != 0
        if second.any():
            meets[np.ix_(own[~second], own[second])] = True
            meets[np.ix_(own[second], own[~second])] = True
        else:
            meets[np.ix_(own, own)] = True
    step = max(1, most // n)
    for lo in range(0, n, step):
        x, y = np.nonzero(meets[lo : lo + step])
        x += lo
        yield x[x < y], y[x < y]


def _bounded(a: np.ndarray, b: np.ndarray, ns: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which of the row pairs (a, b) may link by their sketches."""
    length = np.fromiter(map(len, sketches), np.int64, len(sketches))
    place, table = np.zeros(len(sketches), np.int64), {}
    for size in np.unique(length).tolist():
        own = np.flatnonzero(length == size)
        place[own] = np.arange(len(own))
        table[size] = np.frombuffer(b"".join([sketches[i] for i in own.tolist()]), "<u8").reshape(len(own), size // 8)
    keep = np.ones(len(a), bool)
    kinds = length[a] << 32 | length[b]
    for kind in np.unique(kinds).tolist():
        x, y = kind >> 32, kind & 0xFFFFFFFF
        if not x or not y:
            continue
        size = min(x, y)
        of = np.flatnonzero(kinds == kind)
        for lo in range(0, len(of), max(1, (1 << 24) // max(x, y))):
            at = of[lo : lo + max(1, (1 << 24) // max(x, y))]
            p, q = table[x][place[a[at]]], table[y][place[b[at]]]
            if x != y:
                p, q = _fold(p, size // 8), _fold(q, size // 8)
            both = _most_common(p, q, ns[a[at]], ns[b[at]])
            keep[at] = 100 * both >= percent * (ns[a[at]] + ns[b[at]] - both)
    return keep


def _across(percent: int):
    """Of some groups of one first member: the pairs of documents of different components that may link, each once.

    The groups come as ids; their documents' sizes, components and sketches come once, beside them.
    """

    def run(docs: pa.Table, groups: pa.Table) -> pa.Table:
        docs, groups = docs.sort_by("doc_id"), groups.sort_by([("gid", "ascending"), ("doc_id", "ascending")])
        known, ns, cs = (docs.column(c).to_numpy() for c in ("doc_id", "n_shingles", "component"))
        gid, doc, block, i, j = (groups.column(c).to_numpy() for c in ("gid", "doc_id", "block", "i", "j"))
        side = np.where(i == j, 0, block - i)
        cut = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(gid))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(cut):
            # all groups at once if their documents are few, so that each pair is looked at once
            hi = len(cut) if len(known) <= 2 * BLOCK else max(lo + 1, int(np.searchsorted(ends, cut[lo] + 2 * BLOCK, "right")))
            at = slice(int(cut[lo]), int(ends[hi - 1]))
            names, which = np.unique(doc[at], return_inverse=True)
            row = np.searchsorted(known, names)
            few, n, c = docs.column("sketch").take(pa.array(row)).to_pylist(), ns[row], cs[row]
            for x, y in _met(which, cut[lo:hi] - at.start, ends[lo:hi] - at.start, side[at], len(names)):
                small = np.minimum(n[x], n[y])
                ok = (c[x] != c[y]) & ((100 * small >= percent * np.maximum(n[x], n[y])) | (small == 0))
                x, y = x[ok], y[ok]
                keep = _bounded(x, y, n, few, percent)
                left.append(names[x[keep]])
                right.append(names[y[keep]])
            if sum(map(len, left)) > GIVEN:
                left, right = _once(left, right)
            lo = hi
        left, right = _once(left, right)
        release()
        return pa.table({"a": left[0], "b": right[0]})

    return run


def _once(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return [pairs[:, 0]], [pairs[:, 1]]


def _features(k: int):
    def run(batches):
        for b in runs(batches):
            sets = [None] * b.num_rows
            for i, own in feature_sets(b.column("text"), k, salt=1):
                sets[i] = own.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "features"])

    return run


def _profiles(k: int):
    """Sizes and fine sketches."""

    def run(batches):
        for b in runs(batches):
            n, sk = np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for i, own in feature_sets(b.column("text"), k):
                n[i], sk[i] = len(own), sketch(own, FINE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "sketch"])

    return run


def _some(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of distinct ids, which are broadcast if they are few."""
    ids = materialise(ids, "jaccard-used")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, "doc_id")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets."""
    pairs = materialise(pairs, "jaccard-pairs")
    used = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = _some(docs, used).mapInArrow(_features(k), "doc_id long, features array<bigint>")
    sets = materialise(sets, "jaccard-sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("features").alias("fb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("features").alias("fa")), "a")
    common = F.size(F.array_intersect("fa", "fb")).cast("long")
    return both.filter(100 * common >= percent * (F.size("fa") + F.size("fb") - common)).select("a", "b")


def thinned(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gid, doc_id): the memberships that are left after sets have left the groups that their surplus lets them leave."""
    rows = groups.select(F.xxhash64("members", F.size("members")).alias("gid"), "members", "times").groupBy("gid").agg(F.first("members").alias("members"), F.sum("times").alias("times"))
    rows = rows.select("gid", F.size("members").alias("size"), "times", F.explode("members").alias("doc_id"))
    extra = nodes.groupBy("doc_id").agg(F.min("surplus").alias("surplus"))
    own = Window.partitionBy("doc_id")  # as many rows as a document has signatures, at most
    rows = rows.join(extra, "doc_id").withColumn("shared", F.sum("times").over(own))
    left = F.sum("times").over(own.orderBy(F.desc("size"), "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("left", left).filter((F.col("shared") >= F.col("surplus")) & (2 * F.col("left") > F.col("surplus") - 1))
    return rows.select("gid", "doc_id")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links of at least ``percent`` % Jaccard similarity.

    buckets: parts of the signature space, each sorted in one task's memory; by default their number
    follows the bytes of the texts, which are counted first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = buckets or max(partitions(spark), -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    nodes = materialise(docs.mapInArrow(_nodes(k, percent), "doc_id long, n_shingles long, surplus long, sketch binary"), "jaccard-nodes")
    packed = docs.mapInArrow(_packed(k, percent, buckets), "bucket long, docs binary, counts binary, sigs binary")
    groups = packed.groupBy("bucket").applyInArrow(_shared, "members array<bigint>, times long")
    groups = materialise(groups, "jaccard-groups")
    certain = groups.filter("times = 0").select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"))
    size = nodes.filter("doc_id is not null")
    members = materialise(thinned(groups.filter("times > 0"), size), "jaccard-members")
    first = members.groupBy("gid").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).filter("size > 1")
    stars = members.join(first, "gid").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    told = stars.join(size.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    told = told.join(size.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
    likely = told.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).mapInArrow(_may_link(percent), "a long, b long").distinct()
    links = materialise(_verified(docs, likely, k, percent).union(certain), "jaccard-links")
    found = components(links, "jaccard")
    named = size.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = materialise(named, "jaccard-named")
    labelled = members.join(first, "gid").filter("size > 2").join(named, "doc_id")
    mixed = labelled.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("gid")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    spread = labelled.join(mixed, "gid").withColumnRenamed("a", "rep").select("rep", "gid", "size", "doc_id")
    deals = spread.groupBy("rep").agg(F.ceil(F.count("*") / TASK_ROWS).alias("deals"))  # a first member of very many groups is dealt to several tasks
    spread = spread.join(deals, "rep").withColumn("deal", F.pmod(F.xxhash64("gid"), F.col("deals")))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    spread = materialise(spread.select("rep", "deal", "i", "j", "gid", "block", "doc_id"), "jaccard-spread")
    key = ["rep", "deal", "i", "j"]
    # rows that share an id and differ have no one size or sketch: theirs are left empty, which rules nothing out
    one = F.count_distinct("n_shingles", "sketch") == 1
    fine = _some(docs, spread.select("doc_id").distinct()).mapInArrow(_profiles(k), "doc_id long, n_shingles long, sketch binary")
    profile = fine.groupBy("doc_id").agg(F.when(one, F.max("n_shingles")).otherwise(F.lit(0)).alias("n_shingles"), F.when(one, F.max("sketch")).otherwise(F.lit(b"")).alias("sketch"))
    beside = spread.select(*key, "doc_id").distinct().join(profile, "doc_id").join(named, "doc_id")
    beside = beside.select(*[F.col(c).alias(c) for c in beside.columns])
    cross = beside.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(_across(percent), "a long, b long").distinct()
    more = _verified(docs, cross.join(links, ["a", "b"], "left_anti"), k, percent)
    more = more.join(named.select(F.col("doc_id").alias("a"), F.col("component").alias("ca")), "a").join(named.select(F.col("doc_id").alias("b"), F.col("component").alias("cb")), "b")
    merged = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "jaccard-merge").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = named.join(merged, "component", "left").select("doc_id", F.coalesce("merged", "component").alias("component_id"))
    return nodes.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", "component_id")
