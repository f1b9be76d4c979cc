"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source's documents, in the order of a hash of their ids, are cut into blocks. A source of whole
weight w, of the sum W of all weights, releases its j-th block (from 0) at slot floor(j W / w) and must
place it before slot ceil((j + 1) W / w). Each slot goes to the released block of earliest deadline.

The schedule is worked out by frames, each in a row of its own, so frames run in parallel. At a frame's
first slot T a source has placed floor(T w / W) blocks, or one more if it is among those whose next
block is furthest on: as many of these as make T in all. So the counts at a frame's ends need no earlier
frame, and between them earliest-deadline-first takes the blocks with the releases and deadlines of the
whole schedule. A frame has ``frame`` slots, or as many as give the lightest source one, so
counts never fall from frame to frame, and no source is ever a whole block before or behind its target
weight. When a source has no block left its slots close up, and the others keep their proportions.

No window holds a whole source: documents are ranked within hash buckets of a source, and the
buckets' counts give the offsets, so a hot source is spread over all tasks. A frame's row lists the
sources, one entry each; its work grows with its slots times the sources that are in it.

Defined cases: documents with a null source are a source of their own; those with a null doc_id
come in the place of the hash of ``null``; rows that repeat get a place each; an empty table gives an
empty result; other columns are ignored by ``mixing_order`` and kept by ``mix_documents``; texts, of
whatever length, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, FRAME, DIGITS = 64, 256, 3
#: millionths of the whole that a source has at least where targets are given by name
LEAST = 1000


def root_weight() -> Column:
    """Default target: the square root of a source's number of documents, in thousandths."""
    return F.floor(F.sqrt(F.col("n_docs").cast("double")) * 1000).cast("long")


def target_weights(targets: dict[str, float]) -> Column:
    """Target shares given by name, in millionths; a source without one, or of a lesser one, gets ``LEAST``."""
    out = F.lit(0).cast("long")
    for name, share in targets.items():
        out = F.when(F.col("source_key") == "=" + name, F.lit(round(share * 1e6)).cast("long")).otherwise(out)
    return F.greatest(out, F.lit(LEAST).cast("long"))


def frames(sources: DataFrame, weight: Column, block: int, frame: int) -> DataFrame:
    """(frame, s): a row a frame that has blocks, with an entry for each source that has blocks in it.

    An entry has source_key, w, all (the sum of weights), a (blocks placed before the frame), q (blocks
    in it) and n_docs. sources has a row a source.
    """
    weighed = sources.withColumn("w", F.greatest(weight, F.lit(1).cast("long"))).withColumn("blocks", F.expr(f"(n_docs + {block - 1}) div {block}L"))
    listed = weighed.agg(F.sort_array(F.collect_list(F.struct("source_key", "w", "blocks", "n_docs"))).alias("s"), F.sum("w").alias("all"), F.min("w").alias("least")).filter("all is not null")
    listed = listed.withColumn("slots", F.expr(f"greatest({frame}L, (`all` + least - 1) div least)"))
    last = "array_max(transform(s, x -> x.blocks * `all` div x.w)) div slots"
    each = listed.select("s", "all", "slots", F.explode(F.expr(f"sequence(0L, {last})")).alias("frame"))
    each = each.repartition("frame").withColumn("t", F.expr("frame * slots"))
    # blocks placed by every source before a slot: whole ones, and one more of those up to the last that is counted on;
    # transform(array(x), y -> ...)[0] computes x once
    def placed(at: str) -> str:
        whole = f"aggregate(s, 0L, (n, x) -> n + {at} * x.w div `all`)"
        others = f"array_sort(filter(transform(s, (x, i) -> named_struct('on', -({at} * x.w % `all`), 'i', i)), y -> y.on < 0))"
        one = f"if(coalesce(named_struct('on', -({at} * x.w % `all`), 'i', i) <= last and {at} * x.w % `all` > 0, false), 1L, 0L)"
        return f"transform(array(get({others}, cast({at} - {whole} as int) - 1)), last -> transform(s, (x, i) -> {at} * x.w div `all` + {one}))[0]"

    entry = "named_struct('source_key', x.source_key, 'w', x.w, 'all', `all`, 'a', g.a[i], 'q', least(g.z[i], x.blocks) - g.a[i], 'n_docs', x.n_docs)"
    entries = f"transform(array(named_struct('a', {placed('t')}, 'z', {placed('(t + slots)')})), g -> filter(transform(s, (x, i) -> {entry}), x -> x.q > 0))[0]"
    return each.select("frame", "slots", "t", F.expr(entries).alias("s")).filter("size(s) > 0")


def schedule(framed: DataFrame) -> DataFrame:
    """(frame, frame_slot, slot, source_key, block, n_docs): the earliest-deadline-first order of each frame's blocks."""
    state = "named_struct('c', transform(s, x -> x.a), 'p', cast(array() as array<struct<i: int, block: bigint>>))"
    open_ = "filter(transform(s, (x, i) -> named_struct('wait', greatest(st.c[i] * x.`all` div x.w - k, 0L), 'deadline', ((st.c[i] + 1) * x.`all` + x.w - 1) div x.w, 'i', i, 'left', x.a + x.q - st.c[i])), x -> x.left > 0)"
    step = f"transform(array(array_min({open_}).i), pick -> named_struct('c', transform(st.c, (n, i) -> if(i = pick, n + 1L, n)), 'p', concat(st.p, array(named_struct('i', pick, 'block', st.c[pick])))))[0]"
    picks = f"aggregate(sequence(t, t + aggregate(s, 0L, (n, x) -> n + x.q) - 1L), {state}, (st, k) -> {step}, st -> st.p)"
    rows = framed.select("frame", "t", "s", F.posexplode(F.expr(picks)).alias("frame_slot", "p"))
    return rows.select("frame", F.col("frame_slot").cast("long").alias("frame_slot"), (F.col("t") + F.col("frame_slot")).alias("slot"), F.expr("s[p.i].source_key").alias("source_key"), F.expr("p.block").alias("block"), F.expr("s[p.i].n_docs").alias("n_docs"))


def mixing_order(docs: DataFrame, weight: Column | None = None, block: int = BLOCK, frame: int = FRAME, digits: int = DIGITS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, block, slot, position): each document's block in its source, the block's slot, and its place in the mix."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    keyed = docs.select(*(keep or ["doc_id", "source"]), key.alias("source_key"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("mix_hash"))
    keyed = keyed.withColumn("mix_bucket", F.substring("mix_hash", 1, digits))
    counts = keyed.groupBy("source_key", "mix_bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_key").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_key", "mix_bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source_key", "mix_bucket").orderBy("mix_hash", "doc_id")) - 1
    ranked = keyed.withColumn("within", within).join(offsets, ["source_key", "mix_bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.withColumn("block", F.expr(f"rank div {block}L")).withColumn("in_block", F.expr(f"rank % {block}L"))

    sources = counts.groupBy("source_key").agg(F.sum("n").alias("n_docs"))
    placed = schedule(frames(sources, root_weight() if weight is None else weight, block, frame))
    placed = placed.withColumn("size", F.expr(f"least({block}L, n_docs - block * {block}L)"))
    sizes = placed.groupBy("frame").agg(F.sum("size").alias("n"))
    earlier = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)  # a row a frame: some 1 / (block * frame) of the rows
    starts = sizes.select("frame", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("frame").orderBy("frame_slot").rowsBetween(Window.unboundedPreceding, -1)
    based = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "frame")
    based = based.select("source_key", "block", "slot", (F.col("start") + F.col("inside")).alias("base"))
    out = ranked.join(based, ["source_key", "block"])
    return out.select(*(keep or ["doc_id", "source"]), "block", "slot", (F.col("base") + F.col("in_block")).alias("position"))


def mix_documents(docs: DataFrame, weight: Column | None = None, block: int = BLOCK, frame: int = FRAME, position: str | None = None) -> DataFrame:
    """The documents with their own columns, in mixed order: range partitions of positions, sorted within.

    ``position`` names a further column for each document's place in the mix, which later steps can follow.
    """
    names = docs.columns
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    order = mixing_order(packed, weight, block, frame, keep=["doc_id", "source", "row"])
    laid = order.repartitionByRange("position").sortWithinPartitions("position")
    place = [F.col("position").cast("long").alias(position)] if position else []
    return laid.select(*[F.col("row").getField(c).alias(c) for c in names], *place)
