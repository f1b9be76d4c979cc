"""The pipeline's stages take effect in what it returns."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import mixing, packing

from lodestone.llm import pii, quality_rules

from .cases import DOCS, components, documents
from .test_operators import check_packing, mixed_by_hand, quality_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of over half a sequence each, so that every document has a sequence of its own; one source has three times the other's."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(rng.randint(720, 780))), "en", f"s{int(i % 4 == 0)}", 5000, "h", "k", 1) for i in range(600)]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d, rows


def in_sequence_order(found):
    return [r.doc_id for r in sorted(found, key=lambda r: (r.sequence_id, r.offset))]


def test_sequences_follow_the_mix(spark, tables):
    d, rows = tables
    found = corpus_pipeline.run(spark, d).collect()
    assert len(found) == len({r.sequence_id for r in found}) == len(rows) and all(r.length > packing.CAPACITY // 2 for r in found)
    want, _ = mixed_by_hand(rows, mixing.BLOCK, mixing.FRAME)
    assert in_sequence_order(found) == [r[0] for r in want]


def test_packing_follows_an_order(spark):
    rows = documents()
    places = random.Random(1).sample(range(len(rows)), len(rows))
    docs = spark.createDataFrame([(*r, p) for r, p in zip(rows, places, strict=True)], DOCS + ", place long").repartition(3)
    found = packing.best_fit_packing(docs, capacity=64, open_bins=8, order="place")
    assert found.columns == packing.best_fit_packing(docs, capacity=64, open_bins=8).columns
    found = found.collect()
    used, least = check_packing(found, [(r[0], r[1]) for r in rows], 64)
    assert used <= least * 1.08 + 2
    of = defaultdict(set)
    for r, p in zip(rows, places, strict=True):
        of[r[0]].add(p)
    known = [r for r in found if len(of[r.doc_id]) == 1]
    first = {r.sequence_id: (*of[r.doc_id], r.piece) for r in known if r.offset == 0}
    assert [first[k] for k in sorted(first)] == sorted(first.values())
    assert all((*of[r.doc_id], r.piece) >= first[r.sequence_id] for r in known if r.sequence_id in first)
    assert max(Counter(r.sequence_id for r in found).values()) > 1


def by_hand(rows):
    """The documents that the first three stages leave, and the order of the fourth."""
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(quality_of(r[1])[-1])
    m = sum(map(sum, hosts.values())) / len(rows)
    v = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / len(rows) - m * m
    strength = max(1.0, m * (1 - m) / v - 1) if v > 1e-12 else len(rows)
    kept = [r for r in rows if not quality_of(r[1])[-1] and (sum(hosts[r[3]]) + m * strength) / (len(hosts[r[3]]) + strength) <= quality_rules.HOST_RATE]
    group = components(kept)
    kept = [r for r in kept if group[r[0]][1] == r[0]]
    field = pii.trained()
    return [(r[0], pii.masked(r[1], field), *r[2:]) for r in kept]


def test_pipeline_against_brute_force(spark, tmp_path):
    secret = " ".join(f"word{i}" for i in range(60)) + " write to joe@example.com or call +1 (743) 555-3824 now"
    rows = [(*r[:3], r[3] or "s9", *r[4:]) for r in documents(150, 7)] + [(500, secret, "en", "s1", 1, "h", "k", 1), (501, None, "en", "s1", 1, "h", "k", 1)]
    rows += [(600 + i, "spam", "en", "spam", 4, "h", "k", 1) for i in range(60)] + [(700, secret.replace("word", "other"), "en", "spam", 1, "h", "k", 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = by_hand(rows)
    assert {500} <= {r[0] for r in left} and not {501, 600, 700} & {r[0] for r in left} and len(left) < len(rows)
    used, least = check_packing(found, [(r[0], r[1]) for r in left], packing.CAPACITY)
    assert used <= least + 4
    want, _ = mixed_by_hand(left, mixing.BLOCK, mixing.FRAME)
    place = {r[0]: r[4] for r in want}
    first = {r.sequence_id: place[r.doc_id] for r in found if r.offset == 0}
    assert [first[k] for k in sorted(first)] == sorted(first.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
