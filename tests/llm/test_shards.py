import math
import struct
import zlib
from collections import Counter

import xxhash

from tests.llm.helpers import ODD_TEXTS
from tagsieve.llm import shards


def placed(spark, tree, n=4000):
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    return {r.doc_id: r.s for r in shards.shard_of(rows, "doc_id", tree, "s").collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = shards.layout(24)
    before, after = placed(spark, tree), placed(spark, shards.grow(tree))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(after[k] == 24 for k in moved)
    assert len(moved) / len(before) < 0.08
    assert set(before.values()) == set(range(24))


def test_movement_stays_within_changed_subtrees(spark):
    tree = shards.layout(24)
    heavier = tuple(shards.Shard(s.number, s.region, s.rack, 2.0) if s.number == 5 else s for s in tree)
    before, after = placed(spark, tree), placed(spark, heavier)
    where = {s.number: s for s in tree}
    for key in before:
        old, new = where[before[key]], where[after[key]]
        if old != new:
            assert new.region == "region0"
            assert old.region != "region0" or new.rack == "rack1"
            assert (old.region, old.rack) != ("region0", "rack1") or new.number == 5


def descended(key, tree):
    """The shard of a key, drawn level by level."""

    def draw(name, weight):
        first = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        bits = xxhash.xxh64_intdigest(name.encode(), seed=first) >> 11
        return -math.log((bits + 0.5) / 2**53) / weight

    def lightest(groups):
        return min(groups, key=lambda name: draw(name, sum(s.weight for s in groups[name])))

    held = list(tree)
    for name_of in (lambda s: s.region, lambda s: f"{s.region}/{s.rack}", lambda s: f"shard{s.number}"):
        groups = {}
        for s in held:
            groups.setdefault(name_of(s), []).append(s)
        held = groups[lightest(groups)]
    return held[0].number


def test_places_equal_draws_made_one_by_one(spark):
    uneven = tuple(shards.Shard(i, f"r{i % 3}", f"k{i % 2}", 0.5 + i) for i in range(11))
    for tree in (shards.layout(24), shards.grow(shards.layout(24)), uneven):
        found = placed(spark, tree, 1500)
        assert found == {key: descended(key, tree) for key in range(1500)}


def test_weights_are_followed(spark):
    tree = tuple(shards.Shard(i, f"r{i % 2}", "k", float(w)) for i, w in enumerate([1, 2, 3, 4, 0]))
    counts = Counter(placed(spark, tree, 20_000).values())
    assert 4 not in counts
    for i, w in enumerate([1, 2, 3, 4]):
        assert abs(counts[i] / 20_000 - w / 10) < 0.02


def test_sizes_slots_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 3)
    monkeypatch.setattr(shards, "REPEAT_CHUNK", 4)
    rows = [(i, t, 1) for i, t in enumerate(ODD_TEXTS)] + [(7, "again", 2)] * 30 + [(None, "n", 3)] * 2 + [(i, "s", 4) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    found = shards.assign(docs, "doc_id", "text", shards.layout(5)).collect()
    size = lambda t: len((t or "").encode()) + 8
    expected = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected
    for shard in range(5):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id == 7}) == 1
    assert shards.assign(docs.limit(0), "doc_id", "text", shards.layout(5)).count() == 0
