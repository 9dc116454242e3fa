import random

import pytest
import xxhash

from tests.llm.helpers import ODD_TEXTS, blank_words
from tagsieve.llm import simhash


def plain_print(text):
    words = blank_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    texts = [*ODD_TEXTS, "One two  three\tFOUR", "ä Ö ü", "a b", "x y z x y z x y z"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def families(rng):
    """Chains and crowds of near fingerprints, and strangers."""
    found = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):
            found.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    x = rng.getrandbits(64)
    found |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    return found


@pytest.mark.parametrize(("crowd", "distance", "partitions"), [(32, 2, (1, 2, 3, 4)), (1, 2, (2,)), (4, 2, (3,)), (3, 3, (2, 4))])
def test_components_against_all_pairs(spark, monkeypatch, crowd, distance, partitions):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PARTITIONS", partitions)
    prints = families(random.Random(8))
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.links(table, distance)).collect()}
    expected = plain_components(prints, distance)
    groups, own = {}, {}
    for p, root in expected.items():
        groups.setdefault(root, set()).add(signed(p))
    for p in prints:
        own.setdefault(roots.get(signed(p), signed(p)), set()).add(signed(p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_allocation_covers_the_distance():
    import numpy as np

    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 10:30] = bits[:, :1]  # correlated
    both = bits.T @ bits
    for distance in (0, 1, 2, 3, 5):
        for n in (2000, 10**9):
            chosen = simhash.allocation(n, both * (n // 2000), distance)
            assert sum(t + 1 for _, t in chosen) == distance + 1
            places = [b for g, _ in chosen for b in g]
            assert len(places) == len(set(places))
    groups = simhash.grouped_bits(2000, both, 3)
    held = [len({0, *range(10, 30)} & set(g)) for g in groups]
    assert max(held) >= 20


def test_link_and_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, base, "other text of its own", None, "", base.upper(), *ODD_TEXTS]
    rows = [(i * 10, t, "x") for i, t in enumerate(texts)] + [(20, "other text of its own", "x"), (None, "lonely words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = {plain_print(t) for _, t, _ in rows}
    roots = plain_components(prints, 2)
    lowest = {}
    for i, t, _ in rows:
        root = roots[plain_print(t)]
        lowest[root] = min(x for x in (lowest.get(root), i) if x is not None) if i is not None or root in lowest else None
    expected = sorted((str(i), signed(plain_print(t)), str(lowest[roots[plain_print(t)]])) for i, t, _ in rows)
    found = simhash.link(docs, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in found) == expected
    kept = simhash.keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, lowest.values()))


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in simhash.link(docs, "doc_id", "text").collect()] == [(1, 1)]
    assert simhash.link(docs.limit(0), "doc_id", "text").count() == 0
    assert simhash.keep_one(docs.limit(0), "doc_id", "text").count() == 0
