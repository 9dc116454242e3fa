import numpy as np
import pytest

from tagsieve.llm import negatives


def brute(rows, k=5, m=10, least=30, most=90):
    """rows: (id, label, vector) -> the expected rows, as a sorted list."""
    points = sorted({(i, lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, lab, v in rows})
    out = []

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    for a in points:
        if a[0] % 100:
            continue
        others = [(-dot(a[2], c[2]), c[0], c[1]) for c in points if c[0] != a[0]]
        for p, pid, _ in sorted(o for o in others if o[2] == a[1])[:k]:
            found = sorted((n, nid) for n, nid, lab in others if lab != a[1] and least * -p <= 100 * -n <= most * -p)
            out += [(a[0], pid, rank + 1, nid, -p, -n) for rank, (n, nid) in enumerate(found[:m])]
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, lab, v, 0) for i, lab, v in rows], "vec_id long, label int, embedding array<float>, id int")
    points = negatives.rows_of(table, "vec_id", "label", "embedding")
    return sorted(tuple(r) for r in negatives.mine(points, points.filter("id % 100 = 0"), **more).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"ANCHOR_ROWS": 4, "CANDIDATE_ROWS": 90, "BLOCKS_IN_TASK": 2, "SLICE": 16, "BUCKETS": 3}.items():
        monkeypatch.setattr(negatives, name, value)


def clustered(n=900, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 6))
    labels = rng.choice(5, n, p=[0.4, 0.2, 0.2, 0.1, 0.1])  # a hot label
    return [(i * 4, int(lab), (centers[lab] + rng.normal(size=6) * 0.6).astype(np.float32).tolist()) for i, lab in enumerate(labels)]


def test_equals_brute_force(spark, small_blocks):
    rows = clustered()
    rows += [(i, 1, rows[0][2]) for i in range(5001, 5200)]  # copies of a vector, another label
    rows += [(i, rows[25][1], rows[25][2]) for i in range(100_000, 100_040)]  # copies of an anchor
    rows += [(100, 3, rows[3][2]), (100, 3, rows[4][2]), (7, 0, rows[9][2]), (7, 0, rows[9][2])]  # repeated ids and rows
    rng = np.random.default_rng(2)
    rows += [(8001 + i, int(rng.integers(0, 5)), rng.integers(0, 2, 6).astype(float).tolist()) for i in range(200)]  # ties
    expected = brute(rows)
    assert len(expected) > 500
    assert found(spark, rows) == expected


def test_other_numbers_and_one_block(spark):
    rows = clustered(500, 3)
    assert found(spark, rows, positives=2, negatives=3, least=10, most=100) == brute(rows, 2, 3, 10, 100)


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 2.0]), (100, 1, [1.0, 1.0]), (3, 2, [0.5, 0.5]), (4, 2, [0.25]), (5, 1, []), (200, 2, [-1.0, 0.0]), (6, 2, [-2.0])]
    bad = [(None, 1, [1.0, 1.0]), (7, None, [1.0, 1.0]), (8, 2, None), (9, 2, [1.0, None]), (10, 2, [nan, 1.0]), (11, 2, [inf, 1.0])]
    assert found(spark, good + bad) == brute(good) != []
    assert found(spark, bad) == [] and found(spark, []) == []
    assert found(spark, [(0, 1, [1.0])]) == [] and found(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [0.0]), (1, 1, [1.0]), (2, 2, [3.0])]) == [(0, 1, 1, 2, 0, 0)]  # a window of zero only


def test_large_products_stay_exact(spark):
    big = float(1 << 22)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 2.0]), (2, 2, [big / 2, 3.0]), (3, 2, [big / 2, 3.0 + 1 / 256]), (4, 2, [big / 2, 2.0])]
    assert found(spark, rows) == brute(rows) != []


def test_tree_and_bounds():
    rng = np.random.default_rng(7)
    points = np.repeat(rng.normal(size=(10, 8)) * 300, 12, axis=0) + rng.normal(size=(120, 8)) * 4
    points = points.astype(np.int64)
    order, parent, edge = negatives.spanning_tree(points.astype(float))
    place = {int(a): i for i, a in enumerate(order)}
    assert sorted(order) == list(range(120)) and (parent < 0).sum() == 1
    assert all(parent[a] < 0 or place[int(parent[a])] < place[a] for a in range(120))
    gaps = [np.linalg.norm(points[a] - points[parent[a]]) for a in range(120) if parent[a] >= 0]
    assert np.allclose(gaps, [edge[a] for a in range(120) if parent[a] >= 0])
    assert sorted(gaps)[-10] < 100  # only edges between the ten groups are long
    rows = (rng.normal(size=(5000, 8)) * 300).astype(np.int64)
    anchors = {"ids": -np.arange(120), "labels": np.zeros(120), "rows": points, "order": order, "parent": parent, "edge": edge}
    candidates = {"ids": np.arange(5000) + 1, "labels": np.zeros(5000), "rows": rows}
    walks = []
    walk = negatives.Walk

    class Counted(walk):
        def __init__(self, *x):
            super().__init__(*x)
            walks.append(self)

    negatives.Walk = Counted
    try:
        hits = negatives.find_positives(anchors, candidates, 5)
    finally:
        negatives.Walk = walk
    for a in (0, 50, 119):
        scores = rows @ points[a]
        best = sorted(zip((-scores).tolist(), range(1, 5001)))[:5]
        assert [(-s, i) for at, s, i in hits if at == a] == best
    assert walks[0].scored < 0.5 * 120 * 5000  # most candidates were bounded away


def test_same_as_sql(spark, tmp_path):
    import duckdb

    from tagsieve.llm.oracles import OP12
    from tagsieve.llm.queries import op12_hard_negatives

    rows = [(i, lab * 2, v) for i, lab, v in clustered(700, 5)] + [(5, 3, None), (400, None, [1.0] * 6), (300, 1, [2.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert got == sorted(duck.sql(f"select {names} from ({OP12})").fetchall()) != []
