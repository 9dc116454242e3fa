
import numpy as np
import pytest

from tagsieve.llm import mtree


def brute(rows, k):
    """rows: {id: vector}, or (id, vector) with queries of unlike ids."""
    rows = list(rows.items()) if isinstance(rows, dict) else rows
    points = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows]
    out = set()
    for q, at in points:
        if q % 50:
            continue
        n = lambda a, b: sum(x * y for x, y in zip(a.tolist(), b.tolist()))
        best = sorted(((-n(at, v), i) for i, v in points if i != q))[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


def found(spark, rows, k=5):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    points = mtree.points(table, "vec_id", "embedding")
    result = mtree.search(points, points.filter("id % 50 = 0"), k)
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect()]


@pytest.fixture
def small_pages(monkeypatch):
    for name, value in {"TREE_ROWS": 120, "LEAF": 8, "FANOUT": 4, "QUERY_BLOCK": 5}.items():
        monkeypatch.setattr(mtree, name, value)


def test_many_trees_copies_and_ties(spark, small_pages):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    rows = {i: (centers[i % 6] + rng.normal(size=8) * 0.3).astype(np.float32).tolist() for i in range(700)}
    rows |= {i: rows[3] for i in range(700, 950)}  # one vector has over a quarter of the rows
    rows |= {i: np.sign(rng.normal(size=8)).tolist() for i in range(1000, 1100)}  # many equal scores
    result = found(spark, [(i, v, "x") for i, v in rows.items()])
    assert len(result) == len(set(result)) and set(result) == brute(rows, 5)


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], None), (50, [0.5, -1.0], None), (1, None, None), (2, [1.0, None], None), (3, [nan, 1.0], None),
        (4, [inf, 1.0], None), (None, [1.0, 1.0], None), (5, [1.0, 2.0], None), (5, [1.0, 2.0], None), (6, [0.25], None), (7, [], None),
    ]
    usable = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [0.25, 0.0]), (7, [0.0, 0.0])]
    assert set(found(spark, rows)) == brute(usable, 5)
    assert found(spark, rows[2:6]) == [] and found(spark, [(0, [1.0], None)]) == []
    assert found(spark, [(1, [1.0], None)]) == []


def test_repeated_ids_and_rows_are_as_in_sql(spark, small_pages, tmp_path):
    import duckdb

    from tagsieve.llm.oracles import OP4
    from tagsieve.llm.queries import op4_mtree_search

    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist()) for i in rng.integers(0, 160, 500)]
    rows += [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])] + [(50, [9.0, 9.0, 9.0, 9.0])] * 30 + [(50, [1.0, 2.0, 3.0, 3.0])] * 2
    rows += [(7, [8.0, 8.0, 8.0, 8.0])] * 9 + [(i, [7.0, 7.0, 7.0, 7.0]) for i in range(40, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op4_mtree_search(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"select query_id, rank, vec_id, score from ({OP4})").fetchall()) != []


def test_bounds_skip_pages():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 3, size=(400, 4)) for c in (-400, 0, 400)]).astype(np.int64)
    largest = float((points**2).sum(1).max())
    tree = mtree.Tree(np.arange(1200), points, largest)
    copy = mtree.Tree.load(tree.dump())
    q = points[7]
    scores = points @ q
    best = sorted(((-int(s), i) for i, s in enumerate(scores) if i != 7))[:5]
    assert copy.search(q, 7, 5, None) == [(-s, i) for s, i in best]


@pytest.mark.parametrize("scale", [256, 1 << 20, 1 << 28])
def test_queries_go_down_together_exactly(scale, monkeypatch):
    monkeypatch.setattr(mtree, "TOGETHER", 30)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(3000, 16))
    points = np.floor(scale * points / np.linalg.norm(points, axis=1)[:, None]).astype(np.int64)
    points[:40] = points[7]
    ids = rng.permutation(3000) // 2
    tree = mtree.Tree.load(mtree.Tree(ids, points, float((points**2).sum(1).max())).dump())
    queries, own = points[:100], ids[:100]
    bounds = np.sort(points @ queries.T, axis=0)[-4].copy()
    bounds[::3] = np.iinfo(np.int64).min
    place, score, found = tree.search_all(queries, own, 5, bounds)
    for j in range(100):
        scores = points @ queries[j]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != own[j] and s >= bounds[j])[:5]
        assert [(-int(s), int(i)) for s, i in zip(score[place == j], found[place == j])] == best


def test_trees_are_stored_small_and_few_in_a_file(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.floor(256 * rng.normal(size=(2000, 64)))
    tree = mtree.Tree(np.arange(2000), points.astype(np.int64), float((points**2).sum(1).max()))
    assert len(tree.dump()) < 2000 * 64 * 4
    monkeypatch.setattr(mtree, "TREES_IN_FILE", 3)
    rows = mtree._stored_trees(spark.range(10, numPartitions=1).selectExpr("string(id) tree", "1 pivot", "binary('x') pages"))
    assert rows.count() == 10 and len(rows.inputFiles()) == 4
