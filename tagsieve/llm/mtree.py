"""Exact top-k search by inner product in a forest of M-trees.

Vectors are scaled to integers. With M the largest squared norm, a vector x becomes the point
(x, sqrt(M - |x|^2)) and a query q the point (q, 0); then the squared distance is
|q|^2 + M - 2 q.x, so the largest inner products are the nearest points, and a metric tree
finds them.

Pivots, a bounded sample spread out by farthest-first choice, split the points into regions; a
region is dealt into trees of at most about ``TREE_ROWS`` rows by a hash of the id, counted
beforehand, so a crowded region becomes many trees. Each tree is built in a task: pages of at
most ``FANOUT`` routing objects, each with a covering radius and its distance to the parent
object, down to leaves of at most ``LEAF`` rows with their distances to the leaf's object.

A query first searches a tree of its nearest region, which gives it a bound; then all other
trees whose region may hold a better point. In a tree, queries go down together, ``TOGETHER`` at a
time: pages are visited best first, by the least distance any of their points can have from any query
that wants the page, and each query has its own reach. An entry whose stored parent distance already
shows, by the triangle inequality, that it is out of a query's reach is dropped for it before its distance
is computed. Bounds have a margin for rounding, and the best of
all trees are merged by a ranking that Spark limits before the shuffle. Scores are exact integers: a leaf's are one
product of matrices of floats where these hold every inner product exactly, else of 64-bit integers.

Of the copies of a vector only the k + 1 smallest ids are kept, and of equal rows k: no other copy can
be among the k best of a query. Queries go in blocks of ``QUERY_BLOCK``, and a tree is copied for each
block that wants it. Trees are stored in the smallest integers that hold their components, a few in a file,
as a file's rows are read at once.

Defined cases: null ids, null vectors and vectors with null or non-finite components take no
part; every other row counts, also equal ones and those of one id, whose queries are ranked together and
are never candidates of each other; vectors of unequal length are
compared over the components both have; ties go to the smaller id; a query without
candidates returns no row; an empty table gives no rows. Components must keep inner products
within 63 bits. Extra columns are not used.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.llm.common import shared_folder, stored

K = 5
SCALE = 256
TREE_ROWS = 16_384
LEAF = 512
FANOUT = 16
QUERY_BLOCK = 32_768
#: Queries that go down a tree together; with a leaf they make a matrix of LEAF times as many scores.
TOGETHER = 1024
#: Trees, each of about 2 to 8 MB, in a stored file.
TREES_IN_FILE = 8
MAX_PIVOTS = 256
#: Pivots are chosen among about so many rows for each pivot.
PIVOT_SAMPLE = 8

RESULT = "query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def points(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): the scaled vectors of all usable rows."""
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    return rows.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"))


def _few_equal(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, n): n, at most k, equal rows as one."""
    return rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))


def _unfolded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    lists = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.int64()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64, copy=False)
    out = np.zeros((len(lists), dim), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = flat
    return out


def _exact(largest: float) -> type:
    """The fastest numbers whose products and sums hold every inner product of vectors not longer than this exactly."""
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64


def _smallest(rows: np.ndarray) -> np.ndarray:
    """The same in the smallest integers that hold all components."""
    ends = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= ends[0] and ends[1] <= np.iinfo(k).max)
    return rows.astype(kind)


def _lifted(rows: np.ndarray, largest: float) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0.0))[:, None]])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From each row of x to the point y."""
    d = x - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _reach(base: np.ndarray, score: np.ndarray) -> np.ndarray:
    """How far at most a point with a score may be from a query, base being |query|^2 plus the largest squared norm; with a
    margin for what squares of far points lose in rounding."""
    return np.sqrt(np.maximum(base - 2.0 * score, 0.0)) * (1 + 1e-9) + 1e-7 * np.sqrt(base) + 1e-4


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row, the first of those that seem equally near after rounding, and the distance to it."""
    at = np.zeros(len(x), np.int64)
    halves = 0.5 * (centers * centers).sum(1)
    for start in range(0, len(x), 4096):
        at[start : start + 4096] = (halves - x[start : start + 4096] @ centers.T).argmin(1)
    return at, _distances(x, centers[at])


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Rows chosen farthest first."""
    chosen = [0]
    far = _distances(x, x[0])
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1]]))
    return x[chosen]


#: Less than any score; a power of two, so every kind of number holds it.
_OPEN = -(1 << 63)


def _merge(best: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Takes found (query, score, id) into best, the scores and ids of each query's k best in order, which
    begin as ``_OPEN`` and -1; the queries it found something for."""
    query, score, ids = found
    some, at = np.unique(query, return_inverse=True)
    held = best[0][some] > _OPEN
    at = np.concatenate([np.nonzero(held)[0], at])
    score, ids = np.concatenate([best[0][some][held], score]), np.concatenate([best[1][some][held], ids])
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    best[0][some[at[kept]], place[kept]], best[1][some[at[kept]], place[kept]] = score[kept], ids[kept]
    return some


class Tree:
    """Pages of an M-tree. Inner page: objects, radii, parent distances, child pages. Leaf:
    first row, end row; rows are stored in leaf order with their distance to the leaf's object."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: float):
        self.ids, self.rows, self.largest = ids, rows, largest
        self.pages: list[dict] = []
        lifted = _lifted(rows, largest)
        self.order: list[np.ndarray] = []
        self.gaps: list[np.ndarray] = []
        self.filled = 0
        root = lifted.mean(axis=0)
        self.center = root
        self.radius = float(_distances(lifted, root).max()) if len(rows) else 0.0
        self.root = self._build(lifted, np.arange(len(rows)), root)
        order = np.concatenate(self.order) if self.order else np.arange(0)
        self.ids, self.rows = ids[order], rows[order]
        self.parent = np.concatenate(self.gaps) if self.gaps else np.zeros(0)
        self.products: np.ndarray | None = None

    def _leaf(self, lifted: np.ndarray, members: np.ndarray, center: np.ndarray) -> int:
        gaps = _distances(lifted[members], center)
        near = np.argsort(gaps, kind="stable")
        self.order.append(members[near])
        self.gaps.append(gaps[near])
        self.pages.append({"leaf": (self.filled, self.filled + len(members))})
        self.filled += len(members)
        return len(self.pages) - 1

    def _build(self, lifted: np.ndarray, members: np.ndarray, center: np.ndarray) -> int:
        if len(members) <= LEAF:
            return self._leaf(lifted, members, center)
        step = max(1, len(members) // 256)
        objects = _spread(lifted[members[::step]], FANOUT)
        at, gaps = _nearest(lifted[members], objects)
        parts = [members[at == i] for i in range(len(objects))]
        if max(map(len, parts)) == len(members):  # equal points: cut in rows
            parts = [members[i : i + LEAF] for i in range(0, len(members), LEAF)]
            objects = np.repeat(objects[:1], len(parts), axis=0)
        kept = [i for i, p in enumerate(parts) if len(p)]
        page = {
            "objects": objects[kept],
            "radii": np.array([_distances(lifted[parts[i]], objects[i]).max() for i in kept]),
            "parent": _distances(objects[kept], center),
            "children": [self._build(lifted, parts[i], objects[i]) for i in kept],
        }
        self.pages.append(page)
        return len(self.pages) - 1

    def search(self, query: np.ndarray, own: int, k: int, bound: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of other ids for one query; those that cannot reach bound are missing."""
        least = None if bound is None else np.array([bound])
        _, scores, ids = self.search_all(np.asarray(query)[None, :], np.array([own]), k, least)
        return [(int(s), int(i)) for s, i in zip(scores, ids)]

    def search_all(
        self, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, id): the k best of other ids for each query, in order; those that cannot
        reach its bound are missing. ``_OPEN`` bounds nothing."""
        bounds = np.full(len(queries), _OPEN) if bounds is None else bounds
        parts = [
            self._together(queries[i : i + TOGETHER], own[i : i + TOGETHER], k, bounds[i : i + TOGETHER], i)
            for i in range(0, len(queries), TOGETHER)
        ]
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _together(self, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray, first: int):
        exact = _exact(self.largest)
        if self.products is None or self.products.dtype != exact:
            self.products = self.rows.astype(exact)
        asked, plain = queries.astype(exact), queries.astype(np.float64)
        q = np.hstack([plain, np.zeros((len(plain), 1))])
        base = (plain * plain).sum(1) + self.largest
        # what a row must have to matter: the bound, and the k-th best score so far
        cut = bounds.astype(np.int64)
        limit = np.full(len(q), np.inf)

        def reach(some: np.ndarray) -> None:
            """No point with the score of the cut or a better one is farther."""
            closed = some[cut[some] > _OPEN]
            limit[closed] = _reach(base[closed], cut[closed])

        everyone = np.arange(len(q))
        reach(everyone)
        best = np.full((len(q), k), _OPEN), np.full((len(q), k), -1)
        start = _distances(q, self.center)
        least = np.maximum(0.0, start - self.radius)
        heap = [(float(least.min()), 0, self.root, everyone, least, start)]
        pushed = 1
        while heap:
            _, _, number, some, least, to_center = heapq.heappop(heap)
            wanted = least <= limit[some]
            if not wanted.any():
                continue
            some, to_center = some[wanted], to_center[wanted]
            page = self.pages[number]
            if "leaf" in page:
                begin, end = page["leaf"]
                gaps = self.parent[begin:end]
                # gaps are sorted: rows within reach of the triangle inequality are a slice
                low = np.searchsorted(gaps, to_center - limit[some] - 1e-6, side="left")
                high = np.searchsorted(gaps, to_center + limit[some] + 1e-6, side="right")
                near = low < high
                if not near.any():
                    continue
                some = some[near]
                rows = slice(begin + int(low[near].min()), begin + int(high[near].max()))
                found = self._scored(rows, asked, own, some, cut, k)
                if not len(found[0]):
                    continue
                changed = _merge(best, found, k)
                cut[changed] = np.maximum(cut[changed], best[0][changed, -1])
                reach(changed)
                continue
            # the stored parent distances drop entries before their distances are computed
            for i, child in enumerate(page["children"]):
                radius = float(page["radii"][i])
                hopeful = np.abs(to_center - page["parent"][i]) - radius <= limit[some] + 1e-6
                if not hopeful.any():
                    continue
                those = some[hopeful]
                gap = _distances(q[those], page["objects"][i])
                lower = np.maximum(0.0, gap - radius)
                inside = lower <= limit[those] + 1e-6
                if inside.any():
                    heapq.heappush(heap, (float(lower[inside].min()), pushed, child, those[inside], lower[inside], gap[inside]))
                    pushed += 1
        query, place = np.nonzero(best[0] > _OPEN)
        return query + first, best[0][query, place], best[1][query, place]

    def _scored(self, rows: slice, asked: np.ndarray, own: np.ndarray, some: np.ndarray, cut: np.ndarray, k: int):
        """(query, score, id) of the rows of a leaf that reach the cut of a query; of a query without
        one the k best and what equals the last of them."""
        scores = asked[some] @ self.products[rows].T
        least, ids = cut[some], self.ids[rows]
        unbounded = np.flatnonzero(least == _OPEN)
        if len(unbounded) and scores.shape[1] > k:
            others = np.where(ids == own[some[unbounded], None], np.array(_OPEN, scores.dtype), scores[unbounded])
            kth = np.partition(others, others.shape[1] - k, axis=1)[:, others.shape[1] - k]
            least = least.copy()
            least[unbounded] = kth.astype(np.int64)
        # a cut is a score, which these numbers hold, or the least number
        query, row = np.nonzero(scores >= least.astype(scores.dtype)[:, None])
        other = ids[row] != own[some[query]]
        query, row = query[other], row[other]
        return some[query], scores[query, row].astype(np.int64), ids[row]

    def dump(self) -> bytes:
        arrays = {"ids": self.ids, "rows": _smallest(self.rows), "parent": self.parent, "center": self.center}
        inner = []
        for i, page in enumerate(self.pages):
            if "leaf" in page:
                inner.append((0, *page["leaf"]))
            else:
                inner.append((1, 0, 0))
                for name in ("objects", "radii", "parent"):
                    arrays[f"{name}{i}"] = page[name]
                arrays[f"children{i}"] = np.array(page["children"])
        arrays["pages"] = np.array(inner, np.int64).reshape(-1, 3)
        arrays["top"] = np.array([self.root, self.radius, self.largest], np.float64)
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        arrays = np.load(io.BytesIO(data))
        tree = cls.__new__(cls)
        tree.ids, tree.rows, tree.parent, tree.center = (arrays[n] for n in ("ids", "rows", "parent", "center"))
        tree.root, tree.radius, tree.largest = int(arrays["top"][0]), float(arrays["top"][1]), float(arrays["top"][2])
        tree.products = None
        tree.pages = [
            {n: arrays[f"{n}{i}"] for n in ("objects", "radii", "parent", "children")}
            if kind
            else {"leaf": (int(first), int(end))}
            for i, (kind, first, end) in enumerate(arrays["pages"])
        ]
        return tree


def _pivots(rows: DataFrame, n: int, dim: int, largest: float) -> np.ndarray:
    count = int(min(MAX_PIVOTS, max(1, n // (TREE_ROWS // 2))))
    share = min(1.0, 4.0 * count * PIVOT_SAMPLE / n)
    place = F.shiftrightunsigned(F.xxhash64("id"), 1).cast("double") / float(1 << 63)
    some = rows.filter(place < share).select("id", "v").limit(64 * count * PIVOT_SAMPLE).toArrow()
    if some.num_rows == 0:
        some = rows.select("id", "v").limit(1).toArrow()
    order = np.argsort(np.array(some.column("id").to_pylist()), kind="stable")
    lifted = _lifted(_matrix(some.column("v").combine_chunks(), dim), largest)[order]
    return _spread(lifted, count)


def _placed(vector: Column, pivots: np.ndarray, dim: int, largest: float) -> Column:
    """The nearest pivot and the distance to it."""

    @F.arrow_udf("struct<pivot:int,gap:double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at, gap = _nearest(_lifted(_matrix(batch, dim), largest), pivots)
            yield pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(gap)], ["pivot", "gap"])

    return place(vector)


def _to_visit(vector: Column, bound: Column, pivots: np.ndarray, radii: np.ndarray, dim: int, largest: float) -> Column:
    """The regions that may hold a point as good as bound; all where it is null."""

    @F.arrow_udf("array<int>")
    def visit(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, bounds in batches:
            q = _matrix(vectors, dim).astype(np.float64)
            base = (q * q).sum(1) + largest
            q = np.hstack([q, np.zeros((len(q), 1))])
            gaps = np.stack([_distances(q, c) for c in pivots], axis=1).reshape(len(q), len(pivots)) - radii
            least = np.array([np.nan if b is None else b for b in bounds.to_pylist()], float)
            limit = _reach(base, least)
            limit[np.isnan(least)] = np.inf
            yield pa.array([np.nonzero((row <= lim) & (radii >= 0))[0].tolist() for row, lim in zip(gaps, limit)], pa.list_(pa.int32()))

    return visit(vector, bound)


def _stored_trees(trees: DataFrame) -> DataFrame:
    """As ``stored``, a few in a file: all rows of a file up to thousands are read at once, however large they are."""
    path = shared_folder(trees.sparkSession)
    trees.write.option("maxRecordsPerFile", TREES_IN_FILE).parquet(path)
    return trees.sparkSession.read.schema(trees.schema).parquet(path)


def _searched(pairs: DataFrame, trees: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each (query, tree). pairs: tree, block, id, v, bound.
    Bounds that are null travel as ``_OPEN``, as a column of numbers with nulls would become floats."""
    pairs = pairs.withColumn("bound", F.coalesce("bound", F.lit(_OPEN)))
    wanted = pairs.select(F.col("tree").alias("__tree"), F.col("block").alias("__block")).distinct()
    paged = wanted.join(trees.select("tree", "pages"), F.col("__tree") == F.col("tree")).select("__tree", "__block", "pages")

    def search(tree_rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own = queries["id"].to_numpy(np.int64)
        query = score = vec = np.zeros(0, np.int64)
        if len(tree_rows) and len(queries):
            tree = Tree.load(tree_rows["pages"].iloc[0])
            query, score, vec = tree.search_all(_matrix(queries["v"].tolist(), dim), own, k, queries["bound"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": own[query], "vec_id": vec, "score": score})

    return paged.groupBy("__tree", "__block").cogroup(pairs.groupBy("tree", "block")).applyInPandas(search, RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query. rows and queries as ``points``
    gives them; a query's own id is never its candidate."""
    spark = rows.sparkSession
    rows, queries = stored(_few_equal(rows, k)), stored(_unfolded(_few_equal(queries, k)))
    facts = rows.select("id", "v").union(queries).agg(
        F.max(F.size("v")).alias("dim"), F.max(_dot("v", "v")).cast("double").alias("largest")
    ).first()
    n, asked = rows.count(), queries.count()
    if n == 0 or asked == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, largest = max(1, facts.dim), float(facts.largest)
    copies = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    kept = _unfolded(kept)
    pivots = _pivots(rows, n, dim, largest)
    placed = stored(kept.withColumn("at", _placed(F.col("v"), pivots, dim, largest)))
    regions = {
        r.pivot: (r.n, r.radius)
        for r in placed.groupBy("at.pivot").agg(F.count(F.lit(1)).alias("n"), F.max("at.gap").alias("radius")).collect()
    }
    radii = np.full(len(pivots), -1.0)
    chunks = []
    for p in range(len(pivots)):
        size, radius = regions.get(p, (0, -1.0))
        radii[p] = radius
        chunks.append(max(1, -(-size // TREE_ROWS)))
    per_region = F.get(F.expr(f"array({', '.join(map(str, chunks))})"), F.col("at.pivot"))
    tree = F.concat_ws(".", F.col("at.pivot").cast("string"), F.pmod(F.xxhash64("id"), per_region).cast("string"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found = Tree(group["id"].to_numpy(np.int64), _matrix(group["v"].tolist(), dim), largest)
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "pivot": [group["pivot"].iloc[0]], "pages": [found.dump()]})

    trees = _stored_trees(
        placed.select("id", "v", F.col("at.pivot").alias("pivot"), tree.alias("tree"))
        .groupBy("tree")
        .applyInPandas(build, "tree string, pivot int, pages binary")
    )
    blocks = max(1, -(-asked // QUERY_BLOCK))
    asking = queries.select(
        "id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        _placed(F.col("v"), pivots, dim, largest)["pivot"].alias("home"),
    )
    names = trees.select("tree", "pivot")
    first_tree = names.groupBy("pivot").agg(F.min("tree").alias("tree"))
    homes = asking.join(first_tree, F.col("home") == F.col("pivot")).withColumn("bound", F.lit(None).cast("long"))
    seen = stored(_ranked(_searched(homes, trees, dim, k), k).drop("rank"))
    kth = seen.groupBy("query_id").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("found"))
    kth = kth.filter(F.col("found") == k).select(F.col("query_id").alias("__query"), "bound")
    bounded = asking.join(kth, F.col("id") == F.col("__query"), "left").drop("__query")
    rest = (
        bounded.withColumn("pivot", F.explode(_to_visit(F.col("v"), F.col("bound"), pivots, radii, dim, largest)))
        .join(names, "pivot")
        .join(first_tree.select(F.col("pivot").alias("home"), F.col("tree").alias("__first")), "home", "left")
        .filter(F.col("__first").isNull() | (F.col("tree") != F.col("__first")))
    )
    both = _ranked(seen.union(_searched(rest, trees, dim, k)), k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
