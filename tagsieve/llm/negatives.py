"""Hard negatives by anchor spanning-tree bounds.

For each anchor the positives are its best other rows of the same label by inner product; for each
positive the hard negatives are the best rows of other labels whose score lies in a window given by
percentages of the positive's score.

Anchors lie in blocks of nearby ones (nearest of some pivots), each with a minimum spanning tree over their
distances, built once. Of a slice of candidates the root anchor scores all. For a child c of p and a candidate
x, the score c.x is p.x + (c - p).x, so it is within |c - p| |x| of p.x, and within that of the bounds of
p.x where p did not score x. Only candidates whose bounds overlap what is still wanted are scored
again: for positives, at least the worst of the best so far; for negatives, any of the windows,
each from the worst of its best so far.

Candidates lie in blocks of about ``CANDIDATE_ROWS`` by label bucket and hash, so a hot label is many
blocks. Anchor blocks, which are small, go to the candidate blocks, ``BLOCKS_IN_TASK`` at once; a candidate
block is copied once for each such group. Tasks return the best of their candidates, and a ranking that Spark
limits before the shuffle merges them.

Of the copies of a vector with one label only the smallest ids are kept, one more than anyone can
ask for: no other copy can be among the best.

Defined cases: null ids, labels and vectors and vectors with null or non-finite components take no
part; equal rows count once; rows of one id with another label or vector are rows of their own, and an
anchor's other rows are those of another id; shorter vectors are filled up with zeros; ties go to the smaller id; an
anchor without positives and a positive without rows in its window give no rows; an empty table gives none. Inner
products must keep within 63 bits. Extra columns are not used.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.llm.common import stored
from tagsieve.llm.mtree import SCALE, scaled, usable

POSITIVES = 5
NEGATIVES = 10
#: The window of a negative's score, in percent of the positive's.
LEAST, MOST = 30, 90
ANCHOR_ROWS = 1_024
CANDIDATE_ROWS = 32_768
BLOCKS_IN_TASK = 32
#: Candidates whose bounds are held at once.
SLICE = 2_048
MAX_PIVOTS = 256
#: Labels are told apart by at most so many buckets; labels of one bucket are told apart in its blocks.
BUCKETS = 64


def rows_of(df: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, tag, label, v): the usable rows, scaled; tag tells rows of one id apart."""
    rows = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    named = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled(F.col(vector), scale).alias("v")
    ).distinct()
    return named.select("id", F.xxhash64("label", "v").alias("tag"), "label", "v")


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(rows: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    most = int(np.abs(rows).max()) if rows.size else 0
    return rows.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent and edge length of a minimum spanning tree; parents come before their children, the
    root has parent -1."""
    n = len(points)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    near, via, open_ = np.full(n, np.inf), np.full(n, -1, np.int64), np.ones(n, bool)
    if n:
        center = points.mean(axis=0)
        now = int(((points - center) ** 2).sum(1).argmin())
    for step in range(n):
        order[step], parent[now], open_[now] = now, via[now], False
        edge[now] = near[now] if via[now] >= 0 else 0.0
        gaps = np.sqrt(((points - points[now]) ** 2).sum(1))
        closer = open_ & (gaps < near)
        near[closer], via[closer] = gaps[closer], now
        now = int(np.where(open_, near, np.inf).argmin())
    return order, parent, edge


class Best:
    """The best (score, id) so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def worst(self) -> float:
        """The least score that may still come in."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            # the k best scores and all their ties
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[some], ids[some]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


class Walk:
    """Walks the anchors' tree over slices of candidates and hands each anchor the scores that may matter."""

    def __init__(self, anchors: dict, candidates: dict):
        self.anchors, self.candidates = anchors, candidates
        rows, points = candidates["rows"], anchors["rows"]
        # sums of products stay below the largest product of lengths
        lengths = [float((x.astype(np.float64) ** 2).sum(1).max()) if len(x) else 0.0 for x in (rows, points)]
        exact = np.float64 if max(lengths) < 2.0**52 else np.int64
        self.rows, self.points = rows.astype(exact), points.astype(exact)
        self.norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1)) if len(rows) else np.zeros(0)
        self.slack = 1.0 + 1e-12 * np.sqrt(lengths[0] * lengths[1])
        self.scored = 0

    def run(self, wanted, take) -> None:
        """wanted(anchor, low, high, part): which candidates of the slice may matter; take(anchor, scores,
        places): their exact scores."""
        largest_first = np.argsort(-self.norms, kind="stable")
        order, parent, edge = (self.anchors[n] for n in ("order", "parent", "edge"))
        for start in range(0, len(largest_first), SLICE):
            part = largest_first[start : start + SLICE]
            rows, norms = self.rows[part], self.norms[part]
            low, high = np.empty((len(order), len(part))), np.empty((len(order), len(part)))
            for a in order:
                if parent[a] < 0:
                    some, scores = np.arange(len(part)), rows @ self.points[a]
                else:
                    reach = edge[a] * norms * (1 + 1e-9) + self.slack
                    np.subtract(low[parent[a]], reach, out=low[a])
                    np.add(high[parent[a]], reach, out=high[a])
                    some = np.flatnonzero(wanted(a, low[a], high[a], part))
                    scores = (rows if 2 * len(some) > len(part) else rows[some]) @ self.points[a]
                    scores = scores[some] if len(scores) > len(some) else scores
                self.scored += len(some)
                low[a][some] = high[a][some] = scores
                keep = wanted(a, low[a][some], high[a][some], part[some])
                take(a, scores[keep].astype(np.int64), part[some[keep]])


def find_positives(anchors: dict, candidates: dict, k: int) -> list[tuple[int, int, int, int]]:
    """(place of the anchor, score, id, place of the candidate): the k best others of the same label."""
    best = [Best(k) for _ in anchors["ids"]]
    ids, labels = candidates["ids"], candidates["labels"]

    def wanted(a, low, high, part):
        return (high >= best[a].worst()) & (labels[part] == anchors["labels"][a]) & (ids[part] != anchors["ids"][a])

    Walk(anchors, candidates).run(wanted, lambda a, scores, places: best[a].add(scores, ids[places]))
    return [(a, int(s), int(i)) for a, b in enumerate(best) for s, i in zip(b.scores, b.ids)]


def find_negatives(anchors: dict, candidates: dict, positive_scores: list, k: int, least: int, most: int) -> list:
    """(place of the anchor, positive's score, score, id): for each positive score of each anchor, the k
    best of other labels within the window."""
    ids, labels = candidates["ids"], candidates["labels"]
    windows: list[list[tuple[int, int, int, Best]]] = []
    for scores in positive_scores:
        ends = [(p, -(-least * p // 100), most * p // 100) for p in scores]
        windows.append([(p, low, high, Best(k)) for p, low, high in ends if low <= high])

    def wanted(a, low, high, part):
        some = np.zeros(len(part), bool)
        for _, first, last, best in windows[a]:
            some |= (high >= max(first, best.worst())) & (low <= last)
        return some & (labels[part] != anchors["labels"][a]) & (ids[part] != anchors["ids"][a])

    def take(a, scores, places):
        for _, first, last, best in windows[a]:
            inside = (scores >= first) & (scores <= last)
            if inside.any():
                best.add(scores[inside], ids[places[inside]])

    Walk(anchors, candidates).run(wanted, take)
    return [(a, p, int(s), int(i)) for a, w in enumerate(windows) for p, _, _, b in w for s, i in zip(b.scores, b.ids)]


def _bucket(label: Column) -> Column:
    return F.pmod(label, F.lit(BUCKETS)).cast("int")


def _load(data: bytes) -> dict:
    return dict(np.load(io.BytesIO(data)))


def _candidate_blocks(rows: DataFrame, dim: int) -> tuple[DataFrame, dict[int, tuple[int, int, bool]]]:
    """(block, rows) packed, and for each bucket its first block, their number, and whether it has one label only."""
    sizes = rows.groupBy(_bucket(F.col("label")).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), (F.min("label") == F.max("label")).alias("single")
    )
    spans, first = {}, 0
    for r in sorted(sizes.collect()):  # at most BUCKETS rows
        parts = -(-r.n // CANDIDATE_ROWS)
        spans[r.b] = (first, parts, r.single)
        first += parts
    bucket = _bucket(F.col("label"))
    starts = F.array(*[F.lit(spans.get(b, (0, 1, True))[0]) for b in range(BUCKETS)])
    parts = F.array(*[F.lit(spans.get(b, (0, 1, True))[1]) for b in range(BUCKETS)])
    block = F.get(starts, bucket) + F.pmod(F.xxhash64("id", "tag"), F.get(parts, bucket)).cast("int")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        data = _packed(
            ids=group["id"].to_numpy(np.int64), labels=group["label"].to_numpy(np.int64), rows=_narrow(_matrix(group["v"].tolist(), dim))
        )
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "rows": [data]})

    return stored(rows.withColumn("block", block).groupBy("block").applyInPandas(pack, "block int, rows binary")), spans


def _anchor_blocks(anchors: DataFrame, asked: int, dim: int) -> DataFrame:
    """(anchors, bucket, pack): blocks of near anchors of a bucket with their spanning trees, numbered from 0."""
    pivots_wanted = min(MAX_PIVOTS, max(1, asked // ANCHOR_ROWS))
    some = anchors.orderBy(F.xxhash64("id", "tag"), "id", "tag").select("v").limit(pivots_wanted).collect()
    pivots = _matrix([r.v for r in some], dim).astype(np.float64)

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        x = _matrix(v.to_pylist(), dim).astype(np.float64)
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
        for i, pivot in enumerate(pivots):
            gaps = ((x - pivot) ** 2).sum(1)
            closer = gaps < best
            best[closer], at[closer] = gaps[closer], i
        return pa.array(at)

    celled = stored(anchors.select("*", _bucket(F.col("label")).alias("bucket"), nearest("v").alias("cell")))
    sizes = celled.groupBy(F.col("bucket").alias("c_bucket"), F.col("cell").alias("c_cell")).agg(
        F.ceil(F.count(F.lit(1)) / ANCHOR_ROWS).cast("int").alias("parts")
    )
    dealt = celled.join(sizes, (F.col("bucket") == F.col("c_bucket")) & (F.col("cell") == F.col("c_cell")))
    part = F.pmod(F.xxhash64("id", "tag"), F.col("parts")).cast("int").alias("part")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = _matrix(group["v"].tolist(), dim)
        order, parent, edge = spanning_tree(rows.astype(np.float64))
        labels = group["label"].to_numpy(np.int64)
        ids, tags = group["id"].to_numpy(np.int64), group["tag"].to_numpy(np.int64)
        data = _packed(ids=ids, tags=tags, labels=labels, rows=_narrow(rows), order=order, parent=parent, edge=edge)
        keys = {c: [int(group[c].iloc[0])] for c in ("bucket", "cell", "part")}
        return pd.DataFrame({**keys, "pack": [data]})

    packed = dealt.select("id", "tag", "label", "v", "bucket", "cell", part).groupBy("bucket", "cell", "part")
    return stored(packed.applyInPandas(pack, "bucket int, cell int, part int, pack binary"))


_NAME = ["bucket", "cell", "part"]


def _met(packs: DataFrame, blocks: DataFrame, groups: int, targets: Column):
    """Anchor blocks and candidate blocks together: each anchor block with every block of targets."""
    group = F.pmod(F.xxhash64(*_NAME), F.lit(groups)).cast("int")
    sent = packs.select("*", group.alias("a_group"), F.explode(targets).alias("a_block"))
    copied = blocks.select("block", "rows", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return copied.groupBy("block", "group").cogroup(sent.groupBy("a_block", "a_group"))


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). rows and anchors as
    ``rows_of`` gives them."""
    spark = rows.sparkSession
    rows, anchors = stored(rows), stored(anchors)
    asked, total = anchors.count(), rows.count()
    dim = rows.union(anchors).agg(F.max(F.size("v"))).first()[0]
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked or not total:
        return spark.createDataFrame([], result)
    dim = max(1, dim)
    copies = Window.partitionBy("label", "v").orderBy("id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= max(positives, negatives) + 1)
    blocks, spans = _candidate_blocks(kept.drop("copy"), dim)
    packs = _anchor_blocks(anchors, asked, dim)
    groups = max(1, -(-packs.count() // BLOCKS_IN_TASK))
    last = sum(parts for _, parts, _ in spans.values()) - 1
    # where each bucket's blocks begin and end; empty for buckets without rows
    begin = F.get(F.array(*[F.lit(spans.get(b, (0, 0, True))[0]) for b in range(BUCKETS)]), F.col("bucket"))
    number = F.get(F.array(*[F.lit(spans.get(b, (0, 0, True))[1]) for b in range(BUCKETS)]), F.col("bucket"))
    single = F.get(F.array(*[F.lit(spans.get(b, (0, 0, True))[2]) for b in range(BUCKETS)]), F.col("bucket"))
    everywhere = F.sequence(F.lit(0), F.lit(last))

    def same_label(candidates: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(sent):
            held = _load(candidates["rows"].iloc[0])
            for data in sent["pack"]:
                a = _load(data)
                out += [(int(a["ids"][i]), int(a["tags"][i]), s, p) for i, s, p in find_positives(a, held, positives)]
        return pd.DataFrame(out, columns=["id", "tag", "score", "positive"]).astype("int64")

    own = F.filter(everywhere, lambda x: (x >= begin) & (x < begin + number))
    found = _met(packs, blocks, groups, own).applyInPandas(same_label, "id long, tag long, score long, positive long")
    order = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "positive")
    best = stored(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"))

    def other_labels(candidates: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(sent):
            held = _load(candidates["rows"].iloc[0])
            for data, windows in zip(sent["pack"], sent["windows"]):
                a = _load(data)
                wanted = {(w["id"], w["tag"]): sorted(map(int, w["scores"])) for w in windows}
                scores = [wanted.get(key, []) for key in zip(a["ids"].tolist(), a["tags"].tolist())]
                hits = find_negatives(a, held, scores, negatives, least, most)
                out += [(int(a["ids"][i]), int(a["tags"][i]), p, s, n) for i, p, s, n in hits]
        return pd.DataFrame(out, columns=["id", "tag", "positive_score", "score", "negative"]).astype("int64")

    # the windows of a block: at most ANCHOR_ROWS anchors, about, with some scores each
    members = anchors_in(packs)
    scores = best.groupBy(F.col("id").alias("s_id"), F.col("tag").alias("s_tag")).agg(F.collect_set("score").alias("scores"))
    windows = (
        members.join(scores, (F.col("id") == F.col("s_id")) & (F.col("tag") == F.col("s_tag")))
        .groupBy(*[F.col(c).alias(f"w_{c}") for c in _NAME])
        .agg(F.collect_list(F.struct("id", "tag", "scores")).alias("windows"))
    )
    asked_packs = packs.join(windows, [F.col(c) == F.col(f"w_{c}") for c in _NAME]).select(*_NAME, "pack", "windows")
    others = F.filter(everywhere, lambda x: ~(single & (x >= begin) & (x < begin + number)))
    hits = _met(asked_packs, blocks, groups, others).applyInPandas(
        other_labels, "id long, tag long, positive_score long, score long, negative long"
    )
    order = Window.partitionBy("id", "tag", "positive_score").orderBy(F.desc("score"), "negative")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = best.select(F.col("id").alias("p_id"), F.col("tag").alias("p_tag"), F.col("score").alias("p_score"), "positive")
    same = (F.col("id") == F.col("p_id")) & (F.col("tag") == F.col("p_tag")) & (F.col("positive_score") == F.col("p_score"))
    return ranked.join(pairs, same).select(
        F.col("id").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def anchors_in(packs: DataFrame) -> DataFrame:
    """(bucket, cell, part, id, tag): the anchors of each block."""

    @F.arrow_udf("array<struct<id:long,tag:long>>")
    def names(data: pa.Array) -> pa.Array:
        out = []
        for pack in data.to_pylist():
            held = _load(pack)
            out.append([{"id": i, "tag": t} for i, t in zip(held["ids"].tolist(), held["tags"].tolist())])
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("tag", pa.int64())])))

    return packs.select(*_NAME, F.explode(names("pack")).alias("x")).select(*_NAME, "x.id", "x.tag")
