"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by ``FEATURES``, plain statistics of its bytes, words and lines. Each feature
is cut into quantile bins and has a lookup table; selected pairs of features have small
tables too. Training visits the tables in turn, again and again: a shallow tree over the
bins of one feature (or one cut through each of two features) is fitted to the current
gradients and added to the table, damped by the learning rate. A score is the logistic
function of the sum of the looked-up values, for a whole batch at once.

Training uses at most about ``max_rows`` labelled rows, drawn by a hash of the id, so that the
sample and the model fit one process whatever the corpus; only their feature vectors are
collected. The sampled ids are broadcast, which ``max_rows`` bounds, and texts are not shuffled.
Scoring covers every row, whole texts, in Arrow batches.

Defined cases: null texts are scored like empty ones; labels without a text, null labels and
null ids teach nothing; a repeated label counts each time; labels of one class, or none,
give the smoothed share of ones as every score; an empty table gives no rows. Extra columns
stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import released

MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
SMOOTH = 1.0
LEAF_ROWS = 8

FEATURES = (
    "log_chars", "upper", "digits", "blanks", "line_breaks", "stops", "marks", "symbols", "bars", "non_ascii",
    "log_words", "word_length", "distinct_words", "top_word", "short_words", "repeated_lines", "repeated_chars",
    "line_words", "ended_lines", "odd_words", "capital_words", "distinct_pairs", "short_lines", "longest_word",
)

#: The bytes that the shares count.
_SYMBOLS = [ord(c) for c in "#$%&*+=<>^~@\\/_{}[]`"]
_STOPS, _MARKS = [ord(c) for c in ".,;:"], [ord(c) for c in "!?"]
_SEPARATORS = "!?#$%&*+=<>^~@|_{}[]`"


def describe(text: str | None) -> list[float]:
    """The feature vector of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(text))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [line for line in text.split("\n") if line.strip()]
    line_seen = Counter(lines)
    extra = [(line, k) for line, k in line_seen.items() if k > 1]
    line_words = [line.count(" ") + 1 for line in lines]
    k = max(1, len(lines))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(text)),
        upper / max(1, upper + lower),
        counts[48:58].sum() / chars,
        counts[32] / chars,
        counts[10] / chars,
        counts[_STOPS].sum() / chars,
        counts[_MARKS].sum() / chars,
        counts[_SYMBOLS].sum() / chars,
        counts[124] / chars,
        (len(raw) - len(text)) / chars,
        np.log1p(len(words)),
        lengths.mean(),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        (lengths <= 3).sum() / n,
        sum(c - 1 for _, c in extra) / k,
        sum(len(line) * (c - 1) for line, c in extra) / chars,
        sum(line_words) / k,
        sum(line.rstrip()[-1] in ".!?" for line in lines) / k,
        sum(word[-1] in _SEPARATORS for word in words) / n,
        sum(len(word) > 1 and word.isupper() for word in words) / n,
        pairs / max(1, n - 1),
        sum(c < 5 for c in line_words) / k,
        np.log1p(lengths.max()),
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, rows[:, j], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            left = np.searchsorted(self.pair_edges[a], rows[:, a], side="right")
            out += values[left, np.searchsorted(self.pair_edges[b], rows[:, b], side="right")]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(rows), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles; equal values share a bin."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of a small tree over ordered bins, from sums of gradients, curvatures and rows."""
    out = np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    gain[(left_n < LEAF_ROWS) | (n.sum() - left_n < LEAF_ROWS)] = -np.inf
    at = int(np.argmax(gain))
    if gain[at] <= _gain(g.sum(), h.sum()) + 1e-9:
        return out
    cut = at + 1
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts through a table: its gain, and the values of its four parts."""

    def corners(x: np.ndarray) -> list[np.ndarray]:
        total = x.cumsum(0).cumsum(1)
        upper = total[:-1, :-1]
        right, below = total[:-1, -1:] - upper, total[-1:, :-1] - upper
        return [upper, right, below, total[-1, -1] - upper - right - below]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts_g, parts_h, parts_n = corners(g), corners(h), corners(n)
    gain = sum(_gain(a, b) for a, b in zip(parts_g, parts_h)) - _gain(g.sum(), h.sum())
    gain = np.where(np.min(parts_n, axis=0) >= LEAF_ROWS, gain, 0.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, np.zeros_like(g)
    leaf = [a[i, j] / (b[i, j] + SMOOTH) for a, b in zip(parts_g, parts_h)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


def train(rows: np.ndarray, labels: np.ndarray) -> Model:
    """rows: one feature vector each; labels: 0 or 1."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    count = rows.shape[1]
    logits = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logits))
        return labels - p, p * (1 - p)

    model.edges = [_cuts(rows[:, j], BINS) for j in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    placed = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(model.edges)]
    sizes = [np.bincount(at, minlength=len(t)) for at, t in zip(placed, model.tables)]
    for _ in range(ROUNDS):
        for j, at in enumerate(placed):
            g, h = slopes()
            k = len(model.tables[j])
            step = RATE * _tree(np.bincount(at, g, k), np.bincount(at, h, k), sizes[j])
            model.tables[j] += step
            logits += step[at]

    model.pair_edges = [_cuts(rows[:, j], PAIR_BINS) for j in range(count)]
    coarse = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(model.pair_edges)]

    def summed(a: int, b: int, values: np.ndarray | None) -> np.ndarray:
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).astype(float).reshape(shape)

    g, h = slopes()
    gains = [
        (-_quadrants(summed(a, b, g), summed(a, b, h), summed(a, b, None))[0], a, b)
        for a in range(count)
        for b in range(a + 1, count)
    ]
    model.pairs = [(a, b) for gain, a, b in sorted(gains)[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for place, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(summed(a, b, g), summed(a, b, h), summed(a, b, None))[1]
            model.pair_tables[place] += step
            logits += step[coarse[a], coarse[b]]
    return model


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([describe(t.as_py()) for t in batch], pa.list_(pa.float64()))

    return described(text)


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> Model:
    """A model of label (above 0: good) from labels joined to docs by key."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("__llm_key"), (F.col(label) > 0).cast("int").alias("__llm_label")
    )
    n = known.count()
    if n > max_rows:
        place = F.shiftrightunsigned(F.xxhash64("__llm_key"), 1).cast("double") / float(1 << 63)
        known = known.filter(place < max_rows / n)
    found = docs.select(F.col(key), F.col(text)).join(F.broadcast(known), F.col(key) == F.col("__llm_key"))
    rows = found.select(F.col(key), "__llm_label", features(F.col(text)).alias("x")).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("__llm_label").to_pylist(), float)
    order = np.lexsort((*x.T, y)) if len(y) else np.arange(0)
    return train(x[order], y[order])


def score(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1. The model's tables, some 20 KB, travel with the function."""

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([describe(t.as_py()) for t in batch], float).reshape(-1, len(FEATURES))
            yield pa.array(model.scores(rows), pa.float64())

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(judged(batches))

    return scored(text)


def classify(docs: DataFrame, text: str, model: Model, threshold: float, name: str = "score") -> DataFrame:
    """docs with the score and predicted (1 from the threshold on), which replace columns of these names."""
    return docs.withColumn(name, score(F.col(text), model)).withColumn(
        "predicted", (F.col(name) >= threshold).cast("int")
    )
