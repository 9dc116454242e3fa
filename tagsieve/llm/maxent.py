"""Language-model scoring with a hashed maximum-entropy model.

Tokens are words after lower-casing A-Z, then one end token per text (stored as the empty
string). Training counts of all tokens are gathered by Spark, for the whole training part.

The model is log-linear with a class-factored softmax: P(token | history) = P(class | history) *
P(token | class, history). The ``TOP`` most frequent tokens fill classes of ``CLASS_SIZE`` by rank;
inside such a class a second softmax picks the token. All other tokens belong to a class by a
hash of their last three bytes, inside which they have their smoothed share of the
training counts, one share being left for unseen tokens. Both softmaxes start from the training
counts and add hashed features of the history: the token before (bigram), the one before that
(skip), and both (trigram), each a row of weights. In the history a token is a hash of its bytes, so
tokens have histories of their own at every size of the vocabulary.

Training goes over the whole training part once, in ``ROUNDS`` slices by a hash. A slice is dealt by a hash of id
and text into parts of about ``PART_TOKENS`` tokens, sorted by that hash, so the result does not hang on how
the table was split into tasks. Each part makes gradient updates in small batches, from the common weights, with
row-wise adaptive steps; it hands back the change of each row it touched. Changes are added up in a tree of groups
of at most ``FAN`` parts, and the mean change becomes the new common weights. The weights
have a fixed size, so broadcasts and the driver's share do not grow with the corpus.

Scoring runs numpy over batches of tokens. At most ``KNOWN`` frequent tokens are broadcast with
their counts; the counts of all others are joined to the texts that use them. Those tokens
are rare by choice, so no key of that join is hot.

Defined cases: null texts are empty and consist of the end token; a null id trains (it
counts as empty text in the hash); without training texts all counts are zero and classes
equally likely; repeated rows train each time and are scored each; an empty table gives no
rows. Extra columns are not used; the key may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.llm.common import released, stored

KNOWN = 100_000
TOP = 256
CLASS_SIZE = 16
TAILS = 16
CLASSES = TOP // CLASS_SIZE + TAILS
#: Rows of weights for classes and for tokens in their class.
ROWS = 1 << 14
INNER_ROWS = 1 << 11
ROUNDS = 3
#: Training tokens of a slice that one task learns from, about.
PART_TOKENS = 1_000_000
RATE = 0.15
BATCH = 8_192
FAN = 32
#: Bytes of weight rows that travel together.
PIECE_BYTES = 1 << 17
#: Characters of text, about, that are read at once; more only where one text is longer.
SLICE_CHARS = 1 << 18
#: Distinct tokens a task counts before it hands them on.
COUNTED = 200_000
END = b""
#: What stands before a text, in the history.
START = -1


def tokens(text: str | None) -> list[bytes]:
    """The words of a text and the end token."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    found.append(END)
    return found


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % TAILS


def history_number(token: bytes) -> int:
    """64 bits of the token's bytes, whether or not its count is broadcast."""
    return xxhash.xxh64_intdigest(token) - (1 << 63)


def tail_column(token: Column) -> Column:
    last = F.expr("substring(cast(token as binary), -3)")
    return (F.crc32(last) % TAILS).cast("int")


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, c) of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch() -> pa.RecordBatch:
            keys = pa.array([k.decode("utf-8", "replace") for k in seen], pa.string())
            return pa.RecordBatch.from_arrays([keys, pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for rows in batches:
            for value in rows.column(0):
                seen.update(tokens(value.as_py()))
                if len(seen) >= COUNTED:
                    yield batch()
                    seen.clear()
        yield batch()

    parts = docs.select(text).mapInArrow(counted, "token string, c bigint")
    return parts.groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts that scoring needs; all sizes are bounded by KNOWN and CLASSES."""

    total: int
    distinct: int
    known: list[tuple[bytes, int]]
    class_counts: np.ndarray
    tail_sizes: np.ndarray

    def __post_init__(self) -> None:
        self.index = {w: i for i, (w, _) in enumerate(self.known)}
        n = len(self.known)
        self.counts = np.array([c for _, c in self.known] or [0], np.float64)
        ranks = np.arange(max(n, 1))
        top = ranks < min(TOP, n)
        tails = np.array([tail_class(w) for w, _ in self.known] or [0])
        self.classes = np.where(top, ranks // CLASS_SIZE, TOP // CLASS_SIZE + tails).astype(np.int64)
        self.places = np.where(top, ranks % CLASS_SIZE, -1).astype(np.int64)
        inner = np.full((TOP // CLASS_SIZE, CLASS_SIZE), -np.inf)
        for i in range(min(TOP, n)):
            inner[i // CLASS_SIZE, i % CLASS_SIZE] = np.log(self.counts[i] + 1)
        self.inner = inner.astype(np.float32)
        with np.errstate(divide="ignore"):
            weight = np.where(np.arange(CLASSES) < TOP // CLASS_SIZE, self.class_counts, self.class_counts + 1)
            self.outer = np.log(weight).astype(np.float32)
        self.tail_log = np.log(self.class_counts[TOP // CLASS_SIZE :] + self.tail_sizes + 1)
        self.histories = np.array([history_number(w) for w, _ in self.known] or [0], np.int64)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """index (-1: not broadcast), class, number in the history."""
        ids = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        classes = self.classes[ids]
        history = self.histories[ids]
        other = np.flatnonzero(ids < 0)
        if len(other):
            unread = [words[i] for i in other.tolist()]
            classes[other] = [TOP // CLASS_SIZE + tail_class(w) for w in unread]
            history[other] = [history_number(w) for w in unread]
        return ids, classes, history


#: Tokens of one count level are taken by hash, in so many parts.
_PARTS_OF_LEVEL = 4_096


def lexicon(counts: DataFrame) -> Lexicon:
    """counts: token, c."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in levels), sum(r.n for r in levels)
    room, split = KNOWN, None
    for row in sorted(levels, key=lambda r: -r.level):
        if row.n > room:
            split = row.level
            break
        room -= row.n
    if split is None:
        chosen = counts.collect()
    else:
        # as many of the level that does not fit as there is room for, by parts of its tokens' hashes
        part = F.pmod(F.xxhash64("token"), F.lit(_PARTS_OF_LEVEL))
        sizes = counts.filter(level == split).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        below = 0
        for row in sorted(sizes):
            if row.n > room:
                break
            room, below = room - row.n, row.part + 1
        chosen = counts.filter((level > split) | ((level == split) & (part < below))).collect()
    known = sorted(((r.token.encode(), r.c) for r in chosen), key=lambda x: (-x[1], x[0]))
    class_counts, sizes = np.zeros(CLASSES), np.zeros(TAILS)
    for row in counts.groupBy(tail_column(F.col("token")).alias("t")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_counts[TOP // CLASS_SIZE + row.t], sizes[row.t] = row.c, row.n
    for i, (word, c) in enumerate(known[:TOP]):
        class_counts[i // CLASS_SIZE] += c
        class_counts[TOP // CLASS_SIZE + tail_class(word)] -= c
        sizes[tail_class(word)] -= 1
    return Lexicon(total, distinct, known, class_counts, sizes)


@dataclass
class Weights:
    outer: np.ndarray
    inner: np.ndarray

    @classmethod
    def zero(cls) -> Weights:
        return cls(
            np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER_ROWS, TOP // CLASS_SIZE, CLASS_SIZE), np.float32)
        )

    def flat(self) -> list[np.ndarray]:
        return [self.outer, self.inner.reshape(INNER_ROWS, -1)]


def _hashed(x: np.ndarray, salt: int, size: int) -> np.ndarray:
    """Row numbers from 1; row 0 is the bias. The numbers fit 16 bits, which sort fast."""
    mixed = (x.view(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (((mixed >> np.uint64(32)) * np.uint64(size - 1) >> np.uint64(32)) + np.uint64(1)).astype(np.uint16)


def _history(history: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The active rows of each token of texts of these sizes: of classes (bigram, skip, trigram; the bias is
    row 0) and inside classes."""
    first = np.cumsum(sizes) - sizes
    one, two = np.roll(history, 1), np.roll(history, 2)
    one[first] = two[first] = START
    second = first + 1
    two[second[np.asarray(sizes) > 1]] = START
    outer = np.stack(
        [
            _hashed(one, 1, ROWS),
            _hashed(two, 1 << 40, ROWS),
            _hashed(one * 1_000_003 + two, 1 << 41, ROWS),
        ],
        axis=1,
    )
    return outer, np.stack([_hashed(one, 7, INNER_ROWS), _hashed(two, 1 << 42, INNER_ROWS)], axis=1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p


def _chosen_logs(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at one column of each row."""
    peak = logits.max(axis=1)
    chosen = logits[np.arange(len(logits)), at] - peak
    logits -= peak[:, None]
    return (chosen - np.log(np.exp(logits, out=logits).sum(axis=1))).astype(np.float64)


def _class_logits(words: Lexicon, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = table.take(rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        out += table.take(rows[:, j], axis=0)
    out += words.outer + table[0]
    return out


def _cells(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where the weights of a class begin among all blocks of CLASS_SIZE weights."""
    return rows * np.uint16(TOP // CLASS_SIZE) + group.astype(np.uint16)


def _inner_logits(words: Lexicon, table: np.ndarray, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    blocks = table.reshape(-1, CLASS_SIZE)
    out = words.inner.take(group, axis=0)
    for j in range(rows.shape[1]):
        out += blocks.take(_cells(rows[:, j], group), axis=0)
    return out


def _summed_rows(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    at = rows[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(grads.take(order, axis=0), first, axis=0)


def _read_slice(words: Lexicon, texts: list[str | None]) -> tuple[list[list[bytes]], list[int], tuple[np.ndarray, ...]]:
    """Of some texts: their tokens, how many they are, and the flat index, class, place and history rows of each."""
    found = [tokens(text) for text in texts]
    sizes = [len(x) for x in found]
    ids, classes, history = words.read(list(chain.from_iterable(found)))
    places = np.where(ids >= 0, words.places[ids], -1)
    return found, sizes, (ids, classes, places, *_history(history, sizes))


class Trainer:
    """Gradient updates on local copies of the weights."""

    def __init__(self, words: Lexicon, weights: Weights):
        self.words = words
        self.outer, self.inner = weights.outer.copy(), weights.inner.copy()
        self.seen_outer = np.zeros(ROWS, np.float32)
        self.seen_inner = np.zeros(INNER_ROWS * (TOP // CLASS_SIZE), np.float32)

    @staticmethod
    def _step(table: np.ndarray, seen: np.ndarray, at: np.ndarray, sums: np.ndarray) -> None:
        seen[at] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        sums *= (RATE / np.sqrt(seen[at] + 1e-6))[:, None]
        table[at] -= sums

    def update(self, classes: np.ndarray, places: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> None:
        grads = _softmax(_class_logits(self.words, self.outer, outer))
        grads[np.arange(len(classes)), classes] -= 1
        self._step(self.outer, self.seen_outer, np.zeros(1, np.int64), grads.sum(axis=0, keepdims=True))
        for j in range(outer.shape[1]):
            self._step(self.outer, self.seen_outer, *_summed_rows(outer[:, j], grads))
        top = np.flatnonzero(places >= 0)
        if len(top):
            group, rows = classes[top], inner[top]
            grads = _softmax(_inner_logits(self.words, self.inner, rows, group))
            grads[np.arange(len(top)), places[top]] -= 1
            blocks = self.inner.reshape(-1, CLASS_SIZE)
            for j in range(rows.shape[1]):
                self._step(blocks, self.seen_inner, *_summed_rows(_cells(rows[:, j], group), grads))

    def examples(self, texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """What ``update`` takes, a few texts at a time."""
        held: list[str | None] = []
        chars = 0
        for text in texts:
            held.append(text)
            chars += len(text or "")
            if chars >= SLICE_CHARS:
                yield _read_slice(self.words, held)[2][1:]
                held, chars = [], 0
        if held:
            yield _read_slice(self.words, held)[2][1:]


def _batched(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in batches of BATCH, about."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BATCH:
            whole = [np.concatenate(x) for x in zip(*held)]
            for at in range(0, n, BATCH):
                yield tuple(x[at : at + BATCH] for x in whole)
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


CHANGES = "part long, piece int, change binary, touched binary"


def _changes(docs: DataFrame, text: str, words, weights) -> DataFrame:
    """What the updates of each part change: (part, piece, change, touched). Rows lie by part."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((part, text) for batch in batches for part, text in zip(*(c.to_pylist() for c in batch.columns)))
        for part, own in groupby(rows, key=itemgetter(0)):
            yield changed(part, (text for _, text in own))

    def changed(part: int, texts: Iterator[str | None]) -> pa.RecordBatch:
        trainer = Trainer(words.value, weights.value)
        for batch in _batched(trainer.examples(texts)):
            trainer.update(*batch)
        new = Weights(trainer.outer, trainer.inner).flat()
        rows = []
        for table, (before, after) in enumerate(zip(weights.value.flat(), new)):
            size = PIECE_BYTES // (4 * after.shape[1])
            for at in range(0, len(after), size):
                change = after[at : at + size] - before[at : at + size]
                touched = (np.abs(change).max(axis=1) > 0).astype(np.float32)
                if touched.any():
                    rows.append((part, table * 1_000_000 + at, change.tobytes(), touched.tobytes()))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "piece", "change", "touched"]
        )

    return docs.select("part", text).mapInArrow(lambda batches: released(learned(batches)), CHANGES)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    """The sum of the changes of one piece."""
    change = np.sum([np.frombuffer(c, np.float32) for c in group["change"]], axis=0, dtype=np.float32)
    touched = np.sum([np.frombuffer(t, np.float32) for t in group["touched"]], axis=0, dtype=np.float32)
    return pd.DataFrame(
        {
            "part": [int(group["part"].iloc[0])],
            "piece": [int(group["piece"].iloc[0])],
            "change": [change.tobytes()],
            "touched": [touched.tobytes()],
        }
    )


def train(docs: DataFrame, text: str, key: Column, words: Lexicon, rounds: int = ROUNDS) -> Weights:
    """Weights learned from docs in slices by a hash of key."""
    spark = docs.sparkSession
    weights = Weights.zero()
    shared_words = spark.sparkContext.broadcast(words)
    dealt = -(-words.total // (rounds * PART_TOKENS)) or 1
    place = F.xxhash64(key, text)
    for number in range(rounds):
        own = docs.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == number)
        own = own.select(F.pmod(place, F.lit(dealt)).cast("int").alias("part"), place.alias("place"), key.alias("key"), text)
        shared = spark.sparkContext.broadcast(weights)
        parts = dealt
        lying = own.repartitionById(dealt, F.col("part")).sortWithinPartitions("place", "key", text)
        changes = _changes(lying, text, shared_words, shared)
        while True:
            changes = changes.withColumn("part", F.expr(f"part div {FAN}"))
            changes = changes.groupBy("part", "piece").applyInPandas(_added, CHANGES)
            parts = -(-parts // FAN)
            if parts <= 1:
                break
        tables = [t.copy() for t in weights.flat()]
        for row in changes.toLocalIterator():
            table, at = divmod(row.piece, 1_000_000)
            touched = np.frombuffer(row.touched, np.float32)
            change = np.frombuffer(row.change, np.float32).reshape(len(touched), -1)
            tables[table][at : at + len(touched)] += change / np.maximum(touched, 1)[:, None]
        weights = Weights(tables[0], tables[1].reshape(INNER_ROWS, TOP // CLASS_SIZE, CLASS_SIZE))
        shared.unpersist()
    return weights


RARE = "array<struct<token:string,n:int>>"
_SCORED = pa.struct(
    [
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("log_counts", pa.float64()),
        ("model", pa.float64()),
        ("rare", pa.list_(pa.struct([("token", pa.string()), ("n", pa.int32())]))),
    ]
)
SCORED = f"struct<n_tokens:bigint,known:bigint,log_counts:double,model:double,rare:{RARE}>"


class Scorer:
    def __init__(self, words: Lexicon, weights: Weights):
        self.words, self.outer, self.inner = words, weights.outer, weights.inner
        self.log_counts = np.log(words.counts + 1)

    def logs(self, classes: np.ndarray, places: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """log P(class) for all, plus log P(token | class) for tokens of the softmax."""
        out = _chosen_logs(_class_logits(self.words, self.outer, outer), classes)
        top = np.flatnonzero(places >= 0)
        if len(top):
            logits = _inner_logits(self.words, self.inner, inner[top], classes[top])
            out[top] += _chosen_logs(logits, places[top])
        return out

    def texts(self, texts: list[str | None]) -> list[dict]:
        words = self.words
        found, sizes, (ids, classes, places, *rows) = _read_slice(words, texts)
        known, tail = ids >= 0, places < 0
        if not words.known:
            known[:] = False
        fixed = np.where(known & tail, self.log_counts[ids], 0.0)
        fixed[tail] -= words.tail_log[classes[tail] - TOP // CLASS_SIZE]
        logs = fixed + np.concatenate([self.logs(*batch) for batch in _batched(iter([(classes, places, *rows)]))])
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, first) for x in (logs, known, np.where(known, self.log_counts[ids], 0.0))]
        rare: list[Counter] = [Counter() for _ in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        for i in np.flatnonzero(~known).tolist():
            at = int(owner[i])
            rare[at][found[at][i - int(first[at])]] += 1
        return [
            {
                "n_tokens": sizes[i],
                "known": int(sums[1][i]),
                "log_counts": float(sums[2][i]),
                "model": float(sums[0][i]),
                "rare": [{"token": w.decode("utf-8", "replace"), "n": n} for w, n in rare[i].items()],
            }
            for i in range(len(texts))
        ]


def _slices(batch: pa.Array) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    chars = 0
    for value in batch:
        held.append(value.as_py())
        chars += len(held[-1] or "")
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _scored(text: Column, words, weights) -> Column:
    def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(words.value, weights.value)
        for batch in batches:
            for texts in _slices(batch):
                yield pa.array(scorer.texts(texts), _SCORED)

    @F.arrow_udf(SCORED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(sliced(batches))

    return scored(text)


def score(docs: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the rows
    where ``held`` is not true train the model. Scores are log10 probabilities of whole texts."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(key), F.col(text).alias("__llm_text"), held.alias("__llm_held"))
    training = rows.filter(~F.col("__llm_held"))
    counts = stored(count_tokens(training, "__llm_text"))
    words = lexicon(counts)
    weights = train(training, "__llm_text", F.coalesce(F.col(key).cast("string"), F.lit("")), words)
    shared_words, shared = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(weights)
    first = stored(
        rows.select(
            F.monotonically_increasing_id().alias("__llm_row"), F.col(key).alias("__llm_key"), "__llm_held",
            _scored(F.col("__llm_text"), shared_words, shared).alias("s"),
        )
    )
    rare = first.select("__llm_row", F.explode("s.rare").alias("r")).select("__llm_row", "r.token", "r.n")
    # counts that were broadcast are used already; a rare token is never among them
    joined = rare.join(counts, "token")
    extra = joined.groupBy("__llm_row").agg(
        F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("logs"), F.sum("n").alias("known")
    )
    logs = F.coalesce(F.col("logs"), F.lit(0.0))
    ten = float(np.log(10))
    floor = float(np.log(words.total + words.distinct + 1))
    return first.join(extra, "__llm_row", "left").select(
        F.col("__llm_key").alias(key),
        F.col("__llm_held").alias("held_out"),
        F.col("s.n_tokens").alias("n_tokens"),
        (F.col("s.known") + F.coalesce(F.col("known"), F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        ((F.col("s.log_counts") + logs - F.col("s.n_tokens") * floor) / ten).alias("base_score"),
        ((F.col("s.model") + logs) / ten).alias("score"),
    )
