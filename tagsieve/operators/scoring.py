"""Stage 2: score chunks against every tag.

Two kinds of model: a linear one stored as a table of term coefficients, applied
natively, and any function from texts to logits, run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import scores, text

KEYS = ["doc_id", "trecho_id"]


@dataclass(frozen=True)
class LinearModel:
    """TF-IDF linear model over words and word pairs.

    ``terms`` has (term, idf, coefs) with one coefficient per tag; ``n_terms``, where it is known, bounds
    their number. A model of at most ``BROADCAST_CELLS`` numbers is broadcast, any other is not.
    """

    tags: list[str]
    terms: DataFrame
    intercepts: list[float]
    n_terms: int | None = None

    @property
    def small(self) -> bool:
        return self.n_terms is not None and self.n_terms * (len(self.tags) + 4) <= config.BROADCAST_CELLS


def _term_counts(rows: DataFrame, others: list[str], column: str) -> DataFrame:
    """(keys..., others..., _first, term, _tf): the terms of every row; its other columns are on the
    first one only. A row without terms gives one row."""
    words = rows.select("*", text.tokens(F.col(column)).alias("_words"))
    grams = words.select(*rows.columns, F.sort_array(text.with_bigrams(F.col("_words"))).alias("_grams"))
    runs = grams.select("*", text.run_starts(F.col("_grams")).alias("_starts"))
    counts = F.posexplode_outer(text.run_counts(F.col("_grams"), F.col("_starts"))).alias("_pos", "_gram")
    listed = runs.select(*KEYS, *others, counts)
    first = F.coalesce("_pos", F.lit(0)) == 0
    return listed.select(
        *KEYS,
        *[F.when(first, F.col(name)).alias(name) for name in others],
        first.alias("_first"),
        F.col("_gram.term").alias("term"),
        F.col("_gram.tf").alias("_tf"),
    )


def _sums(known: DataFrame, model: LinearModel, others: list[str]) -> DataFrame:
    """One row per text: its other columns, the length of its vector and its product with each tag."""
    weighted = known.withColumn("_w", F.col("_tf") * F.col("idf"))
    products = [F.sum(F.col("_w") * F.get("coefs", F.lit(i))).alias(f"_s{i}") for i in range(len(model.tags))]
    return weighted.groupBy(*KEYS).agg(
        *[F.max(name).alias(name) for name in others],
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"),
        *products,
    )


#: Bits, as a power of two, of the filter of a large model's terms: 4 MB.
_FILTER_BITS = 25


def _term_filter(terms: DataFrame) -> Column:
    """Whether ``term`` may be one of the model's: one bit for each hash of a term, in an array of fixed size."""
    place = F.pmod(F.xxhash64("term"), F.lit(1 << _FILTER_BITS))
    inside = F.pmod(place, F.lit(64)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), inside)
    held = terms.select(F.floor(place / 64).alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    every = terms.sparkSession.range(1 << (_FILTER_BITS - 6)).withColumnRenamed("id", "_i")
    filled = every.join(held, F.col("_i") == F.col("_at"), "left")
    cells = F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_bits", F.lit(0)).alias("_b"))))
    bits = filled.agg(F.transform(cells, lambda c: c["_b"]).alias("bits")).scalar()
    word = F.get(bits, F.floor(place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, inside).bitwiseAND(F.lit(1)) == 1


def score_linear(rows: DataFrame, model: LinearModel, column: str = "trecho", norm: str | None = None) -> DataFrame:
    """``rows`` plus ``logits``, and the lengths of their vectors where ``norm`` names a column for them; rows are told
    apart by (doc_id, trecho_id).

    Terms are counted inside the row. With a small model the other columns travel on the first of
    a row's terms, so scoring is one pass: no self-join of the rows and, when
    they lie by report, no shuffle. With a large one only (key, term, count) of terms
    that pass a filter of the model's terms meet the model in a plain join, and the sums
    come back to the rows.
    """
    others = [name for name in rows.columns if name not in KEYS]
    if model.small:
        postings = _term_counts(rows, others, column)
        known = postings.join(F.broadcast(model.terms), "term", "left").filter(F.col("idf").isNotNull() | F.col("_first"))
        summed = _sums(known, model, others)
    else:
        postings = _term_counts(rows.select(*KEYS, column), [], column).filter("term is not null").drop("_first")
        thinned = postings.filter(_term_filter(model.terms.select("term")))
        summed = rows.join(_sums(thinned.join(model.terms, "term"), model, []), KEYS, "left")
    logits = [
        F.coalesce(F.col(f"_s{i}") / F.col("_norm"), F.lit(0.0)) + F.lit(float(bias))
        for i, bias in enumerate(model.intercepts)
    ]
    length = [F.col("_norm").alias(norm)] if norm else []
    return summed.select(*rows.columns, F.array(*logits).alias("logits"), *length)


def batches_of(sizes: np.ndarray, max_rows: int, max_chars: int) -> list[np.ndarray]:
    """Places of texts in batches of similar length: at most max_rows texts, which take at most max_chars
    when all are as long as the longest; a longer text is a batch of its own."""
    out, held = [], []
    for place in np.argsort(sizes, kind="stable"):
        if held and (len(held) == max_rows or (len(held) + 1) * sizes[place] > max_chars):
            out.append(np.array(held))
            held = []
        held.append(place)
    return [*out, np.array(held)] if held else out


def score_batches(
    rows: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str = "trecho",
    batch_size: int = config.SCORING_BATCH,
    max_chars: int = config.SCORING_CHARS,
) -> DataFrame:
    """``rows`` plus ``logits`` from any model that maps an array of texts to a
    (texts x tags) array. ``make_predict`` runs once per Python worker, so the
    model is loaded once and not once per batch.

    A model pads a batch to its longest text. So the texts of a part are sorted by length, and a batch is
    bounded by the characters it takes when padded, not by rows alone: short texts are not padded
    to long ones, and long ones do not come in large batches.
    """
    model = uuid4().hex

    @F.pandas_udf("array<double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = ModelCache.get(model)
        if loaded is None:
            loaded = make_predict()
            ModelCache.add(model, loaded)
        for part in parts:
            texts = part.to_numpy(dtype=object)
            sizes = np.array([len(t) if t is not None else 0 for t in texts], dtype=np.int64)
            out = [None] * len(texts)
            for places in batches_of(sizes, batch_size, max_chars):
                for place, logits in zip(places, np.asarray(loaded(texts[places]), dtype=float)):
                    out[place] = logits
            yield pd.Series(out, dtype=object)

    return rows.withColumn("logits", predict(F.col(column)))


def classify(
    scored: DataFrame,
    tags: list[str],
    threshold: float = config.CLASSIFICATION_THRESHOLD,
    review_below: float = config.REVIEW_THRESHOLD,
) -> DataFrame:
    """Replace ``logits`` by ``probs`` and the prediction columns."""
    others = [name for name in scored.columns if name != "logits"]
    with_probs = scored.select(*others, scores.probabilities(F.col("logits")).alias("probs"))
    return with_probs.select(*others, *scores.decode(F.col("probs"), tags, threshold, review_below), "probs")


def wide_scores(classified: DataFrame, tags: list[str]) -> DataFrame:
    """The probability vector as one column per tag."""
    others = [name for name in classified.columns if name != "probs"]
    return classified.select(*[_quoted(name) for name in others], *scores.wide(F.col("probs"), tags))


def long_scores(classified: DataFrame, tags: list[str]) -> DataFrame:
    """(doc_id, trecho_id, idx, tag, prob), one row per chunk and tag."""
    names = F.array(*[F.lit(tag) for tag in tags])
    return classified.select(*KEYS, F.posexplode("probs").alias("idx", "prob")).select(
        *KEYS, "idx", F.get(names, F.col("idx")).alias("tag"), "prob"
    )


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
