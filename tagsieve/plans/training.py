"""Training: data preparation, TF-IDF features, one linear model per tag, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import scores, text
from tagsieve.operators import labels, logistic, metrics, scoring, split
from tagsieve.operators.chunks import term_counts
from tagsieve.operators.ranks import numbered
from tagsieve.session import stored
from tagsieve.sources import sinks


@dataclass(frozen=True)
class TrainingSet:
    rows: DataFrame  # row_id, quotation, codes, tags, is_test
    vocab: DataFrame  # idx, tag
    frequencies: DataFrame  # tag, n of the kept tags
    removed: DataFrame  # tag, n of the rare tags

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("is_test")


def training_set(
    quotations: DataFrame,
    reviews: DataFrame | None = None,
    min_count: int = config.MIN_TAG_COUNT,
    test_size: float = config.TEST_SIZE,
    seed: int = config.SEED,
    min_train: int = config.MIN_TRAIN_PER_TAG,
) -> TrainingSet:
    """Merge corrections, clean, list tags, drop rare tags and split."""
    # Many steps below read these rows and the short tag table.
    tagged = stored(labels.with_tags(labels.training_base(quotations, reviews)))
    frequency = stored(labels.tag_frequency(tagged))
    kept = labels.frequent_tags(frequency, min_count)
    rows = split.tag_preserving_split(labels.keep_tags(tagged, kept), test_size, seed, min_train)
    return TrainingSet(rows, labels.label_vocab(kept.select("tag")), kept, labels.rare_tags(frequency, min_count))


def _sketch(terms: DataFrame, slots: int) -> DataFrame:
    """(slot, n): terms counted by a hash of theirs. A slot's count is at least that of each of its terms."""
    return stored(terms.groupBy(_slot(slots).alias("slot")).agg(F.count(F.lit(1)).alias("n")))


def _slot(slots: int):
    return F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int")


def _least_count(sketch: DataFrame, limit: int) -> int:
    """The count that a few more than ``limit`` slots reach: about what the last of the top terms has."""
    room = limit + limit // 4
    # there are about as many different counts as the square root of the number of words
    for row in sketch.groupBy("n").agg(F.count(F.lit(1)).alias("slots")).orderBy(F.desc("n")).toLocalIterator():
        room -= row["slots"]
        if room <= 0:
            return row["n"]
    return 1


def _counted_heavy(terms: DataFrame, limit: int, slots: int) -> DataFrame | None:
    """Counts of the terms in slots that reach some count, or None where they do not hold all top terms."""
    sketch = _sketch(terms, slots)
    least = _least_count(sketch, limit)
    heavy = F.broadcast(sketch.filter(F.col("n") >= least).select("slot"))
    kept = terms.withColumn("slot", _slot(slots)).join(heavy, "slot", "left_semi")
    counted = stored(kept.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    return counted if counted.count() >= limit else None


#: So many times the limit may be sorted at once; more equal terms are ranked by ranges.
_SORTED_AT_ONCE = 10


def top_terms(
    rows: DataFrame, limit: int = config.TFIDF_MAX_TERMS, column: str = "quotation", slots: int | None = None
) -> DataFrame:
    """(term, n): the most frequent words and word pairs; equal counts in term order.

    Counts of counts, of which ``limit`` are enough, tell the count of the last top term and how many terms
    reach it. Only these are sorted: at once where they are few, else by ranges.

    With ``slots``, terms that cannot be among the top are not counted one by one: a count-min sketch
    with one row of so many counters never falls short, so a term in a slot below some count is below
    it too, and only terms of the other slots, a broadcast of at most ``slots`` numbers, enter
    the second shuffle. If fewer than ``limit`` of them reach the count, everything is counted. That walks
    twice over the words and moves far less, which pays where most terms are rare and moving
    them costs more than cutting texts.
    """
    words = rows.select(text.tokens(F.col(column)).alias("words"))
    counted = None
    if slots:
        words = stored(words)
    terms = words.select(F.explode_outer(text.with_bigrams(F.col("words"))).alias("term")).filter("term is not null")
    if slots:
        counted = _counted_heavy(terms, limit, slots)
    if counted is None:
        counted = stored(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    levels = counted.groupBy("n").agg(F.count(F.lit(1)).alias("terms"))
    least, reached = 0, 0
    for row in levels.orderBy(F.desc("n")).limit(limit).collect():
        least, reached = row["n"], reached + row["terms"]
        if reached >= limit:
            break
    found = counted.filter(F.col("n") >= least)
    if reached > _SORTED_AT_ONCE * limit:
        found = numbered(found.withColumn("_minus", -F.col("n")), ["_minus", "term"], "_rank")
        found = found.filter(F.col("_rank") < limit).select("term", "n")
    return found.orderBy(F.desc("n"), "term").limit(limit)


def with_grams(rows: DataFrame, column: str = "quotation") -> DataFrame:
    words = rows.select("*", text.tokens(F.col(column)).alias("_words"))
    return words.withColumn("grams", text.with_bigrams(F.col("_words"))).drop("_words")


def fit_features(train: DataFrame, limit: int = config.TFIDF_MAX_TERMS, column: str = "quotation") -> PipelineModel:
    """Smoothed TF-IDF over words and pairs, unit length; input column ``grams``.

    The vocabulary, at most ``limit`` terms, is the only thing the driver holds.
    """
    counter = _counter(train, limit, column)
    return _weighed(counter, _counted(counter, train, column))


def _counter(train: DataFrame, limit: int, column: str) -> CountVectorizerModel:
    vocabulary = sorted(row["term"] for row in top_terms(train, limit, column).collect())
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="counts")


def _counted(counter: CountVectorizerModel, rows: DataFrame, column: str, *others: str) -> DataFrame:
    """(indices, values, others...): how often the vocabulary's terms are in each row."""
    counts = F.unwrap_udt("counts").alias("_c")
    found = counter.transform(with_grams(rows.select(column, *others), column)).select(counts, *others)
    return found.select(F.col("_c.indices").alias("indices"), F.col("_c.values").alias("values"), *others)


def _weighed(counter: CountVectorizerModel, counted: DataFrame) -> PipelineModel:
    """The vectorizer with weights from the counted rows."""
    vocabulary, found = counter.vocabulary, counted.select(F.col("indices").alias("found"))
    # rows with each term, and all rows under -1: as many numbers as terms, added up in place
    each = found.select(F.explode_outer(F.concat(F.array(F.lit(-1)), "found")).alias("pos"))
    rows_with = {r["pos"]: r["n"] for r in each.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    df = np.array([rows_with.get(i, 0) for i in range(len(vocabulary))], dtype=float)
    idf = np.log((rows_with.get(-1, 0) + 1.0) / (df + 1.0)) + 1.0
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted")
    return PipelineModel([counter, weigh, Normalizer(p=2.0, inputCol="weighted", outputCol="features")])


def feature_rows(model: PipelineModel, rows: DataFrame, column: str = "quotation") -> DataFrame:
    """(row_id, term, weight) of every non-zero feature."""
    vocabulary = pd.DataFrame({"term": model.stages[0].vocabulary})
    terms = rows.sparkSession.createDataFrame(vocabulary.reset_index(names="pos"), "pos int, term string")
    sparse = model.transform(with_grams(rows, column)).select("row_id", F.unwrap_udt("features").alias("f"))
    pairs = F.arrays_zip(F.col("f.indices").alias("pos"), F.col("f.values").alias("weight"))
    exploded = sparse.select("row_id", F.explode_outer(pairs).alias("p")).filter("p is not null")
    return exploded.select("row_id", "p.pos", "p.weight").join(F.broadcast(terms), "pos").select(
        "row_id", "term", "weight"
    )


def _tasks(spark: SparkSession, n_rows: int) -> int:
    """Parts of the training rows: at least one for a core where rows are enough."""
    cores = spark.sparkContext.defaultParallelism
    return max(-(-n_rows // config.TRAIN_ROWS_PER_TASK), min(cores, -(-n_rows // 100)), 1)


def fit_linear(
    train: DataFrame,
    vocab: DataFrame,
    features: PipelineModel,
    column: str = "quotation",
    max_iter: int = config.LR_MAX_ITER,
    tolerance: float = config.LR_TOLERANCE,
    counted: DataFrame | None = None,
) -> scoring.LinearModel:
    """Balanced logistic regression for each tag of ``vocab`` from (row_id, quotation, tags). ``counted``, where it is
    given, has (indices, values, tags) of the same rows, the counts of the vectorizer's terms."""
    tags = [row["tag"] for row in vocab.orderBy("idx").collect()]
    n_rows = train.count()
    counts = {row["tag"]: row["n"] for row in labels.tag_frequency(train).collect()}
    known = F.array(*[F.lit(tag) for tag in tags]).cast("array<string>")
    found = F.transform("tags", lambda tag: F.array_position(known, tag).cast("int") - 1)
    if counted is None:
        # dealt before the words are paired: only the texts move
        dealt = train.select(column, "tags").repartition(_tasks(train.sparkSession, n_rows))
        counted = _counted(features.stages[0], dealt, column, "tags")
    rows = counted.select("indices", "values", F.filter(found, lambda i: i >= 0).alias("labels"))
    vocabulary = features.stages[0].vocabulary
    pos = np.array([counts.get(tag, 0) for tag in tags], dtype=float)
    idf = features.stages[1].getScalingVec().toArray()
    coefs, bias = logistic.fit(rows, len(vocabulary), n_rows, pos, max_iter, tolerance, idf)
    terms = pd.DataFrame({"term": vocabulary, "idf": idf, "coefs": coefs.tolist()})
    table = train.sparkSession.createDataFrame(terms, "term string, idf double, coefs array<double>")
    return scoring.LinearModel(tags, table, bias.tolist(), len(vocabulary))


def score_rows(rows: DataFrame, model: scoring.LinearModel, column: str = "quotation") -> DataFrame:
    """(row_id, tags, idx, tag, prob) for annotated rows."""
    texts = rows.select(F.col("row_id").alias("doc_id"), F.lit(1).alias("trecho_id"), F.col(column).alias("trecho"), "tags")
    scored = scoring.score_linear(texts, model)
    names = F.array(*[F.lit(tag) for tag in model.tags])
    return scored.select(
        F.col("doc_id").alias("row_id"), "tags", F.posexplode(scores.probabilities(F.col("logits"))).alias("idx", "prob")
    ).select("row_id", "tags", "idx", F.get(names, F.col("idx")).alias("tag"), "prob")


def evaluate(rows: DataFrame, model: scoring.LinearModel, name: str = "tfidf_lr", column: str = "quotation") -> DataFrame:
    """F1 of the model on annotated rows."""
    scored = score_rows(rows, model, column)
    outcome = scored.select(
        F.lit(name).alias("model"), "idx", F.array_contains("tags", F.col("tag")).alias("truth"), "prob"
    )
    return metrics.f1_metrics(outcome)


def coefficient_table(model: scoring.LinearModel) -> DataFrame:
    """(idx, tag, term, idf, weight, intercept): the fitted model as rows."""
    names = F.array(*[F.lit(tag) for tag in model.tags])
    biases = F.array(*[F.lit(bias) for bias in model.intercepts])
    return model.terms.select("term", "idf", F.posexplode("coefs").alias("idx", "weight")).select(
        "idx",
        F.get(names, F.col("idx")).alias("tag"),
        "term",
        "idf",
        "weight",
        F.get(biases, F.col("idx")).alias("intercept"),
    )


def optimality(train: DataFrame, vocab: DataFrame, model: scoring.LinearModel, tolerance: float) -> DataFrame:
    """(idx, tag, n_train, n_pos, optimal) for every tag of ``vocab``: whether no component of the gradient
    of the training objective, at these coefficients, exceeds the tolerance.

    The objective is the mean of the losses, each weighing n / (2 * rows of its class), plus
    |w|^2 / (2 * n), with a free intercept. Tags without rows of both classes have none, and
    are not optimal."""
    n = train.count()
    counts = labels.label_counts(train, vocab)
    sides = {row["tag"]: row["pos"] for row in counts.collect()}
    known = F.array(*[F.lit(tag) for tag in model.tags])
    # what a row of each class weighs in the loss of each tag; 0 where there is no objective
    usable = [0 < sides.get(tag, 0) < n for tag in model.tags]
    weigh_pos = F.array(*[F.lit(0.5 / sides[tag] if use else 0.0) for tag, use in zip(model.tags, usable)])
    weigh_neg = F.array(*[F.lit(0.5 / (n - sides[tag]) if use else 0.0) for tag, use in zip(model.tags, usable)])
    texts = train.select(F.col("row_id").alias("doc_id"), F.lit(1).alias("trecho_id"), F.col("quotation").alias("trecho"))
    scored = scoring.score_linear(texts, model, norm="norm").select("doc_id", "logits", "norm")
    # tags come back afterwards: only numbers are summed up on the way, so postings are not sorted
    carried = train.groupBy("row_id").agg(F.max("tags").alias("tags"))
    both = scored.join(carried, F.col("doc_id").eqNullSafe(F.col("row_id")))

    def error(logit, i):
        truth = F.array_contains("tags", F.get(known, i))
        weight = F.when(truth, F.get(weigh_pos, i)).otherwise(F.get(weigh_neg, i))
        return F.when(weight > 0, weight * (scores.sigmoid(logit) - truth.cast("int"))).otherwise(0.0)

    errors = stored(both.select("row_id", "norm", F.transform("logits", error).alias("e")))
    per_row = errors.filter("norm is not null").select("row_id", F.transform("e", lambda e: e / F.col("norm")).alias("e"))
    idf = model.terms.select("term", "idf")
    if model.small:
        # texts meet their errors before they are cut, and terms are summed up where they are cut
        cut = term_counts(train.select("row_id", "quotation").join(per_row, "row_id"), ["e"], "quotation", bigrams=True)
        weighted = cut.join(F.broadcast(idf), "term")
    else:
        # one array of errors a row: a term meets its rows once, not once for every tag
        weighted = term_counts(train, ["row_id"], "quotation", bigrams=True).join(idf, "term").join(per_row, "row_id")
    slopes = weighted.groupBy("term").agg(
        *[F.sum(F.col("tf") * F.col("idf") * F.get("e", F.lit(i))).alias(f"_g{i}") for i in range(len(model.tags))]
    )
    both = model.terms.select("term", "coefs").join(slopes, "term", "left")
    gradient = [F.abs(F.coalesce(f"_g{i}", F.lit(0.0)) + F.get("coefs", F.lit(i)) / n) for i in range(len(model.tags))]
    steepest = both.agg(*[F.max(g).alias(f"_s{i}") for i, g in enumerate(gradient)]).first()
    free = errors.agg(*[F.abs(F.sum(F.get("e", F.lit(i)))).alias(f"_f{i}") for i in range(len(model.tags))]).first()
    small = [
        (i, use and max(steepest[i] or 0.0, free[i] or 0.0) <= tolerance * 1.01) for i, use in enumerate(usable)
    ]
    verdicts = train.sparkSession.createDataFrame(
        [(model.tags[i], bool(ok)) for i, ok in small], "tag string, optimal boolean"
    )
    return counts.join(verdicts, "tag", "left").select(
        "idx", "tag", F.col("n").alias("n_train"), F.col("pos").alias("n_pos"), F.coalesce("optimal", F.lit(False)).alias("optimal")
    )


@dataclass(frozen=True)
class Trained:
    data: TrainingSet
    features: PipelineModel
    model: scoring.LinearModel
    paths: dict[str, str]  # classificador, vectorizer, labels, frequencia_tags, avaliacao, metricas, ...
    metrics: DataFrame  # model, f1_macro, f1_micro, f1_weighted, as stored


def train_and_report(
    quotations: DataFrame,
    reviews: DataFrame | None,
    folder: str,
    name: str = "tfidf_lr",
    max_terms: int = config.TFIDF_MAX_TERMS,
    min_count: int = config.MIN_TAG_COUNT,
    test_size: float = config.TEST_SIZE,
    seed: int = config.SEED,
) -> Trained:
    """The whole training run: prepare and split, fit on the training part, store model, vectorizer and
    label tables, score the test part once, store the scores and the F1 computed from them.

    ``folder`` must not hold an earlier run. Scores are (model, row_id, idx, tag, truth, prob), one row for
    each test row and tag, so that other metrics need no model.
    """
    prepared = training_set(quotations, reviews, min_count, test_size, seed)
    data = TrainingSet(stored(prepared.rows), stored(prepared.vocab), prepared.frequencies, prepared.removed)
    # texts are cut twice: for the vocabulary, and once dealt for the counts that weights and training both need
    counter = _counter(data.train, max_terms, "quotation")
    dealt = data.train.select("quotation", "tags").repartition(_tasks(quotations.sparkSession, data.train.count()))
    counted = stored(_counted(counter, dealt, "quotation", "tags"))
    features = _weighed(counter, counted)
    model = fit_linear(data.train, data.vocab, features, counted=counted)
    paths = save_model(model, folder, features)
    paths |= sinks.write_label_tables(folder, data.vocab, data.frequencies, data.removed)
    paths |= {"avaliacao": f"{folder}/avaliacao", "metricas": f"{folder}/metricas"}
    scored = score_rows(data.test, model).select(
        F.lit(name).alias("model"), "row_id", "idx", "tag", F.array_contains("tags", F.col("tag")).alias("truth"), "prob"
    )
    scored.write.parquet(paths["avaliacao"])
    spark = quotations.sparkSession
    metrics.f1_metrics(spark.read.schema(scored.schema).parquet(paths["avaliacao"])).write.parquet(paths["metricas"])
    return Trained(data, features, model, paths, spark.read.parquet(paths["metricas"]))


def save_model(model: scoring.LinearModel, folder: str, features: PipelineModel | None = None) -> dict[str, str]:
    """Coefficients and, where given, the fitted vectorizer side by side."""
    paths = {"classificador": f"{folder}/classificador"}
    coefficient_table(model).write.parquet(paths["classificador"])
    if features is not None:
        paths["vectorizer"] = f"{folder}/vectorizer"
        features.write().save(paths["vectorizer"])
    return paths


def load_features(folder: str) -> PipelineModel:
    """The fitted vectorizer stored next to a model."""
    return PipelineModel.load(f"{folder}/vectorizer")


def load_model(spark: SparkSession, folder: str) -> scoring.LinearModel:
    """Linear model from a stored coefficient table."""
    table = spark.read.parquet(f"{folder}/classificador")
    head = table.select("idx", "tag", "intercept").distinct().orderBy("idx").collect()
    terms = table.groupBy("term", "idf").agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("c"))
    return scoring.LinearModel(
        [row["tag"] for row in head],
        terms.select("term", "idf", F.col("c.weight").alias("coefs")),
        [row["intercept"] for row in head],
        table.count() // max(1, len(head)),
    )
