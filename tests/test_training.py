from __future__ import annotations

import random

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve.operators import logistic
from tagsieve.plans import training

WORDS = [f"term{i}" for i in range(25)]


def quotations(spark, n=120):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 12))]
        codes = [w for w in ("term1", "term2", "term3") if w in words] + (["rare"] if i < 3 else [])
        rows.append((i, " ".join(words), " ; ".join(codes) or "none"))
    return spark.createDataFrame(rows, "ref_pos bigint, quotation string, codes string")


@pytest.fixture(scope="module")
def data(spark):
    return training.training_set(quotations(spark))


def newton(x, y):
    """Minimise 0.5*|w|^2 + sum of balanced losses, intercept free."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    design = np.column_stack([x, np.ones(n)])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty, grad)
    return w[:-1], w[-1]


def test_training_set(data):
    assert [r["tag"] for r in data.vocab.orderBy("idx").collect()] == ["none", "term1", "term2", "term3"]
    assert [tuple(r) for r in data.removed.collect()] == [("rare", 3)]
    assert data.test.count() == 24 and data.train.count() == 96


def test_features_are_unit_length_and_from_the_training_rows(data):
    model = training.fit_features(data.train, limit=30)
    assert len(model.stages[0].vocabulary) == 30
    rows = training.feature_rows(model, data.rows)
    lengths = rows.groupBy("row_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in lengths)
    top = [r["term"] for r in training.top_terms(data.train, 30).collect()]
    assert sorted(top) == list(model.stages[0].vocabulary)


def many_terms(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"word{int(i)}" for i in rng.zipf(1.4, 60) % 3000) for _ in range(200)]
    texts += ["equal pairs here", "nothing", "a b", ""]
    counts = Counter()
    for t in texts:
        words = re.findall(r"\w{3,}", t)
        counts.update(words)
        counts.update(" ".join(p) for p in zip(words, words[1:]))
    frame = spark.createDataFrame([(t,) for t in texts], "quotation string")
    return frame, sorted(counts.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("slots", [None, 1 << 16, 64])
@pytest.mark.parametrize("at_once", [10, 0])
def test_top_terms_whatever_the_way(spark, monkeypatch, slots, at_once):
    """Counted all or by a sketch, also one too small to tell anything; ranked at once or by ranges."""
    monkeypatch.setattr(training, "_SORTED_AT_ONCE", at_once)
    frame, expected = many_terms(spark)
    for limit in (1, 50, 700, 10**6):
        found = training.top_terms(frame, limit, slots=slots).collect()
        assert [tuple(r) for r in found] == expected[:limit]


def test_the_sketch_lets_few_terms_through(spark):
    frame, expected = many_terms(spark)
    words = frame.select(training.text.tokens(F.col("quotation")).alias("words"))
    terms = words.select(F.explode(training.text.with_bigrams(F.col("words"))).alias("term"))
    counted = training._counted_heavy(terms, 50, 1 << 16)
    assert 50 <= counted.count() < 100 < len(expected) / 20
    assert training._counted_heavy(terms, 50, 64) is None


def test_fit_equals_newton(data):
    model = training.fit_features(data.train, limit=60)
    fitted = training.fit_linear(data.train, data.vocab, model, tolerance=1e-9)
    vocabulary = {term: i for i, term in enumerate(model.stages[0].vocabulary)}
    rows = {r["row_id"]: r["tags"] for r in data.train.collect()}
    order = {row_id: i for i, row_id in enumerate(rows)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r in training.feature_rows(model, data.train).collect():
        x[order[r["row_id"]], vocabulary[r["term"]]] = r["weight"]
    coefs = {r["term"]: r["coefs"] for r in fitted.terms.collect()}
    for i, tag in enumerate(fitted.tags):
        y = np.array([float(tag in tags) for tags in rows.values()])
        w, bias = newton(x, y)
        assert fitted.intercepts[i] == pytest.approx(bias, abs=1e-4)
        assert np.allclose([coefs[term][i] for term in vocabulary], w, atol=1e-4)


def test_partial_gradients_add_up_over_many_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [
        ([int(i) for i in np.flatnonzero(mask)], [float(v) for v in rng.normal(size=mask.sum())], [0] if rng.random() < 0.4 else [])
        for mask in rng.random((200, 6)) < 0.5
    ]
    schema = "indices array<int>, values array<double>, labels array<int>"
    pos = np.array([sum(bool(r[2]) for r in rows)], dtype=float)
    results = []
    for tasks in (1, 40):
        frame = spark.createDataFrame(rows, schema).repartition(tasks)
        results.append(logistic.fit(frame, 6, len(rows), pos, 100, 1e-9))
    assert np.allclose(results[0][0], results[1][0], atol=1e-6)


def test_no_tag_waits_for_the_steps_of_others(spark, monkeypatch):
    """All tags together take as many passes as the slowest of them alone, and end where each ends alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) * np.array([12.0, 4.0, 1.0, 0.2])
    truth = x @ rng.normal(size=(4, 3)) + rng.normal(size=(60, 3)) * 8 > np.array([0.0, 9.0, -14.0])
    passes = []
    evaluate = logistic._evaluate

    def counting(*args):
        at = evaluate(*args)
        return lambda point, live: passes.append(len(live)) or at(point, live)

    monkeypatch.setattr(logistic, "_evaluate", counting)

    def fitted(tags):
        labels = [[i for i, tag in enumerate(tags) if row[tag]] for row in truth]
        rows = [([0, 1, 2, 3], [float(v) for v in values], found) for values, found in zip(x, labels)]
        frame = spark.createDataFrame(rows, "indices array<int>, values array<double>, labels array<int>").coalesce(1)
        passes.clear()
        coefs, bias = logistic.fit(frame, 4, len(rows), truth[:, tags].sum(axis=0).astype(float), 100, 1e-6)
        return coefs, bias, len(passes)

    alone = [fitted([tag]) for tag in range(3)]
    coefs, bias, together = fitted([0, 1, 2])
    assert together == max(n for _, _, n in alone)
    assert np.allclose(coefs, np.hstack([c for c, _, _ in alone]), atol=1e-6)
    assert np.allclose(bias, np.concatenate([b for _, b, _ in alone]), atol=1e-6)


def test_tag_without_rows_of_a_class(spark, data):
    vocab = spark.createDataFrame([(0, "term1"), (1, "unseen")], "idx int, tag string")
    model = training.fit_features(data.train)
    fitted = training.fit_linear(data.train, vocab, model)
    assert fitted.intercepts[1] == float("-inf")
    probs = training.score_rows(data.test, fitted).filter("tag = 'unseen'").select("prob").distinct().collect()
    assert [r["prob"] for r in probs] == [0.0]


def test_model_is_better_than_saying_nothing_and_survives_storage(spark, data, tmp_path):
    features = training.fit_features(data.train)
    model = training.fit_linear(data.train, data.vocab, features)
    scores = training.evaluate(data.test, model).first()
    assert scores["f1_macro"] > 0.6
    assert set(training.save_model(model, str(tmp_path), features)) == {"classificador", "vectorizer"}
    again = training.load_model(spark, str(tmp_path))
    assert again.tags == model.tags and again.intercepts == model.intercepts
    one = training.evaluate(data.test, again).first()
    assert one["f1_macro"] == pytest.approx(scores["f1_macro"])


def test_one_run_trains_evaluates_and_stores(spark, tmp_path):
    trained = training.train_and_report(quotations(spark), None, str(tmp_path), "m", max_terms=60)
    expected = {"classificador", "vectorizer", "labels", "frequencia_tags", "tags_removidas", "avaliacao", "metricas"}
    assert set(trained.paths) == expected and all((tmp_path / p.rsplit("/", 1)[1]).exists() for p in trained.paths.values())
    scores = spark.read.parquet(trained.paths["avaliacao"])
    assert scores.count() == trained.data.test.count() * len(trained.model.tags)
    metrics = trained.metrics.first()
    again = training.evaluate(trained.data.test, training.load_model(spark, str(tmp_path)), "m").first()
    assert metrics["model"] == "m" and metrics["f1_macro"] > 0.6
    assert [metrics[n] for n in ("f1_macro", "f1_micro", "f1_weighted")] == pytest.approx(list(again)[1:])


def test_optimality_tells_good_coefficients_from_others(spark, data):
    features = training.fit_features(data.train, limit=60)
    model = training.fit_linear(data.train, data.vocab, features, tolerance=1e-6)
    verdicts = {r["tag"]: r["optimal"] for r in training.optimality(data.train, data.vocab, model, 1e-5).collect()}
    assert verdicts == {"none": True, "term1": True, "term2": True, "term3": True}
    moved = model.terms.withColumn("coefs", F.transform("coefs", lambda c, i: F.when(i == 1, c + 0.5).otherwise(c)))
    other = type(model)(model.tags, moved, model.intercepts)
    verdicts = {r["tag"]: r["optimal"] for r in training.optimality(data.train, data.vocab, other, 1e-5).collect()}
    assert verdicts == {"none": True, "term1": False, "term2": True, "term3": True}


def zipf_rows(spark, n=400, terms=300):
    """(indices, values, labels) of unit length; few terms are in nearly all rows, most in a few."""
    rng = np.random.default_rng(12)
    share = 0.9 / np.arange(1, terms + 1) ** 0.8
    x = np.where(rng.random((n, terms)) < share, 1.0, 0.0) * (1.0 - np.log(share))
    x[:3] = 0.0
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]
    truth = x @ rng.normal(size=(terms, 4)) + rng.normal(size=(n, 4)) * 0.3 > np.array([0.0, 0.5, -0.5, 1.0])
    rows = []
    for values, found in zip(x, truth):
        at = np.flatnonzero(values)
        rows.append((at.tolist(), values[at].tolist(), np.flatnonzero(found).tolist()))
    frame = spark.createDataFrame(rows, "indices array<int>, values array<double>, labels array<int>").coalesce(2)
    return frame, n, terms, truth.sum(axis=0).astype(float)


def test_common_terms_do_not_hold_the_search_up(spark, monkeypatch):
    frame, n, terms, pos = zipf_rows(spark)
    passes, evaluate = [], logistic._evaluate

    def counting(*args):
        at = evaluate(*args)
        return lambda point, live: passes.append(len(live)) or at(point, live)

    monkeypatch.setattr(logistic, "_evaluate", counting)
    logistic.fit(frame, terms, n, pos, 500, 1e-5)
    assert len(passes) < 21  # 28 in plain coordinates


def test_blocks_and_pieces_of_any_size_give_the_same_fit(spark, monkeypatch):
    frame, n, terms, pos = zipf_rows(spark)
    coefs, bias = logistic.fit(frame, terms, n, pos, 500, 1e-9)
    for name, value in {"_BLOCK_ROWS": 37, "_BLOCK_VALUES": 100, "_PIECE": 16}.items():
        monkeypatch.setattr(logistic, name, value)
    small_coefs, small_bias = logistic.fit(frame, terms, n, pos, 500, 1e-9)
    assert np.allclose(coefs, small_coefs, atol=1e-5) and np.allclose(bias, small_bias, atol=1e-5)
    blocks = frame.mapInArrow(logistic._packer(37, 100, None), logistic._BLOCK).collect()
    sizes = [np.frombuffer(b["sizes"], np.int64) for b in blocks]
    assert sum(map(len, sizes)) == n and all(len(s) == 1 or (len(s) <= 37 and s.sum() <= 100) for s in sizes)


def test_counts_made_once_serve_weights_and_training(spark, data):
    features = training.fit_features(data.train, limit=60)
    counted = training._counted(features.stages[0], data.train, "quotation", "tags")
    again = training._weighed(features.stages[0], counted)
    assert again.stages[1].getScalingVec() == features.stages[1].getScalingVec()
    one = training.fit_linear(data.train, data.vocab, features, tolerance=1e-9)
    two = training.fit_linear(data.train, data.vocab, features, tolerance=1e-9, counted=counted)
    assert one.tags == two.tags and np.allclose(one.intercepts, two.intercepts, atol=1e-6)
    first, second = ({r["term"]: r["coefs"] for r in m.terms.collect()} for m in (one, two))
    assert first.keys() == second.keys() and all(np.allclose(first[t], second[t], atol=1e-6) for t in first)
