from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve.functions import scores
from tagsieve.operators import metrics, scoring

TAGS = ["Área: Um", "b", "c"]


def classified(spark, *probs):
    rows = spark.createDataFrame([(i, 1, list(map(float, p))) for i, p in enumerate(probs)], "doc_id int, trecho_id int, probs array<double>")
    return rows.select("doc_id", "trecho_id", *scores.decode(F.col("probs"), TAGS), "probs").orderBy("doc_id")


def test_decode(spark):
    found = classified(spark, (0.4, 0.49999, 0.1), (0.5, 0.2, 0.9), (0.69996, 0.1, 0.1), (0.7, 0.0, 0.0)).collect()
    assert [r["tags_preditas"] for r in found] == [None, "Área: Um | c", "Área: Um", "Área: Um"]
    assert [r["numero_tags"] for r in found] == [0, 2, 1, 1]
    assert [r["confianca"] for r in found] == [0.5, 0.9, 0.7, 0.7]
    assert [r["revisar"] for r in found] == [True, False, True, False]


def test_wide_and_long(spark):
    frame = classified(spark, (0.12345, 0.2, 0.3))
    row = scoring.wide_scores(frame, TAGS).first().asDict()
    assert row["prob_.rea..Um"] == 0.1234 and row["prob_c"] == 0.3
    assert [tuple(r) for r in scoring.long_scores(frame, TAGS).collect()][1] == (0, 1, 1, "b", 0.2)
    for tags in (["a-b", "a.b"], ["Um", "um"]):
        with pytest.raises(ValueError):
            scores.probability_names(tags)


@pytest.mark.parametrize("n_terms", [None, 2])
def test_linear_scores_equal_the_formula(spark, n_terms):
    terms = spark.createDataFrame(
        [("rede", 2.0, [1.0, -1.0]), ("rede social", 3.0, [0.5, 2.0])], "term string, idf double, coefs array<double>"
    )
    model = scoring.LinearModel(["x", "y"], terms, [0.25, float("-inf")], n_terms)
    assert model.small == (n_terms is not None)
    rows = spark.createDataFrame(
        [(1, 1, "Rede social rede", "k"), (1, 2, "nada aqui", "l"), (2, 1, "...", None)],
        "doc_id int, trecho_id int, trecho string, other string",
    )
    got = {(r["doc_id"], r["trecho_id"]): r for r in scoring.score_linear(rows, model).collect()}
    size = np.sqrt(4.0**2 + 3.0**2)
    assert got[1, 1]["logits"] == [pytest.approx((4 * 1 + 3 * 0.5) / size + 0.25), float("-inf")]
    assert got[1, 2]["logits"] == got[2, 1]["logits"] == [0.25, float("-inf")]
    assert got[1, 1]["trecho"] == "Rede social rede" and got[1, 2]["other"] == "l" and got[2, 1]["other"] is None
    probs = scoring.classify(scoring.score_linear(rows, model), ["x", "y"]).filter("trecho_id = 2").first()["probs"]
    assert probs == [pytest.approx(1 / (1 + np.exp(-0.25))), 0.0]


def test_a_model_of_two_million_terms_is_joined(spark):
    size = 2_000_000
    coefs = F.array((F.col("id") % 7 - 3).cast("double"), (F.col("id") % 5).cast("double"))
    terms = spark.range(size).select(
        F.concat(F.lit("w"), F.col("id")).alias("term"), (1.0 + F.col("id") % 3).alias("idf"), coefs.alias("coefs")
    )
    model = scoring.LinearModel(["x", "y"], terms, [0.5, -0.5], size)
    texts = [f"w{1000 + 17 * i} w{i} unknown{i} w{1999999 - i} w{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, trecho_id int, trecho string")
    # sizes at run time may still make it a broadcast; the plan does not ask for one
    found = scoring.score_linear(rows, model)
    assert not model.small and "ResolvedHint" not in found._jdf.queryExecution().analyzed().toString()
    got = {r["doc_id"]: r["logits"] for r in found.collect()}
    for i, t in enumerate(texts):
        counts = {}
        for w in t.split():
            if w.startswith("w") and len(w) >= 3:
                counts[int(w[1:])] = counts.get(int(w[1:]), 0) + 1
        weights = {n: tf * (1.0 + n % 3) for n, tf in counts.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        expected = [sum(w * (n % 7 - 3) for n, w in weights.items()) / norm + 0.5, sum(w * (n % 5) for n, w in weights.items()) / norm - 0.5]
        assert got[i] == pytest.approx(expected)
    bits = rows.select(F.explode(F.split("trecho", " ")).alias("term")).filter(scoring._term_filter(terms.select("term")))
    kept = [r["term"] for r in bits.collect()]
    assert sum(t.startswith("w") for t in kept) == 1200 and sum(t.startswith("unknown") for t in kept) < 60


def test_batches_are_bounded_by_padded_characters():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 900, 500)
    sizes[7] = 40_000
    batches = scoring.batches_of(sizes, 64, 10_000)
    assert sorted(np.concatenate(batches)) == list(range(500))
    for batch in batches:
        assert len(batch) <= 64 and (len(batch) * sizes[batch].max() <= 10_000 or len(batch) == 1)
    padded = sum(len(b) * sizes[b].max() for b in batches)
    assert padded < 1.2 * sizes.sum()  # little is padding
    assert scoring.batches_of(sizes[:0], 8, 10) == []


def test_batch_model_sees_bounded_batches(spark):
    def make_predict():
        def predict(texts):
            assert len(texts) * max(map(len, texts)) <= 200 or len(texts) == 1
            return np.array([[float(len(t)), float(len(texts))] for t in texts])

        return predict

    rows = spark.createDataFrame([(i, 1, "x" * (i * 7 % 90)) for i in range(60)], "doc_id int, trecho_id int, trecho string")
    got = {r["doc_id"]: r["logits"] for r in scoring.score_batches(rows.coalesce(1), make_predict, max_chars=200).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: float(i * 7 % 90) for i in range(60)}
    assert max(x[1] for x in got.values()) == 8


def test_batch_model(spark):
    def make_predict():
        def predict(texts):
            return np.array([[float(len(t)), -1.0] for t in texts])

        return predict

    rows = spark.createDataFrame([(i, 1, "x" * i) for i in range(20)], "doc_id int, trecho_id int, trecho string")
    got = {r["doc_id"]: r["logits"] for r in scoring.score_batches(rows, make_predict).collect()}
    assert got == {i: [float(i), -1.0] for i in range(20)}


def test_f1(spark):
    rows = [("m", 0, True, 0.9), ("m", 0, False, 0.5), ("m", 0, True, 0.1), ("m", 1, True, 0.8), ("m", 2, False, 0.0)]
    rows += [("zero", 0, False, 0.1)]
    frame = spark.createDataFrame(rows, "model string, idx int, truth boolean, prob double")
    got = {r["model"]: r for r in metrics.f1_metrics(frame).collect()}
    assert got["m"]["f1_macro"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert got["m"]["f1_micro"] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))
    assert got["m"]["f1_weighted"] == pytest.approx((2 * 0.5 + 1 * 1) / 3)
    assert [got["zero"][name] for name in ("f1_macro", "f1_micro", "f1_weighted")] == [0, 0, 0]
