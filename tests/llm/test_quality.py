import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS
from tagsieve.llm import quality, queries
from tagsieve.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = queries.op2_additive_quality(spark, SF)
    rows = scored.filter("held_out").join(table(spark, SF, "labels"), "doc_id").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in rows)
    assert len(rows) > 40 and right / len(rows) >= 0.95
    assert scored.count() == table(spark, SF, "documents").count()


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    part = held_out(F.col("doc_id"), 5, 0)
    turned = labels.withColumn("quality", F.when(part, 1 - F.col("quality")).otherwise(F.col("quality")))
    models = [quality.fit(docs, "doc_id", "text", x.filter(~part), "quality") for x in (labels, turned)]
    rows = np.array([quality.describe(t) for t in ("some words here.", "###!! X")])
    assert (models[0].scores(rows) == models[1].scores(rows)).all()


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_lookups_equal_the_sum_of_tables():
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 4)), rng.integers(0, 2, 300).astype(float)
    model = quality.train(x, y)
    for row in x[:20]:
        total = model.intercept
        for j, value in enumerate(row):
            total += model.tables[j][sum(value >= e for e in model.edges[j])]
        for (a, b), values in zip(model.pairs, model.pair_tables):
            total += values[sum(row[a] >= e for e in model.pair_edges[a]), sum(row[b] >= e for e in model.pair_edges[b])]
        assert abs(model.logits(row[None, :])[0] - total) < 1e-9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (None, 0), (99, 0), (3, None)], "doc_id long, quality int")
    one_class = quality.fit(docs, "doc_id", "text", labels, "quality")
    rows = quality.classify(docs, "text", one_class, 0.3).collect()
    assert {round(r.score, 6) for r in rows} == {0.75} and len(rows) == len(ODD_TEXTS)
    none = quality.fit(docs, "doc_id", "text", labels.limit(0), "quality")
    assert {r.score for r in quality.classify(docs, "text", none, 0.3).collect()} == {0.5}
    both = quality.fit(docs, "doc_id", "text", spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int"), "quality")
    assert quality.classify(docs, "text", both, 0.3).count() == len(ODD_TEXTS)
    assert quality.classify(docs.limit(0), "text", both, 0.3).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    original = quality.train
    quality.train = lambda x, y: seen.append(len(y)) or original(x, y)
    try:
        quality.fit(docs, "doc_id", "text", labels, "quality", max_rows=500)
    finally:
        quality.train = original
    assert 350 < seen[0] < 650
