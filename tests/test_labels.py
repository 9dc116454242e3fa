from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tagsieve.operators import labels, split
from tagsieve.sources import sinks
from tests import plain
from workload import queries

QUOTATION = "ref_pos bigint, quotation string, codes string"
REVIEW = "seq bigint, quotation string, codes string"


def tagged_rows(spark, rows):
    return spark.createDataFrame(rows, "row_id string, tags array<string>")


def test_clean(spark):
    rows = spark.createDataFrame([(None, "x"), ("", "x"), ("nan", "x"), (" ", "x"), ("q", None)], "quotation string, codes string")
    assert [r["quotation"] for r in labels.clean_quotations(rows).collect()] == [" "]
    assert labels.clean_quotations(rows, ("quotation",)).count() == 2


def test_latest_review_wins(spark):
    originals = spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "p", "c"), (4, "p", "d"), (5, "n", "x")], QUOTATION)
    reviews = spark.createDataFrame([(9, "q", "new"), (3, "q", "old"), (4, "fresh", "f"), (5, "n", "nan")], REVIEW)
    merged = labels.training_base(originals, reviews).collect()
    assert sorted((r["row_id"], r["quotation"], r["codes"]) for r in merged) == [
        ("o4", "p", "d"),
        ("r4", "fresh", "f"),
        ("r9", "q", "new"),
    ]


def test_stored_corrections_without_numbers_win(spark, tmp_path):
    originals = spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "p", "c")], QUOTATION)
    path = f"{tmp_path}/reviews"
    spark.createDataFrame([(7, "q", "numbered")], REVIEW).write.parquet(path)
    for codes in ("first", "second"):
        new = spark.createDataFrame([("q", codes, "2024-05-06 07:08")], "quotation string, codes string, data_revisao string")
        sinks.write_reviews(new, path)
    merged = labels.training_base(originals, sinks.read_reviews(spark, path)).collect()
    assert {(r["quotation"], r["codes"]) for r in merged} == {("q", "second"), ("p", "c")}
    assert all(r["row_id"] for r in merged)
    plain = spark.createDataFrame([("q", "x"), ("q", "x")], "quotation string, codes string")
    assert {r["codes"] for r in labels.training_base(originals, plain).collect()} == {"x", "c"}


def test_without_usable_reviews_repeats_stay(spark):
    originals = spark.createDataFrame([(1, "q", "a"), (2, "q", "b")], QUOTATION)
    assert labels.training_base(originals).count() == 2
    wrong = spark.createDataFrame([("q",)], "text string")
    assert labels.training_base(originals, wrong).count() == 2


def test_one_quotation_in_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("ref_pos"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("quotation"),
        F.col("id").cast("string").alias("codes"),
    )
    merged = labels.training_base(rows, spark.createDataFrame([], REVIEW))
    assert merged.count() == 2001
    assert merged.filter("quotation = 'hot'").first()["codes"] == "2997"


def test_rare_tags_and_rows_left_without_tags(spark):
    rows = tagged_rows(
        spark, [(f"{i}", ["five"] + (["four"] if i < 4 else [])) for i in range(5)] + [("x", ["once"])]
    )
    frequency = labels.tag_frequency(rows)
    kept = labels.frequent_tags(frequency)
    assert [tuple(r) for r in kept.collect()] == [("five", 5)]
    assert sorted(tuple(r) for r in labels.rare_tags(frequency).collect()) == [("four", 4), ("once", 1)]
    left = {r["row_id"]: r["tags"] for r in labels.keep_tags(rows, kept).collect()}
    assert left == {**{f"{i}": ["five"] for i in range(5)}, "x": []}
    nothing = labels.keep_tags(rows, labels.frequent_tags(frequency, 99))
    assert {tuple(r["tags"]) for r in nothing.collect()} == {()}


def test_vocabulary_order_and_matrix(spark):
    rows = tagged_rows(spark, [("1", ["é", "b"]), ("2", ["Z", "unknown"]), ("3", [])])
    vocab = labels.label_vocab(spark.createDataFrame([("é",), ("b",), ("Z",)], "tag string"))
    assert [r["tag"] for r in vocab.orderBy("idx").collect()] == sorted(["é", "b", "Z"])
    ones = labels.label_matrix(rows, vocab).collect()
    assert sorted(tuple(r) for r in ones) == [("1", 1), ("1", 2), ("2", 0)]


def test_weights(spark):
    counts = spark.createDataFrame(
        [(0, "none", 20, 0), (1, "most", 20, 15), (2, "few", 41, 1), (3, "all", 4, 4)],
        "idx int, tag string, n bigint, pos bigint",
    )
    assert {r["tag"]: r["pos_weight"] for r in labels.pos_weight(counts).collect()} == {
        "none": 15.0,
        "most": 1.0,
        "few": 15.0,
        "all": 1.0,
    }
    balanced = {r["tag"]: (r["weight_pos"], r["weight_neg"]) for r in labels.class_weight(counts).collect()}
    assert balanced["none"] == (None, 0.5)
    assert balanced["most"] == (pytest.approx(2 / 3), 2.0)
    assert balanced["all"] == (0.5, None)


def test_counts_include_unused_tags_and_untrained(spark):
    rows = tagged_rows(spark, [("1", ["a"]), ("2", ["a"])])
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, tag string")
    assert sorted(tuple(r) for r in labels.label_counts(rows, vocab).collect()) == [(0, "a", 2, 2), (1, "b", 2, 0)]
    assert [r["tag"] for r in labels.untrained_tags(rows, vocab).collect()] == ["b"]


def in_hash_order(rows, seed):
    import hashlib

    return sorted(rows, key=lambda row: (hashlib.md5(f"{seed}:{row[0]}".encode()).hexdigest(), row[0]))


@pytest.mark.parametrize("case", range(6))
def test_split_equals_the_greedy_walk(spark, case):
    rng = random.Random(case)
    tags = [f"t{i}" for i in range(rng.randint(2, 14))]
    rows = [
        (f"o{i}", rng.sample(tags, rng.randint(0, min(4, len(tags))))) for i in range(rng.randint(5, 60))
    ]
    size, least = rng.choice([0.2, 0.5, 0.9, 1.0]), rng.choice([1, 2, 3])
    flagged = split.tag_preserving_split(tagged_rows(spark, rows), size, case, least).collect()
    got = {r["row_id"] for r in flagged if r["is_test"]}
    assert len(flagged) == len(rows)
    assert got == plain.walk(in_hash_order(rows, case), round(len(rows) * size), least)
    for tag in tags:
        total = sum(tag in row_tags for _, row_tags in rows)
        train = sum(tag in row_tags for row_id, row_tags in rows if row_id not in got)
        assert train >= min(least, total)


def test_split_small_cases(spark):
    rows = [("1", ["two"]), ("2", ["two"]), ("3", ["three"]), ("4", ["three"]), ("5", ["three"]), ("6", [])]
    flagged = split.tag_preserving_split(tagged_rows(spark, rows), 1.0).collect()
    test = {r["row_id"] for r in flagged if r["is_test"]}
    assert not test & {"1", "2"} and len(test & {"3", "4", "5"}) == 1 and "6" in test
    assert split.tag_preserving_split(tagged_rows(spark, rows), 0.0).filter("is_test").count() == 0
    assert split.tag_preserving_split(tagged_rows(spark, []), 0.2).count() == 0


def test_one_tag_on_nearly_all_rows_is_not_gathered(spark):
    rows = spark.range(20000).select(
        F.concat(F.lit("o"), F.col("id")).alias("row_id"),
        F.when(F.col("id") % 100 == 0, F.array(F.lit("rare"))).otherwise(F.array(F.lit("hot"))).alias("tags"),
    )
    assert split.tag_preserving_split(rows).filter("is_test").count() == 4000
    plan = split._waiting_rows(rows.withColumn("_hash", split.order_hash(F.col("row_id"))), 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit", text.index("Exchange hashpartitioning(tag")) > 0


def test_split_of_five_thousand_tags(spark):
    rng = random.Random(11)
    tags = [f"t{i}" for i in range(5000)]
    rows = [(f"o{i}", ["hot", *rng.sample(tags, rng.randint(0, 4))]) for i in range(8000)]
    for size in (0.2, 1.0):
        flagged = split.tag_preserving_split(tagged_rows(spark, rows), size, 3).collect()
        got = {r["row_id"] for r in flagged if r["is_test"]}
        assert got == plain.walk(in_hash_order(rows, 3), round(len(rows) * size), 2)


def test_split_of_rows_that_wait_for_each_other(spark):
    """Neighbours in the order share a tag, so every decision hangs on the one before."""
    ordered = in_hash_order([(f"o{i}", None) for i in range(24)], 5)
    rows = [(row_id, [f"t{i}", f"t{i + 1}"]) for i, (row_id, _) in enumerate(ordered)]
    flagged = split.tag_preserving_split(tagged_rows(spark, rows), 1.0, 5, 1).collect()
    assert {r["row_id"] for r in flagged if r["is_test"]} == plain.walk(rows, 24, 1)


def plans_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_step_of_the_split_sees_all_rows(spark):
    rows = tagged_rows(spark, [(f"o{i}", [f"t{i % 7}"]) for i in range(50)])
    hashed = rows.withColumn("_hash", split.order_hash(F.col("row_id")))
    waiting = split._waiting_rows(hashed, 2)
    for frame in (waiting, split._round(waiting, waiting.select("row_id", F.lit(0).alias("state")))):
        assert "SinglePartition" not in plans_of(frame) and "Cartesian" not in plans_of(frame)


def test_ten_thousand_tags_that_begin_alike(spark):
    tags = [f"Categorias de impacto: {i}" for i in range(10_000)]
    shuffled = random.Random(1).sample(tags, len(tags))
    frame = spark.createDataFrame([(t,) for t in shuffled], "tag string")
    found = labels.label_vocab(frame, parts=6)
    assert [r["tag"] for r in sorted(found.collect())] == sorted(tags)
    ranged = frame.repartitionByRange(6, "tag").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 6 and max(r["count"] for r in ranged) < 3000


def test_numbers_of_an_empty_table(spark):
    assert labels.label_vocab(spark.createDataFrame([], "tag string")).count() == 0


def test_random_split_has_the_exact_size(spark):
    rows = spark.range(1003).select(F.col("id").cast("string").alias("row_id"))
    first = {r["row_id"] for r in split.random_split(rows).filter("is_test").collect()}
    again = {r["row_id"] for r in split.random_split(rows.repartition(5)).filter("is_test").collect()}
    ordered = in_hash_order([(str(i), None) for i in range(1003)], 42)
    assert first == again == {row_id for row_id, _ in ordered[:201]}


def test_untrained_tags_looks_at_every_training_row(spark, tmp_path):
    """Rows of every language count; what only test rows carry is untrained."""
    documents = [(i, f"text number {i}", "en" if i % 2 else "fr", f"s{i}", 10) for i in range(40)]
    tables = {
        "documents": spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {r["row_id"]: set(r["tags"]) for r in queries._tagged(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda x: (hashlib.md5(f"42:{x}".encode()).hexdigest(), x))
    trained = set().union(*(rows[x] for x in order[8:]))
    found = {r["tag"] for r in queries.untrained_tags(spark, str(tmp_path)).collect()}
    assert found == set().union(*rows.values()) - trained
    assert len(found) == 8 and "fr" not in found
