from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tagsieve.operators import chunks, similarity
from tagsieve.plans import analyze
from tests import plain

VOCABULARY = [f"word{i}" for i in range(40)] + ["ação", "número", "the", "and"]


def make_texts(seed: int):
    rng = random.Random(seed)

    def prose(n):
        return " ".join(rng.choice(VOCABULARY[: rng.randint(5, 44)]) for _ in range(n))

    quotations = [prose(rng.randint(3, 15)) for _ in range(12)]
    quotations.append(quotations[2])  # a copy: the first one has to win
    reports = []
    for _ in range(25):
        blocks = [prose(rng.randint(6, 40)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            blocks.append(rng.choice(quotations) + " " + prose(8))
        if rng.random() < 0.3:
            blocks.append("zzz yyy xxx " * 5)
        reports.append("\n\n".join(blocks))
    # One report with far more chunks than all others together.
    reports.append("\n\n".join(prose(12) for _ in range(300)))
    return reports, quotations


@pytest.fixture(scope="module")
def case(spark):
    reports, quotations = make_texts(7)
    frame = spark.createDataFrame(
        [(i, f"r{i}", t) for i, t in enumerate(reports)], "doc_id bigint, nome string, texto string"
    )
    refs = similarity.prepare_references(
        spark.createDataFrame(list(enumerate(quotations)), "ref_pos bigint, quotation string")
    )
    expected = {}
    for i, report in enumerate(reports):
        pieces = plain.cut(report)
        for j, (sim, pos) in enumerate(plain.best_matches(pieces, quotations)):
            expected[i, j + 1] = (sim, pos, pieces[j], quotations[pos])
    return frame, refs, expected


def nearest(frame, refs):
    found = similarity.nearest_reference(frame, refs).collect()
    return {(r["doc_id"], r["trecho_id"]): (r["sim"], r["ref_pos"]) for r in found}


def test_nearest_equals_plain_python(case):
    frame, refs, expected = case
    got = nearest(frame, refs)
    assert got.keys() == expected.keys()
    for key, (sim, pos, _, _) in expected.items():
        assert got[key][1] == pos, key
        assert got[key][0] == pytest.approx(sim, abs=1e-9)
        assert 0 <= got[key][0] <= 1 + 1e-9


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.15, 0.5])
def test_candidates_equal_plain_python(case, threshold):
    frame, refs, expected = case
    found = analyze.find_candidates(frame, refs, threshold).collect()
    got = {
        (r["doc_id"], r["trecho_id"]): (r["similaridade"], r["trecho"], r["quotation_referencia"]) for r in found
    }
    assert len(found) == len(got)
    wanted = {
        key: (round(sim, 4), piece, quotation)
        for key, (sim, _, piece, quotation) in expected.items()
        if round(sim, 4) >= threshold
    }
    assert got == wanted


def test_a_report_is_scored_independently_of_the_others(case):
    frame, refs, _ = case
    alone = nearest(frame.filter("doc_id = 3"), refs)
    together = nearest(frame, refs)
    assert alone == {key: pytest.approx(value) for key, value in together.items() if key[0] == 3}


def test_chunk_without_words_or_shared_terms(spark):
    reports = spark.createDataFrame([(1, "a", "- " * 30), (2, "b", "other " * 10)], "doc_id bigint, nome string, texto string")
    refs = similarity.prepare_references(
        spark.createDataFrame([(4, "later words"), (3, "first words"), (5, "nan")], "ref_pos bigint, quotation string")
    )
    assert refs.count == 2
    assert nearest(reports, refs) == {(1, 1): (0.0, 3), (2, 1): (0.0, 3)}
    zero = similarity.candidates(reports, refs, 0.0).collect()
    assert [(r["similaridade"], r["quotation_referencia"]) for r in zero] == [(0.0, "first words")] * 2


def test_similarity_is_rounded_before_the_threshold(spark, monkeypatch):
    pairs = spark.createDataFrame(
        [(1, 1, 0, 0.149951), (1, 2, 0, 0.149949)], "doc_id bigint, trecho_id int, ref_pos bigint, sim double"
    )
    monkeypatch.setattr(
        similarity, "similarity_pairs", lambda c, r, least=0.0: pairs.filter(F.col("sim") >= least)
    )
    refs = similarity.prepare_references(spark.createDataFrame([(0, "q")], "ref_pos bigint, quotation string"))
    rows = spark.createDataFrame([(1, "a", "x" * 50 + "\n\n" + "y" * 50)], "doc_id bigint, nome string, texto string")
    found = similarity.candidates(rows, refs, 0.15).collect()
    assert [(r["trecho_id"], r["similaridade"]) for r in found] == [(1, 0.15)]


def test_no_references_is_an_error(spark, case):
    frame, _, _ = case
    empty = similarity.prepare_references(spark.createDataFrame([], "ref_pos bigint, quotation string"))
    with pytest.raises(ValueError):
        similarity.candidates(frame, empty)


def final_plan(frame) -> str:
    """The plan as it ran."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shape(plan: str) -> list[str]:
    """The operators of a plan that move rows or call Python."""
    return re.findall(r"Exchange (?:SinglePartition|hashpartitioning|REBALANCE|\w+)|Cartesian\w*|NestedLoop\w*|\w*Python\w*", plan)


def test_one_plan_for_small_and_huge_reports(spark, case):
    """The same plan whatever the lengths, known or not; texts are dealt once, nothing goes to one
    task, no cross join, no Python."""
    frame, refs, _ = case
    huge = spark.createDataFrame([(1, "a", "word1 word2 word3 " * 200_000)], frame.schema)
    known = frame.withColumn("n_chars", F.length("texto"))
    plans = [similarity.candidates(x, refs)._jdf.queryExecution().sparkPlan().toString() for x in (frame, huge, known)]
    joins = [re.findall(r"\w+Join|\w*Aggregate|Repartition\w*|Rebalance\w*|Window", p) for p in plans]
    assert joins[0] == joins[1] == joins[2]
    plan = final_plan(similarity.candidates(frame, refs))
    found = shape(plan)
    assert not [x for x in found if "Cartesian" in x or "NestedLoop" in x or "Python" in x or "SinglePartition" in x]
    assert "ReusedExchange" in plan


def test_no_sort_comes_from_the_choice_of_the_nearest(case):
    frame, refs, _ = case
    pairs = similarity.similarity_pairs(frame, refs)
    assert "SortAggregate" not in similarity._best(pairs)._jdf.queryExecution().executedPlan().toString()


def test_a_word_in_every_chunk(spark):
    blocks = "\n\n".join(f"common text number{i} which fills a chunk of words" for i in range(60))
    frame = spark.createDataFrame([(i, f"r{i}", blocks) for i in range(20)], "doc_id bigint, nome string, texto string")
    quotations = [(i, f"common number{i}") for i in range(10)]
    refs = similarity.prepare_references(spark.createDataFrame(quotations, "ref_pos bigint, quotation string"))
    pieces = plain.cut(blocks)
    expected = [(s, p) for s, p in plain.best_matches(pieces, [q for _, q in quotations])]
    got = nearest(frame, refs)
    assert len(got) == 20 * 60
    for (_, chunk), (sim, pos) in got.items():
        assert (pytest.approx(expected[chunk - 1][0], abs=1e-9), expected[chunk - 1][1]) == (sim, pos)


def test_the_session_keeps_its_settings(spark, case):
    frame, refs, _ = case
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    before = dict(spark.sparkContext.getConf().getAll()), {r["key"]: r["value"] for r in spark.sql("set").collect()}
    try:
        analyze.find_candidates(frame, refs).collect()
        after = dict(spark.sparkContext.getConf().getAll()), {r["key"]: r["value"] for r in spark.sql("set").collect()}
        assert after == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parts_stay_small_when_the_table_grows(spark, case):
    """A table of as many splits as cores is dealt into a number of parts that nothing merges."""
    frame, refs, _ = case
    cores = spark.sparkContext.defaultParallelism
    texts = frame.repartition(cores).localCheckpoint()
    assert chunks.dealt(texts).rdd.getNumPartitions() == cores * chunks._PARTS_OF_A_SPLIT
    assert chunks.dealt(texts.coalesce(1)).rdd.getNumPartitions() <= cores
    assert nearest(texts, refs) == nearest(texts.coalesce(1), refs)


def test_texts_move_once(case):
    """With quotations that are broadcast, candidates are found and cut where their reports lie."""
    frame, refs, _ = case
    small = {name: F.broadcast(getattr(refs, name)) for name in ("table", "postings", "frequencies", "moments")}
    plan = similarity.candidates(frame, replace(refs, **small))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\w+, trecho_id", plan)


def test_copies_of_a_report_of_different_length(spark):
    text = "first words which fill a chunk of their own here"
    reports = spark.createDataFrame(
        [(1, "a", f"{text}\n\nsecond {text}"), (1, "b", text), (None, "c", text)], "doc_id bigint, nome string, texto string"
    )
    refs = similarity.prepare_references(spark.createDataFrame([(1, "first words")], "ref_pos bigint, quotation string"))
    found = sorted((r["arquivo"], r["trecho_id"], r["trecho"]) for r in similarity.candidates(reports, refs, 0.01).collect())
    assert found == [("a", 1, text), ("a", 2, f"second {text}"), ("b", 1, text)]


def without_broadcasts(spark, plan):
    """What ``plan`` returns in a session that broadcasts nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_postings_and_pairs_stay_in_place_at_any_broadcast_threshold(spark, case):
    frame, refs, _ = case
    for make in (similarity.candidates, similarity.similarity_pairs, similarity.chosen):
        plan = without_broadcasts(spark, lambda: make(frame, refs)._jdf.queryExecution().executedPlan().toString())
        assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\w+, [a-z]", plan)
        # the only sorted joins: texts with their lists, and the index of the quotations itself
        assert len(re.findall("SortMergeJoin", plan)) <= 2


def test_quotations_of_a_large_size_are_not_broadcast(spark, case, monkeypatch):
    frame, refs, _ = case
    monkeypatch.setattr(similarity.config, "BROADCAST_CELLS", 10)
    quotations = spark.createDataFrame(refs.table.collect(), refs.table.schema)
    large = similarity.prepare_references(quotations)
    plan = without_broadcasts(spark, lambda: similarity.similarity_pairs(frame, large)._jdf.queryExecution().executedPlan().toString())
    assert "Broadcast" not in plan
    got, wanted = nearest(frame, large), nearest(frame, refs)
    assert got.keys() == wanted.keys()
    assert all(got[key] == (pytest.approx(sim, abs=1e-9), pos) for key, (sim, pos) in wanted.items())


def test_parts_are_counted_by_the_size_of_texts(spark, case, monkeypatch):
    """A table in one split, too, is dealt into as many parts as its texts ask for."""
    frame, refs, _ = case
    monkeypatch.setattr(chunks, "_PART_BYTES", 1000)
    size = sum(len(row["texto"].encode()) for row in frame.collect())
    one = frame.coalesce(1)
    assert size > 8000
    assert chunks.dealt(one).rdd.getNumPartitions() == -(-size // 1000)
    assert nearest(one, refs) == nearest(frame, refs)


def test_parts_of_a_small_table_are_not_merged(spark, case):
    """Merged up to the advisory size, all texts for fewer parts than cores would be cut and paired in one task."""
    frame, refs, _ = case
    merging = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        dealt = chunks.dealt(frame.coalesce(1))
        held = dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
        assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert len(held) > 1 and sum(row["n"] for row in held) == frame.count()
        assert nearest(frame.coalesce(1), refs) == nearest(frame, refs)
    finally:
        spark.conf.set(merging, before)


def test_parts_of_texts_that_are_missing(spark):
    reports = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id bigint, nome string, texto string")
    refs = similarity.prepare_references(spark.createDataFrame([(1, "first words")], "ref_pos bigint, quotation string"))
    for frame in (reports, reports.limit(0)):
        assert similarity.candidates(frame, refs).collect() == nearest_rows(frame, refs) == []


def nearest_rows(frame, refs):
    return similarity.nearest_reference(frame, refs).collect()


def test_texts_are_cut_behind_their_exchange_only(spark, case, tmp_path):
    """Texts of a file, whose columns may be null: no filter below the exchange cuts them, so both branches share it."""
    frame, refs, _ = case
    frame.write.parquet(str(tmp_path / "reports"))
    read = spark.read.parquet(str(tmp_path / "reports"))
    found = similarity.candidates(read, refs)
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in optimized.split("\n") if "Filter" in line and "split(texto" in line]
    plan = final_plan(found)
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(doc_id" in line]
    assert len([line for line in moved if "ReusedExchange" not in line]) == 1 and len(moved) == 2


def test_nearest_reference_moves_texts_once(case):
    frame, refs, _ = case
    plan = similarity.nearest_reference(frame, refs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1
