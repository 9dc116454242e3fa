from __future__ import annotations

from pyspark.sql import functions as F

from tagsieve.operators import labels, reports, reviews
from tagsieve.sources import sinks, tables

RESULT = (
    "doc_id int, arquivo string, trecho_id int, trecho string, similaridade double,"
    " tags_preditas string, confianca double, numero_tags int, revisar boolean"
)


def results(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1, "t1", 0.3, "x | y", 0.9, 2, False),
            (1, "a", 2, "t2", 0.2, "x", 0.6, 1, True),
            (1, "a", 3, "t3", 0.2, None, 0.3, 0, True),
            (2, "b", 1, "t" * 500, 0.4, "x | y | z", 0.9, 3, False),
            (3, "c", 1, "none", 0.4, None, 0.2, 0, True),
        ],
        RESULT,
    )


def known(spark):
    return spark.createDataFrame([("z", None), ("x", None), ("y", None)], "tag string, n bigint")


def test_tables_and_summary(spark):
    frame = results(spark)
    assert reports.results_table(frame).count() == 3
    assert reports.results_table(frame, "a", only_tagged=False).count() == 3
    assert [r["arquivo"] for r in reports.report_names(frame).collect()] == ["a", "b", "c"]
    assert [r["trecho_id"] for r in reports.first_rows(frame, 3).collect()] == [1, 1, 2]
    summary = reports.result_summary(frame).first()
    assert (summary["n_trechos"], summary["n_revisar"]) == (5, 3)
    empty = reports.result_summary(frame.limit(0)).first()
    assert tuple(empty) == (0, 0, None)


def test_coverage_and_status(spark):
    texts = spark.createDataFrame([(i, c, "") for i, c in enumerate("abcd", 1)], "doc_id int, nome string, texto string")
    assert tuple(reports.report_coverage(texts, results(spark)).first()) == (3, 4, 5)
    counts = spark.createDataFrame([(1, "a", 3), (4, "d", 0), (5, "e", 2)], "doc_id int, arquivo string, n_trechos int")
    status = {r["arquivo"]: (r["n_candidatos"], r["status"]) for r in reports.report_status(counts, results(spark)).collect()}
    assert status == {"a": (3, "classificado"), "d": (0, "sem trechos"), "e": (0, "sem candidatos")}


def test_tag_counts_and_absent_tags(spark):
    frame = results(spark)
    counts = {(r["arquivo"], r["tag"]): r["n"] for r in reports.report_tag_counts(frame).collect()}
    assert counts == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 1, ("b", "z"): 1}
    absent = sorted((r["arquivo"], r["tag"]) for r in reports.absent_tags(frame, known(spark)).collect())
    assert absent == [("a", "z"), ("c", "x"), ("c", "y"), ("c", "z")]


def test_brief(spark):
    briefs = reports.brief_inputs(results(spark), known(spark))
    rows = {r["arquivo"]: r for r in briefs.collect()}
    assert [tuple(t) for t in rows["a"]["tags"]] == [("x", 2), ("y", 1)]
    assert rows["b"]["ausentes"] == [] and rows["c"]["ausentes"] == ["x", "y", "z"]
    assert [e["trecho"] for e in rows["a"]["evidencias"]] == ["t1", "t2"]
    assert len(rows["b"]["evidencias"][0]["trecho"]) == 400 and rows["b"]["evidencias"][0]["confianca_pct"] == "90%"
    texts = {r["arquivo"]: r["texto"] for r in reports.brief_text(briefs, briefs["arquivo"]).collect()}
    assert "* x - 2 chunk(s)\n* y - 1 chunk(s)" in texts["a"]
    assert "every known tag occurs" in texts["b"]
    assert "no tag was found" in texts["c"] and "no chunk was tagged" in texts["c"]
    whole = reports.brief_inputs(results(spark), known(spark), []).first()
    assert whole["n_total"] == 5 and [tuple(t) for t in whole["tags"]] == [("x", 3), ("y", 2), ("z", 1)]


def test_evidence_keeps_the_top_of_each_report(spark):
    frame = spark.range(200).selectExpr(
        "cast(1 as int) doc_id", "'a' arquivo", "cast(id as int) trecho_id", "'t' trecho", "'x' tags_preditas",
        "id / 1000.0d confianca", "true revisar",
    )
    found = reports.brief_evidence(frame).orderBy("pos").collect()
    assert [r["trecho_id"] for r in found] == list(range(199, 169, -1))


def test_review_queue(spark):
    frame = spark.createDataFrame(
        [
            (1, "a", 1, "t", 0.2, "Áreas de impacto: Econômica | Áreas de Impacto: Ambiental", 0.6, 2, True),
            (1, "a", 2, "u", 0.2, None, 0.1, 0, True),
            (1, "a", 3, "v", 0.2, "Áreas de Impacto: Ambiental", 0.8, 1, False),
        ],
        RESULT,
    )
    queue = {r["trecho"]: r["tags_corrigidas"] for r in reviews.review_queue(frame, tables.full_tags()).collect()}
    assert queue == {"t": ["Áreas de Impacto: Ambiental"], "u": []}
    loose = reviews.review_queue(frame, tables.full_tags(), only_flagged=False, ignore_case=True)
    assert {r["trecho"]: r["tags_corrigidas"] for r in loose.collect()} == {
        "t": ["Áreas de Impacto: Econômica", "Áreas de Impacto: Ambiental"],
        "u": [],
        "v": ["Áreas de Impacto: Ambiental"],
    }


def test_accept_and_append(spark):
    edited = spark.createDataFrame(
        [("t", ["x", "y"], True), ("u", [], True), ("v", ["x"], False), ("w", None, True)],
        "trecho string, tags_corrigidas array<string>, incluir_no_treino boolean",
    )
    new = reviews.accepted_corrections(edited, "2024-05-06 07:08:59")
    assert [tuple(r) for r in new.collect()] == [("t", "x | y", "2024-05-06 07:08")]
    old = spark.createDataFrame([(None, None, None), ("t", "z", None)], "quotation string, codes string, data_revisao string")
    assert reviews.append_reviews(old, new).count() == 2
    assert reviews.append_reviews(None, new).count() == 1


def test_upsert(spark):
    pairs = spark.createDataFrame(
        [(1, "t", ["x"]), (2, "t", ["y", "z"]), (3, "", ["x"]), (4, "u", []), (5, None, ["x"])],
        "seq bigint, trecho string, tags array<string>",
    )
    stored = spark.createDataFrame([(8, "t", "old"), (9, "k", "kept")], "seq bigint, quotation string, codes string")
    assert reviews.usable_pairs(pairs).count() == 2
    got = {r["quotation"]: r["codes"] for r in reviews.upsert_reviews(stored, pairs).collect()}
    assert got == {"t": "y | z", "k": "kept"}
    assert reviews.upsert_reviews(None, pairs).count() == 1


def executed(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_stored_corrections_are_merged_where_they_lie(spark, tmp_path):
    quotations = spark.createDataFrame(
        [(i, f"q{i % 30}", f"old {i}") for i in range(40)] + [(90, None, "x"), (91, "", "x"), (92, "nan", "x")],
        "ref_pos bigint, quotation string, codes string",
    )
    first = spark.createDataFrame([(f"q{i}", f"first {i}", i) for i in range(0, 50, 3)], "quotation string, codes string, seq bigint")
    second = spark.createDataFrame([(f"q{i}", f"second {i}") for i in range(0, 50, 6)], "quotation string, codes string")
    sinks.append_to_review_table(first, "kept_reviews", f"{tmp_path}/a", 8)
    sinks.append_to_review_table(second, "kept_reviews", f"{tmp_path}/a", 8)
    stored = spark.table("kept_reviews")
    expected = {f"q{i % 30}": f"old {i}" for i in range(40)}
    expected |= {f"q{i}": f"first {i}" for i in range(0, 50, 3)} | {f"q{i}": f"second {i}" for i in range(0, 50, 6)}
    for table in ("kept_reviews", "compacted_reviews"):
        if table == "compacted_reviews":
            sinks.compact_review_table(spark, "kept_reviews", table, f"{tmp_path}/b", 8)
            assert spark.table(table).count() == stored.select("quotation").distinct().count() < stored.count()
        base = labels.training_base_in_place(quotations, spark.table(table))
        found = {r["quotation"]: r["codes"] for r in base.collect()}
        plain = labels.training_base(quotations, spark.table(table))
        assert found == expected == {r["quotation"]: r["codes"] for r in plain.collect()}
        assert base.count() == len(expected)
    # the annotations move, the stored corrections do not
    plan = spark.table("kept_reviews").groupBy("quotation").count()
    assert "Exchange" not in executed(plan)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = executed(labels.training_base_in_place(quotations, spark.table("kept_reviews")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert merged.count("Exchange hashpartitioning") == 1
    for table in ("kept_reviews", "compacted_reviews"):
        spark.sql(f"drop table {table}")


def test_compacting_keeps_what_is_written_later(spark, tmp_path):
    rows = spark.createDataFrame([("q", "one"), ("p", "only")], "quotation string, codes string")
    sinks.append_to_review_table(rows, "early_reviews", f"{tmp_path}/a", 2)
    sinks.compact_review_table(spark, "early_reviews", "late_reviews", f"{tmp_path}/b", 2)
    sinks.append_to_review_table(rows.limit(1).withColumn("codes", F.lit("two")), "late_reviews", f"{tmp_path}/b", 2)
    nothing = spark.createDataFrame([], "ref_pos bigint, quotation string, codes string")
    base = labels.training_base_in_place(nothing, spark.table("late_reviews")).collect()
    assert {r["quotation"]: r["codes"] for r in base} == {"q": "two", "p": "only"}
    for table in ("early_reviews", "late_reviews"):
        spark.sql(f"drop table {table}")
