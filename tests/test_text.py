from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagsieve.functions import text
from tagsieve.operators import chunks
from tests import plain


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


def test_strip_removes_every_kind_of_blank(spark):
    assert one(spark, "\t\n \u001c x y \u0085　", text.strip) == "x y"


def test_paragraphs(spark):
    assert one(spark, "a\n \n\nb\n\n\t\nc\nd", text.paragraphs) == ["a", "b", "c\nd"]
    assert one(spark, " \n\n \t", text.paragraphs) == []


def sentence(n: int) -> str:
    return "x" * (n - 1) + "."


@pytest.mark.parametrize(
    "paragraph, sizes",
    [
        (sentence(600) + " " + sentence(599), [1200]),
        (sentence(600) + " " + sentence(600), [600, 600]),
        (sentence(1500), [1500]),
        (sentence(50) + " " + sentence(1500) + " " + sentence(60), [50, 1500, 60]),
        (sentence(400) + "  \n" + sentence(400) + " " + sentence(398) + " " + sentence(1), [1200, 1]),
    ],
)
def test_packing(spark, paragraph, sizes):
    assert [len(piece) for piece in one(spark, paragraph, text.pack_sentences)] == sizes


def test_packing_of_very_many_pieces(spark):
    paragraph = " ".join(f"{i:05d}." for i in range(3000))
    pieces = one(spark, paragraph, lambda c: text.pack_sentences(c, 6))
    assert pieces == paragraph.split(" ")


def test_length_filter_counts_characters(spark):
    assert one(spark, "y" * 39, text.chunks) == []
    assert one(spark, "y" * 39 + "\U0001f600", text.chunks) == ["y" * 39 + "\U0001f600"]


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.text(alphabet="ab .!?\n\t \u001cç", min_size=0, max_size=400), min_size=20, max_size=40
    )
)
def test_chunks_equal_plain_python(spark, reports):
    rows = spark.createDataFrame(list(enumerate(reports)), "id int, t string")
    got = {r["id"]: r["c"] for r in rows.select("id", text.chunks(F.col("t"), 60, 5).alias("c")).collect()}
    assert got == {i: plain.cut(t, 60, 5) for i, t in enumerate(reports)}


def test_tokens_keep_accents_and_underscores(spark):
    assert one(spark, "Ação e o número_2 às 10h", text.tokens) == ["ação", "número_2", "10h"]


def test_bigrams_bridge_short_words(spark):
    grams = one(spark, "impacto de rede social", lambda c: text.with_bigrams(text.tokens(c)))
    assert grams == ["impacto", "rede", "social", "impacto rede", "rede social"]
    assert one(spark, "a b", lambda c: text.with_bigrams(text.tokens(c))) == []
    assert one(spark, "only", lambda c: text.with_bigrams(text.tokens(c))) == ["only"]


def test_run_counts(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "c", "c", "c"],), ([],)], "w array<string>")
    counted = rows.select("w", text.run_starts(F.col("w")).alias("s")).select(
        text.run_counts(F.col("w"), F.col("s")).alias("c")
    )
    assert [[tuple(x) for x in r["c"]] for r in counted.collect()] == [[("a", 2), ("b", 1), ("c", 3)], []]


def test_tag_split(spark):
    assert one(spark, "A, B | C;A; ,", text.split_tags) == ["A", "B", "C"]
    assert one(spark, "A, B | C | C", text.split_predicted) == ["A, B", "C", "C"]
    assert one(spark, None, text.split_predicted) == []


def test_rounding_is_half_to_even(spark):
    rows = spark.createDataFrame([(0.12345,), (0.12355,), (0.00005,)], "v double")
    assert [r["r"] for r in rows.select(text.round4(F.col("v")).alias("r")).collect()] == [0.1234, 0.1236, 0.0]
    halves = spark.createDataFrame([(0.125,), (0.375,)], "v double")
    assert [r["r"] for r in halves.select(text.percent_text(F.col("v")).alias("r")).collect()] == ["12%", "38%"]


def test_present(spark):
    rows = spark.createDataFrame([(None,), ("",), ("nan",), (" ",)], "v string")
    assert [r["v"] for r in rows.filter(text.present(F.col("v"))).collect()] == [" "]


def test_chunk_numbers_and_counts(spark):
    long = "z" * 50
    reports = spark.createDataFrame(
        [(1, "a", f"{long}\n\nshort\n\n{long}!"), (2, "b", "short"), (3, "c", "")],
        "doc_id bigint, nome string, texto string",
    )
    found = chunks.report_chunks(reports).orderBy("doc_id", "trecho_id").collect()
    assert [(r["doc_id"], r["arquivo"], r["trecho_id"], r["trecho"], r["n_trechos"]) for r in found] == [
        (1, "a", 1, long, 2),
        (1, "a", 2, long + "!", 2),
    ]
    counts = {r["doc_id"]: (r["n_paragrafos"], r["n_trechos"]) for r in chunks.chunk_counts(reports).collect()}
    assert counts == {1: (3, 2), 2: (1, 0), 3: (0, 0)}
