import corpus_pipeline
import pytest

from tests.llm.helpers import benchmark_words
from tests.llm.test_decontam import brute
from tests.llm.test_simhash import plain_components, plain_print
from tagsieve.llm import pii, quality, queries
from tagsieve.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        frames.append(docs)
    return [{r.doc_id: r for r in f.collect()} for f in frames], frames


def test_columns(steps):
    _, frames = steps
    for frame in frames[:-1]:
        assert frame.columns == frames[0].columns
    assert frames[-1].columns == [*frames[0].columns, "ids", "n_tokens", "round_trip"]


def test_rejected_documents_go(spark, steps):
    rows, frames = steps
    model = queries.quality_model(spark, frames[0], SF)
    good = {r.doc_id for r in quality.classify(frames[0], "text", model, 0.3).collect() if r.predicted == 1}
    assert set(rows[1]) == good and 0 < len(good) < len(rows[0])


def test_one_of_each_group_stays(steps):
    rows, _ = steps
    prints = {i: plain_print(r.text) for i, r in rows[1].items()}
    roots = plain_components(set(prints.values()), 2)
    first = {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    assert set(rows[2]) == set(first.values())


def test_contaminated_documents_go(spark, steps):
    rows, _ = steps
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {i for i, r in rows[2].items() if brute(r.text, items)[1] == 0}
    assert set(rows[3]) == clean and benchmark_words("A b") == ["a", "b"]


def test_pseudonyms_and_tokens(spark, steps):
    rows, frames = steps
    expected = {r.doc_id: r.text for r in pii.pseudonymise(frames[3], "text", queries.DEMO_KEY).collect()}
    assert {i: r.text for i, r in rows[4].items()} == expected
    assert all(r.n_chars == len(r.text) for r in rows[4].values())
    assert set(rows[5]) == set(rows[4])
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in rows[5].values())


def test_run_gives_the_last_stage(spark, steps):
    rows, _ = steps
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, bytes(r.ids)) for r in found} == {i: (r.text, bytes(r.ids)) for i, r in rows[5].items()}


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (None, "lonely words here", "en", "s", 3), (2, "", None, None, 0), (2, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    empty = docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
