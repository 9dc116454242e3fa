import random

import pytest

from tests.llm.helpers import ODD_TEXTS, benchmark_words
from tagsieve.llm import decontam


def brute(text, items, n=10):
    words = benchmark_words(text)
    hit, named = [False] * len(words), set()
    for item, item_text in items:
        parts = benchmark_words(item_text)
        m = min(n, len(parts))
        windows = {tuple(parts[i : i + m]) for i in range(len(parts) - m + 1)} if parts else set()
        for i in range(len(words) - m + 1) if windows else ():
            if tuple(words[i : i + m]) in windows:
                hit[i : i + m] = [True] * m
                named |= {str(item)} if item is not None else set()
    return len(words), sum(hit), sorted(named)


def marked(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.mark(docs, "text", bench, "item_id", "text").collect()
    return {r.doc_id: (r.benchmark.n_words, sum(s.end - s.start for s in r.benchmark.spans), r.benchmark["items"]) for r in rows}


@pytest.mark.parametrize("limit", [decontam.SHARD_WINDOWS, 7])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "SHARD_WINDOWS", limit)
    rng = random.Random(7)
    vocabulary = ["a", "B", "cé", "d1", "E", "of"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 9, 10, 11, 14]))) for i in range(9)] + [(9, None), (10, ".."), (None, "zz yy xx"), (2, "q r s")]
    texts = [make(rng.randrange(60)) for _ in range(60)] + [f"so {t} it" for _, t in items if t] + ["q r s zz yy xx q r s"]
    texts += [" ".join(benchmark_words(items[0][1])) * 3, *ODD_TEXTS]
    assert marked(spark, texts, items) == {i: brute(t, items) for i, t in enumerate(texts)}


def test_empty_tables(spark):
    assert marked(spark, ["some words"], [(1, None)]) == {0: (2, 0, [])}
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.mark(docs, "text", bench, "item_id", "text").count() == 0
    assert decontam.mark(bench, "text", bench.limit(0), "item_id", "text").count() == 1
