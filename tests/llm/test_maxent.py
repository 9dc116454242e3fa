import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS, blank_words
from tagsieve.llm import maxent
from tagsieve.llm.common import held_out

SF = "/root/testdata/sf0.001"


def plain_base(rows, held):
    tokens = [[*blank_words(t), ""] for _, t in rows]
    counts = Counter(w for (i, _), words in zip(rows, tokens) if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        for (i, _), words in zip(rows, tokens)
    ]


def scored(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    return maxent.score(docs, "doc_id", "text", held_out(F.col("doc_id"), 7, 2)).collect()


def check(spark, rows):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored(spark, rows)), key=str)
    expected = sorted(((*x[:5], round(x[5], 6)) for x in plain_base(rows, held)), key=str)
    assert found == expected


def test_counts_and_base_scores(spark, monkeypatch):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in texts]
    check(spark, rows)
    monkeypatch.setattr(maxent, "KNOWN", 50)  # most counts come by the join
    check(spark, rows[:60] + rows[:5])


def test_odd_tables(spark):
    check(spark, [*enumerate(ODD_TEXTS), (None, "null id"), (3, "word again")])
    only_held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    check(spark, [(i, "never seen") for i in only_held])
    assert all(math.isfinite(r.score) for r in scored(spark, [(i, "never seen") for i in only_held]))
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.score(docs, "doc_id", "text", F.lit(False)).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(12)
    words = [f"w{i}".encode() for i in range(600)] + [maxent.END]
    counts = [(w, int(c)) for w, c in zip(words, rng.integers(1, 500, len(words)))]
    counts.sort(key=lambda x: (-x[1], x[0]))
    class_counts, sizes = np.zeros(maxent.CLASSES), np.zeros(maxent.TAILS)
    for i, (w, c) in enumerate(counts):
        place = i // maxent.CLASS_SIZE if i < maxent.TOP else maxent.TOP // maxent.CLASS_SIZE + maxent.tail_class(w)
        class_counts[place] += c
        sizes[maxent.tail_class(w)] += i >= maxent.TOP
    lexicon = maxent.Lexicon(sum(c for _, c in counts), len(counts), counts, class_counts, sizes)
    trainer = maxent.Trainer(lexicon, maxent.Weights.zero())
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 600, 40)) for _ in range(50)]
    for batch in maxent._batched(trainer.examples(iter(texts))):
        trainer.update(*batch)
    scorer = maxent.Scorer(lexicon, maxent.Weights(trainer.outer, trainer.inner))
    row = next(trainer.examples(iter(["w1 w2 w3"])))
    total = 0.0
    for w, c in counts:
        (at,), (kind,), _ = lexicon.read([w])
        place = lexicon.places[at]
        log = scorer.logs(np.array([kind]), np.array([place]), row[2][2:3], row[3][2:3])[0]
        if place < 0:
            log += math.log(c + 1) - lexicon.tail_log[kind - maxent.TOP // maxent.CLASS_SIZE]
        total += math.exp(log)
    for tail in range(maxent.TAILS):  # the share of unseen tokens
        kind = np.array([maxent.TOP // maxent.CLASS_SIZE + tail])
        total += math.exp(scorer.logs(kind, np.array([-1]), row[2][2:3], row[3][2:3])[0] - lexicon.tail_log[tail])
    assert abs(total - 1) < 1e-4


def test_training_learns_the_history(spark):
    texts = [("a b " * 200 if i % 2 else "c d " * 200) for i in range(120)]
    rows = scored(spark, list(enumerate(texts)))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.99


def test_histories_do_not_depend_on_what_is_broadcast():
    words = [*(f"{i}ing".encode() for i in range(50)), maxent.END]
    counts = [(w, 100 - i) for i, w in enumerate(words)]
    sizes = np.zeros(maxent.CLASSES), np.zeros(maxent.TAILS)
    whole, small, none = (maxent.Lexicon(1, 51, counts[:n], *sizes) for n in (51, 7, 0))
    read = [lexicon.read(words)[2] for lexicon in (whole, small, none)]
    assert len(set(read[0].tolist())) == 51
    assert all((other == read[0]).all() for other in read[1:])


def test_scores_do_not_hang_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(maxent, "PART_TOKENS", 6_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    results = []
    for tasks in (1, 8):
        found = maxent.score(docs.repartition(tasks), "doc_id", "text", held_out(F.col("doc_id"), 7, 2))
        results.append({r.doc_id: r.score for r in found.collect()})
    assert results[0].keys() == results[1].keys()
    assert all(abs(x - results[1][i]) <= 1e-4 * abs(x) for i, x in results[0].items())


def test_tokens_of_one_count_are_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 10)
    counts = spark.createDataFrame([(f"w{i}", 1) for i in range(30)], "token string, c long")
    words = maxent.lexicon(counts)
    assert len(words.known) == 10 and (words.total, words.distinct) == (30, 30)
    more = counts.union(spark.createDataFrame([("often", 9), ("", 5)], counts.schema))
    again = maxent.lexicon(more)
    assert {w for w, _ in again.known[:2]} == {b"often", b""} and len(again.known) == 10
    assert {w for w, _ in again.known[2:]} <= {w for w, _ in words.known}


def test_the_key_may_have_any_name(spark):
    for name in ("row", "s", "token", "part"):
        docs = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "a")], f"{name} long, text string")
        assert {r[name] for r in maxent.score(docs, name, "text", F.col(name) == 2).collect()} == {1, 2, 3}


def test_gradients_are_summed_by_row():
    rng = np.random.default_rng(13)
    rows, grads = rng.integers(0, 9, 200), rng.normal(size=(200, 3))
    at, sums = maxent._summed_rows(rows, grads)
    expected = np.zeros((9, 3))
    np.add.at(expected, rows, grads)
    assert np.allclose(sums, expected[at]) and list(at) == sorted(set(rows.tolist()))
