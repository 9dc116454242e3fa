import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve.llm import phrases
from tests.llm.helpers import ODD_TEXTS, lower


def brute(rows, n=3, min_count=10, cover=50, top=2000):
    """rows: (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, n + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= cover * f[p[i : i + k]]:
                        covered.add(p[i : i + k])
        found = []
        for p, a in candidates.items():
            if p not in covered:
                cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, rank + 1, p.decode(), -a, left, right, totals[lang], -score))
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, f int")
    got = [tuple(r) for r in phrases.collocations(table, "text", "lang", **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(seed=2, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Élan", "été", "THE", "x" * 50]
    fixed = ["as far as we know", "one two three four five six seven", "go go go go", "the quick brown fox; the quick brown dog"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choices(words, weights=range(16, 0, -1), k=rng.randint(1, 9))))
        out.append((rng.choice(["en", "de", None, ""]), rng.choice([" ", ". ", "\t", "\n", " , "]).join(parts)))
    return out


@pytest.mark.parametrize("n", [2, 3, 4])
def test_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(phrases, "PATH_EDGES", 2)
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(phrases, "PART_BYTES", 1000)
    rows = texts() + [("en", t) for t in ODD_TEXTS]
    expected = brute(rows, n, min_count=4)
    assert len(expected) > 40
    assert found(spark, rows, n=n, min_count=4) == expected


def test_limits_and_covering(spark):
    rows = texts(5)
    assert found(spark, rows, top=3) == brute(rows, top=3)
    assert found(spark, rows, cover=90) == brute(rows, cover=90) != brute(rows)


@pytest.mark.parametrize("bits", [0, 12])
def test_a_full_map_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "MAP_BITS", bits)
    rows = texts(6)
    assert found(spark, rows) == brute(rows)


def test_rare_edges_are_folded(spark):
    rows = spark.createDataFrame(texts(7, 300), "lang string, text string")
    whole = phrases.grams(phrases.pieces(rows, "text", "lang"), 3)
    folded = phrases.folded_grams(rows, "text", "lang", 3, 10)
    assert 3 * folded.count() < whole.count()
    assert folded.agg(F.sum("f")).first() == whole.agg(F.sum("f")).first()


def test_packed_numbers():
    numbers = np.array([0, 5, 2**44 - 1, 7], np.uint64)
    assert (phrases._unpacked(phrases._packed(numbers), 4) == numbers).all()
    assert len(phrases._unpacked(phrases._packed(numbers[:0]), 0)) == 0


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None), ("en", "")]) == set()


def edges(spark, grams):
    return spark.createDataFrame([("en", g, f) for g, f in grams.items()], "lang string, phrase string, f long")


def test_paths_hold_each_edge_once(spark):
    chain = " ".join(f"c{i}" for i in range(40)).split()
    grams = {" ".join(chain[i : i + 3]): 100 + i for i in range(38)}
    grams |= {"c10 c11 other": 7, "p q p": 5, "q p q": 6, "r r r": 9}  # a branch, a circle and a loop
    paths = phrases.compact(edges(spark, grams), 3).collect()
    back = {}
    for p in paths:
        assert len(p.words) == len(p.weights) + 2
        for i, w in enumerate(p.weights):
            back[" ".join(p.words[i : i + 3])] = w
    assert back == grams and sum(len(p.weights) for p in paths) == len(grams)
    assert sorted(len(p.weights) for p in paths) == [1, 1, 1, 1, 10, 28]


def test_flow_is_the_count_of_shorter_phrases(spark):
    table = spark.createDataFrame([("en", "a b a b. a b c")], "lang string, text string")
    level = phrases.grams(phrases.pieces(table, "text", "lang"), 3)
    pairs = {r.phrase: r.f for r in phrases.node_flow(level, 2).collect()}
    assert pairs == {"a b": 3, "b a": 1, "b c": 1, "b": 1, "c": 1}  # the last two end pieces
    singles = phrases.node_flow(phrases.node_flow(level, 2), 1)
    assert {r.phrase: r.f for r in singles.collect()} == {"a": 3, "b": 3, "c": 1}


def test_large_counts_are_exact(spark):
    rows = [("en", 2, "x y", 10**14 - 1), ("en", 1, "x", 10**14 + 7), ("en", 1, "y", 10**14 + 1)]
    often = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    r = phrases._scored(often, often.filter(F.col("words") == 2)).first()
    assert r.score == 10**6 * (10**14 - 1) ** 2 // ((10**14 + 7) * (10**14 + 1))


def test_same_as_sql(spark, tmp_path):
    import duckdb

    from tagsieve.llm.oracles import OP11
    from tagsieve.llm.queries import op11_phrase_graph

    table = spark.createDataFrame([(i, *r) for i, r in enumerate(texts(9, 400))], "doc_id long, lang string, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op11_phrase_graph(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duck.sql(f"select lang, rank, phrase, a, l, r, n, score from ({OP11})").fetchall()) != set()
