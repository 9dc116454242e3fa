import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tagsieve.llm import linededup
from tests.llm.helpers import ODD_TEXTS, lower

LONG = [f"Line number {i} which many of the documents share, é" for i in range(30)]


def brute(rows, min_chars=40, min_docs=5):
    """rows: (id, text) -> a list of (id, n_lines, n_dropped, kept)."""

    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != me)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, deduped string")
    result = linededup.drop_repeated(table, "doc_id", "text", **more)
    assert result.columns == ["doc_id", "text", "deduped"]
    return [(r.doc_id, r.deduped.n_lines, r.deduped.n_dropped, r.deduped.kept) for r in result.collect()]


def some_rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        lines = [LONG[j] for j in rng.integers(0, 30, 4) if j < 20 or rng.random() < 0.1]
        lines += [f"only in {i}, and long enough to be looked at by the operator", "short", ""]
        if i % 3 == 0:
            lines += [f" \t{LONG[0].upper()} \r", LONG[0]]  # a third of the documents, twice each
        rng.shuffle(lines)
        rows.append((int(rng.integers(0, 100)), "\n".join(lines)))  # ids repeat
    return rows + [(None, LONG[1]), (None, LONG[1] + "\n" + LONG[2]), *((1000 + i, t) for i, t in enumerate(ODD_TEXTS))]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("routed", [False, True])
def test_equals_brute_force(spark, monkeypatch, routed):
    if routed:
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(linededup, "PROBES", 10)
    rows = some_rows()
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 100
    assert order(found(spark, rows)) == order(expected)
    assert order(found(spark, rows, min_docs=1, min_chars=5)) == order(brute(rows, 5, 1))


@pytest.mark.parametrize("routed", [False, True])
def test_empty_and_tiny_tables(spark, monkeypatch, routed):
    if routed:
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_shard_finds_its_keys_and_no_others():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64) for _ in range(2))
    b[7] = b[8]  # the same place in every level
    shard = linededup.Shard.load(linededup.Shard(a, b, np.arange(20_000) + 1, np.arange(20_000)).dump())
    slots = shard.find(a, b)
    assert sorted(slots) == list(range(20_000))
    assert (shard.last[slots] == np.arange(20_000)).all() and (shard.counts[slots] == np.arange(20_000) + 1).all()
    assert (shard.find(a + 1, b) == -1).all()
    assert (shard.find(b, a) == -1).all()
    assert len(shard.words) * 64 < 20_000 * 4  # under four bits a key


def test_empty_shard():
    none = np.zeros(0, np.int64)
    shard = linededup.Shard.load(linededup.Shard(none, none, none, none).dump())
    assert (shard.find(np.arange(3), np.arange(3)) == -1).all()


def test_same_as_sql(spark, tmp_path):
    import duckdb

    from tagsieve.llm.oracles import OP13
    from tagsieve.llm.queries import op13_line_dedup

    rows = [(i, t) for i, t in dict(some_rows()).items() if i is not None]
    table = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op13_line_dedup(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, n_lines, n_dropped, kept_sha256"
    assert got == set(duck.sql(f"select {names} from ({OP13})").fetchall())
    plain = {(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)}
    assert got == plain
    assert re.fullmatch("[0-9a-f]{64}", next(iter(got))[3])
