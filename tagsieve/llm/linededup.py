"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line stripped of ASCII blanks at both ends, with A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points found in at least ``MIN_DOCS`` documents lose all their lines, except in
the largest id that holds them.

Keys travel as 128-bit hashes, never as text. Hashes are counted by (hash, id) and then by hash, both
combined before the shuffle, so a line of a third of all documents is a few rows a task. Hashes of
enough documents are dealt into shards of about ``SHARD_KEYS``. A task builds one shard: a minimal perfect
hash (levels of bits; a key takes the first level where it is alone, its slot is the rank of its bit)
and, by slot, a 64-bit fingerprint, the number of documents and the largest id.

Documents probe these arrays; lines are not joined. As long as all shards together take at most
``BROADCAST_BYTES``, measured on the stored shards, every task has them all and no document moves. Beyond
that, the hashes of the lines go to their shard, each shard copied for every ``PROBES`` probes, so that
a hot line is many tasks; the answers come back as one row a document and meet it by the hash of its text.
Both ways give the same rows.

Two lines are mistaken for each other only where 64 bits of fingerprint and the slot agree.

Defined cases: a null text is an empty one, which is one empty line; a null id is one document,
smaller than all others; rows of one id are one document, and each keeps the lines that its id
keeps; an empty table gives no rows. A column with the name of the result is replaced, other
columns stay.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import OWN, let, lower_ascii, stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys in a shard, about; a key takes some 20 bytes.
SHARD_KEYS = 65_536
#: Small sets of keys are dealt into so many shards.
LEAST_SHARDS = 16
BROADCAST_BYTES = 32 << 20
#: Probes that one task answers, about.
PROBES = 2_000_000

#: Bits of a level for each key that is left.
_ROOM = 2
_LEVELS = 24
#: Stands for a null id.
_NO_ID = -(1 << 63)

_BLANKS = " \t\n\x0b\x0c\r"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def lines(text: Column) -> Column:
    """All lines, also empty ones at the end."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(_BLANKS)))


def key_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """For each line the two halves (a, b) of its key's hash, null where the key is too short."""

    def of_key(key: Column) -> Column:
        halves = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
        return F.when(F.length(key) >= min_chars, halves)

    return F.transform(
        lines(text), lambda line: F.when(F.length(line) >= min_chars, let(line_key(line), of_key))
    )


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + _MIX[2] * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class Shard:
    """Minimal perfect hash of (a, b) with the arrays it indexes. b chooses the slot, a is the fingerprint."""

    def __init__(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, last: np.ndarray):
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        words, sizes, left = [], [], np.arange(len(b))
        while len(left) and len(sizes) < _LEVELS:
            size = 64 * -(-_ROOM * len(left) // 64)
            at = (_mixed(b[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.rest = b[left]  # keys that share b with another one: their slots come last
        self._prepare()
        slot = self._slots(b)
        slot[left] = self.placed + np.arange(len(left))
        order = np.empty(len(b), np.int64)
        order[slot] = np.arange(len(b))
        self.fingerprints, self.last = a[order], last[order].astype(np.int64)
        self.counts = counts[order].astype(np.min_scalar_type(int(counts.max()))) if len(b) else counts

    def _prepare(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])[:-1] if len(ones) else np.zeros(0, np.int64)
        self.placed = int(ones.sum())

    def _slots(self, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that no level holds."""
        slot, open_ = np.full(len(b), -1, np.int64), np.arange(len(b))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mixed(b[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot[open_[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key of the shard, -1 for all other keys."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        slot = self._slots(b)
        known = np.flatnonzero(slot >= 0)
        slot[known[self.fingerprints[slot[known]] != a[known]]] = -1
        for i in np.flatnonzero(np.isin(b, self.rest)) if len(self.rest) else ():
            same = np.flatnonzero((self.rest == b[i]) & (self.fingerprints[self.placed :] == a[i]))
            slot[i] = self.placed + same[0] if len(same) else -1
        return slot

    def dropped(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether the line goes: enough documents hold it, and this is not the last of them."""
        slot = self.find(a, b)
        out = slot >= 0
        out[out] = (self.counts[slot[out]] >= min_docs) & (self.last[slot[out]] != ids[out])
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        names = ("words", "sizes", "rest", "fingerprints", "counts", "last")
        np.savez(out, **{n: getattr(self, n) for n in names})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        arrays = np.load(io.BytesIO(data))
        shard = cls.__new__(cls)
        for name in arrays.files:
            setattr(shard, name, arrays[name])
        shard._prepare()
        return shard


def line_counts(docs: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, n, last): for each key's hash the number of documents that hold it and the largest id."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))
    held = F.array_distinct(F.filter(key_hashes(F.col(text), min_chars), lambda h: h.isNotNull()))
    # an outer explode: for an inner one the optimizer hashes every line a second time
    rows = docs.select(doc.alias("doc"), F.explode_outer(held).alias("h")).filter("h is not null").select("doc", "h.a", "h.b")
    once = rows.groupBy("a", "b", "doc").agg(F.lit(1).alias("one"))
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))


def index(counts: DataFrame) -> tuple[DataFrame, int]:
    """(shard, n_probes, pages) over (a, b, n, last), stored, and the number of shards."""
    kept = stored(counts)
    shards = max(LEAST_SHARDS, -(-kept.count() // SHARD_KEYS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found = Shard(*(group[c].to_numpy() for c in ("a", "b", "n", "last")))
        return pd.DataFrame(
            {"shard": [int(group["shard"].iloc[0])], "n_probes": [int(group["n"].sum())], "pages": [found.dump()]}
        )

    dealt = kept.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, "shard int, n_probes long, pages binary")), shards


def _flat(hashes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of hash lists: lengths, places of the hashes that are not null, a, b."""
    flat = pc.list_flatten(hashes)
    places = np.flatnonzero(pc.is_valid(flat).to_numpy(zero_copy_only=False))
    held = flat.take(pa.array(places))
    a, b = (pc.struct_field(held, i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return pc.list_value_length(hashes).to_numpy(zero_copy_only=False), places, a, b


def _probed_in_place(doc: Column, hashes: Column, index_rows: DataFrame, shards: int, min_docs: int) -> Column:
    """For each line whether it goes, from arrays that every task has; their size was checked."""
    pages = {r["shard"]: bytes(r["pages"]) for r in index_rows.select("shard", "pages").collect()}
    sent = index_rows.sparkSession.sparkContext.broadcast(pages)

    @F.arrow_udf("array<boolean>")
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        loaded = {shard: Shard.load(data) for shard, data in sent.value.items()}
        for ids, lists in batches:
            sizes, places, a, b = _flat(lists)
            owner = np.repeat(ids.to_numpy(zero_copy_only=False), sizes)
            out, home = np.zeros(len(owner), bool), a % shards
            for shard, arrays in loaded.items():
                mine = np.flatnonzero(home == shard)
                out[places[mine]] = arrays.dropped(a[mine], b[mine], owner[places[mine]], min_docs)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out))

    return probe(doc, hashes)


def _probed_by_shard(docs: DataFrame, text: str, index_rows: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The documents with the hashes that go, for shards that are too large to be everywhere."""
    known = [f"{OWN}doc", f"{OWN}x", f"{OWN}y"]
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(known[1], F.xxhash64(body)).withColumn(known[2], F.xxhash64(F.lit(1), body))
    copies = index_rows.select("shard", F.ceil((F.col("n_probes") + 1) / PROBES).cast("int").alias("copies"))
    held = F.array_distinct(F.filter(f"{OWN}hashes", lambda h: h.isNotNull()))
    asked = keyed.select(*known, F.explode(held).alias("h")).select(*known, "h.a", "h.b")
    asked = asked.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).join(copies, "shard")
    asked = asked.withColumn("copy", F.pmod(F.xxhash64(known[0]), F.col("copies")).cast("int"))
    arrays = index_rows.join(copies, "shard").select(
        F.col("shard").alias("at_shard"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("at_copy"), "pages"
    )

    def probe(pages: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(rows):
            return rows[[*known, "a", "b"]].iloc[:0]
        a, b, ids = (rows[c].to_numpy() for c in ("a", "b", known[0]))
        return rows[[*known, "a", "b"]][Shard.load(pages["pages"].iloc[0]).dropped(a, b, ids, min_docs)]

    found = (
        arrays.groupBy("at_shard", "at_copy")
        .cogroup(asked.groupBy("shard", "copy"))
        .applyInPandas(probe, ", ".join(f"`{c}` long" for c in [*known, "a", "b"]))
    )
    gone = found.groupBy(*known).agg(F.collect_set(F.struct("a", "b")).alias(f"{OWN}gone"))
    goes = F.transform(
        f"{OWN}hashes", lambda h: h.isNotNull() & F.coalesce(F.array_contains(f"{OWN}gone", h), F.lit(False))
    )
    return keyed.join(gone, known, "left").withColumn(f"{OWN}goes", goes)


def drop_repeated(
    docs: DataFrame,
    key: str,
    text: str,
    into: str = "deduped",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns and ``into``: kept (the lines that stay, joined), n_lines, n_dropped."""
    counts = line_counts(docs, key, text, min_chars).filter(F.col("n") >= min_docs)
    index_rows, shards = index(counts)
    size = index_rows.agg(F.sum(F.octet_length("pages"))).first()[0] or 0
    hashed = docs.select(
        "*",
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias(f"{OWN}doc"),
        key_hashes(F.col(text), min_chars).alias(f"{OWN}hashes"),
    )
    if size <= BROADCAST_BYTES:
        goes = _probed_in_place(F.col(f"{OWN}doc"), F.col(f"{OWN}hashes"), index_rows, shards, min_docs)
        probed = hashed.withColumn(f"{OWN}goes", goes)
    else:
        probed = _probed_by_shard(hashed, text, index_rows, shards, min_docs)
    marks = F.col(f"{OWN}goes")
    stay = F.filter(lines(F.col(text)), lambda line, i: ~F.get(marks, i))
    result = F.struct(
        F.array_join(stay, "\n").alias("kept"),
        F.size(marks).cast("long").alias("n_lines"),
        F.size(F.filter(marks, lambda m: m)).cast("long").alias("n_dropped"),
    )
    return probed.withColumn(into, result).select(*[c for c in docs.columns if c != into], into)
