"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z. A
pattern is a window of ``n`` consecutive words of a benchmark item, or the whole item if it has
fewer words. Patterns of one length m are searched together: the shift table maps every
block of two words (one, for patterns of one word) that ends before the pattern's end to its
distance from that end, so positions whose block is unknown are skipped by m - 1 words. Where
the shift is zero, the block's bucket lists the patterns that end with it, and direct
comparison of the words confirms occurrences.

Patterns go to the tasks in shards of at most about ``SHARD_WINDOWS`` windows, dealt by a hash of
window and item: each broadcast has that bound, and further shards add further passes over
the documents, whose hits are united. Documents are one row each: no shuffle.

Defined cases: null or empty texts have no words; items without words have no pattern;
windows of items with a null id mark words but name no item; repeated items count once;
repeated documents each get a row; an empty benchmark hits nothing. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import released

WINDOW = 10
#: Windows that one pass searches, about; it bounds the broadcast.
SHARD_WINDOWS = 200_000

#: Bytes to search text: A-Z to lower case, separators to blanks.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split() if text else []


class Patterns:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, window: tuple[bytes, ...], items: list[str]) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            block = window[end - b : end] if b == 2 else window[end - 1]
            distance = m - end
            if distance < self.shift.get(block, m):
                self.shift[block] = distance
        last = window[m - b :] if b == 2 else window[m - 1]
        self.buckets.setdefault(last, {})[window] = items

    def search(self, text: list[bytes], found: list[tuple[int, int]], items: set[str]) -> None:
        """Adds the spans (first word, end) of all occurrences and the items they name."""
        m, n = self.length, len(text)
        shift, buckets = self.shift.get, self.buckets
        if m == 1:
            for at, word in enumerate(text):
                hit = buckets.get(word)
                if hit:
                    found.append((at, at + 1))
                    items.update(hit[(word,)])
            return
        step, end = m - 1, m - 1
        while end < n:
            block = (text[end - 1], text[end])
            ahead = shift(block, step)
            if ahead:
                end += ahead
                continue
            start = end + 1 - m
            window = tuple(text[start : end + 1])
            hit = buckets[block].get(window)
            if hit is not None:
                found.append((start, end + 1))
                items.update(hit)
            end += 1


def windows(benchmark: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(window, item): the distinct windows of all items; words of a window are joined by a blank."""

    @F.arrow_udf("array<string>")
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for value in batch:
                found = words(value.as_py())
                spans = range(max(len(found) - n, 0) + 1) if found else ()
                out.append([b" ".join(found[i : i + n]).decode("utf-8", "surrogatepass") for i in spans])
            yield pa.array(out, pa.list_(pa.string()))

    cut_text = benchmark.select(F.col(item).cast("string").alias("item"), cut(F.col(text)).alias("found"))
    return cut_text.select(F.explode("found").alias("window"), "item").distinct()


def _tables(rows: list[tuple[str, list[str]]]) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for window, items in rows:
        parts = tuple(window.encode("utf-8", "surrogatepass").split())
        by_length.setdefault(len(parts), Patterns(len(parts))).add(parts, items)
    return list(by_length.values())


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


RESULT = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def mark(
    docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, n: int = WINDOW, out: str = "benchmark"
) -> DataFrame:
    """docs with a struct column ``out``: n_words, spans (word positions from 0 that lie in an
    occurrence, as start and end), items (ids as strings, sorted)."""
    spark = docs.sparkSession
    cut = windows(benchmark, item, item_text, n)
    total = cut.count()
    shards = max(1, -(-total // SHARD_WINDOWS))
    marked = docs
    for shard in range(shards):
        part = cut.filter(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == shard)
        rows = [(r.window, r.items) for r in part.groupBy("window").agg(F.collect_list("item").alias("items")).collect()]
        shared = spark.sparkContext.broadcast(rows)
        found = _search(shared)(F.col(text))
        marked = marked.withColumn(out if not shard else f"__llm_{out}", found)
        if shard:
            old, new = F.col(out), F.col(f"__llm_{out}")
            both = _unite(F.concat(old["spans"], new["spans"]))
            items = F.array_sort(F.array_union(old["items"], new["items"]))
            marked = marked.withColumn(
                out, F.struct(old["n_words"].alias("n_words"), both.alias("spans"), items.alias("items"))
            ).drop(f"__llm_{out}")
    return marked


def _unite(spans):
    """Overlapping spans of several passes, united."""

    @F.arrow_udf("array<struct<start:bigint,end:bigint>>")
    def united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [_united([(s["start"], s["end"]) for s in row.as_py()]) for row in batch]
            yield pa.array([[{"start": a, "end": b} for a, b in row] for row in rows], _ARROW.field("spans").type)

    return united(spans)


def _search(shared):
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _tables(shared.value)
        for batch in batches:
            out = []
            for value in batch:
                text, spans, items = words(value.as_py()), [], set()
                for patterns in tables:
                    patterns.search(text, spans, items)
                out.append(
                    {
                        "n_words": len(text),
                        "spans": [{"start": a, "end": b} for a, b in _united(spans)] if spans else [],
                        "items": sorted(items) if items else [],
                    }
                )
            yield pa.array(out, _ARROW)

    @F.arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(searched(batches))

    return search
