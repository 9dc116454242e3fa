"""Phrase collocations from a weighted de Bruijn graph.

Texts fall into pieces, pieces into words. Every word position gives one gram: the longest run of at most
``n`` words from there, shorter where the piece ends. Counted once, the grams of n words are
the edges of a de Bruijn graph: an edge leads from the node of its first n - 1 words to the
node of its last n - 1 words, so edges overlap in a node. Shorter grams are the corrections for piece ends.

Counts of shorter phrases are not counted in the texts: the flow out of a node, its edges and its
corrections added up, is the count of its n - 1 words, and so on down to single words. Sums
are combined before each shuffle, so a frequent word is a few rows a task.

Most edges of a large corpus occur once or twice. They matter only as flow out of their node, so they are
folded into it before the shuffle: a gram is cut to its longest beginning that may occur ``min_count`` times.
Which may is told by 44-bit codes of all runs of up to n words, counted beforehand. Codes travel
sorted, as compressed differences, a few bytes each, and every part of the code space is counted in a task of
its own; the number of parts follows the size of the texts. Frequent codes set a bit in a map of at most
``MAP_BITS``. Codes that meet in a place only make counts look larger, so no frequent phrase is ever
cut, whatever the size of the corpus; a full map only folds less.

Edges of at least ``min_count`` occurrences are compacted: a node with one such edge in and one out joins
them, and pointer doubling over edge numbers finds the head of each path and each edge's place in it,
in as many rounds as the longest path has binary digits. A path is one row of words and weights (cut
every ``PATH_EDGES`` edges). It tells in the row what the longest phrases around each of its inner nodes count;
only the nodes at its ends are grouped. Edges of a circle without a head stay paths of one edge.

A candidate of j words that a longer one covers is covered by one of j + 1 words, as that counts at least as
much; so one level up is enough.

Defined cases: null and empty texts have no pieces; a null language is ``und``, an empty one stays;
words are kept whole, whatever their length; equal scores are ranked by count and then by the phrase's
UTF-8 bytes; repeated rows count as often as they come; an empty table gives no rows. Counts up to 10^15 are
exact. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.llm.common import lower_ascii, released, stored

MAX_WORDS = 3
MIN_COUNT = 10
#: A longer phrase with at least this percentage of the count covers a shorter one.
COVER = 50
TOP = 2_000
#: Edges in one row of a path.
PATH_EDGES = 1_024

CODE_BITS = 44
#: The map has 32 bits for each frequent code, as long as that is at most this many, 32 MB.
MAP_BITS = 28
#: Codes that a task holds before it hands them on.
HELD = 4_000_000
#: Bytes of text for each part of the code space.
PART_BYTES = 16 << 20

PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
_GAPS = r"[\x20\x09]+"


def pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, words): the word list of every piece."""
    parts = F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), PIECE_ENDS, -1)
    # outer explodes: for inner ones the optimizer makes each list a second time, to see that it is not empty
    named = F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(named, F.explode_outer(parts).alias("piece"))
    return rows.select("lang", F.filter(F.split("piece", _GAPS, -1), lambda w: w != "").alias("words"))


def _word_hashes() -> Column:
    return F.transform("words", lambda w: F.xxhash64("lang", w))


def _levels(lists: pa.Array, n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of lists of word hashes: the lengths, and for runs of 1 to n words the flat positions where one begins
    and their codes."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    at, state, out = np.arange(len(words)), np.zeros(len(words), np.uint64), []
    with np.errstate(over="ignore"):
        for k in range(n):
            long = left[at] > k
            at, state = at[long], state[long]
            state = (state ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + 1)
            state = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            state ^= state >> np.uint64(32)
            out.append((at, state >> np.uint64(64 - CODE_BITS)))
    return sizes, out


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, bytes of equal rank together, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def frequent_codes(rows: DataFrame, parts_log: int, n: int, min_count: int) -> DataFrame:
    """(part, n, codes): codes of the runs of up to n words that occur at least min_count times, packed as
    differences; 2^parts_log parts share the code space."""
    shift = np.uint64(CODE_BITS - parts_log)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (codes >> shift).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(first[1:], len(codes))
            steps = np.diff(codes, prepend=np.uint64(0))
            steps[first] = codes[first]
            columns = [part[first], ends - first]
            columns += [[_packed(x[i:j]) for i, j in zip(first, ends)] for x in (steps, counts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(columns[3])],
                ["part", "n", "steps", "counts"],
            )

        for batch in batches:
            for _, codes in _levels(batch.column(0), n)[1]:
                held.append(codes)
                size += len(codes)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        codes = [np.cumsum(_unpacked(s, k), dtype=np.uint64) for s, k in zip(group["steps"], group["n"])]
        counts = [_unpacked(c, k) for c, k in zip(group["counts"], group["n"])]
        codes, counts = _summed(np.concatenate(codes), np.concatenate(counts))
        codes = codes[counts >= min_count]
        packed = _packed(np.diff(codes, prepend=np.uint64(0)))
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "n": [len(codes)], "codes": [packed]})

    sent = rows.select(_word_hashes().alias("h")).mapInArrow(
        lambda batches: released(send(batches)), "part int, n int, steps binary, counts binary"
    )
    return sent.groupBy("part").applyInPandas(count, "part int, n int, codes binary")


def _map_of(frequent: DataFrame, parts_log: int) -> tuple[bytes, int]:
    """A bit for every place that a frequent code has; at most 2^MAP_BITS of them."""
    frequent = stored(frequent)
    size = frequent.agg(F.sum("n")).first()[0] or 0
    bits = max(min(MAP_BITS, int(32 * size).bit_length()), parts_log + 3)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside = bits - parts_log
        for batch in batches:
            out = []
            for data, n in zip(batch["codes"], batch["n"]):
                marks = np.zeros(1 << inside, bool)
                codes = np.cumsum(_unpacked(data, n), dtype=np.uint64) >> np.uint64(CODE_BITS - bits)
                marks[(codes & np.uint64((1 << inside) - 1)).astype(np.int64)] = True
                out.append(np.packbits(marks, bitorder="little").tobytes())
            yield pd.DataFrame({"part": batch["part"], "marks": out})

    step = 1 << (bits - parts_log - 3)
    whole = bytearray(1 << (bits - 3))
    for row in frequent.mapInPandas(mark, "part int, marks binary").toLocalIterator():
        whole[row["part"] * step : (row["part"] + 1) * step] = row["marks"]
    return bytes(whole), bits


def _kept_words(marks, bits: int, n: int):
    """How many words from each position on may be frequent together."""

    @F.arrow_udf("array<int>")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = np.frombuffer(marks.value, np.uint8)
        for lists in batches:
            sizes, levels = _levels(lists, n)
            out = np.zeros(int(sizes.sum()), np.int32)
            for k, (at, codes) in enumerate(levels):
                place = (codes >> np.uint64(CODE_BITS - bits)).astype(np.int64)
                hit = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                going = at[hit & (out[at] == k)]
                out[going] = k + 1
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out))

    return kept(_word_hashes())


def grams(rows: DataFrame, n: int, lengths: Column | None = None) -> DataFrame:
    """(lang, phrase, f) of the grams: edges, and shorter ones at piece ends or where ``lengths``, a number of
    words for each position, cuts them; an empty one counts words that no frequent phrase begins with."""
    sized = rows.select("lang", "words", (F.lit(None) if lengths is None else lengths).alias("lengths"))
    size = F.lit(n) if lengths is None else None
    runs = F.transform(
        "words", lambda w, i: F.array_join(F.slice("words", i + 1, F.get("lengths", i) if size is None else size), " ")
    )
    each = sized.select("lang", F.explode_outer(runs).alias("phrase")).filter("phrase is not null")
    return each.groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f"))


def folded_grams(docs: DataFrame, text: str, lang: str, n: int, min_count: int) -> DataFrame:
    """``grams`` with everything that is surely rarer than min_count folded into shorter ones."""
    rows = pieces(docs, text, lang)
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    parts_log = max(4, (size // PART_BYTES).bit_length())
    marks, bits = _map_of(frequent_codes(rows, parts_log, n, min_count), parts_log)
    sent = docs.sparkSession.sparkContext.broadcast(marks)
    return grams(rows, n, _kept_words(sent, bits, n))


def node_flow(level: DataFrame, words: int) -> DataFrame:
    """(lang, phrase, f): of grams of up to words + 1 words, the counts of their first words."""
    first = F.substring_index("phrase", " ", words)
    return level.groupBy("lang", first.alias("phrase")).agg(F.sum("f").alias("f"))


def n_words(phrase: Column) -> Column:
    """0 for an empty phrase."""
    return F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)


def _first(phrase: Column | str, k) -> Column:
    return F.substring_index(phrase, " ", k)


def _rest(phrase: str, first: Column) -> Column:
    return F.substring(F.col(phrase), F.length(first) + 2, F.length(phrase))


def phrase_counts(docs: DataFrame, text: str, lang: str, n: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of 1 to n words with at least min_count occurrences, and
    (lang, n) with all word occurrences."""
    level = stored(folded_grams(docs, text, lang, n, min_count))
    often = []
    for words in range(n, 0, -1):
        if words < n:
            level = stored(node_flow(level, words))
        whole = level.filter((F.col("f") >= min_count) & (n_words(F.col("phrase")) == words))
        often.append(whole.select("lang", F.lit(words).alias("words"), "phrase", "f"))
    return stored(reduce(DataFrame.union, often)), level.groupBy("lang").agg(F.sum("f").alias("n"))


def _heads(links: DataFrame) -> DataFrame:
    """(edge, head, place) of all edges with a predecessor, from (edge, prev); edges of circles are their own heads."""
    state = stored(links.select("edge", F.col("prev").alias("head"), F.lit(1).cast("long").alias("place")))
    done, left = [], state.count()
    while left:
        ahead = state.select(F.col("edge").alias("at"), F.col("head").alias("next"), F.col("place").alias("more"))
        stepped = state.join(ahead, F.col("head") == F.col("at"), "left")
        moved = stored(
            stepped.select(
                "edge",
                F.coalesce("next", "head").alias("head"),
                (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
                F.col("at").isNull().alias("done"),
            )
        )
        # finished edges still lead the others, one more time, so they stay in the state
        state, before = moved.drop("done"), left
        left = moved.filter(~F.col("done")).count()
        if left == before:
            done.append(moved.filter(~F.col("done")).select("edge", F.col("edge").alias("head"), F.lit(0).cast("long").alias("place")))
            state = moved.filter("done").drop("done")
            break
    return reduce(DataFrame.union, done, state)


def compact(edges: DataFrame, n: int) -> DataFrame:
    """(lang, words, weights) of the paths, from (lang, phrase, f) with n words each: edge i of a path goes
    from words i .. i + n - 2 to words i + 1 .. i + n - 1."""
    numbered = stored(edges.select(F.monotonically_increasing_id().alias("edge"), "lang", "phrase", "f"))
    source, target = _first("phrase", n - 1), _rest("phrase", _first("phrase", 1))
    none = F.lit(None).cast("long")
    sides = numbered.select("lang", target.alias("node"), F.col("edge").alias("into"), none.alias("out")).union(
        numbered.select("lang", source.alias("node"), none.alias("into"), F.col("edge").alias("out"))
    )
    nodes = sides.groupBy("lang", "node").agg(
        F.count("into").alias("n_into"), F.count("out").alias("n_out"), F.max("into").alias("prev"), F.max("out").alias("edge")
    )
    links = nodes.filter("n_into = 1 and n_out = 1 and prev <> edge").select("edge", "prev")
    heads = _heads(links).withColumnRenamed("edge", "linked")
    placed = numbered.join(heads, F.col("edge") == F.col("linked"), "left").select(
        "lang", "phrase", "f", F.coalesce("head", "edge").alias("head"), F.coalesce("place", F.lit(0)).alias("place")
    )
    part = F.floor(F.col("place") / PATH_EDGES).alias("part")
    paths = placed.groupBy("lang", "head", part).agg(F.array_sort(F.collect_list(F.struct("place", "phrase", "f"))).alias("edges"))
    later = F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: F.substring_index(e["phrase"], " ", -1))
    words = F.concat(F.split(F.col("edges")[0]["phrase"], " "), later)
    return paths.select("lang", words.alias("words"), F.col("edges.f").alias("weights"))


def around_nodes(paths: DataFrame, n: int) -> DataFrame:
    """(lang, node, most): the largest weight of an edge at each node, inner nodes of paths in the row."""

    def node(i) -> Column:
        return F.array_join(F.slice("words", i + 1, F.lit(n - 1)), " ")

    paths = stored(paths)
    last = F.size("weights")
    inner = F.transform(
        F.slice("weights", F.lit(2), last),
        lambda w, i: F.struct(node(i + 1).alias("node"), F.greatest(w, F.get("weights", i)).alias("most")),
    )
    ends = F.array(
        F.struct(node(F.lit(0)).alias("node"), F.col("weights")[0].alias("most")),
        F.struct(node(last).alias("node"), F.get("weights", last - 1).alias("most")),
    )
    inside = paths.select("lang", F.explode(inner).alias("x")).select("lang", "x.node", "x.most")
    outside = paths.select("lang", F.explode(ends).alias("x")).select("lang", "x.node", "x.most")
    # a node inside a path lies in no other one; all others are ends
    return inside.union(outside.groupBy("lang", "node").agg(F.max("most").alias("most")))


def _covering(often: DataFrame, words: int, n: int) -> DataFrame:
    """(lang, node, most): the largest count of a phrase of words + 1 words around each of ``words`` words."""
    longer = often.filter(F.col("words") == words + 1).select("lang", "phrase", "f")
    if words == n - 1:
        return around_nodes(compact(longer, n), n)
    sides = F.explode(F.array(_first("phrase", words), _rest("phrase", _first("phrase", 1))))
    return longer.select("lang", sides.alias("node"), "f").groupBy("lang", "node").agg(F.max("f").alias("most"))


def _scored(often: DataFrame, candidates: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each candidate: (lang, phrase, a, score, k, l, r)."""
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    # the first k words, for k that differs by row
    cut = cuts.withColumn("first", F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " "))
    cut = cut.withColumn("rest", _rest("phrase", F.col("first")))
    left = often.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    right = often.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    both = cut.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase"))).join(
        right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase"))
    )
    wide = {c: f"cast({c} as decimal(15,0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.*")


def collocations(
    docs: DataFrame,
    text: str,
    lang: str,
    n: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    cover: int = COVER,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to n words of each language. a is the
    count of the phrase, l and r those of the two parts of its lowest-scoring cut, n all word occurrences."""
    if n < 2:
        raise ValueError("phrases have at least two words")
    often, totals = phrase_counts(docs, text, lang, n, min_count)
    free = [often.filter(F.col("words") == n)]
    for words in range(n - 1, 1, -1):
        covering = _covering(often, words, n).select(F.col("lang").alias("c_lang"), F.col("node"), "most")
        open_ = often.filter(F.col("words") == words).join(
            covering, (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("node")), "left"
        )
        kept = open_.filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f")))
        free.append(kept.select("lang", "words", "phrase", "f"))
    scored = _scored(often, reduce(DataFrame.union, free))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
