"""Text expressions: native columns only, no Python on the rows.

Character classes are spelled out because the short forms differ between regex
engines: Java's ``\\s`` and ``\\w`` are ASCII only, and ``trim`` removes only
the space character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagsieve import config

# The characters that Unicode counts as white space, plus the four
# ASCII separators; once as a regex class, once as a plain list for trimming.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

_PARAGRAPH_GAP = rf"\n[{BLANKS}]*\n+"
_SENTENCE_GAP = rf"(?<=[.!?])[{BLANKS}]+"
_TOKEN = r"[\p{L}\p{N}_]{3,}"
_TAG_SEPARATORS = r"[,;|]"

#: Sentences are packed in segments of this many. A fold copies its state at every
#: step, so a fold over all sentences of a very long paragraph would copy all its
#: pieces again and again.
_SEGMENT = 512


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(_BLANK_CHARS))


def round4(value: Column) -> Column:
    """Round to four decimals, halves to even."""
    return F.rint(value * 10000) / 10000


def percent_text(value: Column) -> Column:
    """0.125 -> '12%', halves to even."""
    return F.concat(F.rint(value * 100).cast("bigint").cast("string"), F.lit("%"))


def present(text: Column) -> Column:
    """True for text that is neither missing, empty nor the word a missing cell turns into."""
    return text.isNotNull() & ~text.isin("", "nan")


def paragraphs(text: Column) -> Column:
    """Non-empty stripped blocks of text between blank lines."""
    blocks = F.transform(F.split(text, _PARAGRAPH_GAP), strip)
    return F.filter(blocks, lambda block: block != "")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack_sentences(paragraph: Column, max_chars: int = config.MAX_CHARS_CHUNK) -> Column:
    """Split a stripped paragraph longer than ``max_chars`` at sentence ends and
    fill pieces greedily. A single longer sentence stays whole."""
    nothing = F.array().cast("array<string>")

    def add(state: Column, sentence: Column) -> Column:
        size = F.length(sentence)
        fresh = state.size == 0
        joins = ~fresh & (state.size + 1 + size <= max_chars)
        return F.struct(
            F.when(fresh | joins, state.done).otherwise(F.concat(state.done, F.array(state.open))).alias("done"),
            F.when(joins, F.concat(state.open, F.lit(" "), sentence)).otherwise(sentence).alias("open"),
            F.when(joins, state.size + 1 + size).otherwise(size).alias("size"),
        )

    def add_segment(state: Column, segment: Column) -> Column:
        start = F.struct(nothing.alias("done"), state.open.alias("open"), state.size.alias("size"))
        return _bind(
            F.aggregate(segment, start, add),
            lambda packed: F.struct(
                F.concat(state.blocks, F.array(packed.done)).alias("blocks"),
                packed.open.alias("open"),
                packed.size.alias("size"),
            ),
        )

    def pack(sentences: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(sentences) - 1) / _SEGMENT).cast("int"))
        segments = F.transform(numbers, lambda i: F.slice(sentences, i * _SEGMENT + 1, F.lit(_SEGMENT)))
        empty = F.struct(
            F.array().cast("array<array<string>>").alias("blocks"), F.lit("").alias("open"), F.lit(0).alias("size")
        )
        return F.aggregate(
            segments,
            empty,
            add_segment,
            lambda state: F.concat(
                F.flatten(state.blocks), F.filter(F.array(state.open), lambda piece: piece != "")
            ),
        )

    packed = _bind(F.split(paragraph, _SENTENCE_GAP), pack)
    return F.when(F.length(paragraph) <= max_chars, F.array(paragraph)).otherwise(packed)


def chunks(
    text: Column,
    max_chars: int = config.MAX_CHARS_CHUNK,
    min_chars: int = config.MIN_CHARS_CHUNK,
) -> Column:
    """Ordered pieces of a report that are long enough to analyse."""
    return pieces(paragraphs(text), max_chars, min_chars)


def pieces(
    blocks: Column,
    max_chars: int = config.MAX_CHARS_CHUNK,
    min_chars: int = config.MIN_CHARS_CHUNK,
) -> Column:
    """``chunks`` of a text whose paragraphs are known."""
    packed = F.flatten(F.transform(blocks, lambda block: pack_sentences(block, max_chars)))
    return F.filter(packed, lambda piece: F.length(piece) >= min_chars)


def tokens(text: Column) -> Column:
    """Lower-case runs of at least three letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def run_starts(words: Column) -> Column:
    """Positions in a sorted word list where another word begins."""
    marked = F.transform(words, lambda word, i: F.when((i == 0) | (word != F.get(words, i - 1)), i))
    return F.filter(marked, lambda start: start.isNotNull())


def run_counts(words: Column, starts: Column) -> Column:
    """Distinct words of a sorted list with their number: array of (term, tf).

    Both arguments must be plain columns: they are read once per word.
    """
    return F.transform(
        starts,
        lambda start, i: F.struct(
            F.get(words, start).alias("term"),
            (F.coalesce(F.get(starts, i + 1), F.size(words)) - start).alias("tf"),
        ),
    )


def with_bigrams(words: Column) -> Column:
    """Words followed by pairs of neighbouring words (neighbours after short words are dropped)."""
    pairs = F.transform(
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda word, i: F.concat(F.get(words, i), F.lit(" "), word),
    )
    return F.concat(words, pairs)


def split_tags(codes: Column) -> Column:
    """Tags of a free-form code cell: split on comma, semicolon or bar, without repeats."""
    parts = F.transform(F.split(codes, _TAG_SEPARATORS), strip)
    return F.array_distinct(F.filter(parts, lambda tag: tag != ""))


def split_predicted(tags: Column) -> Column:
    """Tags of a decoded prediction, which uses the bar only. Missing gives an empty list."""
    parts = F.transform(F.split(tags, r"\|"), strip)
    return F.coalesce(F.filter(parts, lambda tag: tag != ""), F.array().cast("array<string>"))
