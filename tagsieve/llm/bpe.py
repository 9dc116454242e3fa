"""Byte pair encoding by per-prefix dynamic programming, and decoding.

A byte string has one encoding, and so has each of its prefixes. The last token of a prefix is
the one token that ends there (an Aho-Corasick automaton over the vocabulary reports all of
them) and may follow the last token of the prefix before it. Whether token b may follow
token a is a test on the pair alone: take their merges back, latest first, and see whether
any two parts that touch across the border would have merged earlier. The last tokens are
back-pointers: followed from the end they give the ids, in time linear in the text, however
long a piece is.

Texts are cut at added tokens, then by the pattern of the byte-level pre-tokenizer, and pieces
are encoded one by one; a bounded cache keeps the codes of frequent pieces.

``encode`` gives the ids packed as little-endian unsigned 32-bit integers, ``decode`` the text of
packed ids, byte sequences that are not UTF-8 replaced. Both are Arrow functions on single
rows: no shuffle, memory bounded by an Arrow batch, the cache and the vocabulary.

Defined cases: null texts encode like empty ones, to no ids; null ids decode to the empty
text; unknown ids raise an error; added tokens inside a text are recognised, as the
library does by default; rows are independent; extra columns stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import released

#: Fixed value: how the byte-level pre-tokenizer cuts text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Letters and numbers newer than Unicode 16, which the library does not count as such.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The same for texts of ASCII characters alone.
ASCII_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Pieces and pairs remembered per worker; longer pieces are encoded anew each time.
CACHED_PIECES = 150_000
CACHED_PAIRS = 300_000
CACHED_CHARS = 48
#: Texts whose results are handed back together.
SLICE = 256


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Tokens by rank: 0 to 255 are bytes, 256 + i is the result of merge i."""

    ids: list[int]
    parts: list[tuple[int, int]]
    pairs: dict[tuple[int, int], int]
    texts: list[bytes]
    added: dict[str, int]
    by_id: dict[int, bytes] = field(default_factory=dict)

    def compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge below limit joins what touches where a ends and b begins."""
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                # of equal merges the left one is done first, so b's own rank counts
                limit, b = b + 1, self.parts[b][0]


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, cut = data["model"], data["pre_tokenizer"]
    plain = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and data["normalizer"] is None
    odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"])
    if model["type"] != "BPE" or not plain or odd or model.get("ignore_merges") or model.get("byte_fallback"):
        raise ValueError("only plain byte-level BPE files are read")
    symbols, numbers = byte_symbols(), model["vocab"]
    by_byte = {b: c for c, b in symbols.items()}
    names = [by_byte[b] for b in range(256)]
    ranks = {name: rank for rank, name in enumerate(names)}
    parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
    pairs: dict[tuple[int, int], int] = {}
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pair = ranks[left], ranks[right]
        if left + right in ranks:
            raise ValueError(f"two merges make the token {left + right!r}")
        ranks[left + right] = pairs[pair] = len(names)
        names.append(left + right)
        parts.append(pair)
    texts = [bytes(symbols[c] for c in name) for name in names]
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    found = Vocabulary([numbers[n] for n in names], parts, pairs, texts, added)
    found.by_id = dict(zip(found.ids, texts, strict=True)) | {i: t.encode() for t, i in added.items()}
    return found


class Codec:
    def __init__(self, path: str):
        import ahocorasick

        self.words = read_vocabulary(path)
        self.sizes = [len(t) for t in self.words.texts]
        self.packed = [i.to_bytes(4, "little") for i in self.words.ids]
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.matches = ahocorasick.Automaton()
        for rank, text in enumerate(self.words.texts):
            self.matches.add_word(text.decode("latin-1"), rank)
        self.matches.make_automaton()
        self.pattern = regex.compile(PIECES)
        self.ascii = re.compile(ASCII_PIECES, re.ASCII)
        self.newer = regex.compile(f"[{NEWER}]")
        older = PIECES.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"(?:[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]|[{NEWER}])")
        for kind in ("L", "N"):
            older = older.replace(f" ?\\p{{{kind}}}+", f" ?(?:(?![{NEWER}])\\p{{{kind}}})+")
        self.older = regex.compile(older)
        inside = "|".join(regex.escape(t) for t in sorted(self.words.added, key=len, reverse=True) if t)
        self.cut = regex.compile(f"({inside})") if inside else None

    def _alone(self, rank: int) -> bool:
        """Whether the bytes of the token encode to the token."""
        known = self.whole.get(rank)
        if known is None:
            a, b = self.words.parts[rank]
            known = rank < 256 or (self.words.compatible(a, b, rank) and self._alone(a) and self._alone(b))
            self.whole[rank] = known
        return known

    def _follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.words.compatible(a, b, 1 << 62) and self._alone(b)
        return known

    def ranks(self, raw: str) -> list[int]:
        """The ranks of a piece, given as one character per byte."""
        sizes, last, done = self.sizes, [-1] * (len(raw) + 1), -1
        known, follows = self.pairs, self._follows
        for end, rank in self.matches.iter(raw):
            if end == done:
                continue
            start = end + 1 - sizes[rank]
            if start:
                before = last[start]
                fits = known.get(before << 32 | rank)
                if fits is None:
                    fits = follows(before, rank)
            else:
                fits = self._alone(rank)
            if fits:
                last[end + 1], done = rank, end
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= sizes[last[at]]
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        packed = self.packed
        code = b"".join([packed[r] for r in self.ranks(piece.encode().decode("latin-1"))])
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = code
        return code

    def _plain(self, text: str) -> bytes:
        known, piece = self.pieces.get, self._piece
        pattern = self.ascii if text.isascii() else self.older if self.newer.search(text) else self.pattern
        return b"".join([known(p) or piece(p) for p in pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(t in text for t in self.words.added):
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(
            self.words.added[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts)
        )

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        return b"".join(map(self.words.by_id.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker and file."""
    return Codec(path)


def _sliced(batches: Iterator[pa.Array], convert: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield convert(batch[at : at + SLICE])


def encoded(text: Column, path: str) -> Column:
    """The packed ids of a text; path: a vocabulary file that every executor can open."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(path)
        return released(_sliced(batches, lambda b: pa.array([code.encode(t.as_py() or "") for t in b], pa.binary())))

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(path)
        return released(_sliced(batches, lambda b: pa.array([code.decode(i.as_py() or b"") for i in b], pa.string())))

    return texts(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct(ids, decoded): the packed ids of a text and the text decoded from them, in one pass."""

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(path)

        def convert(part: pa.Array) -> pa.Array:
            ids = [code.encode(t.as_py() or "") for t in part]
            texts = pa.array([code.decode(i) for i in ids], pa.string())
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), texts], ["ids", "decoded"])

        return released(_sliced(batches, convert))

    return both(text)


def encode(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    return df.withColumn(ids, encoded(F.col(text), path))


def decode(df: DataFrame, ids: str, path: str, text: str = "decoded") -> DataFrame:
    return df.withColumn(text, decoded(F.col(ids), path))


def encode_and_decode(df: DataFrame, text: str, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the packed ids and the text decoded from them."""
    pair = df.withColumn("__llm_pair", round_trip(F.col(text), path))
    return pair.withColumn(ids, F.col("__llm_pair.ids")).withColumn(out, F.col("__llm_pair.decoded")).drop("__llm_pair")
