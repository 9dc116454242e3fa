import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS
from tagsieve.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def ids(packed):
    return array("I", packed).tolist()


def test_same_ids_as_the_library(library):
    rng = random.Random(10)
    parts = ["a", "e", "th", "in", " ", "  ", "\n", "\t", "1", "42", "é", "日本", "😀", "'s", "'S", "-", "--", "==", "_", "the", "<|endoftext|>",
             "<|end", " ", "　", " ", "\x85", "\x1c", "՘", "꟎", "\U00011de1", "ing", "ẞ", "٣", "Ⅷ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(150))) for _ in range(500)]
    texts += [" " * 3000 + "x", "-" * 3000, "ab" * 5000, "aaaa" * 999]
    codec = bpe.codec(PATH)
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(codec.encode(text)) == expected
        assert codec.decode(codec.encode(text)) == library.decode(expected, skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    codec = bpe.codec(PATH)
    assert all(codec._alone(rank) for rank in range(len(codec.words.texts)))


def test_bytes_that_are_not_text(library):
    codec = bpe.codec(PATH)
    broken = [i for i in range(50_256)][188:200]
    assert codec.decode(array("I", broken).tobytes()) == library.decode(broken, skip_special_tokens=False)


def test_caches_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    codec = bpe.Codec(PATH)
    text = "several quite different words follow each other in this sentence"
    assert ids(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(codec.pieces) <= 5 and len(codec.pairs) <= 5


def test_odd_tables(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, "text", PATH), "ids", PATH).collect()
    for row in rows:
        assert ids(row.ids) == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == (row.text or "")
    assert len(rows) == len(ODD_TEXTS)
    both = bpe.encode_and_decode(docs, "text", PATH).collect()
    assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in both) == sorted((r.doc_id, bytes(r.ids), r.decoded) for r in rows)
    assert bpe.encode(docs.limit(0), "text", PATH).count() == 0
