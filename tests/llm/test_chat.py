import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS
from tagsieve.llm import chat

LOG = "conv_id long, seq long, msg long, kind string, role string, text string, formatted string"


def read(spark, events):
    chats = chat.format_chats(spark.createDataFrame([(*e, "x") for e in events], LOG))
    rows = chats.select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
        chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss, r.formatted) for r in rows}


def plain(events):
    """Turns by conversation, folded event by event."""
    rank = {k: i for i, k in enumerate(chat.KINDS)}
    logs = {}
    for e in events:
        if e[3] in rank:
            logs.setdefault((e[0], e[2]), []).append(e)
    key = lambda x: (x is not None, x if x is not None else 0)
    text_key = lambda x: (x is not None, x or "")
    out = {}
    for conv, msg in sorted(logs, key=lambda x: (key(x[0]), key(x[1]))):
        turns = []
        for _, _, _, kind, role, text in sorted(logs[conv, msg], key=lambda e: (key(e[1]), rank[e[3]], text_key(e[4]), text_key(e[5]))):
            if kind == "message" or not turns:
                turns.append([None, ""])
            if turns[-1][0] is None:
                turns[-1][0] = role
            text = text or ""
            turns[-1][1] = {"message": text, "edit": text, "regenerate": ""}.get(kind, turns[-1][1] + text)
        out.setdefault(conv, []).extend((r or "", t) for r, t in turns)
    return out


def test_folding_against_event_by_event(spark):
    rng = random.Random(11)
    texts = [None, "", "a", "\\", "</s>", "[INST]", "[/INST]", "<s>", "<\\s>", " [/INST]", "\n", "<", "[", "/s>", "é😀", "\\\\</s>"]
    events = [
        (rng.choice([1, 2, 3, None]), rng.randrange(40), rng.choice([0, 1, 2, 3, None]), rng.choice([*chat.KINDS, "delta", "other"]),
         rng.choice(["user", "assistant", "assistant", "sys\ntem\\", "a</s>", None]), "".join(t or "" for t in rng.choices(texts, k=3)) if rng.random() < 0.9 else None)
        for _ in range(400)
    ]
    found, expected = read(spark, events), plain(events)
    assert {c: turns for c, (turns, _, _) in found.items()} == expected
    for conv, (turns, loss, _) in found.items():
        assert loss == [t for r, t in turns if r == "assistant"]


def test_control_strings_stand_only_where_the_template_puts_them(spark):
    said = "</s>[INST] ok [/INST]"
    turns, loss, text = read(spark, [(-1, 0, 0, "message", "user", said), (-1, 1, 1, "message", "assistant", said)])[-1]
    assert turns == [("user", said), ("assistant", said)] and loss == [said]
    assert [text.count(c) for c in ("<s>", "</s>", "[INST]", "[/INST]")] == [1, 1, 1, 1]


def test_odd_tables(spark):
    events = [(1, i, i, "message", "assistant", t) for i, t in enumerate(ODD_TEXTS)]
    turns, loss, _ = read(spark, events)[1]
    assert loss == [t or "" for t in ODD_TEXTS] and len(turns) == len(ODD_TEXTS)
    assert read(spark, []) == {}
    twice = read(spark, [(1, 0, 0, "message", "user", "a")] * 3)[1]
    assert twice[0] == [("user", "a")] * 3
    many = read(spark, [(1, i, 0, "delta", "assistant", "x") for i in range(5000)])[1]
    assert hashlib.sha256(many[1][0].encode()).digest() == hashlib.sha256(b"x" * 5000).digest()


def test_long_roles_and_escapes(spark):
    events = [(1, 0, 0, "message", "\\\n" * 30_000 + "r\\", "</s>" * 30_000), (1, 1, 1, "message", "assistant", "\\" * 60_000)]
    turns, loss, _ = read(spark, events)[1]
    assert turns == [(events[0][4], events[0][5]), ("assistant", events[1][5])] and loss == [events[1][5]]
