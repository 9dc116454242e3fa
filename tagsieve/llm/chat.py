"""Chat formatting from event logs.

A conversation is stored as a log of events (conv_id, seq, msg, kind, role, text):

* ``message`` opens message number msg with a role and a text;
* ``delta`` appends its text (a streamed piece);
* ``edit`` replaces the text so far;
* ``regenerate`` throws the text so far away; pieces of the new answer follow.

``messages`` partitions the log by conversation and message, sorts by sequence and folds
each message to its final text. ``format_chats`` renders a conversation as one string and
says which spans of it carry loss (the assistant's texts); ``parse`` reads turns back.

The template: ``<s>[INST] role NEWLINE text [/INST]`` for a turn of any role but the assistant,
and `` text </s>`` for the assistant's. Control strings inside roles and texts are broken by a
backslash after their first character, and backslashes are doubled; dropping each backslash
and keeping what follows gives the text back. A line break in a role is escaped as well.

Defined cases: a null text is empty, a null role is the empty role; equal sequence numbers are
ordered by kind, role and text; pieces before a message's first ``message`` event open it;
a repeated ``message`` event is a message again, right after the first; other kinds are
ignored; a null conversation or message number is a value like any other; an empty log
gives no rows. Extra columns of the log are not used.

A conversation's text is one cell, so its size is bounded by the caller's data; all steps
up to the last work by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.llm.common import let

ASSISTANT = "assistant"
KINDS = ("message", "regenerate", "edit", "delta")
#: The control strings of the template, as a pattern for the place after their first character.
CONTROL = r"([<\[])(?=s>|/s>|INST\]|/INST\])"
#: One rendered turn: of another role, or the assistant's.
TURN = r"(?s)<s>\[INST\] .*? \[/INST\]| .*? </s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _fold(events: Column) -> Column:
    """(role, text) of the sorted events of one message."""
    resets = F.transform(events, lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0))
    return let(
        F.greatest(F.array_max(resets), F.lit(1)),
        lambda start: F.struct(
            F.coalesce(F.get(F.filter(events, lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(
                F.transform(
                    F.slice(events, start, F.size(events)),
                    lambda e: F.when(e["kind"] == "regenerate", "").otherwise(F.coalesce(e["text"], F.lit(""))),
                ),
                "",
            ).alias("text"),
        ),
    )


def _messages(events: Column) -> Column:
    """The messages in the sorted events of one number: one from each opening to the next."""
    opens = F.transform(events, lambda e, i: F.when((e["kind"] == "message") | (i == 0), i + 1))
    return let(
        F.filter(opens, lambda p: p.isNotNull()),
        lambda places: F.transform(
            places,
            lambda p, i: let(
                F.slice(events, p, F.coalesce(F.get(places, i + 1), F.size(events) + 1) - p), lambda part: _fold(part)
            ),
        ),
    )


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, msg, pos, role, text): every message in its final form; pos tells apart
    messages of one number."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    event = F.struct("seq", rank.alias("rank"), "kind", "role", "text")
    return (
        log.filter(F.col("kind").isin(*KINDS))
        .groupBy("conv_id", "msg")
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
        .select("conv_id", "msg", F.posexplode(_messages(F.col("events"))).alias("pos", "message"))
        .select("conv_id", "msg", "pos", "message.role", "message.text")
    )


def format_chats(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are (start, length) in characters, from 0,
    of the escaped assistant texts."""
    body = escaped(F.col("text"))
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    answer = F.col("role") == ASSISTANT
    turns = messages(log).select(
        "conv_id",
        "msg",
        "pos",
        answer.alias("answer"),
        F.length(body).alias("body_chars"),
        F.when(answer, F.concat(F.lit(" "), body, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<s>[INST] "), role, F.lit("\n"), body, F.lit(" [/INST]")))
        .alias("piece"),
    )
    ahead = Window.partitionBy("conv_id").orderBy("msg", "pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(ahead), F.lit(0)))
    piece = F.struct("msg", "pos", "piece")
    span = F.when(F.col("answer"), F.struct((F.col("at") + 1).alias("start"), F.col("body_chars").alias("length")))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""

    def turn(piece: Column) -> Column:
        other = let(
            F.substr(piece, F.lit(11), F.length(piece) - 18),
            lambda inner: F.struct(
                unescaped(F.regexp_extract(inner, r"(?s)^(.*?(?<!\\)(?:\\\\)*+)\n", 1)).alias("role"),
                unescaped(F.regexp_extract(inner, r"(?s)^.*?(?<!\\)(?:\\\\)*+\n(.*)$", 1)).alias("text"),
            ),
        )
        answer = F.struct(
            F.lit(ASSISTANT).alias("role"),
            unescaped(F.substr(piece, F.lit(2), F.length(piece) - 6)).alias("text"),
        )
        return F.when(piece.startswith("<s>"), other).otherwise(answer)

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), 0), turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(
        spans,
        lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
