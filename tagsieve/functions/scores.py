"""Expressions over score vectors: one array of doubles per chunk, in label order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions.text import round4


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def probabilities(logits: Column) -> Column:
    """Independent probability per tag."""
    return F.transform(logits, sigmoid)


def decode(
    probs: Column,
    tags: list[str],
    threshold: float = config.CLASSIFICATION_THRESHOLD,
    review_below: float = config.REVIEW_THRESHOLD,
) -> list[Column]:
    """Prediction columns: tags in label order (null if none), confidence, tag
    count and the review flag, which looks at the unrounded confidence."""
    names = F.array(*[F.lit(tag) for tag in tags])
    chosen = F.filter(names, lambda _, i: F.get(probs, i) >= threshold)
    top = F.array_max(probs)
    joined = F.array_join(chosen, config.TAG_SEPARATOR)
    count = F.size(F.filter(probs, lambda p: p >= threshold))
    return [
        F.when(count > 0, joined).alias("tags_preditas"),
        round4(top).alias("confianca"),
        count.alias("numero_tags"),
        (top < review_below).alias("revisar"),
    ]


def probability_names(tags: list[str]) -> list[str]:
    """Column names ``prob_<tag>`` with unusual characters as dots.

    Two tags that would share a name are an error: one would hide the other.
    Column names ignore letter case.
    """
    names = ["prob_" + re.sub(r"[^0-9a-zA-Z_]", ".", tag) for tag in tags]
    if len({name.lower() for name in names}) != len(names):
        raise ValueError("two tags give the same probability column name")
    return names


def wide(probs: Column, tags: list[str]) -> list[Column]:
    """One rounded probability column per tag."""
    return [round4(F.get(probs, F.lit(i))).alias(name) for i, name in enumerate(probability_names(tags))]
