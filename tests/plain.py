"""Plain-Python statements of the semantics, written for the tests only."""

from __future__ import annotations

import math
import re
from collections import Counter


def cut(report: str, limit: int = 1200, least: int = 40) -> list[str]:
    out = []
    for block in re.split(r"\n\s*\n+", report):
        block = block.strip()
        if len(block) <= limit:
            out.append(block)
            continue
        held: list[str] = []
        for sentence in re.split(r"(?<=[.!?])\s+", block):
            if held and len(" ".join([*held, sentence])) > limit:
                out.append(" ".join(held))
                held = []
            held.append(sentence)
        out.append(" ".join(held))
    return [piece for piece in out if len(piece) >= least]


def words(chunk: str) -> list[str]:
    return re.findall(r"\w{3,}", chunk.lower())


def best_matches(chunks: list[str], quotations: list[str]) -> list[tuple[float, int]]:
    """(cosine, position of the quotation) per chunk, weights fitted on all texts together."""
    bags = [Counter(words(t)) for t in [*quotations, *chunks]]
    df = Counter(term for bag in bags for term in bag)

    def vector(bag):
        raw = {t: c * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, c in bag.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / size for t, v in raw.items()} if size else {}

    vectors = [vector(bag) for bag in bags]
    out = []
    for chunk in vectors[len(quotations) :]:
        sims = [
            round(sum(v * quotation.get(t, 0.0) for t, v in chunk.items()), 12)
            for quotation in vectors[: len(quotations)]
        ]
        top = max(sims)
        out.append((top, sims.index(top)))
    return out


def walk(rows: list[tuple[str, list[str]]], target: int, min_train: int) -> set[str]:
    """Ids moved to the test set when rows are taken in the given order."""
    left = Counter(tag for _, tags in rows for tag in tags)
    moved: set[str] = set()
    for row_id, tags in rows:
        if len(moved) == target:
            break
        if all(left[tag] > min_train for tag in tags):
            moved.add(row_id)
            left.subtract(tags)
    return moved
