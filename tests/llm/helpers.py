"""Plain restatements used by several tests."""

from __future__ import annotations

import re


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def benchmark_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


#: Texts that every operator has to take.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "é", "word " * 30_000, "x" * 100_000, "same text here", "same text here", "\u0000 \u0000"]
