"""Cutting texts where a byte-level BPE always cuts them, so that each distinct piece is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: The pattern that splits a text before the merges (a fixed value of the byte-level vocabularies), with white space as Unicode has it.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_LOOSE_SPACE = re.compile(rf" (?:[{_WHITE}]|$)")
_BEFORE_WORD = re.compile(rf" (?=[^{_WHITE}])")


def chunks(text: str) -> list[str]:
    """The text without the space before each later chunk, cut at each space that a word follows.

    Such a space always begins a pre-token, so chunks are encoded apart: the first as it is, each later one with a space in front.
    """
    return _BEFORE_WORD.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")


def stretches(text: str, limit: int = 100_000) -> list[str]:
    """The text in stretches of about `limit` characters that are encoded apart; one longer only where no space before a word is."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = _BEFORE_WORD.search(text, start + limit)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


class Known:
    """What is known of chunks seen so far; held to a bounded number of them."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def look(self, texts: list[list[str]]) -> tuple[dict, dict]:
        """The values of all first and all later chunks of some texts."""
        if len(self.later) > self.limit:
            self.later = {}
        if len(self.first) > self.limit:
            self.first = {}
        missing = {c for t in texts for c in t[1:]}.difference(self.later)
        order = sorted(missing)
        self.later.update(zip(order, self.compute([" " + c for c in order]), strict=True))
        missing = {t[0] for t in texts}.difference(self.first)
        order = sorted(missing)
        self.first.update(zip(order, self.compute(order), strict=True))
        return self.first, self.later
