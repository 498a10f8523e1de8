"""Words of texts as bytes, with A-Z lower-cased, in stretches of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STRETCH = 1 << 20
#: bytes.translate() table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_class(kept: str) -> np.ndarray:
    """Which byte values are in words, from ranges like "0-9a-z"; every byte of a character beyond ASCII is."""
    inside = np.zeros(256, bool)
    for low, high in zip(kept[::3], kept[2::3], strict=True):
        inside[ord(low) : ord(high) + 1] = True
    inside[128:] = True
    return inside


def stretches(text: bytes, inside: np.ndarray, size: int = STRETCH) -> Iterator[bytes]:
    """The text cut into stretches of about `size` bytes, each behind a byte that is in no word; a longer word makes a longer one."""
    start, n = 0, len(text)
    while n - start > size:
        end = start + size
        while end < n:
            outside = np.flatnonzero(~inside[np.frombuffer(text, np.uint8, min(size, n - end), end)])
            if len(outside):
                end += int(outside[0]) + 1
                break
            end = min(n, end + size)
        yield text[start:end]
        start = end
    yield text[start:]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word of texts that lie one behind the other."""
    n = len(data)
    within = inside[data]
    begin, last = within.copy(), within.copy()
    begin[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = within[edges]
    last[edges - 1] = within[edges - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1
