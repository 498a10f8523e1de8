"""Word-shingle sets of texts as 52-bit hashes, a whole batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: At most 2 ** TEXT_BITS texts are hashed at a time.
TEXT_BITS = 12
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that scatters its bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: What each word of a shingle adds to its hash by its place, so that order counts.
_ORDER = mixed(np.arange(1, 65, dtype=np.uint64) * _C)
#: A random number for each byte value at each of the first _PLACES places of a word; white space adds nothing.
_PLACES = 64
_LETTERS = mixed(np.arange(_PLACES * 256, dtype=np.uint64) * _A + np.uint64(1)).reshape(_PLACES, 256)
_LETTERS[:, 65:91] = _LETTERS[:, 97:123]
_LETTERS[:, [32, *range(9, 14)]] = 0
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run of bytes outside \\x20 and \\x09-\\x0D, A-Z as a-z) and the number of the text it is in."""
    white = _WHITE[data]
    ends_text = np.zeros(len(data) + 1, bool)
    ends_text[offsets] = True
    begin = ~white
    begin[1:] &= white[:-1] | ends_text[1 : len(data)]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    far = place >> 6
    term = _LETTERS.ravel()[((place & (_PLACES - 1)) << 8) + data[at[0] :]]
    if far.any():
        term = np.where(far > 0, term * (far.astype(np.uint64) * _B + _A | np.uint64(1)), term)
    hashes = mixed(np.add.reduceat(term, at - at[0]))
    return hashes, np.searchsorted(offsets, at, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the distinct sorted hashes[bounds[i]:bounds[i + 1]] of its k-word shingles.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    n = len(offsets) - 1
    if n > 1 << TEXT_BITS:
        raise ValueError(f"more than {1 << TEXT_BITS} texts at a time")
    words, owner = word_hashes(data, offsets)
    count = np.bincount(owner, minlength=n)
    rolled = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        w = words[j:]
        same = owner[j:] == owner[: len(owner) - j] if j else np.ones(len(words), bool)
        rolled[: len(w)] += np.where(same, mixed(w + _ORDER[j]), np.uint64(0))
    # a text's first shingle always counts, later ones only if they are full
    full = np.zeros(len(words), bool)
    if len(words) >= k:
        full[: len(words) - k + 1] = owner[k - 1 :] == owner[: len(owner) - k + 1]
    first = np.zeros(len(words), bool)
    if len(words):
        first[np.cumsum(count[count > 0]) - count[count > 0]] = True
    used = full | first
    # a text's number in the upper bits, so that one plain sort orders the texts' hashes
    keys = np.sort(mixed(rolled[used]) >> np.uint64(TEXT_BITS) | owner[used].astype(np.uint64) << np.uint64(64 - TEXT_BITS))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    of = (keys >> np.uint64(64 - TEXT_BITS)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    return keys & np.uint64((1 << (64 - TEXT_BITS)) - 1), bounds
