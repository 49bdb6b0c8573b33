"""Sets of hashed word n-grams of whole texts, a batch at a time.

Words are runs of bytes other than ASCII white space. A word's hash is the sum
of a random number for each (place, byte), an n-gram's a random combination of
its words' hashes; both are 64 bits wide and mixed.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240611)
_PLACES = 64
_TABLE = _RANDOM.integers(0, 1 << 63, (_PLACES, 256), dtype=np.uint64) * np.uint64(2) + _RANDOM.integers(0, 2, (_PLACES, 256), dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR, _SHORT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time; a longer text is one piece.
_PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of each word."""
    at = np.flatnonzero(~_SPACE[buffer])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    values = _TABLE.ravel().take((place & (_PLACES - 1)) * 256 + buffer[at])
    if place.max() >= _PLACES:
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()) // _PLACES, _FAR)]).astype(np.uint64), dtype=np.uint64)
        values *= powers[place // _PLACES]
    return mixed(np.add.reduceat(values, starts)), at[starts]


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text its distinct n-grams' hashes, ascending.

    A text of fewer words has one for the whole sequence; one without words none.
    """
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < _PIECE):
            size += len(texts[last]) + 1
            last += 1
        out += _piece(texts[first:last], n)
        first = last
    return out


def _piece(texts: list[bytes], n: int) -> list[np.ndarray]:
    begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    words, at = _words(np.frombuffer(b" ".join(texts), np.uint8))
    bounds = np.append(np.searchsorted(at, begins), len(at))
    grams = np.zeros(0, np.uint64)
    if len(words) >= n:
        m = len(words) - n + 1
        grams = words[:m] * _FACTORS[0]
        for k in range(1, n):
            grams += words[k : k + m] * _FACTORS[k]
        grams = mixed(grams)
    out = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        count = end - start
        if count >= n:
            out.append(np.unique(grams[start : end - n + 1]))
        elif count:
            whole = (words[start:end] * _FACTORS[:count]).sum(dtype=np.uint64, keepdims=True) + np.array([count], np.uint64) * _SHORT
            out.append(mixed(whole))
        else:
            out.append(grams[:0])
    return out
