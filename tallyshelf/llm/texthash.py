"""64-bit hashes of words and word shingles, vectorised over one document.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR in the
UTF-8 text, after A-Z are lower-cased.  A word's hash is a polynomial over
random 64-bit letter values, taken from prefix sums; shingles mix the hashes of
their words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = [np.uint64(x) for x in _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are hashed in segments of about this many bytes, cut between words.
SEGMENT = 1 << 18
_POWERS = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 4096)
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if size > 8 * SEGMENT:  # one giant word: don't keep its tables
            return made[0], made[1]
        _POWERS = (made[0], made[1])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; works in place on a fresh array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment_words(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~_SPACE[a]
    edges = np.flatnonzero(np.diff(word))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LETTER[a] * power[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """The hashes of all words of UTF-8 ``data`` in order; A-Z must be
    lower-cased before if that is wanted."""
    if len(data) <= SEGMENT:
        return _segment_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_segment_words(data[at:end]))
        at = end
    return np.concatenate(out)


def ordered_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in order; with fewer words, the whole
    sequence as one; without words, none."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, np.uint64(size) if size < k else np.uint64(0))
    for i in range(size):
        out += words[i : n - size + 1 + i] * _PLACE[i]
    return mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text (null: none)."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(ordered_shingles(word_hashes(text.encode("utf-8", "surrogatepass").lower()), k))
