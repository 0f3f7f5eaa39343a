"""Shingle sets of texts and fast similarity sketches of them, in numpy.

A sketch of t coordinates is filled in rounds.  In round i < t every element is
thrown into one of t bins by a hash of its own and competes there with the value
(i, hash); in round t + j all elements compete in bin j.  So every bin is full after
2t rounds at most, usually after a few, and the coordinates of two sets agree
with the probability of their Jaccard similarity, with concentration bounds like
those of t independent permutations.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import LOWER

_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Hashes of words that were met, MEMO at most; a task empties it when it ends.
_HASH_OF: dict[bytes, int] = {}
MEMO = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (in place on a fresh array)."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (split at ASCII white space, A-Z lower-cased)."""
    known = _HASH_OF
    if len(known) > MEMO:
        known.clear()
    words = (text or "").encode().translate(LOWER).split()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """A Python worker outlives its tasks; what they remembered need not."""
    _HASH_OF.clear()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of fewer words, the whole
    sequence; none of an empty text."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    width = min(n, k)
    out = mix(np.full(n - width + 1, width, np.uint64))
    for j in range(width):
        out = mix(out ^ h[j:n - width + 1 + j])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(sets, t) coordinates as uint32; an empty set has the row 0."""
    out = np.full(len(sets) * t, _EMPTY)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(flat):
            break
        h = mix(flat ^ mix(np.array([i + 1], np.uint64)))
        bins = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        full = (out.reshape(-1, t) != _EMPTY).all(1)
        some = ~full[owner]
        if not some.all():
            flat, owner = flat[some], owner[some]
    out = out.reshape(-1, t)
    out[(out == _EMPTY).all(1)] = 0
    return ((out ^ (out >> np.uint64(32)) * _GOLD) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """(sets, t // rows) signed 64-bit keys, the band's number mixed in."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, :bands * rows].reshape(len(sketch), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(sketch), bands))
    for j in range(rows):
        key = mix(key ^ parts[:, :, j])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common
