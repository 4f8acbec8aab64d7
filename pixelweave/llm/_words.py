"""Words and their hashes. A word is a run of anything but space and U+0009 to U+000D; letters A to Z are lowered."""

from __future__ import annotations

import numpy as np
import xxhash

from ._shared import begin

#: A worker forgets its words beyond so many; speed only.
CACHE = 250_000
_HASH: dict[bytes, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Which bytes are of words; the lowest bytes of a number, by how many; longer words are hashed alone.
_INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256


def begin_words() -> None:
    begin("words", _HASH.clear)


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = _HASH
    if len(known) > CACHE:
        known.clear()
    for w in {*ws}.difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of `size` words, in order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * _MIX + h[k : k + n])
    return out


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words than `size`, the whole sequence is one."""
    h = word_hashes(words(text))
    return np.unique(windows(h, min(size, len(h)))) if len(h) else np.zeros(0, np.uint64)


def row_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, read eight bytes at a time, and where each text's words begin there, and the last one's end. Not the hashes of word_hashes()."""
    raw = b" ".join((b"", *texts, b" " * 8)).lower()
    inside = _INSIDE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = mix((eights[start] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _MIX)
    at, left = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(left):
        out[left] = mix(out[left] * _MIX + (eights[start[left] + at] & _LOW[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return out, np.searchsorted(start, begin)
