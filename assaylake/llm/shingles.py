"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text hashed at once; a longer word makes a longer piece.
PIECE = 1 << 20
_U = np.uint64


@lru_cache(maxsize=1)
def _constants():
    rng = np.random.default_rng(20240117)
    letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = int(rng.integers(0, 1 << 62)) * 2 + 1
    factors = rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return letters, base, factors, space


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _constants()[1]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``: a polynomial in the letters, then mixed with the length."""
    letters, _, _, space = _constants()
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~space[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    size = 1 << max(16, len(raw).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        cut = at + PIECE
        while cut < len(data) and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield at, data[at:cut]
        at = cut


def sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Per text its set of shingles of ``words`` words, A-Z lower-cased, as sorted hashes.

    A text of fewer words has all of them as one shingle; one without words, or null, has the empty set.
    """
    encoded = [(t or "").encode().lower() for t in texts]
    bounds = np.cumsum([0, *[len(t) + 1 for t in encoded]])
    hashes, starts = [], []
    data = b"\n".join(encoded)
    for at, piece in _pieces(data):
        h, s = _word_hashes(piece)
        hashes.append(h)
        starts.append(s + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner_at = np.searchsorted(np.concatenate(starts) if starts else np.zeros(0, np.int64), bounds)
    factors = _constants()[2]
    n = len(h) - words + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        if n > 0:
            grams += h[j:j + n] * factors[j]
    grams = mix(grams)
    out = []
    for a, b in zip(owner_at[:-1].tolist(), owner_at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            part = h[a:b] * factors[words:words + b - a]
            out.append(mix(part.sum(keepdims=True, dtype=np.uint64) + _U(b - a)))
        else:
            out.append(h[:0])
    return out


def slices(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together."""
    first = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)
