"""Word shingles as 64-bit hashes, computed with numpy on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        steps = np.full(size, U(base))
        steps[0] = U(1)
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(raw):
        return np.empty(0, U)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    if not len(edge):
        return np.empty(0, U)
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)), dtype=np.uint64)))
    down = _power("down", _INV, len(raw) + 1)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; one for a shorter text; none without words."""
    w = word_hashes(text) if text else np.empty(0, U)
    if not len(w):
        return w
    k = min(n, len(w))
    out = mix(w[: len(w) - k + 1] + U(k))
    for i in range(1, k):
        out = mix(out * U(3) + w[i : len(w) - k + 1 + i])
    return np.unique(out)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed longs."""
    a, b = np.sum(mix(s ^ U(0xA5A5A5A55A5A5A5A)), dtype=np.uint64), np.sum(mix(s + U(0x1234567890ABCDEF)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
