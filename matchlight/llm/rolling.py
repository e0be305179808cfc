"""Polynomial fingerprints in numpy: prefix sums modulo 2^64, from which any stretch is read in two look-ups.

The base is odd, so it has an inverse and a stretch's fingerprint does not depend on its
place. Equal stretches have equal fingerprints; different ones are told apart by
``mixed`` fingerprints but for chance, and callers compare text where that matters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The odd base and the multipliers of the final mixing.
BASE, MIX = 0x9E3779B97F4A7C15, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Longest array that prefix sums are taken over.
LONGEST = 1 << 22


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse."""

    def of(base: int) -> np.ndarray:
        steps = np.full(LONGEST + 1, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A fixed random odd number for each byte."""
    return np.random.default_rng(12).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def prefixes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values`` (64-bit, at most ``LONGEST``) times powers of the base."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers()[0][: len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed fingerprints of the stretches from ``start`` to before ``end``."""
    return (sums[end] - sums[start]) * powers()[1][start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits, so that all bits depend on all."""
    for k in MIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(k)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls are empty) and the offsets of its values."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``values`` in order, and how many there are of each (or the sum of their weights)."""
    order = np.argsort(values) if weights is not None else None
    values = np.sort(values) if order is None else values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    if order is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]
