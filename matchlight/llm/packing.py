"""Harmonic packing of tokenised documents into fixed-length sequences.

Class k holds the pieces of at most ``capacity / k`` ids, and each of its bins takes
exactly k of them, one for each of k slots that add up to the capacity. A document's
whole capacities are bins of class 1. Its rest goes uncut into the class whose slot it
nearly fills (at most ``SLACK`` of the slot stays free) or if it is short; else it
fills one slot of the class below to the last id, and only the overhang, which is
less than half of it, is placed in the same way. Every task packs the documents of its
partition on its own: no shuffle, and a lost task is repeated alone. The bins that are
still open at the end of a partition hold one capacity per class at most; their
pieces are laid end to end and cut at every capacity, and the last ids at powers of
two, so they need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one partition are numbered from its index times this.
SEQUENCES_PER_PARTITION = 1 << 36
#: Share of a slot that an uncut piece may leave free, and ids below which a piece is never cut.
SLACK, SHORT = 1 / 48, 48
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 400_000
_SPACE_BEFORE_SPACE = re.compile(r"\s ")
_encoders: dict[tuple, Callable[[str], bytes]] = {}


def byte_encoder(ranks_path: str, pattern: str, special: dict[str, int]) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit integers.

    The ids are those of the byte-level tokenizer whose vocabulary ``ranks_path``
    lists. A single space after a visible character always begins a new
    pre-token, so a text is cut there and each cut's ids are kept by its text.
    Strings of ``special`` tokens get their own id, as the tokenizers library does.
    """
    name = (ranks_path, pattern, tuple(special.items()))
    if name in _encoders:
        return _encoders[name]
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cache: dict[str, bytes] = {}
    splitter = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def raw(text: str) -> bytes:
        return np.array(plain(text), "<u4").tobytes()

    def ordinary(text: str) -> bytes:
        if _SPACE_BEFORE_SPACE.search(text):
            return raw(text)
        head, *words = text.split(" ")
        out = [raw(head)] if head else []
        if words and not words[-1]:  # a space at the end
            return raw(text)
        for word in words:
            ids = cache.get(word)
            if ids is None:
                ids = raw(" " + word)
                if len(word) < 40:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(text: str) -> bytes:
        if splitter is None or not splitter.search(text):
            return ordinary(text)
        return b"".join(special[p].to_bytes(4, "little") if p in special else ordinary(p) for p in splitter.split(text) if p)

    _encoders[name] = encode
    return encode


Piece = tuple[int | None, int, bytes, int]  # doc_id, start, ids, ids of the document


class Bins:
    """The open bins of one partition."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[Piece]] = {}

    def _close(self, pieces: list[Piece]) -> list[tuple]:
        out, at = [], 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def slot(self, k: int) -> int:
        """Size of the next free slot in the open bin of class ``k``; the k slots add up to the capacity."""
        j = len(self.open.get(k, ()))
        return (j + 1) * self.capacity // k - j * self.capacity // k

    def _put(self, k: int, piece: Piece) -> list[tuple]:
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._close(self.open.pop(k)) if len(held) == k else []

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Rows of the bins that the document closes."""
        capacity, total, start, out = self.capacity, len(ids) // 4, 0, []
        while (rest := total - start) > 0:
            if rest >= capacity:
                k, length = 1, capacity
            else:
                k, length = capacity // rest, rest
                if rest >= SHORT and rest < (1 - SLACK) * (capacity // k):
                    k += 1
                    length = min(rest, self.slot(k))
            out += self._put(k, (doc_id, start, ids[4 * start : 4 * (start + length)], total))
            start += length
        return out

    def finish(self) -> list[tuple]:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        out: list[tuple] = []
        left, n = sum(len(p[2]) for p in rest) // 4, 0
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken: list[Piece] = []
            while room:
                doc_id, start, ids, total = rest[n]
                length = min(room, len(ids) // 4)
                taken.append((doc_id, start, ids[: 4 * length], total))
                rest[n] = (doc_id, start + length, ids[4 * length :], total)
                room -= length
                n += length == len(ids) // 4
            out += self._close(taken)
        return out


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """A row for each piece of each row of ``docs(doc_id, text)``, as ``SCHEMA``.

    A null or empty text is the closing id alone; a repeated or null ``doc_id`` is
    packed like any other row; an empty table gives no rows; a text of any length is
    one run of ids. ``capacity`` must be a power of two. Other columns are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_encoder(ranks_path, pattern, special)
        bins = Bins(capacity, TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION)
        end = end_id.to_bytes(4, "little")
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({c: "int64" for c in names[1:]} | {"doc_id": "Int64"})

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows += bins.add(None if pd.isna(doc_id) else int(doc_id), (encode(text) if text else b"") + end)
            yield frame(rows)
        yield frame(bins.finish())

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
