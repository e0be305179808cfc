"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its states are the start and one state after each token
that does not end a word. At first every symbol may follow every state. Each merge
(u, v) -> uv is put in as a gadget, in the order of the merges: from the state after u
the arc v is taken away; the new token uv gets an arc wherever u has one; and the state
after uv is a copy of the state after v as it was before the gadget. When all merges
are in, exactly one path from the start spells a given word: its encoding.

``compile_tables`` does this on a bit matrix of states by tokens (two seconds for
49,000 merges), then merges equal states and equal token columns, which leaves a
transition table of some 20 MB whatever the data. The driver compiles it once and
broadcasts it. Tasks encode the distinct words of each batch in step: all positions
walk the tokens' prefix tree at once, which lists the arcs that the letters allow, and
the transition table picks the one arc into each place that the state before it has.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shingles import U, mix

#: Distinct pieces of text between spaces whose ids a worker keeps.
CACHE_PIECES = 300_000
#: Distance of the symbols that end a word from those within one.
END = 256
_compiled: dict[str, Tables] = {}


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


@dataclass
class Tables:
    """The compiled automaton: all that tasks need."""

    ids: np.ndarray  # vocabulary id of each token
    labels: list[bytes]  # label of each vocabulary id, with a space after it
    state: np.ndarray  # class of the state after each token
    column: np.ndarray  # class of each token's arcs
    allowed: np.ndarray  # bits: state class by column class
    start: int  # class of the start
    slots: np.ndarray  # prefix tree as a hash table: node * 512 + symbol
    child: np.ndarray
    token: np.ndarray  # token that ends at each node, or -1
    special: dict[str, int]


def _hashes(bits: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each column of a matrix of 64-bit words."""
    salt = np.arange(1, len(bits) + 1, dtype=np.uint64)[:, None] * U(0x9E3779B97F4A7C15)
    return np.stack([mix(bits ^ mix(salt + U(k))).sum(0, dtype=np.uint64) for k in (1, 2)])


def _classes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, kind = np.unique(hashes, axis=1, return_index=True, return_inverse=True)
    return first, kind.ravel()


def compile_tables(path: str) -> Tables:
    """Reads a tokenizers file and puts its merges in one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab: dict[str, int] = model["vocab"]
    suffix: str = model.get("end_of_word_suffix") or ""
    if not suffix:
        raise ValueError("the automaton is built for vocabularies with word ends")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    byte_of = {c: b for b, c in byte_symbols().items()}
    spelt: list[tuple[int, ...]] = []
    number: dict[str, int] = {}
    for text in vocab:
        if len(text) == 1 and text in byte_of or len(text) == 1 + len(suffix) and text.endswith(suffix) and text[0] in byte_of:
            number[text] = len(spelt)
            spelt.append((byte_of[text[0]] + (END if len(text) > 1 else 0),))
    symbols = len(spelt)
    after: dict[int, int] = {t: 1 + k for k, t in enumerate(t for t in range(symbols) if spelt[t][0] < END)}
    states = 1 + len(after) + sum(not right.endswith(suffix) or right == suffix for _, right in merges)
    arcs = np.zeros(((states + 63) // 64, symbols + len(merges)), np.uint64)
    for s in range(1 + len(after)):
        arcs[s >> 6, :symbols] |= U(1 << (s & 63))
    for left, right in merges:
        u, v, new = number[left], number[right], len(spelt)
        if left + right in number:
            raise ValueError(f"two merges make {left + right!r}")
        number[left + right] = new
        spelt.append(spelt[u] + spelt[v])
        if u not in after:
            continue
        row, bit = after[u] >> 6, U(1 << (after[u] & 63))
        stood = bool(arcs[row, v] & bit)
        if v in after:
            after[new] = 1 + len(after)
            if stood:
                copied = (arcs[after[v] >> 6, :new] >> U(after[v] & 63)) & U(1)
                arcs[after[new] >> 6, :new] |= copied << U(after[new] & 63)
        if stood:
            arcs[row, v] &= ~bit
            arcs[:, new] = arcs[:, u]
    columns, column = _classes(_hashes(arcs))
    kept = arcs[:, columns]
    if not all(np.array_equal(row[column], whole) for row, whole in zip(kept, arcs, strict=True)):
        raise RuntimeError("columns of different arcs fell together")
    del arcs
    weights = mix(np.arange(1, 1 + 2 * kept.shape[1], dtype=np.uint64)).reshape(2, -1)
    by_bit = np.stack([weights @ ((kept >> U(b)) & U(1)).T for b in range(64)], 2)
    rows, kind = _classes(by_bit.reshape(2, -1)[:, : 1 + len(after)])
    bits = (((kept[rows[k : k + 256] >> 6] >> (rows[k : k + 256] & 63).astype(np.uint64)[:, None]) & U(1)).astype(bool) for k in range(0, len(rows), 256))
    allowed = np.concatenate([np.packbits(b, axis=1, bitorder="little") for b in bits])
    state = np.zeros(len(spelt), np.int32)
    for token, s in after.items():
        state[token] = kind[s]
    edges: dict[int, int] = {}
    ends = {}
    for token, letters in enumerate(spelt):
        node = 0
        for c in letters:
            node = edges.setdefault(node * 512 + c, len(edges) + 1)
        ends[node] = token
    size = 1 << (4 * len(edges)).bit_length()
    slots, child = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for key, node in edges.items():
        at = _slot(key, size)
        while slots[at] >= 0:
            at = (at + 1) % size
        slots[at], child[at] = key, node
    token_at = np.full(len(edges) + 1, -1, np.int32)
    for node, token in ends.items():
        token_at[node] = token
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    labels = [names.get(i, "").encode() + b" " for i in range(1 + max(names))]
    ids = np.zeros(len(spelt), "<u4")
    for text, token in number.items():
        ids[token] = vocab[text]
    return Tables(ids, labels, state, column.astype(np.int32), allowed, int(kind[0]), slots, child, token_at, special)


def _slot(key, size: int):
    return (key * 0x9E3779B1 >> 13) % size


def tables(path: str) -> Tables:
    if path not in _compiled:
        _compiled[path] = compile_tables(path)
    return _compiled[path]


class Encoder:
    """Encodes pre-split words and whole texts by the tables."""

    def __init__(self, t: Tables):
        import regex

        self.t = t
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|[ ]")
        self._special = re.compile("(" + "|".join(map(re.escape, t.special)) + ")") if t.special else None
        self._known: dict[str, int] = {}
        self._ids: list[bytes] = []
        self._texts: list[bytes] = []

    def _arcs(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and token of every token that the letters spell anywhere."""
        t, size = self.t, len(self.t.slots)
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        found = []
        depth = 0
        while len(at):
            key = node * 512 + letters[at + depth]
            slot = _slot(key, size)
            seen = t.slots[slot]
            while len(other := np.flatnonzero((seen != key) & (seen >= 0))):
                slot[other] = (slot[other] + 1) % size
                seen[other] = t.slots[slot[other]]
            on = seen == key
            at, node = at[on], t.child[slot[on]].astype(np.int64)
            depth += 1
            token = t.token[node]
            made = token >= 0
            found.append((at[made], at[made] + depth, token[made]))
            inside = at + depth < len(letters)
            at, node = at[inside], node[inside]
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each word has; no word may be empty or hold white space."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        t = self.t
        raw = np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        gap = raw == 10
        letters = raw[~gap].astype(np.int64)
        ends = np.append(np.flatnonzero(gap) - np.arange(gap.sum()), len(letters))
        starts = np.concatenate(([0], ends[:-1]))
        letters[ends - 1] += END
        start, end, token = self._arcs(letters)
        place = start - np.repeat(starts, ends - starts)[start]
        longest = int((ends - starts).max())
        order = np.argsort(place.astype(np.uint16) if longest < 1 << 16 else place, kind="stable")  # short keys are sorted by radix
        start, end, token = start[order], end[order], token[order]
        column = t.column[token]
        # the token that ends at each place within its word, and where it begins; the start of a word has none
        last, back = np.full(len(letters) + 1, -1, np.int64), np.zeros(len(letters) + 1, np.int64)
        state = np.full(len(letters) + 1, -1, np.int64)
        bounds = np.append(np.searchsorted(place[order], np.arange(longest)), len(start))
        for k in range(len(bounds) - 1):
            e = slice(bounds[k], bounds[k + 1])
            before = state[start[e]] if k else np.full(bounds[1] - bounds[0], t.start)
            may = (before >= 0) & ((t.allowed[before, column[e] >> 3] >> (column[e] & 7)) & 1 == 1)
            to, by = end[e][may], token[e][may]
            # places after a word's last letter belong to the next word's start, so they are kept apart by the end symbols
            inner = letters[to - 1] < END
            state[to[inner]] = t.state[by[inner]]
            last[to - 1], back[to - 1] = by, start[e][may]
        begins = np.zeros(len(letters), bool)
        begins[starts] = True
        path = np.zeros(len(letters), bool)
        at = ends - 1
        while len(at):
            if (last[at] < 0).any():
                raise ValueError("no path spells a word")
            path[at] = True
            first = back[at]
            at = first[~begins[first]] - 1
        return last[:-1][path], np.add.reduceat(path.astype(np.int64), starts)

    def _fresh(self, pieces: list[str]) -> None:
        """Encodes pieces (texts without spaces) that are not known yet."""
        plain = pieces
        if self._special is not None and self._special.search(" ".join(pieces)):
            plain = [p for p in pieces if not self._special.search(p)]
            for piece in pieces:
                parts = self._special.split(piece)
                if len(parts) > 1:
                    self._add([p for p in parts if p and p not in self.t.special and p not in self._known])
                    ids, texts = [], []
                    for p in filter(None, parts):
                        if p in self.t.special:
                            ids.append(self.t.special[p].to_bytes(4, "little"))
                            texts.append(p.encode() + b" ")
                        else:
                            ids.append(self._ids[self._known[p]])
                            texts.append(self._texts[self._known[p]])
                    self._known[piece] = len(self._ids)
                    self._ids.append(b"".join(ids))
                    self._texts.append(b"".join(texts))
        self._add(plain)

    def _add(self, pieces: list[str]) -> None:
        pieces = list(dict.fromkeys(pieces))
        if not pieces:
            return
        text = unicodedata.normalize("NFC", " ".join(pieces))
        # letter by letter: only the capital sigma depends on its place in the whole-text form
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        found = self._split.findall(text)
        gap = np.array([w == " " for w in found], bool)
        tokens, counts = self.words([w for w in found if w != " "])
        of_piece = np.cumsum(gap)[~gap] if len(found) else np.empty(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(of_piece, weights=counts, minlength=len(pieces)).astype(np.int64)))).tolist()
        ids = self.t.ids[tokens]
        labels = [self.t.labels[i] for i in ids.tolist()]
        raw, spans = ids.tobytes(), list(zip(bounds, bounds[1:], strict=False))
        self._known.update(zip(pieces, range(len(self._ids), len(self._ids) + len(pieces)), strict=True))
        self._ids += [raw[4 * a : 4 * b] for a, b in spans]
        self._texts += [b"".join(labels[a:b]) for a, b in spans]

    def texts(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded text in UTF-8 of each text; a null is an empty one."""
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._known) > CACHE_PIECES:
            self._known, self._ids, self._texts = {}, [], []
        known = self._known
        self._fresh([p for p in pieces if p not in known])
        at = [known[p] for p in pieces]
        ids, labels = list(map(self._ids.__getitem__, at)), list(map(self._texts.__getitem__, at))
        for p, k in zip(pieces, at, strict=True):
            if len(p) >= 60:  # a long piece is not kept
                del known[p]
                self._ids[k] = self._texts[k] = b""
        index, bounds = coded.indices.to_numpy().tolist(), split.offsets.to_numpy().tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = index[a:b]
            yield b"".join(map(ids.__getitem__, part)), b"".join(map(labels.__getitem__, part))[:-1]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` for each row of ``docs(doc_id, text)``; a null text is empty.

    Empty and blank texts have no ids and decode to the empty text; strings of the
    file's special tokens get their ids; repeated and null ids are rows like others;
    a text of any length is one row. Other columns are ignored.
    """
    return _mapped(docs, path, "ids binary, decoded string", lambda ids, text: (ids, text.decode()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ``encode_decode`` as digests, made where the ids are."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, schema, lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))


def _mapped(docs: DataFrame, path: str, schema: str, row: Callable[[bytes, bytes], tuple]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            made = [row(*x) for x in encoder.texts(batch.column("text"))]
            data = [pa.array([m[k] for m in made], kinds[kind]) for k, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *data], ["doc_id", *(name for name, _ in columns)])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def decode_ids(ids: bytes, path: str) -> str:
    """Labels of the arcs of ``ids``, joined by single spaces as the file has no decoder."""
    labels = tables(path).labels
    return b"".join(labels[int(i)] for i in np.frombuffer(ids, "<u4"))[:-1].decode()
