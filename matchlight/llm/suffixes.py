"""Removal of long strings that occur twice, by suffix arrays of shards.

A string of ``WIDTH`` bytes has an anchor: the k-gram in it with the least fingerprint.
Equal strings have equal anchors, so a string whose anchor occurs once in all documents
occurs once. ``segments`` finds, for each anchor, the stretch of text whose strings
have it. Of anchors that occur again, equal stretches are one by digest; different
ones are dealt by anchor to shards. A shard's text is concatenated and its suffix array
made by Larsson-Sadakane refinement (groups of equal prefixes, doubled in length while
any are left), with common prefixes of neighbours by Kasai's walk: strings in a run of
neighbours with ``WIDTH`` bytes in common occur again. The stretches of an anchor
with many different ones lie in several shards, which are merged by the strings that
their arrays tell apart: digests of strings that share their middle, ``CORE`` bytes in
steps of ``STEP`` about the anchor, are compared where the middle occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut
from .rolling import mixed, prefixes, byte_values, stretch, utf8

#: Bytes of the strings, and of the k-grams that anchor them.
WIDTH, GRAM = 200, 32
#: Bytes of text whose anchors are found at once; positions take ``PLACE`` bits beside the fingerprint.
PIECE, PLACE = 1 << 20, 21
#: Different stretches of an anchor in one shard, and bytes of a shard's text.
STRETCHES, SHARD = 1024, 1 << 21
#: Places of strings about their anchor that are compared together, and the bytes that all of those have.
STEP = 16
CORE = WIDTH - STEP + 1


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of concatenated texts: ``(text, start, strings, lead, anchor, digest)`` of the stretches, a piece of text at a time.

    A stretch has ``strings`` strings, at ``start`` and the next places, so it is
    ``strings + WIDTH - 1`` bytes long; its anchor lies ``lead`` bytes on.
    """
    sizes = np.diff(offsets)
    pieces, held = [], 0  # (text, from, to): strings start from..to-1
    for text in np.flatnonzero(sizes >= WIDTH):
        for at in range(0, int(sizes[text]) - WIDTH + 1, PIECE):
            upto = min(at + PIECE, int(sizes[text]) - WIDTH + 1)
            if held + upto - at + WIDTH > PIECE + WIDTH and pieces:
                yield _anchored(data, offsets, pieces)
                pieces, held = [], 0
            pieces.append((text, at, upto))
            held += upto - at + WIDTH
    if pieces:
        yield _anchored(data, offsets, pieces)


def _anchored(data: np.ndarray, offsets: np.ndarray, pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    joined = np.concatenate([data[offsets[t] + a : offsets[t] + b + WIDTH - 1] for t, a, b in pieces])
    sums = prefixes(byte_values()[joined])
    grams = np.arange(len(joined) - GRAM + 1)
    prints = mixed(stretch(sums, grams, grams + GRAM))
    low = np.uint64((1 << PLACE) - 1)
    least = window_minimum((prints & ~low) | grams.astype(np.uint64), WIDTH - GRAM + 1)
    text, first, upto = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    sizes = upto - first + WIDTH - 1
    begins = np.cumsum(sizes) - sizes
    at = np.repeat(begins - np.cumsum(upto - first) + upto - first, upto - first) + np.arange(int((upto - first).sum()))
    anchor = (least[at] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    start, n, p = at[new], np.diff(np.append(new, len(at))), anchor[new]
    shape = ((p - start) * (2 * WIDTH) + n).astype(np.uint64)
    digest = mixed(stretch(sums, start, start + n + WIDTH - 1) ^ mixed(shape))
    piece = np.searchsorted(begins, start, "right") - 1
    return text[piece], start - begins[piece] + first[piece], n, p - start, prints[p], digest


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number whose order is theirs; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` in the order of what follows, by Larsson-Sadakane refinement.

    A place's rank is the slot of its group's first member. Each round sorts within
    groups by the rank of the place a sorted length further on, so sorted lengths
    double; groups of one are left alone. Zeros follow the end.
    """
    n = len(text)
    keys = words(text)
    order = np.argsort(keys)
    slots, sorted_keys, done = np.arange(n), keys[order], 8
    rank = np.zeros(n, np.int64)
    while True:
        new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
        heads = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = heads
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if done >= n or not len(slots):
            return order
        places = order[slots]
        ahead = places + done
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = rank[places] * (n + 1) + then
        sort = np.argsort(keys)
        order[slots], sorted_keys = places[sort], keys[sort]
        done *= 2


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """Leading bytes that are zero in each word."""
    return sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8)) + (x == 0)


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Of each place, the length it shares with the place before it in ``order``, at most ``most``.

    Kasai's walk: the length at a place is at least that at the place before it in the
    text, less one. The stretches from ``begins`` walk side by side, each from nothing.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    keys = np.concatenate((words(text), np.zeros(most + 8, np.uint64)))
    out = np.zeros(n, np.int64)
    sizes = np.diff(np.append(begins, n))
    lanes = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[lanes], sizes[lanes]
    held = np.zeros(len(begins), np.int64)
    alive = len(begins)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[alive - 1] <= step:
            alive -= 1
        place = begins[:alive] + step
        other = before[place]
        length = np.where(other >= 0, np.maximum(held[:alive] - 1, 0), 0)
        going = np.flatnonzero(other >= 0)
        while len(going):
            got = _same_bytes(keys[place[going] + length[going]] ^ keys[other[going] + length[going]])
            length[going] += got
            going = going[(got == 8) & (length[going] < most)]
        held[:alive] = np.minimum(length, most)
        out[place] = held[:alive]
    return out


def shard_classes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of all ``texts``: text, start in it, and class; strings are equal where their classes are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    shared = common_prefixes(text, order, begins)
    kind = np.zeros(len(text), np.int64)
    kind[order] = np.cumsum(shared[order] < WIDTH)
    strings = sizes - WIDTH + 1
    owner = np.repeat(np.arange(len(texts)), strings)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    return owner, start, kind[begins[owner] + start]


def _runs(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last of each run of next places."""
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)))) if len(text) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(text)) - 1 if len(text) else new
    return text[new], start[new], start[last]


FOUND = "file long, row long, first long, last long, anchor long, core long, starts array<long>, prints array<long>"


def _shard(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs of strings that are seen here to occur again; then, of anchors in several shards, the strings told apart, by core.

    ``starts`` are -1 for strings that need no finding, being copied or seen to occur again.
    """
    owner, start, kind = shard_classes([r["stretch"] for r in rows])
    file, row, at, lead, anchor, copies, shards = (np.array([r[c] for r in rows], np.int64) for c in ("file", "row", "at", "lead", "anchor", "copies", "shards"))
    size = np.bincount(kind)
    again = (copies == 1)[owner] & (size[kind] > 1)
    text, first, last = _runs(owner[again], start[again])
    none = pa.nulls(len(text), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (file[text], row[text], at[text] + first, at[text] + last, anchor[text])] + [pa.nulls(len(text), pa.int64()), none, none], schema=schema)

    spread = np.flatnonzero((shards > 1)[owner])
    if not len(spread):
        return
    _, one = np.unique(kind[spread], return_index=True)
    one = np.sort(spread[one])
    sizes = np.array([len(r["stretch"]) for r in rows], np.int64)
    begins = np.cumsum(sizes) - sizes
    sums = prefixes(byte_values()[np.frombuffer(b"".join(r["stretch"] for r in rows), np.uint8)])
    text, place = owner[one], begins[owner[one]] + start[one]
    prints = mixed(stretch(sums, place, place + WIDTH)).view(np.int64)
    starts = np.where((size[kind[one]] == 1) & (copies == 1)[text], at[text] + start[one], -1)
    step = (lead[text] - start[one]) // STEP
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (step[1:] != step[:-1]))))
    middle = (begins + lead)[text[new]] - step[new] * STEP
    core = mixed(stretch(sums, middle, middle + CORE) + step[new].astype(np.uint64)).view(np.int64)
    ends = np.append(new, len(one)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, c) for c in (starts, prints)]
    unused = pa.nulls(len(new), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(file[text[new]]), pa.array(row[text[new]]), unused, unused, pa.array(anchor[text[new]]), pa.array(core), *lists], schema=schema)


def _sharded(batches: Iterable[pa.RecordBatch], schema: pa.Schema, shard: int) -> Iterator[pa.RecordBatch]:
    """Shards of whole groups of rows (anchor and salt) that follow each other."""
    rows, size, key = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if size >= shard and (row["anchor"], row["salt"]) != key:
                yield from _shard(rows, schema)
                rows, size = [], 0
            key = row["anchor"], row["salt"]
            rows.append(row)
            size += len(row["stretch"])
    if rows:
        yield from _shard(rows, schema)


SEGMENT = "file long, row long, at long, strings int, lead int, anchor long, digest long"


def _segmented(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        file, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "row"))
        for text, start, n, lead, anchor, digest in segments(data, offsets):
            columns = file[text], row[text], start, n.astype(np.int32), lead.astype(np.int32), anchor.view(np.int64), digest.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def placed(docs: DataFrame) -> DataFrame:
    """``docs``, which are read from files, with the place of each row there: a name that any later reading gives again."""
    return docs.withColumn("file", F.xxhash64("_metadata.file_path")).withColumn("row", F.col("_metadata.row_index"))


def repeated(docs: DataFrame, stretches: int = STRETCHES, shard: int = SHARD) -> DataFrame:
    """``(file, row, spans)`` of ``placed`` documents: runs ``(first, last)`` of places at which a string that occurs again starts."""
    schema, found_schema = _schema(SEGMENT), _schema(FOUND)
    every = cut(docs.select("file", "row", "text").mapInArrow(lambda b: _segmented(b, schema), SEGMENT), "segments")
    again = cut(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors-again")
    some = cut(every.join(again, "anchor"), "segments-again")
    place = F.struct("file", "row", "at", "strings", "lead")
    kinds = cut(some.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(place).alias("one")), "stretches")

    copied = kinds.where("copies > 1").select("anchor", "digest")
    sure = some.join(copied, ["anchor", "digest"]).select("file", "row", F.col("at").alias("first"), (F.col("at") + F.col("strings") - 1).alias("last"))

    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("copies").alias("least")).where("n > 1 AND least = 1")
    open_ = kinds.join(cut(open_.select("anchor", F.ceil(F.col("n") / stretches).alias("shards")), "anchors-open"), "anchor")
    dealt = F.struct("anchor", F.pmod("digest", "shards").alias("salt"), "shards", "copies", F.col("one.at").alias("at"), F.col("one.strings").alias("strings"), F.col("one.lead").alias("lead"))
    wanted = cut(open_.groupBy("one.file", "one.row").agg(F.collect_list(dealt).alias("wanted")), "wanted")
    holders = docs.select("file", "row", "text").join(bounded_broadcast(wanted.select("file", "row")), ["file", "row"], "left_semi")
    inside = F.transform("wanted", lambda w: w.withField("stretch", F.substring(F.encode("text", "UTF-8"), w["at"].cast("int") + 1, w["strings"] + WIDTH - 1)))
    texts = holders.join(wanted, ["file", "row"]).select("file", "row", F.explode(inside).alias("w")).select("file", "row", "w.*")
    texts = texts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "file", "row", "at")
    found = cut(texts.mapInArrow(lambda b: _sharded(b, found_schema, shard), FOUND), "found")

    # one anchor's shards: a string that two of them tell apart occurs again
    told = found.where("core IS NOT NULL").select("file", "row", "anchor", "core", F.arrays_zip(F.col("starts").alias("start"), F.col("prints").alias("print")).alias("told"))
    twice = cut(told.groupBy("anchor", "core").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "core"), "cores")
    strings = told.join(twice, ["anchor", "core"]).select("file", "row", "anchor", F.explode("told").alias("t"))
    alone = F.when(F.col("t.start") >= 0, F.struct("file", "row", F.col("t.start").alias("start")))
    met = strings.groupBy("anchor", "t.print").agg(F.count("*").alias("n"), F.collect_list(alone).alias("alone")).where("n > 1")
    merged = met.select(F.explode("alone").alias("a")).select("a.file", "a.row", F.col("a.start").alias("first"), F.col("a.start").alias("last"))
    runs = sure.unionByName(found.where("core IS NULL").select("file", "row", "first", "last")).unionByName(merged)
    return runs.groupBy("file", "row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_parts(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """What is left of ``text`` where strings start at the places of sorted ``spans``, and the number of maximal removed runs."""
    parts, end, removed = [], 0, 0
    for first, last in spans:
        if first > end or not removed:
            parts.append(text[end:first])
            removed += 1
        end = max(end, last + WIDTH)
    return [*parts, text[end:]], removed


def _reported(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            whole = (text or "").encode()
            parts, removed = kept_parts(whole, [(s["first"], s["last"]) for s in spans or ()])
            left = hashlib.sha256(b"".join(parts))
            out.append((doc_id, len(whole), len(whole) - sum(map(len, parts)), removed, left.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)


def report(docs: DataFrame, stored: bool = False, stretches: int = STRETCHES, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: bytes, bytes removed, maximal removed runs, digest of the rest.

    ``stored``: ``docs`` is a reading of Parquet files, whose rows have places; else it
    is written once. ``stretches`` of one anchor and ``shard`` bytes are what a shard
    holds; results do not depend on them. A null text is empty; texts of fewer than ``WIDTH`` bytes lose
    nothing; repeated rows, also of one ``doc_id`` or a null one, are documents of their
    own and so lose all from ``WIDTH`` bytes on. An empty table gives none. Other columns
    are ignored, whatever their names.
    """
    docs = placed(docs if stored else cut(docs.select("doc_id", "text"), "documents")).select("doc_id", "text", "file", "row")
    schema = _schema(REPORT)
    spans = cut(repeated(docs, stretches, shard), "spans")
    return docs.join(spans, ["file", "row"], "left").select("doc_id", "text", "spans").mapInArrow(lambda b: _reported(b, schema), REPORT)
