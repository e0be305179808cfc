"""Phrases that recur, by Rabin-Karp fingerprints of word n-grams.

Words get fingerprints of their bytes, n-grams those of their words' prefix polynomial.
Counting goes up by length: an n-gram can be frequent only if both its (n-1)-grams are,
so each reading of the texts counts fingerprints of n-grams whose parts are in a bitmap
of the frequent ones. The bitmap has a fixed size whatever the corpus; a bit set by
chance only costs work. A last reading follows the fingerprints that stayed back to where
they occur and counts their text, so phrases and counts are those of the text itself,
and phrases that share a fingerprint are told apart.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .rolling import byte_values, counted, mixed, prefixes, stretch, utf8

#: Bits of a bitmap of frequent fingerprints, and of one of its rows while it is made.
BITS, ROW_BITS = 26, 16
#: Fingerprints held by a task before it counts them, and bytes of text read at once.
HELD, PIECE = 1 << 22, 1 << 21
#: Tasks of the last reading for each core of the session.
TASKS_A_CORE = 2
#: Words of the longest phrase.
LONGEST_PHRASE = 4

# What ends a piece, and what is between words.
ENDS, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"


def _table(inside: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


_END, _APART = _table(ENDS), _table(ENDS + BETWEEN)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces_of(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of some ``size`` bytes together, cut only where a piece of text ends: bytes in lower case, text of each byte, whether it ends a piece (texts end one too)."""
    data = _LOWER[data]
    ends = np.flatnonzero(_END[data])
    begin, n = 0, len(data)
    limits = np.union1d(ends + 1, offsets)
    while begin < n:
        at = np.searchsorted(limits, begin + size, "right") - 1
        upto = int(limits[at]) if limits[at] > begin else int(limits[min(at + 1, len(limits) - 1)])
        yield data[begin:upto], np.searchsorted(offsets, np.arange(begin, upto), "right") - 1, np.isin(np.arange(begin, upto), offsets)
        begin = upto


class Words:
    """The words of a stretch of texts: places, text, fingerprint, and the piece that each is in."""

    def __init__(self, data: np.ndarray, text: np.ndarray, first: np.ndarray, seeds: np.ndarray):
        apart = _APART[data]
        begins = ~apart & (np.concatenate(([True], apart[:-1])) | first)
        self.data, self.start = data, np.flatnonzero(begins)
        stop = ~apart & np.concatenate((apart[1:] | first[1:], [True]))
        self.end = np.flatnonzero(stop) + 1
        self.text = text[self.start]
        self.piece = np.cumsum(_END[data] | first)[self.start]
        long = self.end - self.start
        sums = prefixes(byte_values()[data]) if len(data) else np.zeros(1, np.uint64)
        self.prints = mixed(stretch(sums, self.start, self.end) + long.astype(np.uint64))
        self.sums = prefixes(self.prints)
        self.seeds = seeds[self.text]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the n-grams within pieces, and their fingerprints, which differ by language."""
        at = np.arange(max(0, len(self.start) - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        return at, mixed(stretch(self.sums, at, at + n) + self.seeds[at] + np.uint64(n))

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """Text of the n-grams whose first words are ``at``: the words with one space between them."""
        sizes = self.end - self.start + 1
        begins = np.cumsum(sizes) - sizes
        places = np.repeat(self.start - begins, sizes) + np.arange(int(sizes.sum()))
        spaced = self.data[np.minimum(places, len(self.data) - 1)]
        spaced[begins + sizes - 1] = 32
        first, long = begins[at], (begins + sizes)[at + n - 1] - 1 - begins[at]
        offsets = np.concatenate(([0], np.cumsum(long)))
        taken = spaced[np.repeat(first - offsets[:-1], long) + np.arange(int(offsets[-1]))]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())


def _readings(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[Words, list[str]]]:
    """Words of batches of ``(lang, text)``, and the language of each text in them."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = {x: np.uint64(zlib.crc32(x.encode()) << 32 | zlib.adler32(x.encode())) for x in set(langs)}
        seeds = mixed(np.array([names[x] for x in langs], np.uint64))
        for data, text, first in pieces_of(*utf8(batch.column("text")), size):
            yield Words(data, text, first, seeds), langs


Bitmap = np.ndarray


def is_set(bitmap: Bitmap, prints: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - BITS)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap_of(prints: DataFrame) -> Bitmap:
    """Bits of the ``print`` column: rows of ``ROW_BITS`` bits are made by tasks and come to the driver compressed, 8 MiB together at most."""

    def row(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << ROW_BITS, np.uint8)
        out[part["place"].to_numpy()] = 1
        return pd.DataFrame({"k": [key[0]], "bits": [zlib.compress(np.packbits(out, bitorder="little").tobytes())]})

    place = F.shiftrightunsigned("print", 64 - BITS)
    rows = prints.select(F.shiftright(place, ROW_BITS).alias("k"), place.bitwiseAND((1 << ROW_BITS) - 1).cast("int").alias("place")).distinct()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (ROW_BITS - 3)
    for k, bits in rows.groupBy("k").applyInPandas(row, "k long, bits binary").toLocalIterator():
        out[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out


class Tally:
    """Counts of fingerprints, given in arrays."""

    def __init__(self, most: int) -> None:
        self.held: list[np.ndarray] = []
        self.size, self.most = 0, most

    def add(self, prints: np.ndarray) -> bool:
        self.held.append(prints)
        self.size += len(prints)
        return self.size >= self.most

    def flush(self, schema: pa.Schema) -> pa.RecordBatch:
        prints, n = counted(np.concatenate([np.zeros(0, np.uint64), *self.held]))
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)


_COUNTS = pa.schema([("print", pa.int64()), ("n", pa.int64())])


def _grams_of(n: int, parts: Callable[[], Bitmap] | None, size: int, held: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the n-grams whose first and last n-1 words are in the bitmap."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(held)
        for words, _ in _readings(batches, size):
            at, prints = words.grams(n)
            if parts is not None and len(at):
                lower_at, lower = words.grams(n - 1)
                good = np.zeros(len(words.start) + 1, bool)
                good[lower_at] = is_set(parts(), lower)
                prints = prints[good[at] & good[at + 1]]
            if tally.add(prints):
                yield tally.flush(_COUNTS)
        yield tally.flush(_COUNTS)

    return count


TEXTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


class Found:
    """Phrases that a task has met, by fingerprint: text at the first occurrence, and how many there were."""

    def __init__(self) -> None:
        self.prints = self.checks = np.zeros(0, np.uint64)
        self.place, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.columns: list[tuple[pa.Array, pa.Array, pa.Array]] = []

    def add(self, words: Words, langs: pa.Array, at: np.ndarray, size: int, prints: np.ndarray) -> None:
        """``at`` and ``prints`` are of n-grams of ``size`` words. Beside each fingerprint is one of other weights; phrases of one fingerprint that differ in it stay apart."""
        check = np.zeros(len(at), np.uint64)
        for k in range(size):
            check = check * np.uint64(6364136223846793005) + words.prints[at + k]
        order = np.lexsort((check, prints))
        p, c = prints[order], check[order]
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])))) if len(p) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(p)))
        at, p, c = at[order[first]], p[first], c[first]
        near = np.minimum(np.searchsorted(self.prints, p), max(0, len(self.prints) - 1))
        known = (self.prints[near] == p) & (self.checks[near] == c) if len(self.prints) else np.zeros(len(p), bool)
        self.n[self.place[near[known]]] += n[known]
        new = ~known
        if new.any():
            texts = pa.array(words.text[at[new]])
            self.columns.append((langs.take(texts), pa.array(np.full(len(texts), size, np.int32)), words.phrases(at[new], size)))
            self.place = np.append(self.place, len(self.n) + np.arange(len(texts)))
            self.n = np.append(self.n, n[new])
            self.prints, self.checks = np.append(self.prints, p[new]), np.append(self.checks, c[new])
            order = np.argsort(self.prints)
            self.prints, self.checks, self.place = self.prints[order], self.checks[order], self.place[order]

    def flush(self) -> pa.RecordBatch:
        columns = [pa.concat_arrays(c) for c in zip(*self.columns, strict=True)] if self.columns else [pa.array([], f.type) for f in TEXTS][:3]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(self.n)], schema=TEXTS)
        self.__init__()
        return out


def _texts_of(bitmaps: list[Callable[[], Bitmap]], size: int, held: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Text and count, in a task, of n-grams in the bitmaps, and the number of words by language (0 words, no phrase)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, totals = Found(), Counter()
        for words, langs in _readings(batches, size):
            for text, n in enumerate(np.bincount(words.text).tolist()):
                totals[langs[text]] += n
            names = pa.array(langs, pa.string())
            for n, bitmap in enumerate(bitmaps, 1):
                at, prints = words.grams(n)
                keep = is_set(bitmap(), prints)
                found.add(words, names, at[keep], n, prints[keep])
            if len(found.n) * LONGEST_PHRASE >= held:
                yield found.flush()
        yield found.flush()
        langs = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([0] * len(langs), pa.int32()), pa.nulls(len(langs), pa.string()), pa.array(list(totals.values()), pa.int64())], schema=TEXTS)

    return count


def frequent(docs: DataFrame, least: int = 30, size: int = PIECE, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, phrase, f)`` of the phrases of 1 to 4 words with ``f >= least``, and ``(lang, n)``, the number of words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bitmaps: list[Callable[[], Bitmap]] = []
    for n in range(1, LONGEST_PHRASE + 1):
        counts = texts.mapInArrow(_grams_of(n, bitmaps[-1] if bitmaps else None, size, held), "print long, n long")
        often = counts.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        sent = sc.broadcast(bitmap_of(often))
        bitmaps.append(lambda sent=sent: sent.value)
    # a task gives every frequent phrase that it meets once, so few long tasks give fewer rows than the scan's many
    found = texts.coalesce(TASKS_A_CORE * sc.defaultParallelism).mapInArrow(_texts_of(bitmaps, size, held), "lang string, words int, phrase string, n long")
    summed = cut(found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)), "phrases")
    return summed.where("words > 0"), summed.where("words = 0").select("lang", F.col("f").alias("n"))


#: Shares of a language's phrases that are ranked apart before the first ones are ranked together.
RANKED_APART = 64


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, size: int = PIECE, held: int = HELD) -> DataFrame:
    """The first ``top`` phrases of 2 to 4 words of each language by their weakest cut's score: ``(lang, rank, phrase, a, l, r, n, score)``.

    Everything is per ``lang``, a null one being ``und``; a null text is empty, a text
    without words has no phrases, and repeated rows count each. Arithmetic is in
    decimals of 38 digits. Ties go by a, then by the phrase's bytes. An empty table
    gives none; other columns are ignored.
    """
    often, totals = frequent(docs, least, size, held)
    split = F.split("phrase", " ")
    longer = often.where("words > 2").select("lang", "words", split.alias("w"), "f")
    at = F.explode(F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))"))
    within = longer.select("lang", at.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = often.where("words > 1").join(within, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = left.where(F.col("most").isNull() | (wide("most") * 100 < wide("f") * 80)).select("lang", "phrase", "words", F.col("f").alias("a"))

    cuts = left.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), split.alias("w"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ') AS head"), F.expr("array_join(slice(w, k + 1, words - k), ' ') AS tail"))
    known = often.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) div CAST(l + r AS DECIMAL(20,0)) AS BIGINT)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    rows = weakest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    apart = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    first = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
