"""N-gram Jaccard join with signature trees.

Every document is its set of distinct word shingles. The tree over all sets has

* a *routing level*: sizes are cut into classes so that two sets that can link lie
  in one bucket (a class and its predecessor); a bucket cuts the token space into
  K slices, K one above the number of tokens in which two linked sets of that
  bucket can differ (plus a margin for empty slices). Linked sets therefore agree
  exactly on at least one slice, and a routing node is ``(bucket, slice, signature)``.
  Up to ``slices`` slices are used: documents with K <= slices are routed exactly;
  in longer ones each slice of a linked pair agrees with probability > 1/e, so all
  ``slices`` of them differ with probability < (1 - 1/e)**slices, 1e-8 for 40.
  ``slices=None`` uses all of them at any length.
* *inner nodes* below a routing node that several sets share: sets ordered by
  size, nodes of ``FANOUT`` children with the OR of their token bitmaps, the size
  range and the largest excess (tokens less set bits). Two nodes can hold a linked
  pair only if the size ranges allow it and
  ``bits(OR_x & OR_y) + excess >= required overlap``; a dual traversal drops every
  other pair of nodes. Surviving pairs of sets are compared exactly, word for word.

Equal sets are collapsed first. The trees then run twice. In the first pass each set
takes, from the trees of its first routing nodes, the one earlier set with the largest
possible overlap; a group of near copies is joined by as many pairs as it has sets. In
the second pass the trees of all routing nodes that still hold sets of two components
yield every pair of sets in different components that may link. Hashing only deals the
sets to trees; every candidate comes from a traversal and is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, components, cut
from .shingles import U, digest, mix, shingles

SLICES = 40
#: Slices of a bucket whose trees the first pass asks.
FIRST_SLICES = 3
FANOUT = 8
#: Sets of one routing node that one tree takes; larger nodes are dealt as pairs of blocks.
BLOCK = 256
#: Pairs with one text that are verified in one task.
HUB = 512


class Routes:
    """Size classes, buckets and slice signatures for links ``den * inter >= num * union``."""

    def __init__(self, num: int, den: int, slices: int | None):
        self.num, self.den, self.slices = num, den, slices
        self.starts = [1]

    def size_class(self, n: int) -> int:
        while self.starts[-1] <= n:
            b = self.starts[-1]
            self.starts.append(max(b + 1, (b - 1) * self.den // self.num + 1))
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def plan(self, bucket: int) -> tuple[int, int, int]:
        """Slices, margin for empty slices and bits of a bitmap of a bucket."""
        self.size_class(self.starts[min(bucket, len(self.starts) - 1)])
        while len(self.starts) <= bucket + 1:
            self.size_class(self.starts[-1])
        top = self.starts[bucket + 1] - 1
        differ = (self.den - self.num) * 2 * top // (self.den + self.num)
        margin = 0 if differ <= 2 else 2
        return differ + 1 + margin, margin, 1 << max(8, (2 * top - 1).bit_length())

    def keys(self, s: np.ndarray) -> tuple[list[int], list[int]]:
        """Routing keys of a set: those for the star pass, and all."""
        star, every = [], []
        c = self.size_class(len(s))
        spread = mix(s + U(0x51ED270B))
        for bucket in (c, c + 1):
            k, margin, _ = self.plan(bucket)
            use = k if self.slices is None else min(k, self.slices)
            at = (spread % U(k)).astype(np.int64)
            sums, filled = np.zeros(k, U), np.bincount(at, minlength=k)
            np.add.at(sums, at, mix(s ^ U(0x2545F4914F6CDD1D)))
            j = np.arange(use)
            if use < k or (filled == 0).sum() <= margin:
                j = j[filled[:use] > 0]
            key = mix(mix(sums[j]) + U((bucket + 1) * 0x9E3779B97F4A7C15 % 2**64) + j.astype(np.uint64) * U(0xD6E8FEB86659FD93)).astype(np.int64)
            every += key.tolist()
            star += key[:FIRST_SLICES].tolist()
        return star, every

    def bitmap(self, s: np.ndarray) -> bytes:
        """Token bits in the size of the bucket above; a smaller size is its folding."""
        bits = self.plan(self.size_class(len(s)) + 1)[2]
        on = np.zeros(bits, bool)
        on[(mix(s + U(0xC0FFEE)) % U(bits)).astype(np.int64)] = True
        return np.packbits(on, bitorder="little").tobytes()

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def _fold(bitmap: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(bitmap, np.uint64)
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def tree_candidates(
    sizes: np.ndarray, bitmaps: list[bytes], left: np.ndarray, right: np.ndarray, group: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``i, j`` of ``left`` x ``right`` in different groups that may link, and their greatest possible similarity, by dual traversal of two signature trees."""
    width = min(len(b) for b in bitmaps) // 8
    words = np.stack([_fold(b, width) for b in bitmaps])
    excess = sizes - np.bitwise_count(words).sum(1)

    def tree(rows: np.ndarray) -> list[tuple]:
        rows = rows[np.lexsort((rows, sizes[rows]))]
        level = (words[rows], sizes[rows], sizes[rows], excess[rows])
        levels = [(rows, *level)]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FANOUT)
            level = (
                np.bitwise_or.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts),
                np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts),
            )
            levels.append((None, *level))
        return levels

    x, y = tree(left), tree(right)
    same = left is right

    def children(nodes: np.ndarray, below: int) -> list[np.ndarray]:
        return [np.arange(n * FANOUT, min(below, n * FANOUT + FANOUT)) for n in nodes]

    i = j = np.zeros(1, np.int64)
    near = np.zeros(1)
    dx, dy = len(x) - 1, len(y) - 1
    while True:
        _, wx, lox, hix, ex = x[dx]
        _, wy, loy, hiy, ey = y[dy]
        least = lox[i] + loy[j]
        overlap = np.minimum(np.bitwise_count(wx[i] & wy[j]).sum(1) + np.minimum(ex[i], ey[j]), np.minimum(hix[i], hiy[j]))
        may = (overlap * (num + den) >= num * least) & (den * hix[i] >= num * loy[j]) & (den * hiy[j] >= num * lox[i])
        i, j, near = i[may], j[may], (overlap / (least - overlap))[may]
        if not len(i) or dx == dy == 0:
            break
        if dx >= dy:
            dx -= 1
            kids = children(i, len(x[dx][1]))
            j = np.repeat(j, [len(k) for k in kids])
            i = np.concatenate(kids)
        else:
            dy -= 1
            kids = children(j, len(y[dy][1]))
            i = np.repeat(i, [len(k) for k in kids])
            j = np.concatenate(kids)
    if not len(i):
        return i, j, near
    i, j = x[0][0][i], y[0][0][j]
    keep = group[i] != group[j]
    if same:
        keep &= i < j
    return i[keep], j[keep], near[keep]


def _profile(docs: DataFrame, n: int, routes: Routes) -> DataFrame:
    """Per document its set's size, digest, routing keys and bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, n)
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, [], [], b""))
                    continue
                star, every = routes.keys(s)
                rows.append((doc_id, len(s), *digest(s), star, every, routes.bitmap(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "d1", "d2", "star", "every", "bitmap"])

    return docs.mapInPandas(run, "doc_id long, n_shingles long, d1 long, d2 long, star array<long>, every array<long>, bitmap binary")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, routes: Routes) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` whose whole texts link; a text that many pairs share goes to many tasks."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = docs.where("doc_id is not null").join(bounded_broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = cut(texts, "texts")
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts"))
    second = texts.join(salts, texts["doc_id"] == salts["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("text_b"))
    rows = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(second, ["b", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ok = []
            for b, ta, tb in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[b] = shingles(tb, n)
                ok.append(routes.linked(shingles(ta, n), held[b]))
            yield batch.loc[ok, ["a", "b"]]

    return rows.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def _dealt(members: DataFrame, others: Column) -> DataFrame:
    """Members of routing nodes dealt to pairs of blocks ``(bi, bj)``; ``others`` are the blocks that a block meets."""
    return (
        members.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), "blocks").cast("int"))
        .withColumn("other", F.explode(others))
        .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        .select("key", "bi", "bj", "block", "rep", "component", "size", "keys", "bitmap")
    )


def _tree_pairs(dealt: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Candidate pairs ``(a, b)``, a > b, of the trees of ``dealt``.

    With ``best`` only the likeliest partner of each set among those before it, else
    all in different components; sets that meet at several routing nodes are then a
    candidate at the least of them only.
    """

    def candidates(key: int, bi: int, bj: int, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        block, rep = rows["block"].to_numpy(), rows["rep"].to_numpy()
        first = np.flatnonzero(block == bi)
        second = first if bi == bj else np.flatnonzero(block == bj)
        if not len(first) or not len(second) or len(rows) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i, j, near = tree_candidates(rows["size"].to_numpy(), rows["bitmap"].tolist(), first, second, rows["component"].to_numpy(), num, den)
        a, b = np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])
        if best:
            order = np.lexsort((b, -near, a))
            a, b = a[order], b[order]
            head = np.append(True, a[1:] != a[:-1])[: len(a)]
            return a[head], b[head]
        keys = [set(k.tolist()) for k in rows["keys"]]
        least = [min(keys[x] & keys[y]) == key for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return a[least], b[least]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat((held, batch), ignore_index=True)
            names = held[["key", "bi", "bj"]].to_numpy()
            heads = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
            yield _of_runs(candidates, held, names, heads, heads[1:])
            held = held.iloc[heads[-1] :].reset_index(drop=True)  # the last tree may go on in the next batch
        if held is not None:
            names = held[["key", "bi", "bj"]].to_numpy()
            yield _of_runs(candidates, held, names, np.zeros(1, np.int64), np.array([len(held)]))

    ordered = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def _of_runs(candidates: Callable, rows: pd.DataFrame, names: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    found = [candidates(*names[h].tolist(), rows.iloc[h:e]) for h, e in zip(heads, ends, strict=False)]
    if not found:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    return pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])}, dtype="int64")


def near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, slices: int | None = SLICES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: a row for each row of ``docs(doc_id, text)``.

    Two documents link when ``den * |A & B| >= num * |A | B|`` on their sets of
    ``n``-word shingles; ``component_id`` is the least ``doc_id`` that links reach.
    Null or wordless texts have no shingles and link with nothing; a text of fewer
    than ``n`` words is one shingle; rows with a null ``doc_id`` are returned with a
    null component; rows that repeat a ``doc_id`` share its component. Other columns
    are ignored.

    With the default ``slices`` texts of up to some 300 shingles (at 0.9) are joined
    exactly; a pair of longer ones at the threshold is missed with a probability below
    1e-8, at any size of the table. ``slices=None`` is exact at any length.
    """
    routes = Routes(num, den, slices)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = cut(_profile(docs, n, routes), "profile")
    sets = cut(
        profile.where("doc_id is not null and n_shingles > 0")
        .groupBy("d1", "d2", F.col("n_shingles").alias("size"))
        .agg(F.min("doc_id").alias("rep"), F.first("star").alias("star"), F.first("every").alias("every"), F.first("bitmap").alias("bitmap")),
        "sets",
    )
    # First pass: each set and its likeliest partner in the trees of its first routing nodes.
    first = sets.select("rep", F.explode("star").alias("key"))
    several = bounded_broadcast(cut(first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys"))
    members = sets.select("rep", F.col("rep").alias("component"), "size", F.array().cast("array<long>").alias("keys"), "bitmap", F.explode("star").alias("key")).join(several, "key")
    hub = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    pairs = cut(_tree_pairs(_dealt(members, hub), num, den, best=True), "pairs")
    links = cut(_verified(pairs, docs, n, routes), "links")
    joined = components(links).withColumnRenamed("node", "rep")
    # Second pass: routing nodes that still hold two components.
    known = sets.join(joined, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "every", "size", "bitmap")
    known = cut(known, "known")
    nodes = cut(
        known.select("rep", "component", F.explode("every").alias("key"))
        .groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"))
        .where("c0 <> c1").select("key", "n"),
        "nodes",
    )
    narrow = bounded_broadcast(nodes, BROADCAST_ROWS // 4)
    rows = known.select("rep", F.explode("every").alias("key")).join(narrow, "key")
    members = rows.join(known.select("rep", "component", "size", F.col("every").alias("keys"), "bitmap"), "rep")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    more = cut(_tree_pairs(_dealt(members, every), num, den, best=False).join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = components(cut(links.union(_verified(more, docs, n, routes)), "links"))
    named = sets.select("rep", "d1", "d2", F.col("size").alias("n_shingles")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    return (
        profile.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the near copies: the row of the least ``doc_id`` of each component stays.

    Rows that repeat a ``doc_id`` stay or go together; rows with a null id stay.
    """
    copies = near_copies(docs, n, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(bounded_broadcast(cut(copies, "copies")), "doc_id", "left_anti").select(docs.columns)
