"""A query set against all rows, block by block: what pairs give is computed in matrix products.

Vectors are dealt evenly and packed, a few thousand a row, as bytes; packed queries meet
packed rows, so a task holds two blocks at a time and a pair never is a row unless the
result has one. Distances come from products; those that decide an order, and those of
near copies, are taken again by differences, summed in the order of the dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query rows up to which the packed query set is broadcast (27 MB at 64 floats); a larger one is dealt in so many parts, each of which meets so many slices of the rows.
QUERY_ROWS, PARTS, SLICES = 100_000, 16, 16
#: Rows of a packed block, of a task, and the least that a task is worth.
BLOCK, TASK, LEAST = 2_048, 16_384, 256
#: Rows of the other side that meet a block in one step when pairs become rows.
STEP = 512
#: Pairs whose differences are taken in one step.
PIECE = 256
#: Rows whose least distance is looked at first; rows of a task that keeps nearest ones only, and its tasks a core: what is sent grows with tasks, not with their rows.
RUN, KEPT, WAVES = 64, 65_536, 2
#: Runs that are looked at in one step.
LOOKS = 4_096
#: Rows up to which all are broadcast for whole orders (256 MB at 64 floats), and scores that a task holds for them.
WHOLE_ROWS, HELD = 1_000_000, 32_000_000
#: Greatest squares between which products may be of single precision.
SINGLE = (1e-25, 1e25)
#: Squared distances below this share of the squared norms are taken by differences.
NEAR = 1e-4
#: Scores are whole numbers of these.
DIGITS = 1_000_000
PACKED = "n int, ids binary, labels binary, known binary, v binary"


@dataclass(frozen=True)
class Block:
    """Vectors side by side; one that is null, or holds a null, is a row of NaN. ``known`` tells which labels are not null."""

    ids: np.ndarray
    labels: np.ndarray
    known: np.ndarray
    v: np.ndarray
    square: np.ndarray

    def cut(self, start: int, stop: int) -> Block:
        return Block(*(x[start:stop] for x in (self.ids, self.labels, self.known, self.v, self.square)))

    def picked(self, at: np.ndarray) -> Block:
        return Block(*(x[at] for x in (self.ids, self.labels, self.known, self.v, self.square)))

    def groups(self) -> np.ndarray:
        """Labels as numbers that tell null from any value."""
        return np.where(self.known, self.labels, np.iinfo(np.int64).min)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a list column; those that are null or hold a null become NaN, and all others have one length."""
    whole, flat = column.is_valid().to_numpy(zero_copy_only=False), column.flatten()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    widths = np.unique(lengths[whole]).astype(int)
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and {widths[-1]} numbers cannot be compared")
    out = np.full((len(column), int(widths[0]) if len(widths) else 0), np.nan, kind)
    out[whole] = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(int(whole.sum()), out.shape[1])
    return out


def packed(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """Rows ``(vec_id, embedding, label)`` as blocks of bytes, each of at most ``BLOCK`` rows, or ``size``."""
    most = size or BLOCK
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                b = batch.slice(start, most)
                label = b.column(1)
                parts = (
                    b.column(0).to_numpy(zero_copy_only=False).astype("i8"), label.fill_null(0).to_numpy(zero_copy_only=False).astype("i8"),
                    label.is_valid().to_numpy(zero_copy_only=False).astype("u1"), _matrix(b.column(2), kind),
                )
                columns = [pa.array([x.tobytes()], pa.binary()) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *columns], ["n", "ids", "labels", "known", "v"])

    return vectors.select("vec_id", F.col("label").cast("long"), "embedding").mapInArrow(pack, PACKED)


def _block(row: dict, kind: str) -> Block:
    ids, labels, known = (np.frombuffer(row[c], d) for c, d in (("ids", "i8"), ("labels", "i8"), ("known", "u1")))
    v = np.frombuffer(row["v"], kind).reshape(row["n"], -1).astype(np.float64)
    if not v.shape[1]:
        v = np.full((row["n"], 1), np.nan)
    return Block(ids, labels, known.astype(bool), v, (v * v).sum(1))


Met = Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]]


def _units(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[Block, Block]]:
    """Blocks side by side, queries first, both of one length."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            b = _block(row, kind)
            a = _block({k[2:]: v for k, v in row.items() if k.startswith("q_")}, kind)
            if a.v.shape[1] != b.v.shape[1]:
                empty, full = (a, b) if np.isnan(a.v).all() else (b, a)
                if not np.isnan(empty.v).all():
                    raise ValueError(f"vectors of {a.v.shape[1]} and {b.v.shape[1]} numbers cannot be compared")
                wide_ = Block(empty.ids, empty.labels, empty.known, np.full((len(empty.ids), full.v.shape[1]), np.nan), np.full(len(empty.ids), np.nan))
                a, b = (wide_, b) if empty is a else (a, wide_)
            yield a, b


def meet(vectors: DataFrame, queries: DataFrame, f: Met, schema: str, task: int | None = None, waves: int = 3) -> DataFrame:
    """What ``f`` makes of a task's blocks: queries beside rows, all blocks of queries for one block of rows after another."""
    n, asked = vectors.count(), queries.count()
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "f8"
    wide = waves * vectors.sparkSession.sparkContext.defaultParallelism
    rows = packed(vectors.repartition(max(1, min(-(-n // LEAST), max(wide, -(-n // (task or TASK)))))))
    asks = packed(queries.repartition(max(1, -(-asked // (4 * BLOCK))))).select(*[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "labels", "known", "v")])
    if asked <= QUERY_ROWS:
        both = rows.crossJoin(F.broadcast(asks))
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = asks.withColumn("_part", F.pmod(F.hash("q_ids"), F.lit(PARTS))).withColumn("_slice", every(SLICES))
        both = rows.withColumn("_slice", F.pmod(F.hash("ids"), F.lit(SLICES))).withColumn("_part", every(PARTS)).join(dealt, ["_part", "_slice"]).drop("_part", "_slice")

    return both.mapInArrow(lambda batches: f(_units(batches, kind)), schema)


def others(a: Block, b: Block) -> np.ndarray:
    """Which pairs are of two different rows."""
    return a.ids[:, None] != b.ids[None, :]


def taken(a: Block, b: Block) -> Callable[[np.ndarray], np.ndarray]:
    """Picks the pairs of two different rows of a matrix; where all are, none is asked."""
    keep = others(a, b)
    return np.ravel if keep.all() else lambda x: x[keep]


def exact(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances row by row, added in the order of the dimensions."""
    gap = np.subtract(u, v)
    gap *= gap
    return np.add.reduce(np.ascontiguousarray(gap.T), axis=0)


def exact_at(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """``exact`` of rows ``i`` beside rows ``j``, so few at a time that they stay in the cache."""
    return np.concatenate([exact(a.v[i[s : s + PIECE]], b.v[j[s : s + PIECE]]) for s in range(0, len(i), PIECE)] or [np.zeros(0)])


def products(a: Block, b: Block) -> np.ndarray:
    return a.v @ b.v.T


def squared(a: Block, b: Block, dots: np.ndarray | None = None) -> np.ndarray:
    """Squared distances; those of near copies by differences."""
    dots = products(a, b) if dots is None else dots
    base = a.square[:, None] + b.square[None, :]
    d = base - 2 * dots
    close = d < NEAR * base
    if close.any():
        for i in np.flatnonzero(close.any(1)):
            at = np.flatnonzero(close[i])
            d[i, at] = exact(np.broadcast_to(a.v[i], (len(at), a.v.shape[1])), b.v[at])
    return d


def cosine(a: Block, b: Block, dots: np.ndarray | None = None) -> np.ndarray:
    """Cosines; NaN where a vector is missing or of length zero."""
    dots = products(a, b) if dots is None else dots
    norm = np.sqrt(a.square)[:, None] * np.sqrt(b.square)[None, :]
    return np.divide(dots, norm, out=np.full(dots.shape, np.nan), where=norm > 0)


def number(x: np.ndarray) -> pa.Array:
    """Doubles with null for NaN."""
    return pa.array(x, pa.float64(), from_pandas=True)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded in the task, where it costs a tenth of what decimals cost a row; no negative zero."""
    return np.rint(x * 10**digits) / 10**digits + 0.0


#: Columns of pairs, with their types.
COLUMNS = {"id_a": "long", "id_b": "long", "score": "double", "same": "boolean", "label_a": "int", "label_b": "int", "distance": "double", "norm_a": "double", "norm_b": "double"}


def pair_columns(a: Block, b: Block, names: tuple[str, ...]) -> list[pa.Array]:
    """Columns of all pairs of different rows of two blocks."""
    dots = products(a, b) if {"score", "distance"} & set(names) else None
    take, shape = taken(a, b), (len(a.ids), len(b.ids))
    left, right = (lambda x: take(np.broadcast_to(x[:, None], shape))), (lambda x: take(np.broadcast_to(x[None, :], shape)))
    label = lambda s, block: pa.array(s(block.labels).astype(np.int32), pa.int32(), mask=None if block.known.all() else ~s(block.known))
    made = {
        "id_a": lambda: pa.array(left(a.ids)), "id_b": lambda: pa.array(right(b.ids)),
        "score": lambda: number(take(rounded(cosine(a, b, dots), 6))),
        "same": lambda: pa.array(take(a.labels[:, None] == b.labels[None, :]), mask=None if a.known.all() and b.known.all() else ~take(a.known[:, None] & b.known[None, :])),
        "label_a": lambda: label(left, a), "label_b": lambda: label(right, b), "distance": lambda: number(take(np.sqrt(squared(a, b, dots)))),
        "norm_a": lambda: number(left(np.sqrt(a.square))), "norm_b": lambda: number(right(np.sqrt(b.square))),
    }
    return [made[n]() for n in names]


def pairs(vectors: DataFrame, queries: DataFrame, *names: str) -> DataFrame:
    """Named columns of every query beside every other row: a row a pair."""
    return pair_rows(vectors, queries, lambda a, b: pair_columns(a, b, names), ", ".join(f"{n} {COLUMNS[n]}" for n in names))


def pair_rows(vectors: DataFrame, queries: DataFrame, columns: Callable[[Block, Block], list[pa.Array]], schema: str, step: int | None = None) -> DataFrame:
    """Rows that ``columns`` makes of a block of queries and a step of rows; rows leave a task step by step."""
    names = [c.split()[0] for c in schema.split(", ")]

    def made(units: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        for a, b in units:
            for start in range(0, len(b.ids), step or STEP):
                yield pa.RecordBatch.from_arrays(columns(a, b.cut(start, start + (step or STEP))), names)

    return meet(vectors, queries, made, schema)


def tallies(vectors: DataFrame, queries: DataFrame, count: Callable[[Block, Block], dict[str, int]]) -> DataFrame:
    """``(kind, n)``: pairs of each kind that there are, counted in the tasks."""

    def columns(a: Block, b: Block) -> list[pa.Array]:
        told = {kind: int(n) for kind, n in count(a, b).items() if n}
        return [pa.array(list(told), pa.string()), pa.array(list(told.values()), pa.int64())]

    return pair_rows(vectors, queries, columns, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n"))


def labelled(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of different rows have one label, and which two; those without a label have neither."""
    pair, same = others(a, b), a.labels[:, None] == b.labels[None, :]
    if not (a.known.all() and b.known.all()):
        pair &= a.known[:, None] & b.known[None, :]
    return pair & same, pair & ~same


def outcomes(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """``(kind, n)``: ``tp, tn, fp, fn`` of pairs that match by a rounded cosine of at least ``threshold``; pairs without a score or a label are none."""

    def count(a: Block, b: Block) -> dict[str, int]:
        s, (same, other) = rounded(cosine(a, b), 6), labelled(a, b)
        hit, miss = s >= threshold, s < threshold
        return {k: np.count_nonzero(x & y) for k, x, y in (("tp", hit, same), ("tn", miss, other), ("fp", hit, other), ("fn", miss, same))}

    return tallies(vectors, queries, count)


def contrast(vectors: DataFrame, queries: DataFrame, margin: float) -> DataFrame:
    """``(total, n)``: squared distances of pairs of one label, and squares of what others lack to ``margin``, added up in the tasks.

    Others without a distance count as beyond the margin; pairs of one label without one do not count.
    """

    def columns(a: Block, b: Block) -> list[pa.Array]:
        d, pair, (same, _) = np.sqrt(squared(a, b)), others(a, b), labelled(a, b)
        x = np.where(same, d * d, np.square(np.fmax(margin - d, 0.0)))
        x, n = np.where(pair, x, 0.0), np.count_nonzero(pair)
        missing = np.isnan(x)
        return [pa.array([float(np.where(missing, 0.0, x).sum())]), pa.array([n - np.count_nonzero(missing)], pa.int64())]

    return pair_rows(vectors, queries, columns, "total double, n long").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def unlike(vectors: DataFrame, queries: DataFrame, least: float, digit: str) -> DataFrame:
    """``(id_a, id_b, score)`` of pairs of two labels with a rounded cosine of at least ``least`` and ``digit`` in ``id_b``; other pairs leave no task."""

    def columns(a: Block, b: Block) -> list[pa.Array]:
        b = b.picked(np.flatnonzero([digit in str(i) for i in b.ids.tolist()]))
        s, (_, other) = rounded(cosine(a, b), 6), labelled(a, b)
        i, j = np.nonzero(other & (s >= least))
        return [pa.array(a.ids[i]), pa.array(b.ids[j]), pa.array(s[i, j])]

    return pair_rows(vectors, queries, columns, "id_a long, id_b long, score double")


#: Scores that wait to be counted, scores of a chunk, and squares of vectors that are brought to length one before their products.
WAITING, CHUNK, SCALED = 8_000_000, 1_024, (1e-290, 1e290)
#: Doubles of this size have no digits behind the point: to add it rounds, and the bits hold the number.
WHOLE = 1.5 * 2**52


def _directions(x: Block) -> tuple[Block, np.ndarray]:
    """Rows of length one in the order of their labels, those without a label first, and the places of rows that have no length to divide by."""
    good = (x.square > SCALED[0]) & (x.square < SCALED[1])
    at = np.flatnonzero(good)
    x = x.picked(at[np.argsort(x.groups()[at], kind="stable")])
    return Block(x.ids, x.labels, x.known, x.v / np.sqrt(x.square)[:, None], x.square), np.flatnonzero(~good)


def _rectangles(a: Block, b: Block) -> Iterator[tuple[slice, slice]]:
    """Where pairs of one label lie in two blocks of that order."""
    bare = [np.count_nonzero(~x.known) for x in (a, b)]
    for label in np.intersect1d(a.labels[bare[0] :], b.labels[bare[1] :]):
        yield tuple(slice(*(n + np.searchsorted(x.labels[n:], label, side) for side in ("left", "right"))) for x, n in zip((a, b), bare, strict=True))


def score_counts(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(score, p, n)``: at every distinct score, pairs of one label and of two; a task sends what it counted, a row a chunk of scores.

    Pairs without a label count in neither, and those without a score are one row. Scores are
    products of vectors of length one, rounded in place; all are counted, and of those again
    the ones of one label and the ones without a label.
    """
    width = CHUNK
    span = -(-(2 * DIGITS + 2) // width) * width  # the last place is of pairs without a score

    def counted(units: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        held, waiting, space = np.zeros((3, span), np.int64), ([], [], []), np.empty(0)

        def settle(most: int) -> None:
            for total, parts in zip(held, waiting, strict=True):
                if sum(map(len, parts)) > most:
                    total += np.bincount(np.concatenate(parts), minlength=span)
                    parts.clear()

        def divided(a: Block, b: Block) -> None:
            for start in range(0, len(b.ids), STEP):
                c = b.cut(start, start + STEP)
                s, (same, other), pair = cosine(a, c), labelled(a, c), others(a, c)
                at = np.where(np.isnan(s), span - 1, np.clip(np.rint(s * DIGITS), -DIGITS, DIGITS) + DIGITS).astype(np.int64)
                for parts, which in zip(waiting, (pair, same, pair & ~same & ~other), strict=True):
                    parts.append(at[which])
                settle(WAITING)

        for a, b in units:
            (u, odd), (v, odd_b) = _directions(a), _directions(b)
            if len(odd):
                divided(a.picked(odd), b)
            if len(odd_b):
                divided(a.picked(np.setdiff1d(np.arange(len(a.ids)), odd)), b.picked(odd_b))
            shape = len(u.ids), len(v.ids)
            size = shape[0] * shape[1]
            space = space if space.size >= size else np.empty(size)
            d = np.matmul(u.v * DIGITS, v.v.T, out=space[:size].reshape(shape))
            d += WHOLE
            at = d.view(np.int64)
            at -= np.array(WHOLE).view(np.int64) - DIGITS
            held[0] += np.bincount(at.ravel(), minlength=span)
            waiting[1].extend(at[r].flatten() for r in _rectangles(u, v))
            bare = [np.count_nonzero(~x.known) for x in (u, v)]
            waiting[2].extend((at[: bare[0]].flatten(), at[bare[0] :, : bare[1]].flatten()))
            i, j = _same(u, v)
            own, known = at[i, j], u.known[i]
            for total, x in zip(held, (own, own[known], own[~known]), strict=True):
                np.subtract.at(total, x, 1)
            settle(WAITING)
        settle(0)
        for chunk in np.unique(np.flatnonzero(held[0]) // width).tolist():
            part = held[:, chunk * width : (chunk + 1) * width]
            kind = np.min_scalar_type(part.max())
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([kind.str]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["chunk", "kind", "counts"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.zeros((3, width), np.int64)
        for kind, counts in zip(parts["kind"].to_pylist(), parts["counts"].to_pylist(), strict=True):
            total += np.frombuffer(counts, kind).reshape(3, width)
        every, same, bare = total
        at = np.flatnonzero(every)
        place = at + parts["chunk"][0].as_py() * width
        return pa.table({"score": number(np.where(place == span - 1, np.nan, (place - DIGITS) / DIGITS)), "p": pa.array(same[at]), "n": pa.array((every - same - bare)[at])})

    return meet(vectors, queries, counted, "chunk long, kind string, counts binary").groupBy("chunk").applyInArrow(added, "score double, p long, n long")


NEAREST = "id_a long, id_b long, label_a int, label_b int, dist double"


class _Kept:
    """The ``k`` nearest of all that a block of rows has met, of every group of the others: arrays of groups by ``k`` by rows, nearest first."""

    def __init__(self, me: Block, k: int):
        self.ids, self.labels, self.k = me.ids, me.groups(), k
        self.places: dict[int, int] = {}
        self.dist, self.other, self.label, self.full = (np.zeros((0, k, len(me.ids)), kind) for kind in ("f8", "i8", "i8", "?"))

    def at(self, groups: np.ndarray) -> np.ndarray:
        """Places of groups; new ones hold nothing."""
        new = [g for g in dict.fromkeys(groups.tolist()) if g not in self.places]
        if new:
            self.places |= {g: len(self.places) + n for n, g in enumerate(new)}
            more = lambda x, fill: np.concatenate([x, np.full((len(new), *x.shape[1:]), fill, x.dtype)])
            self.dist, self.other, self.label, self.full = more(self.dist, np.inf), more(self.other, 0), more(self.label, 0), more(self.full, False)
        return np.array([self.places[g] for g in groups.tolist()], np.int64)

    def distances(self, groups: np.ndarray) -> np.ndarray:
        at = self.at(groups)
        return self.dist[at]

    def add(self, i: np.ndarray, groups: np.ndarray, dist: np.ndarray, other: np.ndarray, label: np.ndarray) -> None:
        """Rows ``i`` have met others; of equal distances the least id is kept."""
        if not len(i):
            return
        known, which = np.unique(groups, return_inverse=True)
        n = len(self.ids)
        cell = self.at(known)[which] * n + i
        touched = np.unique(cell)
        g, row = np.divmod(touched, n)
        t, rank = np.nonzero(self.full[g, :, row])
        held = tuple(x[g[t], rank, row[t]] for x in (self.dist, self.other, self.label))
        cell, dist, other, label = (np.concatenate(x) for x in zip((touched[t], *held), (cell, dist, other, label), strict=True))
        order = np.lexsort((other, np.sqrt(dist), cell))
        cell = cell[order]
        places = np.arange(len(order))
        rank = places - np.maximum.accumulate(np.where(np.r_[True, cell[1:] != cell[:-1]], places, 0))
        keep = rank < self.k
        order, (g, row) = order[keep], np.divmod(cell[keep], n)
        for mine, x in ((self.dist, dist), (self.other, other), (self.label, label)):
            mine[g, rank[keep], row] = x[order]
        self.full[g, rank[keep], row] = True

    def meet(self, me: Block, it: Block, by_label: bool) -> None:
        """``me``, the block that this is of, meets ``it``."""
        i, j = _candidates(me, it, self.k, by_label, self)
        dist, label = exact_at(me, i, it, j), it.groups()[j]
        self.add(i, label if by_label else np.zeros(len(i), np.int64), np.where(np.isnan(dist), np.inf, dist), it.ids[j], label)

    def rows(self, back: bool, step: int = 100_000) -> Iterator[list[pa.Array]]:
        """What is kept, as columns ``id_a, id_b, label_a, label_b, dist``; ``back`` if the block is of the rows' side."""
        null = np.iinfo(np.int64).min
        told = lambda x: pa.array(np.where(x == null, 0, x).astype(np.int32), pa.int32(), mask=x == null)
        at = np.nonzero(self.full)
        for start in range(0, len(at[0]), step):
            cut = tuple(x[start : start + step] for x in at)
            dist = self.dist[cut]
            sides = [(pa.array(self.ids[cut[2]]), told(self.labels[cut[2]])), (pa.array(self.other[cut]), told(self.label[cut]))]
            (id_a, label_a), (id_b, label_b) = reversed(sides) if back else sides
            yield [id_a, id_b, label_a, label_b, number(np.where(np.isinf(dist), np.nan, dist))]


_SPACES: dict[type, np.ndarray] = {}


def _space(rows: int, columns: int, kind: type) -> np.ndarray:
    """A matrix to be filled, at the place of the one before: to ask for new pages takes as long as a product."""
    if kind not in _SPACES or _SPACES[kind].size < rows * columns:
        _SPACES[kind] = np.empty(max(rows * columns, BLOCK * BLOCK), kind)
    return _SPACES[kind][: rows * columns].reshape(rows, columns)


def _gaps(a: Block, b: Block, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances less the own square of each row of ``a``, and the slack of their rounding: one product, in which the squares are a dimension more. Missing ones are infinite.

    ``single`` allows single precision, with its slack, where no square is too great or all are too small for it,
    and the next such call takes the place of what is returned.
    """
    whole = np.isfinite(a.square).all() and np.isfinite(b.square).all()
    most = np.nan_to_num(b.square).max(initial=0)
    kind = np.float32 if single and SINGLE[0] < most < SINGLE[1] and np.nan_to_num(a.square).max(initial=0) < SINGLE[1] else np.float64
    left, right = np.ones((len(a.ids), a.v.shape[1] + 1), kind), np.empty((len(b.ids), b.v.shape[1] + 1), kind)
    left[:, :-1], right[:, :-1], right[:, -1] = -2 * a.v, b.v, b.square
    d = np.matmul(left, right.T, out=_space(len(a.ids), len(b.ids), kind) if single else None)
    if not whole:
        d[~np.isfinite(d)] = np.inf
    return d, (32 if kind is np.float64 else 4) * (a.v.shape[1] + 1) * np.finfo(kind).eps * (np.nan_to_num(a.square) + most)


def _same(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a row with itself."""
    rows = np.flatnonzero(np.isin(a.ids, b.ids))
    i, j = np.nonzero(a.ids[rows][:, None] == b.ids[None, :])
    return rows[i], j


def _candidates(a: Block, b: Block, k: int, by_label: bool, kept: _Kept | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that can be among the ``k`` nearest rows of ``b`` (with each label) for a row of ``a``.

    The rows of a label are cut in runs, ``k`` at least: the k-th of their least distances and
    of those ``kept`` bounds the k-th nearest, with slack for rounding. Only runs with a
    distance within it are looked at again.
    """
    if not (len(a.ids) and len(b.ids)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    groups = b.groups() if by_label else np.zeros(len(b.ids), np.int64)
    order = np.argsort(groups, kind="stable")
    b, groups = b.picked(order), groups[order]
    d, slack = _gaps(a, b, single=True)
    d[_same(a, b)] = np.inf
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    size = np.diff(edges)
    runs = np.minimum(size, np.maximum(k, -(-size // RUN)))
    first = np.cumsum(runs) - runs
    of = np.repeat(np.arange(len(size)), runs)
    start = edges[of] + (np.arange(len(of)) - first[of]) * size[of] // runs[of]
    least = np.minimum.reduceat(d, start, axis=1).T.astype(np.float64)
    bound = np.full((len(size), k, len(a.ids)), np.inf) if kept is None else kept.distances(groups[edges[:-1]]) - np.nan_to_num(a.square, posinf=0.0)
    for n in range(runs.max()):
        at = np.flatnonzero(runs > n)
        x = least[first[at] + n] + slack
        for rank in range(k):
            x, bound[at, rank] = np.maximum(x, bound[at, rank]), np.minimum(x, bound[at, rank])
    limit = bound[:, -1] + slack
    run, row = np.nonzero(least <= limit[of])
    length, flat, offset = np.diff(np.r_[start, len(b.ids)])[run], d.reshape(-1), np.arange(RUN)
    found = []
    for s in range(0, len(run), LOOKS):
        cut = slice(s, s + LOOKS)
        at = (row[cut] * len(b.ids) + start[run[cut]])[:, None] + offset
        near = (flat.take(at, mode="clip") <= limit[of[run[cut]], row[cut]][:, None]) & (offset < length[cut, None])
        found.append(at[near])
    i, j = np.divmod(np.concatenate(found or [np.zeros(0, np.int64)]), len(b.ids))
    pair = a.ids[i] != b.ids[j]
    return i[pair], order[j[pair]]


def _ranked(vectors: DataFrame, queries: DataFrame, k: int, by_label: bool, sides: tuple[bool, ...]) -> DataFrame:
    """``NEAREST`` and ``back``: what tasks keep of nearest rows, asked from the queries' side, the rows' (``back``) or both; blocks meet once."""

    def found(units: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, bytes], _Kept] = {}
        for a, b in units:
            for back in sides:
                me, it = (b, a) if back else (a, b)
                name = back, me.ids.tobytes() + me.square.tobytes()
                held.setdefault(name, _Kept(me, k)).meet(me, it, by_label)
        for (back, _), kept in held.items():
            for columns in kept.rows(back):
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), back))], ["id_a", "id_b", "label_a", "label_b", "dist", "back"])

    return meet(vectors, queries, found, f"{NEAREST}, back boolean", KEPT, WAVES)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, by_label: bool = False, back: bool = False) -> DataFrame:
    """``(id_a, id_b, label_a, label_b, dist, rank)``: the ``k`` nearest other rows of each query by squared distance, of every label if ``by_label``, ids breaking ties.

    ``back`` asks from the rows' side: the ``k`` nearest queries of each row. Tasks keep the
    ``k`` best of what they have seen, so what is shuffled grows with rows, not with pairs.
    """
    me, it, group = ("id_b", "id_a", "label_a") if back else ("id_a", "id_b", "label_b")
    order = Window.partitionBy(me, *([group] if by_label else [])).orderBy(F.sqrt("dist").asc_nulls_last(), it)
    return _ranked(vectors, queries, k, by_label, (back,)).drop("back").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mutual(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(id_a, id_b, label_a, label_b, dist)``: pairs in which the row is the query's nearest of its label, and the query the row's. Blocks meet once for both sides."""
    of = lambda there, back: F.when(F.col("back"), F.col(back)).otherwise(F.col(there))
    order = Window.partitionBy("back", of("id_a", "id_b"), of("label_b", "label_a")).orderBy(F.sqrt("dist").asc_nulls_last(), of("id_b", "id_a"))
    best = _ranked(vectors, queries, 1, True, (False, True)).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    sides = best.groupBy("id_a", "id_b").agg(*[F.min(c).alias(c) for c in ("label_a", "label_b", "dist")], F.count_if(~F.col("back")).alias("there"), F.count_if("back").alias("back"))
    return sides.where("there > 0 AND back > 0").select("id_a", "id_b", "label_a", "label_b", "dist")


def leading(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(id_a, rank, same, any)``: the ``k`` other rows of each query with the greatest rounded cosine, ids breaking ties, and whether any row at all has the query's label.

    Tasks keep the ``k`` best of what they have seen; pairs without a score come last.
    """

    def close(a: Block, b: Block, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs that can reach the bound, by one product in single precision, with slack for its rounding."""
        unit = [np.divide(x.v, n, out=np.zeros_like(x.v), where=n > 0).astype(np.float32) for x, n in ((x, np.sqrt(x.square)[:, None]) for x in (a, b))]
        s = np.matmul(unit[0], unit[1].T, out=_space(len(a.ids), len(b.ids), np.float32))
        least = (bound - 2) / DIGITS - (a.v.shape[1] + 4) * np.finfo(np.float32).eps
        return np.divmod(np.flatnonzero(s >= np.nextafter(least.astype(np.float32), np.float32(-2))[:, None]), len(b.ids))

    def best(kept: _Kept, a: Block, b: Block) -> None:
        bound = DIGITS - np.sqrt(kept.distances(np.zeros(1, np.int64))[0, -1])
        if np.isfinite(bound).all() and np.isfinite(b.v).all():
            i, j = close(a, b, bound)
            with np.errstate(invalid="ignore"):
                score = np.rint((a.v[i] * b.v[j]).sum(1) / (np.sqrt(a.square[i]) * np.sqrt(b.square[j])) * DIGITS)
        else:
            s = cosine(a, b)
            s *= DIGITS
            np.rint(s, out=s)
            s[np.isnan(s)] = -np.inf
            s[_same(a, b)] = -np.inf
            open_ = np.flatnonzero(~np.isfinite(bound))
            if len(open_) and len(b.ids) > k:
                bound[open_] = np.partition(s[open_], len(b.ids) - k, axis=1)[:, len(b.ids) - k]
            i, j = np.divmod(np.flatnonzero(s >= bound[:, None]), len(b.ids))
            score = s[i, j]
        pair = (a.ids[i] != b.ids[j]) & ~(score < bound[i])
        i, j, score = i[pair], j[pair], np.where(np.isnan(score[pair]), -np.inf, score[pair])
        kept.add(i, np.zeros(len(i), np.int64), np.square(DIGITS - score), b.ids[j], b.groups()[j])  # perfect squares: their roots are exact

    def found(units: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[_Kept, np.ndarray]] = {}
        for a, b in units:
            kept, like = held.setdefault(a.ids.tobytes() + a.square.tobytes(), (_Kept(a, k), np.zeros(len(a.ids), bool)))
            best(kept, a, b)
            labels, n = np.unique(b.labels[b.known], return_counts=True)
            if len(labels):
                at = np.minimum(np.searchsorted(labels, a.labels), len(labels) - 1)
                like |= a.known & (np.where(labels[at] == a.labels, n[at], 0) > np.isin(a.ids, b.ids))
        for kept, like in held.values():
            told = dict(zip(kept.ids.tolist(), like.tolist(), strict=True))
            for id_a, id_b, label_a, label_b, dist in kept.rows(False):
                yield pa.RecordBatch.from_arrays([id_a, id_b, label_a, label_b, dist, pa.array([told[i] for i in id_a.to_pylist()], pa.bool_())], ["id_a", "id_b", "label_a", "label_b", "dist", "any"])

    rows = meet(vectors, queries, found, f"{NEAREST}, any boolean", KEPT, WAVES)
    one = Window.partitionBy("id_a")
    ranked = rows.withColumn("rank", F.row_number().over(one.orderBy(F.col("dist").asc_nulls_last(), "id_b"))).withColumn("any", F.max("any").over(one))
    return ranked.where(F.col("rank") <= k).select("id_a", "rank", F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False)).alias("same"), "any")


def orders(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(id_a, id_b, rank)``: all other rows of each query, the greatest rounded cosine first, ids breaking ties; pairs without a score come last.

    A task holds the scores of a few queries with all rows (``HELD`` numbers) and sorts them
    there, so no pair is shuffled. More than ``WHOLE_ROWS`` rows are not broadcast; their
    pairs go through a window.
    """
    n, asked = vectors.count(), queries.count()
    if n > WHOLE_ROWS:
        rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))
        return pairs(vectors, queries, "id_a", "id_b", "score").select("id_a", "id_b", rank.alias("rank"))
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "f8"
    few = max(1, min(64, HELD // max(1, n)))
    tasks = max(1, min(-(-asked // few), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    asks = packed(queries.repartition(tasks), few).select(*[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "labels", "known", "v")])
    rows = packed(vectors.repartition(max(1, -(-n // (4 * BLOCK)))))

    def told(units: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        for ids, met in groupby(units, lambda unit: unit[0].ids.tobytes()):  # all rows meet one block of queries after another
            parts = []
            for a, b in met:
                s = np.rint(cosine(a, b) * DIGITS)
                parts.append((b.ids, np.where(np.isnan(s), 2 * DIGITS + 1, DIGITS - s).astype(np.int32)))
            others_, gaps = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
            if len(others_) != n:
                raise RuntimeError(f"{len(others_)} of {n} rows met a block of queries")
            order = np.argsort(others_, kind="stable")
            others_, place = others_[order], np.arange(len(order))
            for me, gap in zip(np.frombuffer(ids, "i8"), gaps, strict=True):
                key = gap[order].astype(np.int64) << 40 | place  # one number holds the score and the place by id
                key.sort()
                it = others_[key & (1 << 40) - 1]
                it = it[it != me]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(it), me)), pa.array(it), pa.array(np.arange(1, len(it) + 1, dtype=np.int32))], ["id_a", "id_b", "rank"])

    return asks.crossJoin(F.broadcast(rows)).mapInArrow(lambda batches: told(_units(batches, kind)), "id_a long, id_b long, rank int")


def extremes(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(id_a, positive, negative)``: of the rows with each query's label the farthest, of those with another the nearest, by distance to six digits, ids breaking ties; null where there is none.

    Pairs without a distance come last. Tasks keep one row of each a query.
    """
    sides = "far", "near"

    def found(units: Iterator[tuple[Block, Block]]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]] = {}
        for a, b in units:
            b = b.picked(np.argsort(b.ids, kind="stable"))  # the first of equal ones is the least id
            d, masks = rounded(np.sqrt(squared(a, b)), 6), labelled(a, b)
            _, kept = held.setdefault(a.ids.tobytes() + a.square.tobytes(), (a.ids, {side: (np.full(len(a.ids), np.inf), np.full(len(a.ids), -1)) for side in sides}))
            missing, every = np.isnan(d), np.arange(len(a.ids))
            for side, mask in zip(sides, masks, strict=True):
                x = -d if side == "far" else d  # missing ones, then those that do not count, are the greatest
                x = np.where(mask, np.where(missing, np.finfo(float).max, x), np.inf)
                at = x.argmin(1)
                x, it, (best, of) = x[every, at], b.ids[at], kept[side]
                better = (x < best) | ((x == best) & (it < of) & np.isfinite(x))
                best[better], of[better] = x[better], it[better]
        for ids, kept in held.values():
            columns = [pa.array(ids)]
            for best, of in (kept[side] for side in sides):
                columns += [pa.array(best), pa.array(of, mask=np.isinf(best))]
            yield pa.RecordBatch.from_arrays(columns, ["id_a", "far", "far_id", "near", "near_id"])

    rows = meet(vectors, queries, found, "id_a long, far double, far_id long, near double, near_id long", KEPT, WAVES)
    best = lambda side: F.min(F.when(F.col(f"{side}_id").isNotNull(), F.struct(side, f"{side}_id")))[f"{side}_id"]
    return rows.groupBy("id_a").agg(best("far").alias("positive"), best("near").alias("negative"))


def within(vectors: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """``(id_a, id_b, dist)``: all other rows within ``radius`` of each query, by squared distance."""

    def columns(a: Block, b: Block) -> list[pa.Array]:
        d, slack = _gaps(a, b)
        near = d <= (radius * radius * (1 + 1e-12) - np.nan_to_num(a.square) + slack)[:, None]
        i, j = np.divmod(np.flatnonzero(near), len(b.ids))
        dist = exact_at(a, i, b, j)
        keep = (np.sqrt(dist) <= radius) & (a.ids[i] != b.ids[j])
        return [pa.array(x[keep]) for x in (a.ids[i], b.ids[j], dist)]

    return pair_rows(vectors, queries, columns, "id_a long, id_b long, dist double")
