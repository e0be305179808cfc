"""The surface for user functions: statistics, similarities, classifiers, tiles, rules and named matchers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B

#: Rows from which user functions get their pieces of groups: a call costs as much as thousands of rows.
PIECE = 250_000
MATCHERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def matcher(name: str) -> Callable:
    """Register a matcher ``(vectors, queries) -> rows`` under a name."""

    def add(f: Callable) -> Callable:
        MATCHERS[name] = f
        return f

    return add


def statistic(f: Callable[[pd.Series], float]) -> Callable[[str], Column]:
    """A grouped aggregate from a function of a sample, which gets a whole group at once; ``merged_statistic`` is for large groups."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> float:
        return float(f(x))

    return run


def merged_statistic(rows: DataFrame, keys: list[str], value: str, parts: dict[str, tuple[Callable[[pd.Series], float], str]], finish: Column, name: str) -> DataFrame:
    """``(*keys, name)``: a statistic of each group's ``value`` from what user functions say of pieces of it.

    ``parts`` names functions of a piece and how their results add up: ``sum``, ``min`` or
    ``max``; ``finish`` makes the statistic of them. Pieces are what some ``PIECE`` rows hold
    of a group, so a group of any size is never in one call. Rows without a value are left
    out; a null key is a key like any other.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema.fields}
    how = {"sum": F.sum, "min": F.min, "max": F.max}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= PIECE:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            held = batch.filter(batch.column(value).is_valid())
            # whole numbers beside nulls stay whole numbers
            number = held.select(keys).to_pandas(integer_object_nulls=True).groupby(keys, dropna=False, sort=False).ngroup()
            first = pa.array(np.flatnonzero(~number.duplicated().to_numpy()))
            found = held.column(value).to_pandas().groupby(number.to_numpy(), sort=True)
            said = [pa.array(found.agg(f).astype(float).to_numpy()) for f, _ in parts.values()]
            yield pa.RecordBatch.from_arrays([held.column(k).take(first).combine_chunks() for k in keys] + said, names=[*keys, *parts])

    schema = ", ".join([f"`{k}` {t}" for k, t in types.items()] + [f"{n} double" for n in parts])
    met = rows.select(*keys, value).mapInArrow(pieces, schema).groupBy(*keys).agg(*[how[kind](n).alias(n) for n, (_, kind) in parts.items()])
    return met.select(*keys, finish.alias(name))


def merged_pairs(vectors: DataFrame, queries: DataFrame, keys: list[str], value: str, parts: dict[str, tuple[Callable[[pd.Series], float], str]], finish: Column, name: str) -> DataFrame:
    """``merged_statistic`` of the pairs of queries and other rows, by ``label_a`` or both labels; ``value`` is ``score`` or ``distance``.

    User functions are called in the tasks that make the values, with those of a block and a key, so a pair is never a row.
    """
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    # bounds of equal labels in a sorted block; all rows are one piece where the label is no key
    cuts = lambda g, key: np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) if key in keys else np.zeros(len(g) - 1, bool), True])

    def columns(a: B.Block, b: B.Block) -> list[pa.Array]:
        a, b = (x.picked(np.argsort(x.groups(), kind="stable")) for x in (a, b))
        x = B.rounded(B.cosine(a, b), 6) if value == "score" else np.sqrt(B.squared(a, b))
        x[~B.others(a, b)] = np.nan
        left, right = cuts(a.groups(), "label_a"), cuts(b.groups(), "label_b")
        said: list[list] = []
        for i, i_end in zip(left[:-1], left[1:], strict=True):
            for j, j_end in zip(right[:-1], right[1:], strict=True):
                piece = x[i:i_end, j:j_end].ravel()
                missing = np.isnan(piece)
                piece = pd.Series(piece[~missing] if missing.any() else piece, name=value)
                if len(piece):
                    labels = {"label_a": int(a.labels[i]) if a.known[i] else None, "label_b": int(b.labels[j]) if b.known[j] else None}
                    said.append([labels[k] for k in keys] + [float(f(piece)) for f, _ in parts.values()])
        return [pa.array([row[k] for row in said], pa.int32() if k < len(keys) else pa.float64()) for k in range(len(keys) + len(parts))]

    schema = ", ".join([f"{k} int" for k in keys] + [f"{n} double" for n in parts])
    met = B.pair_rows(vectors, queries, columns, schema).groupBy(*keys).agg(*[how[kind](n).alias(n) for n, (_, kind) in parts.items()])
    return met.select(*keys, finish.alias(name))


def classify(rows: DataFrame, f: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """``rows`` with ``predicted`` from a classifier that maps a batch of rows to labels; what it was trained on comes as columns."""
    names = rows.columns

    @F.pandas_udf("long")
    def run(row: pd.DataFrame) -> pd.Series:
        return f(row)

    return rows.withColumn("predicted", run(F.struct(*names)))


def on_tiles(pixels: DataFrame, size: int, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``f`` on each tile of ``size`` x ``size`` pixels, returning the tile's pixels.

    Tiles follow each other in their task; one that runs over a batch's end waits for the
    next batch, so ``f`` always gets a whole tile, and a task holds a batch and a tile.
    """
    keys, columns = ["image_id", "ty", "tx"], ["image_id", "y", "x", "value"]

    def cut(rows: pd.DataFrame) -> list[int]:
        new = np.zeros(len(rows) - 1, bool)
        for x, gone in ((rows[k].to_numpy(), rows[k].isna().to_numpy()) for k in keys):
            new |= (x[1:] != x[:-1]) & ~(gone[1:] & gone[:-1])
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            starts = cut(rows)
            rest = rows.iloc[starts[-1] :]
            if len(starts) > 1:
                yield pd.concat([f(rows.iloc[i:j])[columns] for i, j in zip(starts[:-1], starts[1:], strict=True)])
        if rest is not None:
            yield f(rest)[columns]

    tiles = pixels.withColumn("ty", F.expr(f"y DIV {size}")).withColumn("tx", F.expr(f"x DIV {size}"))
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each, "image_id long, y int, x int, value double")


def rule(f: Callable[[pd.Series], pd.Series], message: str) -> Callable[[Column], Column]:
    """A custom rule on a value as ``struct<ok, message>``."""

    @F.pandas_udf("struct<ok:boolean,message:string>")
    def run(x: pd.Series) -> pd.DataFrame:
        ok = f(x)
        return pd.DataFrame({"ok": ok, "message": ["" if o else message for o in ok]})

    return run
