"""Exact neighbours by the triangle inequality: cells about pivots, asked only where a neighbour can be.

Pivots are spread over a bounded sample; each vector belongs to the cell of its nearest
pivot. A question of radius r about q can be answered only by cells whose pivot is at
most 2 r farther than q's own, and whose farthest member reaches that near; within a
cell only by members whose distance from the pivot differs from q's by at most r.
Cells and the questions they get are dealt in blocks, so a crowded cell is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

#: Pivots, rows of the sample that they are spread over, and rows of a cell (or its questions) in one block.
PIVOTS, SAMPLE, BLOCK = 64, 4096, 4096
#: Slack on bounds, so that rounding loses no neighbour.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """Cells of a table: ``members(id, v, cell, gap, block)``, pivots, and each cell's radius and number of blocks."""

    members: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other, each the one farthest from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    taken, gap = [0], np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample)) - 1):
        gap = np.minimum(gap, ((sample - sample[taken[-1]]) ** 2).sum(1))
        taken.append(int(gap.argmax()))
    return sample[taken]


def gaps(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, by differences (the product form loses digits)."""
    return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], axis=1) if len(v) else np.zeros((0, len(pivots)))


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, width))


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS) -> Index:
    """Cells of ``vectors``; rows without a vector are left out, and all vectors have one length."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    n = rows.count()
    sample = rows.sample(min(1.0, SAMPLE / max(n, 1)), seed=7).limit(2 * SAMPLE).select("v").collect() or rows.limit(1).select("v").collect()
    middle = spread(np.array([r["v"] for r in sample]), pivots)

    @F.pandas_udf("cell int, gap double")
    def placed(v: pd.Series) -> pd.DataFrame:
        d = gaps(_stacked(v, middle.shape[1]), middle)
        return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "gap": d.min(1)})

    cells = saved(rows.withColumn("p", placed("v")).select("id", "v", "p.cell", "p.gap"), "cells")
    radii, blocks = np.full(len(middle), -np.inf), np.zeros(len(middle), np.int64)
    for r in cells.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():  # a row a pivot
        radii[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["n"] // BLOCK)
    return Index(cells.withColumn("block", F.pmod(F.xxhash64("id"), _of(blocks, "cell"))), middle, radii, blocks)


def _of(values: np.ndarray, cell: str) -> Column:
    return F.get(F.array(*[F.lit(int(max(1, v))) for v in values]), F.col(cell))


def _asked(index: Index, queries: DataFrame, own: str) -> DataFrame:
    """``queries(id, v, radius)``, each once for every cell and block that can answer; ``own``: ``only``, ``not`` or ``all`` cells but for bounds."""
    middle, radii = index.pivots, index.radii

    @F.pandas_udf("cells array<int>, gaps array<double>")
    def reached(v: pd.Series, radius: pd.Series) -> pd.DataFrame:
        d = gaps(_stacked(v, middle.shape[1]), middle)
        r = radius.to_numpy()[:, None] + SLACK
        least = d.min(1, keepdims=True)
        at = d.argmin(1)
        mine = np.zeros(d.shape, bool)
        mine[np.arange(len(d)), at] = True
        near = (d - least <= 2 * r) & (d - r <= radii[None, :]) & np.isfinite(radii)[None, :]
        near = mine if own == "only" else near & ~mine if own == "not" else near
        return pd.DataFrame({"cells": [np.flatnonzero(x).astype(np.int32) for x in near], "gaps": [x[y] for x, y in zip(d, near, strict=True)]})

    out = queries.withColumn("p", reached("v", "radius")).select("id", "v", "radius", F.explode(F.arrays_zip(F.col("p.cells").alias("cell"), F.col("p.gaps").alias("gap"))).alias("c"))
    out = out.select("id", "v", "radius", "c.cell", "c.gap")
    return out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _of(index.blocks, "cell") - 1)))


PAIRS = "id_a long, id_b long, dist double, computed long"


def _met(index: Index, asked: DataFrame, k: int | None) -> DataFrame:
    """Pairs within the questions' radii (the ``k`` nearest of a block, if given); a row of distance -1 has the number of distances that a block ``computed``."""
    sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.first(_of(index.blocks, "cell")) / BLOCK).alias("parts"))
    parts = F.broadcast(sizes)  # a row a pivot
    left = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    right = index.members.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("gap")
            v, gap, ids = _stacked(b["v"], 0), b["gap"].to_numpy(), b["id"].to_numpy()
            radius = a["radius"].to_numpy()
            low, high = (np.searchsorted(gap, a["gap"].to_numpy() + s * (radius + SLACK), side) for s, side in ((-1, "left"), (1, "right")))
            for i, (q, me) in enumerate(zip(a["v"], a["id"], strict=True)):
                d = ((v[low[i] : high[i]] - q) ** 2).sum(1)
                near = np.flatnonzero((np.sqrt(d) <= radius[i]) & (ids[low[i] : high[i]] != me))
                if k is not None and len(near) > k:
                    near = near[np.lexsort((ids[low[i] : high[i]][near], d[near]))[:k]]
                out.append((np.full(len(near), me), ids[low[i] : high[i]][near], d[near], np.zeros(len(near), np.int64)))
            out.append((np.array([-1]), np.array([-1]), np.array([-1.0]), np.array([int((high - low).sum())])))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("id_a", "id_b", "dist", "computed"), columns, strict=True)))

    keys = ["cell", "block", "part"]
    a, b = left.select("id", "v", "radius", "gap", *keys).groupBy(*keys), right.select("id", "v", "gap", *keys).groupBy(*keys)
    return a.cogroup(b).applyInPandas(meet, PAIRS)


def within(index: Index, queries: DataFrame, radius: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(id_a, id_b, dist)``: all other members within ``radius`` of each query, by squared distance."""
    asks = queries.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"), F.lit(float(radius)).alias("radius"))
    return _met(index, _asked(index, asks, "all"), None).where("dist >= 0").drop("computed")


def nearest(index: Index, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(id_a, id_b, dist, rank)``: the ``k`` nearest other members of each query, ids breaking ties.

    The own cell is asked first; its k-th distance bounds what other cells are asked for.
    A query whose cell has fewer than ``k`` others asks all cells.
    """
    asks = queries.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    order = Window.partitionBy("id_a").orderBy("dist", "id_b")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own = _met(index, _asked(index, asks.withColumn("radius", F.lit(float("inf"))), "only"), k)
    first = saved(best(own.where("dist >= 0").drop("computed")), "nearest")
    bound = first.where(F.col("rank") == k).select(F.col("id_a").alias("id"), F.sqrt("dist").alias("radius"))
    wider = asks.join(bound, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    others = _met(index, _asked(index, wider, "not"), k)
    return best(first.drop("rank").unionByName(others.where("dist >= 0").drop("computed")))
