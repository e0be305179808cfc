"""Ordered work without one task that sees all rows: running values over ranges, and Kendall's tau by inversions counted in ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

#: Value cells of one task when inversions are counted.
CELLS = 1_000_000
#: Rows of a frame's chunk, apart from those that it sees of the chunk before.
FRAME = 50_000


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, written once so that every reader sees the same ranges; ``_part`` numbers them upwards."""
    return saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, order: list[str], kind: str, **values: Column) -> DataFrame:
    """Running ``sum`` or ``max`` of ``values``, the row itself included, in the order of ``ranged`` rows; each has the name it is given by.

    ``order`` names no two rows alike. Each range runs by itself, beginning with what the
    ranges before it give, a table of one row per range. Nulls are passed over.
    """
    total, both = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest)}[kind]
    rows = rows.withColumns({f"_v_{k}": v for k, v in values.items()})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_part").agg(*[total(f"_v_{k}").alias(f"_t_{k}") for k in values]).select("_part", *[total(f"_t_{k}").over(before).alias(f"_b_{k}") for k in values])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({f"_o_{k}": total(f"_v_{k}").over(upto) for k in values}).join(F.broadcast(carried), "_part")
    met = met.withColumns({k: F.coalesce(both(F.col(f"_o_{k}"), F.col(f"_b_{k}")), f"_o_{k}", f"_b_{k}") for k in values})
    return met.drop(*[f"{x}{k}" for x in ("_v_", "_o_", "_b_") for k in values])


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_place``, from 1 by ``order`` in each group of ``by``, ``_rank``, where equal rows share the least place, and ``_size`` of the group.

    A group is as many tasks as it has ranges: rows are numbered within range and group,
    and shifted by the group's rows in the ranges before, a table of a row per range and
    group. A null in ``by`` is a value like any other.
    """
    rows = ranged(df, *by, *order)
    parts = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(Window.partitionBy(*by)).alias("_size"),
    )
    own = Window.partitionBy("_part", *by).orderBy(*order)
    numbered = rows.withColumns({"_place": F.row_number().over(own), "_rank": F.rank().over(own)})
    same = numbered["_part"] == shifts["_p"]
    for c in by:
        same = same & numbered[c].eqNullSafe(shifts[f"_by_{c}"])
    met = numbered.join(shifts, same).withColumns({c: F.col(c) + F.col("_shift") for c in ("_place", "_rank")})
    return met.drop("_part", "_p", "_shift", *[f"_by_{c}" for c in by])


def framed(df: DataFrame, order: list[str], back: int) -> DataFrame:
    """Chunks of rows that follow each other in ``order``, each beginning with the ``back`` rows before it.

    A window of at most ``back`` rows before the current one, partitioned by ``_chunk`` and
    any leading columns of ``order`` and ordered by ``_n``, then gives at rows that are not
    ``_halo`` what it would give over the whole table, and no chunk grows with a key.
    ``_n`` numbers the rows of a chunk, below 1 in the halo.
    """
    size = max(FRAME, back)
    rows = running(ranged(df, *order), order, "sum", _at=F.lit(1).cast("long"))
    chunk, place = F.floor((F.col("_at") - 1) / size), F.pmod(F.col("_at") - 1, F.lit(size))
    seen = F.when(place >= size - back, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    dealt = rows.withColumn("_own", chunk).withColumn("_chunk", F.explode(seen))
    return dealt.withColumn("_halo", F.col("_own") < F.col("_chunk")).withColumn("_n", F.col("_at") - F.col("_chunk") * size).drop("_own", "_at")


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """The number of pairs, weighted by both ``n``, that ``x`` and ``y`` order strictly contrary to each other; exact at any size.

    From the highest bit of the rank of y on, rows of equal higher bits stand in the
    order of x; a pair counts at the bit that tells its ranks apart.
    """
    if not len(x):
        return 0
    order = np.lexsort((y, x))
    rank, w = np.unique(y, return_inverse=True)[1].astype(np.int64)[order], n.astype(np.int64)[order]
    # the rows of a level add up to less than (sum of n) squared; beyond 63 bits Python's own integers add them
    wide = int(w.sum()) ** 2 >= 2**62
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        one = (rank >> bit) & 1
        ones = np.cumsum(w * one)
        start = np.flatnonzero(np.diff(group, prepend=-1))
        base = (ones - w * one)[start]
        above = ones - np.repeat(base, np.diff(np.append(start, len(group))))
        zero = one == 0
        total += sum(a * b for a, b in zip(above[zero].tolist(), w[zero].tolist(), strict=True)) if wide else int((above[zero] * w[zero]).sum())
        moved = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[moved], w[moved]
    return total


def _counted(cells: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """``(d)``, the inversions of each group of ``cells(n)``, as a decimal."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [str(inversions(rows[x].to_numpy(), rows[y].to_numpy(), rows["n"].to_numpy()))]})

    return cells.groupBy(by).applyInPandas(count, "d string").select(F.col("d").cast("decimal(38,0)").alias("d"))


def _dealt(cells: DataFrame, column: str, parts: int) -> Column:
    """Bins of ``column`` in its order: odd ones hold one value, which is frequent or a bound; even ones lie between two bounds."""
    (cuts,) = cells.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()  # parts - 1 values
    bounds = np.unique(np.array(cuts, float))

    @F.pandas_udf("int")
    def bin_of(v: pd.Series) -> pd.Series:
        left, right = np.searchsorted(bounds, v.to_numpy(), "left"), np.searchsorted(bounds, v.to_numpy(), "right")
        return pd.Series((left + right).astype(np.int32))

    return bin_of(F.col(column).cast("double"))


def discordant(cells: DataFrame, per_task: int = CELLS) -> int:
    """Pairs of rows ordered strictly contrary by ``cells(x double, y double, n long)``, whose (x, y) are distinct.

    Both columns are dealt into bins of some ``per_task`` cells. A contrary pair lies in
    one bin of x, or in two bins of x and one of y, or in two of both; the first two are
    counted bin by bin, and the third is the same question about cells of bins, which are
    fewer. A bin of one value holds no contrary pair of its own, so a frequent value is no task.
    """
    total = 0
    while True:
        size = cells.count()
        if size <= per_task:
            got = _counted(cells.withColumn("all", F.lit(0)), "all", "x", "y").agg(F.sum("d")).first()[0]
            return total + int(got or 0)
        parts = -(-size // per_task) + 1
        dealt = saved(cells.withColumn("bx", _dealt(cells, "x", parts)).withColumn("by", _dealt(cells, "y", parts)), "binned")
        inside = _counted(dealt.where("bx % 2 = 0"), "bx", "x", "y").union(_counted(dealt.where("by % 2 = 0"), "by", "bx", "y"))
        total += int(inside.agg(F.sum("d")).first()[0] or 0)
        after = saved(dealt.groupBy(F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y")).agg(F.sum("n").alias("n")), "bins")
        if after.count() >= size:
            raise ValueError(f"{size} cells in {parts} bins a side are no fewer cells of bins: raise per_task to the root of their number")
        cells = after


def kendall(df: DataFrame, x: str, y: str, per_task: int = CELLS) -> DataFrame:
    """One row: ``n``, tau-b, z and the two-sided p of the normal limit, both corrected for ties.

    Rows with a null or NaN in either column are left out; tau is null where a column
    does not vary, z below three rows. Contrary pairs are counted exactly; tied ones in doubles.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cells = saved(rows.groupBy("x", "y").agg(F.count("*").alias("n")), "cells")
    d = discordant(cells, per_task)
    added = lambda m, **terms: [F.sum(F.expr(f"CAST({m} AS DOUBLE) * ({m} - 1){t}")).alias(k) for k, t in terms.items()]
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("t")).agg(*added("t", **{f"p{c}": "", f"q{c}": " * (t - 2)", f"r{c}": " * (2 * t + 5)"}))
    both = cells.agg(*added("n", pb=""), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
    one = both.crossJoin(side("x")).crossJoin(side("y")).withColumn("m", F.expr("n * (n - 1)")).withColumn("s", F.expr("(m - px - py + pb) / 2") - 2 * F.lit(float(d)))  # one row each
    tau = F.expr("2 * s / m / nullif(sqrt((m - px) / m * ((m - py) / m)), 0)")
    spread = F.expr("CASE WHEN n > 2 THEN (m * (2 * n + 5) - rx - ry) / 18 + px * py / (2 * m) + qx * qy / (9 * m * (n - 2)) END")
    from .statistics import normal_p

    return one.withColumn("z", F.col("s") / F.sqrt(F.nullif(spread, F.lit(0.0)))).select(F.col("n").cast("long").alias("n"), tau.alias("tau"), "z", F.expr(normal_p("z")).alias("p"))
