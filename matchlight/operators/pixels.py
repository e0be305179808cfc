"""Image-quality, cell and tile jobs over a pixel table ``(image_id, y, x, value)``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(pixels: DataFrame, offsets: dict[str, tuple[int, int]]) -> DataFrame:
    """Pixels with the values at the given ``(dy, dx)``; pixels at a border that lack one are left out.

    Each pixel sends its value to the places it neighbours and one aggregation per
    place gathers them: one shuffle for any stencil.
    """
    sends = F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k")) for k, (dy, dx) in {"value": (0, 0), **offsets}.items()])
    sent = pixels.select("image_id", "value", F.explode(sends).alias("s")).select("image_id", "s.y", "s.x", "s.k", "value")
    out = sent.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(k) for k in ("value", *offsets)])
    return out.dropna()


RING = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1)}


def sobel(pixels: DataFrame) -> DataFrame:
    p = neighbours(pixels, RING)
    gx, gy = "(ne + 2 * e + se) - (nw + 2 * w + sw)", "(sw + 2 * s + se) - (nw + 2 * n + ne)"
    return p.selectExpr("image_id", "y", "x", f"{gx} AS gx", f"{gy} AS gy").withColumn("magnitude", F.sqrt(F.expr("gx * gx + gy * gy"))).withColumn("direction", F.atan2("gy", "gx"))


def laplacian(pixels: DataFrame) -> DataFrame:
    return neighbours(pixels, {k: RING[k] for k in "nsew"}).selectExpr("image_id", "n + s + e + w - 4 * value AS lap")


def local_binary(pixels: DataFrame) -> DataFrame:
    """Uniform local binary pattern of each inner pixel: ones if at most two changes around the ring, else 9."""
    ring = F.array(*[(F.col(k) >= F.col("value")).cast("int") for k in RING])
    p = neighbours(pixels, RING).withColumn("ring", ring)
    changes = F.aggregate(F.transform("ring", lambda b, i: (b != F.get("ring", F.when(i == 7, 0).otherwise(i + 1))).cast("int")), F.lit(0), lambda a, b: a + b)
    ones = F.aggregate("ring", F.lit(0), lambda a, b: a + b)
    return p.select("image_id", "y", "x", F.when(changes <= 2, ones).otherwise(9).alias("code"))


def histogram(pixels: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    b = F.least(F.greatest(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("long")
    return pixels.groupBy("image_id", b.alias("bin")).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame) -> DataFrame:
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image_id")))
    return p.groupBy("image_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity"))


def cells(pixels: DataFrame, size: int, step: int, last: int) -> DataFrame:
    """Pixels with every cell ``(cy, cx)`` of side ``size`` and stride ``step`` that covers them; cells are 0..last."""
    covers = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step)).cast("int"), F.least(F.lit(last), F.floor(F.col(c) / step)).cast("int"))
    return pixels.withColumn("cy", F.explode(covers("y"))).withColumn("cx", F.explode(covers("x")))


#: Weights of the values along a cell's side whose sum is the mean gradient: central differences inside, one-sided ones at the ends.
SLOPE = {4: (-0.375, 0.125, -0.125, 0.375)}


def cell_moves(side: int = 8, size: int = 4, shift: int = 1) -> list[tuple[int, int, int, list[int], list[int]]]:
    """``(cell, dy, dx, pa, pb)``: for each cell and shift, the places in one image and those they meet in the other."""
    out, per = [], side // size
    for cell, dy, dx in ((k, c, d) for k in range(per * per) for c in range(-shift, shift + 1) for d in range(-shift, shift + 1)):
        at = [(y, x) for y in range(size) for x in range(size) if 0 <= y + dy < size and 0 <= x + dx < size]
        place = lambda y, x: (cell // per * size + y) * side + cell % per * size + x  # noqa: B023, E731
        out.append((cell, dy, dx, [place(y, x) for y, x in at], [place(y + dy, x + dx) for y, x in at]))
    return out


def cell_slopes(side: int = 8, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of an image's values, a column a cell, that give the mean gradient to the right and downwards."""
    per = side // size
    right, down = np.zeros((side * side, per * per)), np.zeros((side * side, per * per))
    for cell in range(per * per):
        for y in range(size):
            for x in range(size):
                place = (cell // per * size + y) * side + cell % per * size + x
                right[place, cell], down[place, cell] = SLOPE[size][x] / size, SLOPE[size][y] / size
    return right, down


#: What ``cell_matcher`` returns for a pair: an entry a cell, then the vote's count, mean correlation and convergence.
MATCHED = "ccf array<double>, dy array<int>, dx array<int>, theta array<double>, is_cmc array<boolean>, n long, mean double, convergence double"


def cell_matcher(least: float = 0.2, limit: float = 20.0, turn: float = 15.0, side: int = 8, size: int = 4, shift: int = 1):
    """A vectorised function of two image columns.

    Per cell: the best normalised correlation over shifts, that shift, the turn of the
    gradient, and whether the cell is congruent: correlated at ``least``, within
    ``limit`` and ``turn`` of the median of cells with any correlation. A batch of pairs
    is two matrices and each move a product of their columns, so a pair stays one row:
    nothing is exploded, sorted or shuffled.
    """
    moves, cells_ = cell_moves(side, size, shift), (side // size) ** 2
    right, down = cell_slopes(side, size)

    def matched(ea: pd.Series, eb: pd.Series) -> pd.DataFrame:
        a, b = (np.stack(s.to_list()).astype(np.float64) if len(s) else np.zeros((0, side * side)) for s in (ea, eb))
        ccf = np.full((len(a), cells_), -np.inf)
        dy, dx = np.zeros((2, len(a), cells_), np.int32)
        for cell, down_by, right_by, pa, pb in moves:
            u, v = a[:, pa], b[:, pb]
            norm = (u * u).sum(1) * (v * v).sum(1)
            now = np.round(np.where(norm > 0, (u * v).sum(1) / np.sqrt(np.where(norm > 0, norm, 1)), 0), 9)
            best = now >= ccf[:, cell]  # moves ascend, so equal ones go to the last
            for to, value in ((ccf, now), (dy, down_by), (dx, right_by)):
                to[:, cell] = np.where(best, value, to[:, cell])
        angle = lambda e: np.degrees(np.arctan2(e @ right, e @ down))
        turned = angle(b) - angle(a)
        theta = np.round(np.where(turned > 180, turned - 360, np.where(turned < -180, turned + 360, turned)), 6)

        ordered = lambda x: np.sort(np.where(ccf > 0, x, np.inf), axis=1)
        seen, row = (ccf > 0).sum(1), np.arange(len(a))
        voted = ccf >= least
        for x, most in ((dy, limit), (dx, limit), (theta, turn)):
            o = ordered(x)
            middle = (o[row, np.maximum(seen - 1, 0) // 2] + o[row, np.minimum(seen // 2, cells_ - 1)]) / 2
            voted &= (np.abs(x - middle[:, None]) <= most) & (seen > 0)[:, None]
        n = voted.sum(1)
        mean = lambda x: np.where(voted, x, 0).sum(1) / np.maximum(n, 1)
        spread = sum(np.sqrt(mean((x - mean(x)[:, None]) ** 2)) / 10 for x in (theta, dx, dy))
        columns = {"ccf": ccf, "dy": dy, "dx": dx, "theta": theta, "is_cmc": voted}
        return pd.DataFrame({k: list(v) for k, v in columns.items()} | {"n": n, "mean": mean(ccf), "convergence": np.where(n >= 3, 1 / (1 + spread), 0.0)})

    return F.pandas_udf(matched, MATCHED)


def cell_match(pairs: DataFrame, a: str = "ea", b: str = "eb", name: str = "met", **limits: float) -> DataFrame:
    """``pairs`` with a struct ``name`` of ``MATCHED`` for the images ``a`` and ``b``, arrays of values."""
    return pairs.withColumn(name, cell_matcher(**limits)(a, b))


def cell_table(matched: DataFrame, name: str = "met", side: int = 8, size: int = 4) -> DataFrame:
    """A row a cell of ``cell_match``: ``(id_a, id_b, cy, cx, ccf, dy, dx, theta, is_cmc)``."""
    per = side // size
    long = matched.select("id_a", "id_b", F.posexplode(F.arrays_zip(*[F.col(f"{name}.{k}").alias(k) for k in ("ccf", "dy", "dx", "theta", "is_cmc")])).alias("c", "x"))
    return long.selectExpr("id_a", "id_b", f"CAST(c DIV {per} AS INT) AS cy", f"CAST(c % {per} AS INT) AS cx", "x.*")


def cell_result(matched: DataFrame, least_cells: int = 6, name: str = "met", total: int = 4) -> DataFrame:
    """``matched`` with the vote's score, verdict and confidence beside count and convergence in ``name``."""
    m = F.col(name)
    sure = F.least(F.lit(1.0), m["mean"] * m["n"] / least_cells * (1 + m["convergence"]))
    return matched.withColumn(name, F.struct(m["n"].alias("n"), (m["n"] / total).alias("score"), (m["n"] >= least_cells).alias("is_match"), m["convergence"].alias("convergence"), sure.alias("confidence")))


def pair_quality(pairs: DataFrame) -> DataFrame:
    """MSE, PSNR, global SSIM and correlation of ``pairs(id_a, id_b, va, vb)``, the values of two images at the same places."""
    c1, c2 = 1e-4, 9e-4
    s = pairs.groupBy("id_a", "id_b").agg(
        F.avg(F.pow(F.col("va") - F.col("vb"), F.lit(2))).alias("mse"), F.corr("va", "vb").alias("r"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"), F.var_pop("va").alias("sa"), F.var_pop("vb").alias("sb"), F.covar_pop("va", "vb").alias("sab")
    )
    ssim = f"((2 * ma * mb + {c1}) * (2 * sab + {c2})) / ((ma * ma + mb * mb + {c1}) * (sa + sb + {c2}))"
    return s.withColumn("ssim", F.expr(ssim)).withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(1 / F.col("mse"))))


def window_places(side: int, window: int, step: int, reach: int) -> dict[tuple[int, int], list[int]]:
    """For each shift, the windows that may be met there, by number: a place beyond the border is moved to it."""
    starts, last, found = range(0, side - window + 1, step), side - window, {}
    for i, y in enumerate(starts):
        for j, x in enumerate(starts):
            for to_y in {min(max(y + d, 0), last) for d in range(-reach, reach + 1)}:
                for to_x in {min(max(x + d, 0), last) for d in range(-reach, reach + 1)}:
                    found.setdefault((to_y - y, to_x - x), []).append(i * len(starts) + j)
    return found


def _area_sums(values: np.ndarray, y: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Sums over windows from ``(y, x)`` of a batch of images: four look-ups each in the summed areas."""
    area = np.pad(values.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    return area[:, y + window, x + window] - area[:, y, x + window] - area[:, y + window, x] + area[:, y, x]


#: Share of a window's mean square below which its variance is rounding.
FLAT = 1e-12
#: What ``window_matcher`` gives for a pair: an entry a window, row by row.
WINDOWS = "r array<double>, ssim array<double>"


def window_matcher(side: int = 8, window: int = 4, step: int = 4, reach: int = 1):
    """A vectorised function of two image columns, arrays of ``side`` times ``side`` values from 0 to 1.

    Per window of the first image: the greatest correlation with a window of the second
    within ``reach``, at least -1 (windows of one value have no correlation), and the
    structural similarity of the two windows at the same place, with population variances.
    Sums are four look-ups in summed areas: of values and squares once an image, of
    products once a shift, for all windows of a batch of pairs. Correlations are rounded to
    nine digits. Without either image, or where one has a null, NaN or infinite value or
    another length, both arrays are empty.
    """
    places, area = window_places(side, window, step, reach), float(window * window)
    starts = np.arange(0, side - window + 1, step)
    wy, wx = np.repeat(starts, len(starts)), np.tile(starts, len(starts))
    c1, c2 = 1e-4, 9e-4

    def usable(e) -> bool:
        return e is not None and len(e) == side * side and bool(np.isfinite(np.asarray(e, np.float64)).all())

    def matched(ea: pd.Series, eb: pd.Series) -> pd.DataFrame:
        good = np.array([usable(u) and usable(v) for u, v in zip(ea, eb, strict=True)], bool)
        out = pd.DataFrame({"r": [[]] * len(ea), "ssim": [[]] * len(ea)}, dtype=object)
        if not good.any():
            return out
        a, b = (np.stack(s[good].to_list()).astype(np.float64).reshape(-1, side, side) for s in (ea, eb))
        sums = lambda v, at, dy=0, dx=0: _area_sums(v, wy[at] + dy, wx[at] + dx, window)
        every = np.arange(len(wy))
        ma, mb = sums(a, every) / area, sums(b, every) / area
        va, vb = sums(a * a, every) / area - ma * ma, sums(b * b, every) / area - mb * mb
        best, ssim = np.full(ma.shape, -1.0), np.zeros(ma.shape)
        squares = b * b
        for (dy, dx), at in places.items():
            at = np.array(at)
            moved = np.zeros_like(b)
            moved[:, max(-dy, 0) : side - max(dy, 0), max(-dx, 0) : side - max(dx, 0)] = b[:, max(dy, 0) : side + min(dy, 0), max(dx, 0) : side + min(dx, 0)]
            mean = sums(b, at, dy, dx) / area
            both = sums(a * moved, at) / area - ma[:, at] * mean
            power = sums(squares, at, dy, dx) / area
            there = power - mean * mean
            norm = va[:, at] * there
            flat = (va[:, at] <= FLAT * (va[:, at] + ma[:, at] ** 2)) | (there <= FLAT * power)
            r = np.where(flat, -1.0, np.clip(np.round(both / np.sqrt(np.where(flat, 1, norm)), 9), -1, 1))
            best[:, at] = np.maximum(best[:, at], r)
            if (dy, dx) == (0, 0):
                ssim[:, at] = ((2 * ma[:, at] * mean + c1) * (2 * both + c2)) / ((ma[:, at] ** 2 + mean**2 + c1) * (va[:, at] + vb[:, at] + c2))
        for column, values in (("r", best), ("ssim", np.round(ssim, 9))):
            out.loc[good, column] = pd.Series(list(values), index=out.index[good])
        return out

    return F.pandas_udf(matched, WINDOWS)


def spread_of(a: Column, name: str, *above: float) -> list[Column]:
    """Mean, greatest, least and deviation of an array, and the shares of entries above each limit; null for an empty one."""
    n, total = F.size(a), lambda f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    mean = F.try_divide(total(lambda v: v), n)
    share = lambda limit: F.try_divide(total(lambda v: F.when(v > limit, 1.0).otherwise(0.0)), n)
    shares = [share(x).alias(f"{name}above_{round(x * 10)}") for x in above]
    deviation = F.sqrt(F.try_divide(total(lambda v: F.pow(v - mean, F.lit(2))), n))
    return [mean.alias(f"{name}mean"), F.array_max(a).alias(f"{name}most"), F.array_min(a).alias(f"{name}least"), deviation.alias(f"{name}std"), *shares]
