"""Window maps against plain loops: shifts, borders, overlapping windows, images without contrast, unusable images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import pixels as P


def plain(a, b, side, window, step, reach):
    a, b = np.reshape(a, (side, side)), np.reshape(b, (side, side))
    last, best, ssim = side - window, [], []
    for y in range(0, last + 1, step):
        for x in range(0, last + 1, step):
            u, top = a[y : y + window, x : x + window], -1.0
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    ty, tx = min(max(y + dy, 0), last), min(max(x + dx, 0), last)
                    v = b[ty : ty + window, tx : tx + window]
                    if np.ptp(u) > 0 and np.ptp(v) > 0:
                        top = max(top, np.corrcoef(u.ravel(), v.ravel())[0, 1])
            v = b[y : y + window, x : x + window]
            cov = ((u - u.mean()) * (v - v.mean())).mean()
            best.append(top)
            ssim.append(((2 * u.mean() * v.mean() + 1e-4) * (2 * cov + 9e-4)) / ((u.mean() ** 2 + v.mean() ** 2 + 1e-4) * (u.var() + v.var() + 9e-4)))
    return best, ssim


@pytest.mark.parametrize(("side", "window", "step", "reach"), [(8, 4, 4, 1), (9, 3, 2, 2), (6, 6, 1, 3), (7, 2, 5, 0)])
def test_windows_are_the_plain_loops(spark, side, window, step, reach):
    rng = np.random.default_rng(side)
    images = [rng.random(side * side) for _ in range(4)] + [np.full(side * side, 0.3), np.tile(rng.random(side), side)]
    images.append(np.roll(images[0].reshape(side, side), (1, -1), (0, 1)).ravel())
    rows = [(i, j, a.tolist(), b.tolist()) for i, a in enumerate(images) for j, b in enumerate(images)]
    df = spark.createDataFrame(rows, "i int, j int, ea array<double>, eb array<double>").repartition(3)
    got = df.select("i", "j", P.window_matcher(side, window, step, reach)("ea", "eb").alias("w")).collect()
    assert len(got) == len(rows)
    for row in got:
        r, s = plain(images[row["i"]], images[row["j"]], side, window, step, reach)
        assert row["w"]["r"] == pytest.approx(r, abs=1e-7)
        assert row["w"]["ssim"] == pytest.approx(s, abs=1e-7)


def test_unusable_images_have_no_windows(spark):
    ok = [0.5] * 64
    bad = [None, [], [0.5] * 63, [None] + ok[1:], [float("nan")] + ok[1:], [float("inf")] + ok[1:]]
    rows = [(k, ok, b) for k, b in enumerate(bad)] + [(10 + k, b, ok) for k, b in enumerate(bad)] + [(99, ok, ok)]
    df = spark.createDataFrame(rows, "k int, ea array<double>, eb array<double>").coalesce(1)
    met = df.select("k", P.window_matcher()("ea", "eb").alias("w"))
    got = {r["k"]: (r["w"]["r"], r["w"]["ssim"]) for r in met.collect()}
    assert got.pop(99) == ([-1.0] * 4, [1.0] * 4)
    assert set(map(str, got.values())) == {"([], [])"}
    told = met.where("k = 0").select(*P.spread_of(F.col("w.r"), "", 0.7)).first()
    assert tuple(told) == (None,) * 5
    assert met.limit(0).count() == 0


def test_spread_of(spark):
    got = spark.createDataFrame([([0.9, 0.75, 0.1, 0.7],)], "a array<double>").select(*P.spread_of(F.col("a"), "x_", 0.7, 0.8)).first()
    assert got.asDict() == pytest.approx({"x_mean": 0.6125, "x_most": 0.9, "x_least": 0.1, "x_std": float(np.std([0.9, 0.75, 0.1, 0.7])), "x_above_7": 0.5, "x_above_8": 0.25})
