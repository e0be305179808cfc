"""Neighbours by cells against brute force; order statistics against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import metric as N
from matchlight.operators import statistics as S


@pytest.fixture(scope="module")
def crowds(spark):
    """Forty clusters in 8 dimensions, a third of the rows in one of them, copies, and one row without a vector."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 8)) * 10
    of = np.where(rng.random(1200) < 0.33, 0, rng.integers(0, 40, 1200))
    v = centre[of] + rng.normal(size=(1200, 8))
    v[1100:1110] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def all_distances(v):
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return d


def test_nearest_is_brute_force(crowds, monkeypatch):
    v, df = crowds
    monkeypatch.setattr(N, "BLOCK", 100)
    d = all_distances(v)
    got = {}
    for r in N.nearest(N.build(df), df, 5).collect():
        got.setdefault(r["id_a"], {})[r["rank"]] = r["id_b"]
    want = {i: dict(enumerate(np.lexsort((np.arange(len(v)), d[i]))[:5].tolist(), 1)) for i in range(len(v))}
    assert got == want


def test_within_is_brute_force(crowds, monkeypatch):
    v, df = crowds
    monkeypatch.setattr(N, "BLOCK", 100)
    asked = df.where("vec_id % 3 = 0")
    got = {(r["id_a"], r["id_b"]) for r in N.within(N.build(df), asked, 3.0).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.sqrt(all_distances(v)) <= 3.0), strict=True) if i % 3 == 0}


def test_most_distances_are_not_computed(crowds):
    """On clustered vectors fewer than three in ten distances are computed."""
    v, df = crowds
    index = N.build(df)
    asks = df.where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(6.0).alias("radius"))
    share = N._met(index, N._asked(index, asks, "all"), None).agg(F.sum("computed")).first()[0] / len(v) ** 2
    assert 0 < share < 0.3


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert N.nearest(N.build(none), none, 3).count() == 0 and N.within(N.build(none), none, 1.0).count() == 0


def test_quantiles_are_numpys(spark, monkeypatch):
    monkeypatch.setattr(S, "LOOKED_AT", 50)
    monkeypatch.setattr(S, "RANGES", 16)
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=3000) ** 5, np.repeat([1.0, 2.0, 2.0 + 1e-15, 1e9], 500), np.array([4.0]), np.full(900, 7.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        shares = [0.0, 0.25, 0.5, 0.9, 1.0]
        assert np.allclose(S.quantiles(df, F.col("x"), shares), np.quantile(x, shares), rtol=1e-12, atol=0)
    assert S.quantiles(df.where("x > 9"), F.col("x"), [0.5]) == [None]
