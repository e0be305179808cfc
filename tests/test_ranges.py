"""Running values by ranges against pandas; Kendall's tau and its p against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import ranges as R
from matchlight.operators import statistics as S


def plain_discordant(x, y, n):
    less = (x[:, None] < x[None]) & (y[:, None] > y[None])
    return int((less * n[:, None].astype(object) * n[None].astype(object)).sum())


@pytest.mark.parametrize("kinds", [3, 40, 10_000])
def test_inversions(kinds):
    rng = np.random.default_rng(kinds)
    x, y, n = rng.integers(0, kinds, 300).astype(float), rng.integers(0, kinds, 300).astype(float), rng.integers(1, 9, 300)
    assert R.inversions(x, y, n) == plain_discordant(x, y, n)
    wide = n.astype(np.int64) * 10**9
    assert R.inversions(x, y, wide) == plain_discordant(x, y, n) * 10**18


def test_discordant_through_bins_with_a_frequent_value(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(3000) < 0.35, 0.5, rng.random(3000))
    y = np.where(rng.random(3000) < 0.2, -1.0, x + rng.normal(size=3000))
    x[::50], y[::50] = x[0], y[0]
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    cells = df.groupBy("x", "y").agg(F.count("*").alias("n"))
    want = plain_discordant(x, y, np.ones(3000, np.int64))
    assert R.discordant(cells, per_task=400) == want
    assert R.discordant(cells) == want
    with pytest.raises(ValueError, match="per_task"):
        R.discordant(spark.range(40).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y", "1L AS n"), per_task=1)


def test_kendall_is_all_pairs(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 30, 400).astype(float), np.round(rng.normal(size=400), 1)
    rows = list(zip(x.tolist(), y.tolist(), strict=True)) + [(None, 1.0), (1.0, None), (float("nan"), 1.0)]
    got = R.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    tau = (sx * sy).sum() / math.sqrt((sx * sx).sum() * (sy * sy).sum())
    tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    n, s = 400.0, (sx * sy).sum() / 2
    v0, vt, vu = n * (n - 1) * (2 * n + 5), *((t * (t - 1) * (2 * t + 5)).sum() for t in (tx, ty))
    v1 = (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2 * n * (n - 1))
    v2 = (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    z = s / math.sqrt((v0 - vt - vu) / 18 + v1 + v2)
    assert (got["n"], got["tau"], got["z"], got["p"]) == (400, pytest.approx(tau), pytest.approx(z), pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-7))


def test_kendall_hard_tables(spark):
    of = lambda rows: R.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (of([])["n"], of([])["tau"]) == (0, None)
    assert of([(1.0, 2.0), (1.0, 3.0)])["tau"] is None
    assert of([(1.0, 2.0), (2.0, 3.0)])["tau"] == 1.0 and of([(1.0, 2.0), (2.0, 3.0)])["z"] is None


@pytest.fixture
def many_ranges(spark):
    """Ranges of few rows stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running(spark, many_ranges):
    rng = np.random.default_rng(1)
    v = rng.normal(size=500)
    rows = [(i, float(x) if i % 7 else None) for i, x in enumerate(v)]
    ranged = R.ranged(spark.createDataFrame(rows, "id long, v double").repartition(3), "id")
    got = R.running(R.running(ranged, ["id"], "sum", s=F.col("id"), n=F.lit(1)), ["id"], "max", top=F.col("v")).orderBy("id").collect()
    assert ranged.select("_part").distinct().count() > 1
    assert [r["s"] for r in got] == np.arange(500).cumsum().tolist()
    assert [r["n"] for r in got] == list(range(1, 501))
    assert got[0]["top"] is None
    assert [r["top"] for r in got[1:]] == np.maximum.accumulate([-np.inf if x is None else x for _, x in rows])[1:].tolist()


def test_adjust_over_many_ranges(spark, many_ranges):
    p = np.round(np.random.default_rng(4).random(200) ** 4, 2)
    got = {r["id"]: (r["i"], r["adjusted"], r["rejected"]) for r in S.adjust(spark.createDataFrame(list(enumerate(p.tolist())), "id long, p double"), "hochberg").collect()}
    order = np.lexsort((np.arange(200), p))
    top = np.minimum(np.maximum.accumulate(p[order] * 200 / np.arange(1, 201)), 1)
    last = max(np.flatnonzero(p[order] <= np.arange(1, 201) * 0.05 / 200), default=-1)
    assert got == {int(i): (k + 1, pytest.approx(t), k <= last) for k, (i, t) in enumerate(zip(order, top, strict=True))}


def test_no_task_sees_all_rows(spark):
    df = spark.range(300).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS grp")
    for made in (S.mann_whitney(df, "a", "b"), S.ks_two_sample(df, "a", "b"), S.adjust(df.selectExpr("id", "(x + 1) / 301 AS p"), "holm")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        for window in (line for line in plan.splitlines() if "Window " in line):
            assert "_part" in window


@pytest.mark.parametrize("by", [["g"], []])
def test_places_in_groups(spark, by):
    """A group of two thirds of the rows, null keys, repeated rows; no window sees a whole group."""
    rng = np.random.default_rng(11)
    rows = [(None if g == 3 else int(g), int(x), "keep") for g, x in zip(rng.choice([1, 2, 3], 900, p=[0.67, 0.2, 0.13]), rng.integers(0, 300, 900), strict=True)]
    df = spark.createDataFrame(rows, "g long, x long, _other string").repartition(6)
    got = R.placed(df, by, ["x"]).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"g", "x", "_other", "_place", "_rank", "_size"}
    groups = {}
    for r in got:
        groups.setdefault(r["g"] if by else 0, []).append(r)
    for held in groups.values():
        held.sort(key=lambda r: r["_place"])
        assert [r["_place"] for r in held] == list(range(1, len(held) + 1))
        xs = [r["x"] for r in held]
        assert xs == sorted(xs) and {r["_size"] for r in held} == {len(held)}
        assert [r["_rank"] for r in held] == [xs.index(x) + 1 for x in xs]
    assert R.placed(df.limit(0), by, ["x"]).count() == 0


def test_numbers_hold_where_partitions_are_merged_by_size(spark):
    """Ranges read twice were merged by their size, which differed between the rows and their counts."""
    from matchlight.operators import catalog

    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 6_000, 1, 8).selectExpr("6000 - id AS k", "concat_ws('-', id, repeat(uuid(), 20)) AS body")
        got = catalog.numbered(rows, "k", 100).select("k", "new_id", "body").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 6_000 and all(r["new_id"] == 100 + r["k"] for r in got)
