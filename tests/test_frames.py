"""Frames over chunks give what windows over whole metrics give; runs that cross chunks stay one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlight.operators import ranges as R
from matchlight.operators import telemetry as T


@pytest.fixture
def metrics(spark, monkeypatch):
    """Chunks of 60 rows in several ranges, three quarters of the rows of one metric, ties in time, a metric of one row and one without a name."""
    monkeypatch.setattr(R, "FRAME", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(12)
    names = rng.choice(["hot", "a", None], 700, p=[0.75, 0.15, 0.1]).tolist() + ["once"]
    rows = [(n, int(s), i, float(v)) for i, (n, s, v) in enumerate(zip(names, rng.integers(0, 300, 701), rng.random(701) * 100, strict=True))]
    yield spark.createDataFrame(rows, "name string, sec long, event_id long, value double").repartition(3)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trend(metrics):
    w = Window.partitionBy("name").orderBy("sec", "event_id")
    over = w.rowsBetween(-49, 0)
    rn = metrics.withColumn("rn", F.row_number().over(w).cast("double"))
    want = {r["event_id"]: (r["n"], pytest.approx(r["slope"], abs=1e-9)) for r in rn.select("event_id", F.count("*").over(over).alias("n"), F.coalesce(F.try_divide(F.covar_pop("rn", "value").over(over), F.var_pop("rn").over(over)), F.lit(-1.0)).alias("slope")).collect()}
    got = T.trend(metrics).collect()
    assert len(got) == 701
    assert {r["event_id"]: (r["n"], -1.0 if r["slope"] is None else r["slope"]) for r in got} == want


def test_anomaly(metrics):
    rows = sorted(metrics.collect(), key=lambda r: (r["sec"], r["event_id"]))
    want, held = {}, {}
    for r in rows:
        before = held.setdefault(r["name"], [])
        if len(before) >= 10:
            v = np.array(before[-100:])
            want[r["event_id"]] = pytest.approx(0.6745 * (r["value"] - np.median(v)) / np.median(np.abs(v - np.median(v))))
        before.append(r["value"])
    assert {r["event_id"]: r["z"] for r in T.anomaly(metrics).collect()} == want


def test_lifecycle(spark, metrics):
    rows = sorted(metrics.withColumn("value", F.when(F.col("event_id") % 90 != 5, F.when(F.col("sec").between(100, 200), 99.0).otherwise(F.col("value")))).collect(), key=lambda r: (r["sec"], r["event_id"]))
    want = []
    for name in {r["name"] for r in rows}:
        runs = []
        for r in (r for r in rows if r["name"] == name):
            bad = None if r["value"] is None else r["value"] > 60
            if runs and bad is not None and runs[-1][0] == bad:
                runs[-1][2] += 1
            else:
                runs.append([bad, r["sec"], 1])
        want += [(name, x[1], runs[i + 1][1] if i + 1 < len(runs) else None, x[2]) for i, x in enumerate(runs) if x[0]]
    got = T.lifecycle(spark.createDataFrame(rows, metrics.schema), 60).collect()
    assert sorted(map(str, ((r["name"], r["opened"], r["resolved"], r["n"]) for r in got))) == sorted(map(str, want))
    assert max(r["n"] for r in got) > 60
    assert T.lifecycle(metrics.limit(0), 60).count() == 0
