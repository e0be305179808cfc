"""Half-space trees against a plain walk, planted spikes, a hot metric in many tasks, hard values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import halfspaces as H

SCHEMA = "name string, event_id long, value double, _score string"


def plain(values, trees, few):
    """Scores of one metric by walking each tree from its root."""
    v = np.array(values, float)
    spread = v.max() / 2 - v.min() / 2
    x = (v / 2 - v.min() / 2) / spread if spread > 0 else np.zeros(len(v))
    total = np.zeros(len(v), np.int64)
    for low, width in H.tree_ranges(trees):
        leaf = np.minimum(np.floor((x - low) / width * H.LEAVES).astype(int), H.LEAVES - 1)
        for i in range(len(v)):
            for d in range(H.DEPTH + 1):
                mass = int(((leaf >> (H.DEPTH - d)) == (leaf[i] >> (H.DEPTH - d))).sum())
                if mass <= few * len(v) or d == H.DEPTH:
                    total[i] += mass * 2**d
                    break
    return total.tolist()


@pytest.mark.parametrize(("trees", "few"), [(25, 0.01), (3, 0.2), (1, 0.0)])
def test_scores_are_the_walk(spark, trees, few):
    rng = np.random.default_rng(trees)
    metrics = {"hot": rng.normal(size=150).tolist() + [40.0], "b": rng.integers(0, 5, 60).astype(float).tolist(), None: [3.0, 1.0, 2.0], "one": [7.0] * 9, "far": [-1.5e308, 1.5e308, 0.0]}
    rows = [(k, i, v, "kept") for k, vs in metrics.items() for i, v in enumerate(vs)]
    hard = [("hot", 900, None, "x"), ("hot", 901, float("nan"), "x"), ("b", 902, float("inf"), "x")]
    got = H.scored(spark.createDataFrame(rows + hard, SCHEMA).drop("_score").repartition(5), trees, few).collect()
    assert sorted((str(r["name"]), r["event_id"], r["mass"]) for r in got) == sorted((str(k), i, m) for k, vs in metrics.items() for i, m in enumerate(plain(vs, trees, few)))


def test_planted_spikes_are_found(spark):
    """20,000 samples in two bands and ten spikes, some between the bands; a second metric on another scale has its own."""
    rng = np.random.default_rng(1)
    bands = np.where(rng.random(20_000) < 0.5, rng.normal(10, 1, 20_000), rng.normal(30, 1, 20_000)).tolist()
    spikes = [20.0, 19.5, 60.0, -25.0, 75.0, 90.0, -40.0, 21.0, 48.0, 110.0]
    rows = [("a", i, v, "") for i, v in enumerate(bands + spikes)] + [("b", i, v, "") for i, v in enumerate([*(rng.random(2000) / 1000).tolist(), 0.02, -0.03])]
    got = H.anomalies(spark.createDataFrame(rows, SCHEMA), share=0.001)
    found = {(r["name"], r["event_id"]) for r in got.where("is_anomaly").collect()}
    assert {("a", 20_000 + i) for i in range(len(spikes))} | {("b", 2000), ("b", 2001)} <= found
    assert len(found) <= 22
    assert got.count() == len(rows)


def test_hard_tables(spark):
    of = lambda rows: sorted(tuple(r) for r in H.anomalies(spark.createDataFrame(rows, SCHEMA).drop("_score"), share=0.5).select("event_id", "is_anomaly").collect())
    assert of([]) == []
    assert of([("a", 1, None, "")]) == []
    assert of([("a", i, 5.0, "") for i in range(4)]) == [(i, False) for i in range(4)]  # equal masses are more than the share
    assert of([(None, i, v, "") for i, v in enumerate([1.0, 1.0, 1.0, 9.0])]) == [(0, False), (1, False), (2, False), (3, True)]


def test_no_window_over_a_metric(spark):
    """All rows of the samples stay out of windows: the plan's windows read counts that were saved."""
    plan = H.scored(spark.range(1000).selectExpr("'k' AS name", "id AS event_id", "CAST(id AS DOUBLE) AS value"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
