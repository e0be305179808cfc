"""Reports on algorithms and curves against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import evaluation as E
from matchlight.operators import vectors as V


def test_report_of_algorithms(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 64))
    v[3] = 2.0  # does not vary: its correlations are 0
    rows = [(i, v[i].tolist(), i % 3 if i != 7 else None) for i in range(40)] + [(40, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["alg"]: r for r in V.algorithm_report(df, df.where("vec_id % 2 = 0"), 0.3).collect()}
    assert set(got) == {"cosine", "euclidean", "correlation"}
    flat = lambda x: np.zeros(64) if np.ptp(x) == 0 else (x - x.mean()) / np.linalg.norm(x - x.mean())
    rules = {
        "cosine": lambda x, y: round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), "euclidean": lambda x, y: 1 - np.sqrt(((x - y) ** 2).sum()) / 8,
        "correlation": lambda x, y: round(abs(float(flat(x) @ flat(y))), 6),
    }
    for alg, rule in rules.items():
        s = {(i, j): rule(v[i], v[j]) for i in range(0, 40, 2) for j in range(40) if i != j}
        labelled = {k: x for k, x in s.items() if 7 not in k}
        for kind, which in (("same", True), ("other", False)):
            x = [x for (i, j), x in labelled.items() if (i % 3 == j % 3) == which]
            assert (got[alg][f"{kind}_mean"], got[alg][f"{kind}_std"]) == pytest.approx((np.mean(x), np.std(x)), abs=1e-9)
        assert got[alg]["matched"] == pytest.approx(np.mean([x >= 0.3 for x in s.values()]), abs=1e-12)


def test_report_without_pairs_of_one_label(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0], i) for i in range(4)], "vec_id long, embedding array<double>, label int")
    for r in V.algorithm_report(df, df).collect():
        assert r["same_mean"] is None and r["same_std"] is None and r["other_mean"] is not None


@pytest.mark.parametrize("at", [0.05, 0.1, 0.25, 0.3, 0.6, 0.99, 1.0])
def test_area_and_point_of_a_stored_curve(spark, at):
    x, y = [0.1, 0.1, 0.3, 0.3, 0.7, 1.0], [0.0, 0.2, 0.2, 0.5, 0.9, 1.0]
    points = spark.createDataFrame([(-float(k), *p) for k, p in enumerate(zip(x, y, strict=True))], "score double, fpr double, tpr double").repartition(3)
    got = E.curve_summary(points, at).first()
    assert got["area"] == pytest.approx(np.trapezoid(y, x))
    assert got["y_at"] == (None if at < 0.1 else pytest.approx(np.interp(at, x, y)))
    assert E.curve_summary(points.where(F.lit(False)), at).first()["area"] is None
