"""Scores of labellings against their plain definitions over all pairs, in blocks smaller than the data, and on hard rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import validity as V

SCHEMA = "label long, embedding array<double>, c int, s string"


def plain(z, label):
    ks, n = np.unique(label), len(z)
    d2 = ((z[:, None] - z[None]) ** 2).sum(2)
    sil = []
    for i in range(n):
        own = label == label[i]
        if own.sum() == 1:
            sil.append(0.0)
            continue
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, label == k].mean() for k in ks if k != label[i])
        sil.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    mean = {k: z[label == k].mean(0) for k in ks}
    within = sum(((z[label == k] - mean[k]) ** 2).sum() for k in ks)
    between = sum((label == k).sum() * ((mean[k] - z.mean(0)) ** 2).sum() for k in ks)
    width = {k: np.sqrt(((z[label == k] - mean[k]) ** 2).sum(1)).mean() for k in ks}
    worst = [max((width[a] + width[b]) / np.linalg.norm(mean[a] - mean[b]) for b in ks if b != a) for a in ks]
    ch, db = between / (len(ks) - 1) / (within / (n - len(ks))), float(np.mean(worst))
    return np.mean(sil), ch, db, (np.mean(sil) + min(1, ch / 1000) + max(0, 1 - db / 10)) / 3


def frame(spark, z, label, more=()):
    return spark.createDataFrame([(int(k), v.tolist(), 1, "x") for k, v in zip(label, z, strict=True)] + list(more), SCHEMA).repartition(3)


@pytest.mark.parametrize(("rows", "block"), [(1024, 1024), (7, 2), (5, 3)])
def test_scores_are_the_plain_ones(spark, monkeypatch, rows, block):
    monkeypatch.setattr(V, "_ROWS", rows)
    monkeypatch.setattr(V, "_BLOCK", block)
    rng = np.random.default_rng(5)
    label = np.append(rng.choice([3, 4, 8, 9, 11], 120, p=[0.4, 0.2, 0.2, 0.15, 0.05]), [77])  # one cluster of a single row
    z = rng.normal(size=(121, 4)) + label[:, None] * 0.7
    # noise, no label, no vector, null and non-finite components: left out
    more = [(-1, [9.0] * 4, 1, "x"), (None, [9.0] * 4, 1, "x"), (3, None, 1, "x"), (3, [1.0, None, 1.0, 1.0], 1, "x"), (3, [1.0, float("nan"), 1.0, 1.0], 1, "x"), (3, [], 1, "x")]
    got = V.scores(frame(spark, z, label, more)).first()
    assert tuple(got) == pytest.approx(plain(z, label), abs=1e-9)
    labels, _, means, _ = V.features(V.usable_rows(frame(spark, z, label), "label", "embedding"))
    near = frame(spark, z, label).select("embedding", V.nearest(F.col("embedding"), labels, means, "long").alias("near")).collect()
    centre = {k: z[label == k].mean(0) for k in labels}
    assert all(r["near"] == min(labels, key=lambda k: (round(float(((np.array(r["embedding"]) - centre[k]) ** 2).sum()), 9), k)) for r in near)


def test_hard_tables(spark):
    of = lambda rows: [tuple(r) for r in V.scores(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert of([]) == []
    assert of([(1, [1.0], 1, "x")] * 3) == []
    # every row a cluster: no deviation within
    assert of([(1, [1.0], 1, "x"), (2, [2.0], 1, "x")]) == [(0.0, None, 0.0, 0.0)]
    # equal rows in both clusters
    assert of([(k, [1.0], 1, "x") for k in (1, 1, 2, 2)]) == [(0.0, None, 0.0, 0.0)]


def test_too_many_means(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 3)
    with pytest.raises(ValueError, match="more than the 3"):
        V.scores(spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [2.0, 1.0], 1, "x")], SCHEMA))
