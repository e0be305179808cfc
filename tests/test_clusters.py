"""Ward against its plain definition, rings told apart, k by curvature and silhouette, hard rows."""

from __future__ import annotations

import numpy as np
import pytest

from matchlight.operators import clusters as C


def plain_ward(z, k):
    """Merges the pair of least cost, one after another."""
    groups = [[i] for i in range(len(z))]
    while len(groups) > k:
        means = np.array([z[g].mean(0) for g in groups])
        sizes = np.array([len(g) for g in groups], float)
        cost = ((means[:, None] - means[None]) ** 2).sum(2) * sizes[:, None] * sizes[None] / (sizes[:, None] + sizes[None])
        np.fill_diagonal(cost, np.inf)
        a, b = sorted(np.unravel_index(cost.argmin(), cost.shape))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def standardised(v):
    return (v - v.mean(0)) / v.std(0)


def frame(spark, v, more=()):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + list(more), "vec_id long, embedding array<double>").repartition(5)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r["vec_id"])
    return {frozenset(g) for g in out.values()}


def plain_silhouette(z, labels):
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    total = 0.0
    for i in range(len(z)):
        own = labels == labels[i]
        if own.sum() < 2:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == x].mean() for x in set(labels.tolist()) - {labels[i]})
        total += (b - a) / max(a, b)
    return total / len(z)


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).normal(size=(300, 5)) @ np.diag([3, 1, 1, 1, 0.5])


def test_hierarchical_is_plain_ward(spark, cloud):
    for k in (2, 5, 9):
        rows = C.hierarchical(frame(spark, cloud), k=k).collect()
        assert groups(rows) == plain_ward(standardised(cloud), k)
        labels = np.array([r["cluster"] for r in sorted(rows, key=lambda r: r["vec_id"])])
        assert rows[0]["silhouette"] == pytest.approx(plain_silhouette(standardised(cloud), labels), abs=1e-9)


def test_hierarchical_picks_k_and_finds_blobs_through_micro_clusters(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [12, 0], [0, 12], [12, 12]])
    of = np.where(rng.random(3000) < 0.4, 0, rng.integers(0, 4, 3000))
    v = centres[of] + rng.normal(size=(3000, 2))
    rows = C.hierarchical(frame(spark, v), k=4, micro=64).collect()
    assert groups(rows) == {frozenset(np.flatnonzero(of == c).tolist()) for c in range(4)}
    picked = C.hierarchical(frame(spark, v[:300])).collect()
    z, ks = standardised(v[:300]), range(2, 11)
    inner = []
    for k in ks:
        parts = [z[sorted(g)] for g in plain_ward(z, k)]
        inner.append(sum(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2).sum() / (len(p) * (len(p) - 1))) for p in parts if len(p) > 1) / k)
    assert picked[0]["clusters"] == ks[int(np.abs(np.diff(inner, n=2)).argmax()) + 1]


def test_spectral_tells_rings_apart(spark):
    rng = np.random.default_rng(6)
    turn, outer = rng.random(2400) * 2 * np.pi, rng.random(2400) < 0.6
    v = np.stack([np.cos(turn), np.sin(turn)], axis=1) * np.where(outer, 4, 1)[:, None] + rng.normal(size=(2400, 2)) * 0.1
    rows = C.spectral(frame(spark, v), k=2, gamma=60.0, micro=256).collect()
    assert groups(rows) == {frozenset(np.flatnonzero(outer).tolist()), frozenset(np.flatnonzero(~outer).tolist())}


def test_spectral_picks_k_by_silhouette(spark):
    rng = np.random.default_rng(8)
    of = rng.integers(0, 3, 600)
    v = np.array([[0, 0, 0], [15, 0, 0], [0, 15, 0]])[of] + rng.normal(size=(600, 3))
    rows = C.spectral(frame(spark, v), gamma=10.0).collect()
    assert rows[0]["clusters"] == 3 and groups(rows) == {frozenset(np.flatnonzero(of == c).tolist()) for c in range(3)}
    labels = np.array([r["cluster"] for r in sorted(rows, key=lambda r: r["vec_id"])])
    assert rows[0]["silhouette"] == pytest.approx(plain_silhouette(standardised(v), labels), abs=1e-9)


@pytest.mark.parametrize("method", [C.hierarchical, C.spectral])
def test_hard_rows(spark, method):
    bad = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 1.0])]
    rows = {r["vec_id"]: r["cluster"] for r in method(frame(spark, np.array([[0.0, 0.0]] * 6 + [[5.0, 1.0]] * 6), bad)).collect()}
    assert [rows[i] for i, _ in bad] == [None] * 5
    assert [rows[i] for i in range(12)] == [0] * 6 + [1] * 6
    assert method(frame(spark, np.zeros((0, 2)))).count() == 0
    assert {r["cluster"] for r in method(frame(spark, np.ones((1, 2)), bad)).collect()} == {0, None}
    assert {r["cluster"] for r in method(frame(spark, np.ones((9, 2)))).collect()} == {0}
