"""Ward's hierarchy and spectral clusters of any number of rows, by mergeable features of a bounded number of micro-clusters.

A micro-cluster is (number of rows, mean, squared deviations, least id). Tasks sum such
features for the rows that are nearest to each centre, Spark adds the sums of all tasks,
and only ``MICRO`` of them reach the driver, however many rows there are. What follows
(merges, eigenvectors) works on those; rows get their clusters in tasks again. Up to
``MICRO`` distinct rows, each is its own micro-cluster and nothing is approximated.

Rows whose vector is null, empty or holds a null, NaN or infinite component have a null
cluster. All other vectors have one length. The input is read a handful of times; cut its
lineage first where it is costly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metric import spread

#: Micro-clusters, expected rows of the sample that their first centres are spread over, and rounds that move the centres.
MICRO, SAMPLE, ROUNDS = 1024, 8192, 2
#: Rows whose distances from all centres are held at once.
_SLAB = 2048


@dataclass(frozen=True)
class Micro:
    """Usable rows ``(id, v)``, their scale, the centres that deal them, and the features of each dealt group."""

    rows: DataFrame
    shift: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    ss: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> int:
        return int(self.n.sum())


def usable(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def squared(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    return np.maximum((z * z).sum(1)[:, None] - 2 * z @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _slabs(batches, shift, scale):
    """Ids and scaled vectors of Arrow batches, ``_SLAB`` rows at a time."""
    for batch in batches:
        for i in range(0, len(batch), _SLAB):
            piece = batch.iloc[i : i + _SLAB]
            yield piece["id"].to_numpy(), (np.stack(piece["v"].to_list()).astype(np.float64) - shift) / scale


def _summed(rows: DataFrame, shift, scale, centres: np.ndarray, label: Callable[[np.ndarray], np.ndarray], options: int):
    """Features by option and label (``label(z)`` gives a column an option), about ``centres[option][label]``; sums are added task by task first."""
    d = len(shift)

    def part(batches):
        held: dict[tuple[int, int], list] = {}
        for ids, z in _slabs(batches, shift, scale):
            at = label(z)
            for o in range(options):
                order = np.argsort(at[:, o], kind="stable")
                kinds, starts = np.unique(at[order, o], return_index=True)
                off = z[order] - centres[o][at[order, o]]
                sums = zip(kinds.tolist(), np.diff(np.append(starts, len(order))).tolist(), np.add.reduceat(off, starts), np.add.reduceat((off * off).sum(1), starts), np.minimum.reduceat(ids[order], starts), strict=True)
                for k, n, s, q, f in sums:
                    was = held.get((o, k))
                    held[o, k] = [n, s, q, f] if was is None else [was[0] + n, was[1] + s, was[2] + q, min(was[3], f)]
        if held:
            yield pd.DataFrame([(o, k, n, s.tolist(), q, f) for (o, k), (n, s, q, f) in held.items()], columns=["o", "k", "n", "s", "q", "f"])

    parts = rows.mapInPandas(part, "o int, k int, n long, s array<double>, q double, f long")
    total = parts.groupBy("o", "k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(d)]).alias("s"), F.sum("q").alias("q"), F.min("f").alias("f"))
    out = [dict() for _ in range(options)]
    for r in total.collect():  # options x labels rows
        s = np.array(r["s"])
        out[r["o"]][r["k"]] = (r["n"], centres[r["o"]][r["k"]] + s / r["n"], max(r["q"] - s @ s / r["n"], 0.0), r["f"])
    return out


def micro_clusters(df: DataFrame, key: str = "vec_id", column: str = "embedding", micro: int = MICRO) -> Micro | None:
    """Micro-clusters of the standardised vectors of ``df``; null where no row is usable. A dimension without spread stays as it is."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(usable(F.col("v")))
    per = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()  # a row a dimension
    if not per:
        return None
    shift, scale = np.array([r["m"] for r in per]), np.array([r["s"] or 1.0 for r in per])
    share = int(2**40 * min(1.0, SAMPLE / per[0]["n"]))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**40)) < max(1, share)).limit(2 * SAMPLE).collect() or rows.limit(1).collect()
    sample = (np.array([r["v"] for r in sorted(drawn)]) - shift) / scale
    centres = np.unique(spread(sample, micro), axis=0)
    for left in range(ROUNDS, -1, -1):
        now = centres
        (got,) = _summed(rows, shift, scale, [now], lambda z, now=now: squared(z, now).argmin(1)[:, None], 1)
        if not left or sum(f[2] for f in got.values()) < 1e-9 * per[0]["n"]:
            break
        centres = np.array([got[k][1] for k in sorted(got)])
    order = sorted(got)
    n, mean, ss, first = zip(*[got[k] for k in order], strict=True)
    return Micro(rows, shift, scale, now[order], np.array(n, float), np.array(mean), np.array(ss), np.array(first))


def ward(n: np.ndarray, mean: np.ndarray) -> list[tuple[int, int]]:
    """Ward's merges in the order of their cost, each by a member of either side, found by nearest-neighbour chains."""
    n, mean = n.astype(float).copy(), mean.copy()
    alive = np.ones(len(n), bool)
    chain: list[int] = []
    merges = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(alive.argmax()))
        a = chain[-1]
        cost = np.where(alive, n * n[a] / (n + n[a]) * ((mean - mean[a]) ** 2).sum(1), np.inf)
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            merges.append((cost[b], a, b))
            mean[b] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
            n[b] += n[a]
            alive[a] = False
            del chain[-2:]
        else:
            chain.append(b)
    return [(a, b) for _, a, b in sorted(merges, key=lambda m: m[0])]


def cut(merges: list[tuple[int, int]], m: int, k: int) -> np.ndarray:
    """Group of each of ``m`` leaves when ``k`` groups are left."""
    up = list(range(m))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in merges[: max(0, m - k)]:
        up[top(a)] = top(b)
    return np.array([top(i) for i in range(m)])


def ordered(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels renamed 0, 1, ... by the least id of their members."""
    least = {x: first[labels == x].min() for x in np.unique(labels)}
    names = {x: i for i, x in enumerate(sorted(least, key=least.get))}
    return np.array([names[x] for x in labels])


def _merged(n, mean, ss, labels):
    """Number, mean and squared deviations of each label's union."""
    out = []
    for x in range(labels.max() + 1):
        at = labels == x
        size = n[at].sum()
        middle = (n[at, None] * mean[at]).sum(0) / size
        out.append((size, middle, ss[at].sum() + (n[at] * ((mean[at] - middle) ** 2).sum(1)).sum()))
    return out


def bend(ks: list[int], spread_of: list[float]) -> int:
    """The k at the largest curvature, either way; the least k of fewer than three."""
    if len(ks) < 3:
        return ks[0]
    return ks[int(np.abs(np.diff(spread_of, n=2)).argmax()) + 1]


def _silhouettes(m: Micro, label, groups: list[list[tuple]]) -> list[float]:
    """Mean silhouette over all rows by squared distances, one an option; ``groups[option]`` are the features of its clusters.

    The mean squared distance of a row from a cluster's members is that from their mean plus their mean squared deviation.
    """
    tables = [(np.array([g[0] for g in gs], float), np.array([g[1] for g in gs]), np.array([g[2] for g in gs])) for gs in groups]
    shift, scale = m.shift, m.scale

    def part(batches):
        total = np.zeros(len(tables))
        for _, z in _slabs(batches, shift, scale):
            at = label(z)
            for o, (n, mean, ss) in enumerate(tables):
                if len(n) < 2:
                    continue
                far = squared(z, mean) + ss / n
                own = (np.arange(len(z)), at[:, o])
                alone = n[at[:, o]] < 2
                inner = far[own] * n[at[:, o]] / np.maximum(n[at[:, o]] - 1, 1)
                far[own] = np.inf
                other = far.min(1)
                total[o] += np.where(alone, 0, (other - inner) / np.maximum(np.maximum(other, inner), 1e-300)).sum()
        yield pd.DataFrame({"o": np.arange(len(tables), dtype=np.int32), "s": total})

    got = {r["o"]: r["s"] for r in m.rows.mapInPandas(part, "o int, s double").groupBy("o").agg(F.sum("s").alias("s")).collect()}
    return [got[o] / m.size for o in range(len(tables))]


def _labelled(df: DataFrame, key: str, column: str, m: Micro | None, label, k: int, silhouette: float) -> DataFrame:
    """``(key, cluster, clusters, silhouette)`` of all rows of ``df``."""
    v = F.col(column).cast("array<double>")
    if m is None:
        named = F.lit(None).cast("int")
    else:
        shift, scale = m.shift, m.scale

        @F.pandas_udf("int")
        def cluster(rows: pd.Series) -> pd.Series:
            good = rows.notna().to_numpy()
            out = pd.Series([None] * len(rows), dtype="Int32")
            if good.any():
                z = (np.stack(rows[good].to_list()).astype(np.float64) - shift) / scale
                out[good] = np.concatenate([label(z[i : i + _SLAB]) for i in range(0, len(z), _SLAB)])
            return out

        named = cluster(F.when(usable(v), v))
    return df.select(key, named.alias("cluster"), F.lit(k).alias("clusters"), F.lit(float(silhouette)).alias("silhouette"))


def hierarchical(df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int | None = None, micro: int = MICRO) -> DataFrame:
    """Ward's clusters of all rows: ``(key, cluster, clusters, silhouette)``, clusters numbered by their least id.

    Without ``k`` it is taken from 2 to 10 (at most half the rows) at the largest
    curvature of the spread within clusters: the root of the mean squared distance of a
    cluster's pairs, summed over clusters of two rows or more and divided by k. Features
    give mean squares of distances exactly, but no means of distances.
    """
    m = micro_clusters(df, key, column, micro)
    if m is None:
        return _labelled(df, key, column, None, None, 0, 0.0)
    merges = ward(m.n, m.mean)
    ks = list(range(2, min(10, m.size // 2, len(m.n)) + 1))
    if k is None:
        inner = []
        for c in ks:
            groups = _merged(m.n, m.mean, m.ss, ordered(cut(merges, len(m.n), c), m.first))
            inner.append(sum(np.sqrt(2 * ss / (n - 1)) for n, _, ss in groups if n > 1) / c)
        k = bend(ks, inner) if ks else 1
    names = ordered(cut(merges, len(m.n), k), m.first)
    centres = m.centres
    label = lambda z: names[squared(z, centres).argmin(1)]
    (silhouette,) = _silhouettes(m, lambda z: label(z)[:, None], [_merged(m.n, m.mean, m.ss, names)])
    return _labelled(df, key, column, m, label, int(names.max()) + 1, silhouette)


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, starts: int = 10, rounds: int = 50) -> np.ndarray:
    """Centres of the best of some runs from spread random starts; for a bounded number of weighted rows."""
    rng = np.random.default_rng(7)
    best, least = None, np.inf
    for _ in range(starts):
        c = x[[rng.choice(len(x), p=w / w.sum())]]
        while len(c) < k:
            p = w * squared(x, c).min(1)
            if p.sum() <= 0:
                break
            c = np.vstack([c, x[rng.choice(len(x), p=p / p.sum())]])
        for _ in range(rounds):
            at = squared(x, c).argmin(1)
            moved = np.array([np.average(x[at == j], axis=0, weights=w[at == j]) if (at == j).any() else c[j] for j in range(len(c))])
            if np.allclose(moved, c, rtol=0, atol=1e-12):
                break
            c = moved
        cost = (w * squared(x, c).min(1)).sum()
        if cost < least:
            best, least = c, cost
    return best


def spectral(df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int | None = None, gamma: float = 1.0, micro: int = MICRO) -> DataFrame:
    """Spectral clusters of all rows: ``(key, cluster, clusters, silhouette)``, clusters numbered by their least id.

    Affinity is exp(-gamma d^2 / dimensions) of standardised vectors. Micro-clusters,
    weighted by their rows, are the landmarks of a Nystroem extension: eigenvectors of
    their random walk are bounded, and each row's own coordinates follow in tasks from
    its affinities to the landmarks (shifted by the largest, so a far row is not 0/0).
    Without ``k`` it is the one of 2 to 8 (at most a third of the rows) with the best
    silhouette over all rows, the least of equal ones.
    """
    m = micro_clusters(df, key, column, micro)
    if m is None:
        return _labelled(df, key, column, None, None, 0, 0.0)
    rate, n, mean = gamma / m.mean.shape[1], m.n, m.mean
    affinity = np.exp(-rate * squared(mean, mean))
    degree = affinity @ n
    values, vectors = np.linalg.eigh(affinity * np.sqrt(np.outer(n, n)) / np.sqrt(np.outer(degree, degree)))
    top = np.argsort(-values)[: 8 if k is None else k]
    top = top[values[top] > 1e-9]
    psi = vectors[:, top] / np.sqrt(n * degree)[:, None] * np.sqrt((n * degree).sum())
    ks = [k] if k is not None else list(range(2, min(8, m.size // 3, len(n)) + 1)) or [1]
    plans = [weighted_kmeans(psi[:, :c], n, c) for c in ks]
    back = psi / values[top]

    def labels(z: np.ndarray) -> np.ndarray:
        log = -rate * squared(z, mean)
        near = np.exp(log - log.max(1, keepdims=True)) * n
        at = near @ back / near.sum(1, keepdims=True)
        return np.stack([squared(at[:, : c.shape[1]], c).argmin(1) for c in plans], axis=1)

    zero = [np.zeros((len(c), mean.shape[1])) for c in plans]
    found = _summed(m.rows, m.shift, m.scale, zero, labels, len(ks))
    names = [{x: i for i, x in enumerate(sorted(f, key=lambda x, f=f: f[x][3]))} for f in found]
    maps = [np.array([x.get(i, 0) for i in range(len(c))]) for x, c in zip(names, plans, strict=True)]
    renamed = lambda z: np.stack([t[c] for t, c in zip(maps, labels(z).T, strict=True)], axis=1)
    scores = _silhouettes(m, renamed, [[f[x] for x in sorted(f, key=name.get)] for f, name in zip(found, names, strict=True)])
    best = int(np.argmax(scores))
    return _labelled(df, key, column, m, lambda z: renamed(z)[:, best], len(names[best]), scores[best])
