"""How good a labelling of vectors is: silhouette, Calinski-Harabasz, Davies-Bouldin, and labellings ranked by all three.

Two readings of the rows, whatever their number: sums per cluster and dimension, then each
row's distances from all clusters, which follow from a cluster's size, mean and mean squared
deviation. The driver and each task hold the means of all clusters, ``HELD`` numbers at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import squared, usable
from .graph import saved

#: Most numbers (clusters times dimensions) of the means that the driver and a task hold.
HELD = 2**24
#: Rows whose distances from a block of clusters are held at once, and clusters of a block.
_ROWS, _BLOCK = 1024, 1024

SCORES = "silhouette double, calinski double, davies_bouldin double, composite double"


def features(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Labels in order, sizes, means and mean squared deviations of the clusters of ``rows(label, v)``."""
    long = rows.select("label", F.posexplode("v").alias("k", "x"))
    sums = long.groupBy("label", "k").agg(F.count("*").alias("n"), F.avg("x").alias("c"), F.var_pop("x").alias("s"))
    sums = saved(sums, "means")
    size = sums.count()
    if size > HELD:
        raise ValueError(f"{size} means of clusters and dimensions are more than the {HELD} that a task holds")
    held = sums.orderBy("label", "k").toPandas()
    labels = held["label"].unique().tolist()
    shape = (len(labels), -1) if labels else (0, 0)
    return labels, held["n"].to_numpy().reshape(shape)[:, 0] if labels else np.zeros(0), held["c"].to_numpy().reshape(shape), held["s"].to_numpy().reshape(shape).sum(1)


def _blocks(z: np.ndarray, means: np.ndarray):
    for b in range(0, len(means), _BLOCK):
        yield b, squared(z, means[b : b + _BLOCK])


def nearest(v: Column, labels: list, means: np.ndarray, kind: str) -> Column:
    """The label, of type ``kind``, whose mean is nearest; of equally near ones (to nine digits) the first."""

    @F.pandas_udf(kind)
    def of(rows: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(rows), _ROWS):
            z = np.stack(rows.iloc[at : at + _ROWS].to_list()).astype(np.float64)
            best, who = np.full(len(z), np.inf), np.zeros(len(z), int)
            for b, d in _blocks(z, means):
                d = np.round(d, 9)
                least = d.min(1)
                who, best = np.where(least < best, b + d.argmin(1), who), np.minimum(best, least)
            out += [labels[i] for i in who]
        return pd.Series(out)

    return of(v)


def usable_rows(df: DataFrame, label: str, column: str, noise: object = -1) -> DataFrame:
    """``(label, v)`` of rows with a label other than ``noise`` and a vector of finite components; vectors have one length."""
    labelled = df.where(F.col(label).isNotNull() & (F.col(label) != F.lit(noise)) & usable(F.col(column)))
    return labelled.select(F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))


def scores(df: DataFrame, label: str = "label", column: str = "embedding", noise: object = -1) -> DataFrame:
    """One row of ``SCORES``; none unless there are two clusters.

    Rows without a label, with label ``noise`` or without a usable vector are left out.
    Silhouettes are of squared distances, 0 in clusters of one row; Davies-Bouldin of plain
    ones, where clusters of equal means count 0 as neighbours. Calinski-Harabasz is null
    where every row is a cluster or none deviates. The composite is the mean of silhouette,
    a thousandth of Calinski-Harabasz up to 1, and one less a tenth of Davies-Bouldin from 0.
    """
    rows = usable_rows(df, label, column, noise)
    labels, n, means, spread = features(rows)
    if len(labels) < 2:
        return df.sparkSession.createDataFrame([], SCORES)
    number = {v: i for i, v in enumerate(labels)}

    @F.pandas_udf("c int, s double, d double")
    def told(label: pd.Series, v: pd.Series) -> pd.DataFrame:
        own, s, dist = label.map(number).to_numpy(), np.zeros(len(v)), np.zeros(len(v))
        for at in range(0, len(v), _ROWS):
            c = own[at : at + _ROWS]
            z, i = np.stack(v.iloc[at : at + _ROWS].to_list()).astype(np.float64), np.arange(len(c))
            other = np.full(len(z), np.inf)
            for b, d in _blocks(z, means):
                mine = (c >= b) & (c < b + d.shape[1])
                dist[at + i[mine]] = np.sqrt(d[i[mine], c[mine] - b])
                d = d + spread[None, b : b + d.shape[1]]
                d[i[mine], c[mine] - b] = np.inf
                other = np.minimum(other, d.min(1))
            inner = (dist[at : at + len(c)] ** 2 + spread[c]) * n[c] / np.maximum(n[c] - 1, 1)
            top = np.maximum(inner, other)
            s[at : at + len(c)] = np.where((n[c] > 1) & (top > 0), (other - inner) / np.where(top > 0, top, 1), 0)
        return pd.DataFrame({"c": own, "s": s, "d": dist})

    per = rows.select(told("label", "v").alias("t")).select("t.*").groupBy("c").agg(F.sum("s").alias("s"), F.avg("d").alias("d")).orderBy("c").toPandas()  # a row a cluster
    total, k = int(n.sum()), len(labels)
    silhouette = float(per["s"].sum() / total)
    between = float((n * ((means - (n @ means) / total) ** 2).sum(1)).sum())
    within = float((n * spread).sum())
    calinski = between / (k - 1) / (within / (total - k)) if total > k and within > 0 else None
    width, worst = per["d"].to_numpy(), np.zeros(k)
    for a in range(0, k, _ROWS):
        for b, d in _blocks(means[a : a + _ROWS], means):
            gap = np.sqrt(d)
            gap[np.add.outer(np.arange(a, a + len(gap)), -np.arange(b, b + gap.shape[1])) == 0] = np.inf
            both = width[a : a + _ROWS, None] + width[None, b : b + _BLOCK]
            worst[a : a + _ROWS] = np.maximum(worst[a : a + _ROWS], np.where(gap > 0, both / np.where(gap > 0, gap, 1), 0).max(1))
    davies = float(worst.mean())
    composite = (silhouette + min(1.0, (calinski or 0.0) / 1000) + (max(0.0, 1 - davies / 10) if davies > 0 else 0.0)) / 3
    return df.sparkSession.createDataFrame([(silhouette, calinski, davies, composite)], SCORES)
