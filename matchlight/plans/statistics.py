"""Queries on statistics and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import clusters as C
from ..operators import ranges as R
from ..operators import statistics as S
from ..operators import validity as V
from .hypothesis import normal_sql
from .registry import register


def rr(*columns: str, n: int = 5):
    return [F.round(c, n).alias(c) for c in columns]


def sr(*columns: str, n: int = 5) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in columns)


# p-values of a family: one per user, rational in the data so that both engines agree
_P = "SELECT user_id AS id, (count(*) FILTER (event_type = 'error') + 1) / (count(*) * 8.0 + 40) AS p FROM events GROUP BY 1"


def p_values(t):
    return t.events.groupBy(F.col("user_id").alias("id")).agg(((F.count_if(F.col("event_type") == "error") + 1) / (F.count("*") * 8.0 + 40)).alias("p"))


_W = "WITH p AS (" + _P + "), r AS (SELECT id, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS i FROM p)"
register("p_bonferroni", lambda t: S.adjust(p_values(t), "bonferroni").select("id", *rr("adjusted"), "rejected"), f"{_W} SELECT id, round(least(p * m, 1), 5) AS adjusted, least(p * m, 1) < 0.05 AS rejected FROM r")
register("p_holm", lambda t: S.adjust(p_values(t), "holm").select("id", *rr("adjusted"), "rejected"), f"{_W}, a AS (SELECT id, least(max(p * (m - i + 1)) OVER (ORDER BY i), 1) AS adjusted FROM r) SELECT id, round(adjusted, 5) AS adjusted, adjusted <= 0.05 AS rejected FROM a")
_BH = "a AS (SELECT id, least(max(p * m / i) OVER (ORDER BY i), 1) AS adjusted, coalesce(i <= max(CASE WHEN p <= i * 0.05 / m / {h} THEN i END) OVER (), false) AS rejected FROM r) SELECT id, round(adjusted, 5) AS adjusted, rejected FROM a"
register("p_benjamini_hochberg", lambda t: S.adjust(p_values(t), "hochberg").select("id", *rr("adjusted"), "rejected"), f"{_W}, {_BH.format(h='1')}")
register("p_benjamini_yekutieli", lambda t: S.adjust(p_values(t), "yekutieli").select("id", *rr("adjusted"), "rejected"), f"{_W}, {_BH.format(h='(SELECT sum(1 / i) FROM r)')}")
register("p_sidak", lambda t: S.adjust(p_values(t), "sidak").select("id", *rr("adjusted"), "rejected"), f"{_W} SELECT id, round(1 - pow(1 - p, m), 5) AS adjusted, p <= 1 - pow(0.95, 1 / m) AS rejected FROM r")
_COLS = ["x", "y", "d", "t"]
_PAIRS = [(a, b) for a in _COLS for b in _COLS if a < b]


#: Two rows: discount and tax, both of few values, and quantity with a price that hardly ever repeats.
_TAU = [("d", "t"), ("x", "y")]


def kendall(t):
    got = [R.kendall(t.samples, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", *rr("tau", "p"), F.round("z", 3).alias("z")) for a, b in _TAU]
    return got[0].union(got[1])


def kendall_sql(a: str, b: str) -> str:
    """Contrary pairs by the rows of each value of ``a`` that lie below in ``b``; z and p corrected for ties."""
    ties = lambda c: f"(SELECT sum(n * (n - 1)) AS p, sum(n * (n - 1) * (n - 2)) AS q, sum(n * (n - 1) * (2 * n + 5)) AS r FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM samples GROUP BY {c}))"
    return f"""(WITH kinds AS (SELECT DISTINCT {a} AS v FROM samples),
        below AS (SELECT v, {a} AS own, count(*) FILTER ({a} = v) OVER (PARTITION BY v ORDER BY {b} RANGE UNBOUNDED PRECEDING) - count(*) FILTER ({a} = v) OVER (PARTITION BY v, {b}) AS n FROM samples, kinds),
        s AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM samples),
        one AS (SELECT n, n * (n - 1) AS m, (n * (n - 1) - tx.p - ty.p + tb.p) / 2 - 2 * (SELECT sum(n) FROM below WHERE own < v) AS s, tx.p AS px, ty.p AS py, tx.q AS qx, ty.q AS qy, tx.r AS rx, ty.r AS ry FROM s, {ties(a)} tx, {ties(b)} ty, {ties(f"{a}, {b}")} tb),
        z AS (SELECT *, s / sqrt((m * (2 * n + 5) - rx - ry) / 18 + px * py / (2 * m) + qx * qy / (9 * m * (n - 2))) AS z FROM one)
        SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, round(2 * s / (sqrt(m - px) * sqrt(m - py)), 5) AS tau, round({normal_sql("z")}, 5) AS p, round(z, 3) AS z FROM z)"""


register("correlation_kendall", kendall, " UNION ALL ".join(kendall_sql(a, b) for a, b in _TAU))
_OUT = "WITH s AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3, avg(y) AS m, stddev_pop(y) AS sd FROM samples), md AS (SELECT quantile_cont(abs(y - q2), 0.5) AS mad FROM samples, s), f AS (SELECT id, grp, y, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS by_iqr, abs((y - m) / sd) > 1.959963984540054 AS by_z, abs(0.6745 * (y - q2) / mad) > 3.5 AS by_mad FROM samples, s, md)"
for _n in ("iqr", "z", "mad"):
    register({"iqr": "outlier_iqr", "z": "outlier_zscore", "mad": "outlier_mad"}[_n], lambda t, n=_n: S.outlier_flags(t.samples, "y", kinds=(n,)).where(f"by_{n}").select("id", "y"), f"{_OUT} SELECT id, y FROM f WHERE by_{_n}")
register("outlier_consensus", lambda t: S.outlier_flags(t.samples, "y").where("CAST(by_iqr AS INT) + CAST(by_z AS INT) + CAST(by_mad AS INT) >= 2").select("id"), f"{_OUT} SELECT id FROM f WHERE CAST(by_iqr AS INT) + CAST(by_z AS INT) + CAST(by_mad AS INT) >= 2")


def measures(t):
    return VectorAssembler(inputCols=_COLS, outputCol="raw").transform(t.samples)


def pca(t, k: int = 4):
    rows = measures(t)
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="z", outputCol="c").fit(scaled)
    parts = [float(v) for v in model.explainedVariance]
    return t.spark.createDataFrame([(i + 1, p, sum(parts[: i + 1])) for i, p in enumerate(parts)], "component int, explained double, cumulative double")


register("pca", pca)
register("pca_by_variance", lambda t: pca(t).where("cumulative - explained < 0.95"))
register("covariance", lambda t: t.samples.agg(*[F.round(F.covar_samp(a, b), 4).alias(f"{a}{b}") for a, b in _PAIRS]), "SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 4) AS {a}{b}" for a, b in _PAIRS) + " FROM samples")


def points(t):
    return t.vectors.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))


def standardised(rows):
    """Unit variances; means stay."""
    return StandardScaler(inputCol="features", outputCol="z", withMean=False).fit(rows).transform(rows)


def elbow(inertias: dict[int, float]) -> int:
    """The k where the inertia bends most: the largest second difference; the least k of fewer than three."""
    ks = sorted(inertias)
    bends = {k: inertias[ks[i]] - 2 * inertias[k] + inertias[ks[i + 2]] for i, k in enumerate(ks[1:-1])}
    return max(bends, key=lambda k: (bends[k], -k)) if bends else ks[0]


def described(labelled, k: int):
    """Per cluster: size, mean squared distance from its centre; beside them k and the silhouette (squared distances, one pass over sums)."""
    silhouette = ClusteringEvaluator(featuresCol="z", predictionCol="prediction").evaluate(labelled) if labelled.select("prediction").distinct().count() > 1 else 0.0
    values = labelled.select("prediction", F.posexplode(vector_to_array("z")).alias("i", "v")).groupBy("prediction", "i").agg(F.var_pop("v").alias("var"), F.count("*").alias("n"))
    got = values.groupBy("prediction").agg(F.max("n").alias("n"), F.sum("var").alias("spread"))
    return got.select(F.col("prediction").alias("cluster"), "n", "spread", F.lit(k).alias("k"), F.lit(float(silhouette)).alias("silhouette"))


def partitioned(rows, make, ks=range(2, 11)):
    """Clusters of ``rows(features)``, standardised, with k by the elbow; ``make(k)`` is a k-means estimator on ``z``."""
    z = standardised(rows).persist()
    models = {k: make(k).fit(z) for k in ks}
    k = elbow({k: m.summary.trainingCost for k, m in models.items()})
    return described(models[k].transform(z), k)


#: Principal components that a mixture is fitted on.
MIXTURE_DIMENSIONS = 8


def mixture(rows, ks=range(2, 11)):
    """Gaussian mixtures of full covariance on the first eight principal components, with k from 2 on by the least Bayes information criterion.

    In all 64 dimensions a component of few rows has a singular covariance, at which the fit fails.
    """
    scaled = standardised(rows)
    size = min(MIXTURE_DIMENSIONS, scaled.first()["z"].size)
    z = PCA(k=size, inputCol="z", outputCol="c").fit(scaled).transform(scaled).select("*", F.col("c").alias("z0")).drop("z", "c").withColumnRenamed("z0", "z").persist()
    n, d = z.count(), z.first()["z"].size
    models = {k: GaussianMixture(featuresCol="z", k=k, seed=7, maxIter=10).fit(z) for k in ks}
    free = lambda k: k * (d + d * (d + 1) / 2) + k - 1
    k = min(models, key=lambda k: (free(k) * np.log(n) - 2 * models[k].summary.logLikelihood, k))
    return described(models[k].transform(z), k)


register("cluster_kmeans", lambda t: partitioned(points(t), lambda k: KMeans(featuresCol="z", k=k, seed=7, initSteps=5)))
register("cluster_hierarchical", lambda t: C.hierarchical(t.vectors))
register("cluster_gmm", lambda t: mixture(points(t)))

register("cluster_spectral", lambda t: C.spectral(t.vectors))
register(
    "cluster_profile",
    lambda t: t.vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "x"))
    .groupBy("label", "feature").agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std")),
    """SELECT label, feature, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std
    FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings) GROUP BY 1, 2""",
)


def agreement(t):
    n = t.vectors.selectExpr("label AS a", "vec_id % 7 AS b").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    c2 = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) / 2"))
    ij, a, b = n.agg(c2("n").alias("ij")), n.groupBy("a").agg(F.sum("n").alias("x")).agg(c2("x").alias("ai")), n.groupBy("b").agg(F.sum("n").alias("x")).agg(c2("x").alias("bj"))
    return ij.crossJoin(a).crossJoin(b).crossJoin(n.agg(F.sum("n").alias("N"))).selectExpr("round((ij - ai * bj / (N * (N - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (N * (N - 1) / 2)), 6) AS ari")  # one row each


register("cluster_agreement", agreement, "WITH n AS (SELECT label AS a, vec_id % 7 AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2), q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM n GROUP BY a)) AS ai, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM n GROUP BY b)) AS bj, (SELECT sum(n) FROM n) AS N) SELECT round((ij - ai * bj / (N * (N - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (N * (N - 1) / 2)), 6) AS ari FROM q")


def scores(t):
    """Scores of the given labels, and of the label whose mean is nearest, ranked by the composite."""
    rows = V.usable_rows(t.vectors, "label", "embedding")
    labels, _, means, _ = V.features(rows)
    both = {"label": rows, "nearest_mean": rows.withColumn("label", V.nearest(F.col("v"), labels, means, "long"))}
    got = [V.scores(r, "label", "v").withColumn("method", F.lit(name)) for name, r in both.items()]
    ranked = got[0].unionByName(got[1]).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "method")))  # a row a labelling
    return ranked.select("method", "rank", *rr("silhouette", "calinski", "davies_bouldin", "composite"))


register(
    "cluster_scores",
    scores,
    """WITH l AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label IS NOT NULL AND label <> -1),
    m AS (SELECT label, k, avg(v) AS c FROM l GROUP BY 1, 2),
    near AS (SELECT vec_id, first(c ORDER BY d, c) AS c FROM (SELECT vec_id, m.label AS c, round(sum(pow(v - m.c, 2)), 9) AS d FROM l JOIN m USING (k) GROUP BY 1, 2) GROUP BY 1),
    labelled AS (SELECT 'label' AS method, vec_id, label AS c FROM l GROUP BY ALL UNION ALL SELECT 'nearest_mean', vec_id, c FROM near),
    p AS (SELECT method, c, l.vec_id, k, v FROM l JOIN labelled USING (vec_id)),
    means AS (SELECT method, c, k, avg(v) AS mean, var_pop(v) AS s, count(*) AS n FROM p GROUP BY 1, 2, 3),
    per AS (SELECT method, c, sum(s) AS s, any_value(n) AS n FROM means GROUP BY 1, 2),
    d AS (SELECT p.method, p.vec_id, p.c AS own, means.c AS other, sum(pow(v - mean, 2)) AS d2 FROM p JOIN means ON means.method = p.method AND means.k = p.k GROUP BY 1, 2, 3, 4),
    sides AS (SELECT d.method, vec_id, own, sum(d2) FILTER (own = other) AS mine, max((d2 + s) * n / greatest(n - 1, 1)) FILTER (own = other) AS inner_, max(n) FILTER (own = other) AS n, min(d2 + s) FILTER (own <> other) AS outer_
        FROM d JOIN per ON per.method = d.method AND per.c = d.other GROUP BY 1, 2, 3),
    sil AS (SELECT method, avg(CASE WHEN n > 1 THEN (outer_ - inner_) / greatest(outer_, inner_) ELSE 0 END) AS silhouette FROM sides GROUP BY 1),
    width AS (SELECT method, own AS c, avg(sqrt(mine)) AS w FROM sides GROUP BY 1, 2),
    gaps AS (SELECT a.method, a.c AS c, b.c AS o, sqrt(sum(pow(a.mean - b.mean, 2))) AS gap FROM means a JOIN means b ON a.method = b.method AND a.k = b.k AND a.c <> b.c GROUP BY 1, 2, 3),
    db AS (SELECT method, avg(worst) AS davies_bouldin FROM (SELECT gaps.method, gaps.c, max((x.w + y.w) / gap) AS worst FROM gaps JOIN width x ON x.method = gaps.method AND x.c = gaps.c JOIN width y ON y.method = gaps.method AND y.c = o GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT method, k, avg(v) AS g FROM p GROUP BY 1, 2),
    b AS (SELECT method, sum(n * pow(mean - g, 2)) AS b FROM means JOIN g USING (method, k) GROUP BY 1),
    ch AS (SELECT per.method, any_value(b.b) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))) AS calinski FROM per JOIN b USING (method) GROUP BY 1),
    scored AS (SELECT *, (silhouette + least(1.0, calinski / 1000) + greatest(0.0, 1 - davies_bouldin / 10)) / 3 AS composite FROM sil JOIN db USING (method) JOIN ch USING (method))
    SELECT method, row_number() OVER (ORDER BY composite DESC, method) AS rank, round(silhouette, 5) AS silhouette, round(calinski, 5) AS calinski, round(davies_bouldin, 5) AS davies_bouldin, round(composite, 5) AS composite FROM scored""",
)


#: Trees of the isolation forest, and rows of each tree's own sample.
TREES, TREE_ROWS = 50, 256


def isolation(t):
    """Rows whose mean path over random one-dimensional trees is among the shortest hundredth.

    Each tree has its own sample of 256 rows (all samples are the least ids after
    mixing, so the driver gets 12,800 values at most); a path that ends among several
    rows is lengthened by the mean depth of a tree of so many.
    """
    drawn = [r["y"] for r in t.samples.where("y IS NOT NULL").orderBy((F.lit(48271) * F.col("id") + 11) % 2147483647).limit(TREES * TREE_ROWS).select("y").collect()]
    samples = [np.sort(np.array(drawn[i::TREES])) for i in range(TREES) if drawn[i::TREES]]

    @F.pandas_udf("double")
    def depth(x: pd.Series) -> pd.Series:
        v, total = x.to_numpy(), np.zeros(len(x))
        for tree, sample in enumerate(samples):
            rng = np.random.default_rng(tree)
            lo, hi = np.full(len(v), sample[0]), np.full(len(v), sample[-1])
            inside = np.full(len(v), len(sample))
            for _ in range(8):
                cut = lo + (hi - lo) * rng.random()
                left, alive = v <= cut, inside > 1
                lo, hi = np.where(left, lo, np.where(alive, cut, lo)), np.where(left & alive, cut, hi)
                total += alive
                inside = np.where(alive, np.searchsorted(sample, hi, "right") - np.searchsorted(sample, lo, "left"), inside)
            more = np.maximum(inside, 2)
            total += np.where(inside > 1, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, 0)
        return pd.Series(total / max(1, len(samples)))

    scored = t.samples.select("id", "y", depth("y").alias("depth"))
    limit = scored.agg(F.percentile_approx("depth", 0.01).alias("cut"))
    return scored.crossJoin(F.broadcast(limit)).where("depth < cut").select("id", "y")


register("outlier_isolation_forest", isolation)
#: Rows within reach, itself among them, that make a vector a core point; the distance to the last of them is its k-distance.
_CORE = 4


def dbscan(t, share: float = 0.9):
    """Clusters of core points within eps of each other, eps being the 90th percentile of the k-distances.

    Other points near a core point join its cluster (the least, if several); the rest is noise, -1.
    """
    from ..operators.graph import saved

    held = t.vectors.where("embedding IS NOT NULL")
    far = saved(B.nearest(held, held, _CORE - 1).where(F.col("rank") == _CORE - 1).select("dist"), "far")
    (eps,) = S.quantiles(far, F.sqrt("dist"), [share])
    near = B.within(held, held, eps or 0.0).select("id_a", "id_b")
    return clustered(t.vectors.select(F.col("vec_id").alias("node")), near)


def clustered(nodes, near):
    """``(node, cluster)`` of ``nodes(node)`` and their symmetric neighbours ``near(id_a, id_b)``."""
    from ..operators.graph import components, saved

    near = saved(near, "near")
    core = saved(near.groupBy(F.col("id_a").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= _CORE - 1).select("node"), "core")
    from_core = near.join(core.withColumnRenamed("node", "id_b"), "id_b", "left_semi")
    edges = from_core.join(core.withColumnRenamed("node", "id_a"), "id_a", "left_semi").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    inner = core.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    border = from_core.join(core.withColumnRenamed("node", "id_a"), "id_a", "left_anti").join(inner.withColumnRenamed("node", "id_b"), "id_b").groupBy(F.col("id_a").alias("node")).agg(F.min("cluster").alias("cluster"))
    return nodes.join(inner.union(border), "node", "left").select("node", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


_DBSCAN = f"""WITH RECURSIVE gap AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b,
        sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    eps AS (SELECT quantile_cont(d, 0.9) AS e FROM (SELECT d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM gap) WHERE k = {_CORE - 1}),
    near AS MATERIALIZED (SELECT a, b FROM gap, eps WHERE d <= e),
    core AS (SELECT a AS node FROM near GROUP BY 1 HAVING count(*) >= {_CORE - 1}),
    reach AS (SELECT node, node AS c FROM core UNION SELECT near.b, reach.c FROM reach JOIN near ON near.a = reach.node JOIN core ON core.node = near.b),
    inside AS (SELECT node, min(c) AS cluster FROM reach GROUP BY 1),
    border AS (SELECT near.a AS node, min(cluster) AS cluster FROM near JOIN inside ON inside.node = near.b WHERE near.a NOT IN (SELECT node FROM core) GROUP BY 1)
    SELECT vec_id AS node, coalesce(cluster, -1) AS cluster FROM embeddings LEFT JOIN (SELECT * FROM inside UNION ALL SELECT * FROM border) x ON x.node = vec_id"""
register("cluster_dbscan", dbscan, _DBSCAN)
