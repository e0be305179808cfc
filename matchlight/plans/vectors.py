"""Queries on vectors and descriptor matches."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import metric as N
from ..operators import vectors as V
from .registry import register

_D2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_AGAINST = "FROM probes a, embeddings b WHERE a.vec_id <> b.vec_id"


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


register("knn_l2", lambda t: V.knn_l2(t.vectors, t.vectors.where("vec_id = 20"), 10).select("id_b", r("dist")), f"SELECT b.vec_id AS id_b, round({_D2}, 6) AS dist FROM embeddings a, embeddings b WHERE a.vec_id = 20 ORDER BY {_D2}, b.vec_id LIMIT 10")
register("knn_batch", lambda t: N.nearest(N.build(t.vectors), t.probes, 5).select("id_a", "id_b", "rank"), "SELECT id_a, id_b, rank FROM (SELECT id_a, id_b, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM pairs) WHERE rank <= 5")
register("range_search", lambda t: N.within(N.build(t.vectors), t.probes, math.sqrt(1.3)).select("id_a", "id_b"), f"SELECT a.vec_id AS id_a, b.vec_id AS id_b {_AGAINST} AND {_D2} <= 1.3")
register("search_similar_cases", lambda t: V.knn_batch(t.vectors, t.probes, 10).withColumn("similarity", 1 - F.sqrt("dist") / 8).where("similarity >= 0.8").join(t.orders.selectExpr("o_orderkey AS id_b", "o_custkey AS case_id"), "id_b").select("id_a", "case_id", r("similarity")),
    "SELECT id_a, o_custkey AS case_id, round(1 - distance / 8, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM pairs) JOIN orders ON o_orderkey = id_b WHERE rank <= 10 AND 1 - distance / 8 >= 0.8")
register("sim_cosine", lambda t: V.similarity(t.vectors, t.probes, "cosine", digits=6), f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_COS}, 6) AS sim {_AGAINST}")
register("sim_euclidean", lambda t: V.similarity(t.vectors, t.probes, "euclidean", digits=6), f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(1 - sqrt({_D2}) / sqrt(len(a.embedding)), 6) AS sim {_AGAINST}")
register("sim_correlation", lambda t: V.similarity(t.vectors, t.probes, "correlation", digits=6), "SELECT id_a, id_b, round(abs(corr(x, y)), 6) AS sim FROM (SELECT id_a, id_b, unnest(CAST(a.embedding AS DOUBLE[])) AS x, unnest(CAST(b.embedding AS DOUBLE[])) AS y FROM pairs JOIN embeddings a ON a.vec_id = id_a JOIN embeddings b ON b.vec_id = id_b) GROUP BY 1, 2")
register("sim_exponential", lambda t: V.similarity(t.vectors, t.probes, "exponential", 2.0, digits=6), "SELECT id_a, id_b, round(exp(-distance / 2.0), 6) AS sim FROM pairs")
register("similarity_matrix", lambda t: V.similarity_matrix(t.vectors, t.probes, digits=5), "WITH h AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim FROM probes a, embeddings b) SELECT * FROM h UNION SELECT id_b, id_a, sim FROM h")
register("batch_compare_report", lambda t: t.pair_columns("score").groupBy(F.expr("CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std")),
    "SELECT CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS class, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM pairs GROUP BY 1")
register("fuse_scores", lambda t: V.fuse_scores(t.pair_columns("id_a", "id_b", "score", "distance").withColumn("other", 1 - F.col("distance") / 8), "score", "other", "weighted", 0.3).select("id_a", "id_b", F.expr("rint(fused * 1000000) / 1000000D AS fused")), "SELECT id_a, id_b, round(0.7 * score + 0.3 * (1 - distance / 8), 6) AS fused FROM pairs")
register(
    "pair_confidence",
    lambda t: V.pair_confidence(t.vectors, t.probes),
    """WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))) AS norm FROM vectors)
    SELECT id_a, id_b, score >= 0.5 AS is_match, round(abs(score - 0.5) * 2, 6) AS confidence,
    round(greatest(0.0, least(1.0, 0.7 * score + 0.3 / (1 + exp(10 - (a.norm + b.norm) / 2)))), 6) AS quality FROM pairs JOIN n a ON a.vec_id = id_a JOIN n b ON b.vec_id = id_b""",
)
register("exclude_cases", lambda t: V.knn_batch(t.vectors.where("label NOT IN (1, 2)"), t.probes, 3).select("id_a", "id_b", "rank"), "SELECT id_a, id_b, rank FROM (SELECT id_a, id_b, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM pairs WHERE label_b NOT IN (1, 2)) WHERE rank <= 3")

# descriptors: a label is an image, a vector a descriptor
_NEAR = "SELECT label_a, label_b, id_a, id_b, distance AS d1, lead(distance) OVER w AS d2, row_number() OVER w AS rn FROM pairs WINDOW w AS (PARTITION BY id_a, label_b ORDER BY distance, id_b)"
_BEST = f"SELECT label_a, label_b, id_a, id_b, d1 AS distance FROM ({_NEAR}) WHERE rn = 1"


def best(t):
    return M.best_of(t.vectors, t.probes)


register("match_ratio_test", lambda t: M.distinctive(M.nearest_two_of(t.vectors, t.probes), 0.95).select("label_a", "label_b", "id_a", "id_b"), f"SELECT label_a, label_b, id_a, id_b FROM ({_NEAR}) WHERE rn = 1 AND d1 < 0.95 * d2")
register("match_cross_check", lambda t: M.cross_check_of(t.vectors, t.probes).select("id_a", "id_b"), "SELECT id_a, id_b FROM (SELECT *, row_number() OVER (PARTITION BY id_a, label_b ORDER BY distance, id_b) AS f, row_number() OVER (PARTITION BY id_b, label_a ORDER BY distance, id_a) AS b FROM pairs) WHERE f = 1 AND b = 1")
register("match_hamming", lambda t: V.hamming(t.vectors, t.probes),
    f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(len(list_filter(list_zip(a.embedding, b.embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS BIGINT) AS bits {_AGAINST}")
_ADAPT = f"""SELECT *, max(ok) OVER p AS any_ok FROM (SELECT *, distance <= greatest(CASE WHEN m < 5 THEN greatest(m + s, 10.0) ELSE least(m - 0.3 * s, 75.0) END, 0.1) AS ok FROM
    (SELECT *, avg(distance) OVER p AS m, stddev_pop(distance) OVER p AS s, count(*) OVER p AS n, row_number() OVER (PARTITION BY label_a, label_b ORDER BY distance, id_a, id_b) AS rn FROM ({_BEST}) WINDOW p AS (PARTITION BY label_a, label_b))) WINDOW p AS (PARTITION BY label_a, label_b)"""
register("match_adaptive_filter", lambda t: M.adaptive_filter(best(t)).select("id_a", "id_b"), f"SELECT id_a, id_b FROM ({_ADAPT}) WHERE ok OR (NOT any_ok AND rn <= least(greatest(floor(n / 3), 10), 50))")
register("match_distance_stats", lambda t: M.distance_stats(best(t)).select("label_a", "label_b", "n", r("mean"), r("std"), r("least"), r("most")), f"SELECT label_a, label_b, count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, round(min(distance), 6) AS least, round(max(distance), 6) AS most FROM ({_BEST}) GROUP BY 1, 2")
_COUNTS = f"SELECT label_a, label_b, count(*) AS n, count(*) FILTER (distance < 1.25) AS good, avg(distance) AS mean, stddev_pop(distance) AS std, min(distance) AS least, max(distance) AS most, avg(CASE WHEN distance < 1.2 THEN 1.0 ELSE 0.0 END) AS share FROM ({_BEST}) GROUP BY 1, 2"


def counts(t):
    return best(t).groupBy("label_a", "label_b").agg(F.count("*").alias("n"), F.count_if(F.col("distance") < 1.25).alias("good"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.min("distance").alias("least"), F.max("distance").alias("most"), F.avg(F.expr("CASE WHEN distance < 1.2 THEN 1.0D ELSE 0.0D END")).alias("share"))


register("match_score", lambda t: M.score(counts(t).withColumn("alg", F.lit("SIFT")).withColumn("q1", F.lit(0.8)).withColumn("q2", F.lit(0.6)).withColumn("kp2", F.lit(40)), "good", "n", "kp2", "alg", "q1", "q2").select("label_a", "label_b", r("base"), r("weighted")),
    f"SELECT label_a, label_b, round(least(b, 100), 6) AS base, round(least(b, 100) * (0.5 + 0.5 * (2 * 0.8 * 0.6 / 1.4)), 6) AS weighted FROM (SELECT *, CASE WHEN good >= 20 THEN 1.1 ELSE 1.0 END * good / least(n, 40) * 100 AS b FROM ({_COUNTS}))")
register("match_confidence", lambda t: counts(t).select("label_a", "label_b", F.round(M.confidence("good", "n"), 6).alias("confidence")), f"SELECT label_a, label_b, round(100 * CASE WHEN good >= 15 THEN 0.9 * good / n + 0.1 WHEN good >= 8 THEN 0.7 * good / n + 0.1 ELSE 0.5 * good / n END, 6) AS confidence FROM ({_COUNTS})")
register("match_quality", lambda t: counts(t).selectExpr("label_a", "label_b", "round(1 - mean / most, 6) AS quality"), f"SELECT label_a, label_b, round(1 - mean / most, 6) AS quality FROM ({_COUNTS})")
register("similarity_with_distance", lambda t: counts(t).selectExpr("label_a", "label_b", "least(100D, 100D * good / n) * greatest(0.1D, 1 - mean / 2) AS s").selectExpr("label_a", "label_b", "round(s, 6) AS similarity", "CASE WHEN s >= 70 THEN 'Alta' WHEN s >= 40 THEN 'Media' ELSE 'Baja' END AS level"),
    f"SELECT label_a, label_b, round(s, 6) AS similarity, CASE WHEN s >= 70 THEN 'Alta' WHEN s >= 40 THEN 'Media' ELSE 'Baja' END AS level FROM (SELECT *, least(100.0, 100.0 * good / n) * greatest(0.1, 1 - mean / 2) AS s FROM ({_COUNTS}))")
register("match_statistics", lambda t: counts(t).selectExpr("label_a", "label_b", "round(mean, 6) AS mean", "round(share, 6) AS close_share", "round(1 / (1 + std), 6) AS consistency"), f"SELECT label_a, label_b, round(mean, 6) AS mean, round(share, 6) AS close_share, round(1 / (1 + std), 6) AS consistency FROM ({_COUNTS})")
register("match_consistency", lambda t: counts(t).selectExpr("label_a", "label_b", "CASE WHEN n < 4 THEN 0D ELSE round(greatest(0D, least(1D, 1 - std / mean)), 6) END AS consistency"), f"SELECT label_a, label_b, CASE WHEN n < 4 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - std / mean)), 6) END AS consistency FROM ({_COUNTS})")
register("search_top_matches", lambda t: counts(t).where("label_a = 3").withColumn("s", F.expr("good / n")).orderBy(F.desc("s"), "label_b").limit(5).select("label_b", "good", F.round("s", 6).alias("s")), f"SELECT label_b, good, round(good / n, 6) AS s FROM ({_COUNTS}) WHERE label_a = 3 ORDER BY good / n DESC, label_b LIMIT 5")


_PART = ("same_mean", "same_std", "other_mean", "other_std", "matched")


def compare_algorithms(t):
    """A row an algorithm, with the names of the best by similarity of one label, by discrimination and by matches."""
    one = V.algorithm_report(t.vectors, t.probes).select("alg", *[r(c) for c in _PART]).withColumn("discrimination", F.round(F.col("same_mean") - F.col("other_mean"), 5))
    best = lambda c: F.min_by("alg", F.struct(-F.col(c), F.col("alg"))).over(Window.partitionBy())
    return one.withColumns({"most_similar": best("same_mean"), "best": best("discrimination"), "most_matches": best("matched")})


register(
    "compare_algorithms",
    compare_algorithms,
    """WITH c AS (SELECT id_a, id_b, abs(corr(x, y)) AS r FROM (SELECT id_a, id_b, unnest(CAST(a.embedding AS DOUBLE[])) AS x, unnest(CAST(b.embedding AS DOUBLE[])) AS y
        FROM pairs JOIN embeddings a ON a.vec_id = id_a JOIN embeddings b ON b.vec_id = id_b) GROUP BY 1, 2
    ), s AS (
        SELECT 'cosine' AS alg, score AS s, same FROM pairs UNION ALL SELECT 'euclidean', 1 - distance / 8, same FROM pairs
        UNION ALL SELECT 'correlation', round(CASE WHEN isfinite(r) THEN r ELSE 0 END, 6), same FROM pairs JOIN c USING (id_a, id_b)
    ), a AS (
        SELECT alg, round(avg(s) FILTER (same), 6) AS same_mean, round(stddev_pop(s) FILTER (same), 6) AS same_std, round(avg(s) FILTER (NOT same), 6) AS other_mean,
               round(stddev_pop(s) FILTER (NOT same), 6) AS other_std, round(avg(CASE WHEN s >= 0.5 THEN 1.0 WHEN s < 0.5 THEN 0.0 END), 6) AS matched FROM s GROUP BY 1
    ), d AS (
        SELECT *, round(same_mean - other_mean, 5) AS discrimination FROM a
    )
    SELECT *, (SELECT alg FROM d ORDER BY same_mean DESC, alg LIMIT 1) AS most_similar, (SELECT alg FROM d ORDER BY discrimination DESC, alg LIMIT 1) AS best,
        (SELECT alg FROM d ORDER BY matched DESC, alg LIMIT 1) AS most_matches FROM d""",
)
