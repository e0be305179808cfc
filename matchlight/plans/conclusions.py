"""Queries on comparison conclusions, and the flagship comparison of a collection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import conclusions as K
from ..operators import matching as M
from .registry import register

_TYPED = "SELECT *, CASE WHEN quality > 0.8 AND regexp_matches(description, 'ring|gear') THEN 'individual' WHEN regexp_matches(description, 'small|large') THEN 'class' ELSE 'subclass' END AS type FROM features"
_SUMMARY = f"""SELECT *, CASE WHEN mean > 0 THEN 1 - std / mean ELSE 0 END AS consistency, CASE WHEN n_individual = 0 THEN 0.5 ELSE pow(0.1, n_individual) * (1 - mean) END AS chance FROM
    (SELECT image_id, count(*) AS n, count(*) FILTER (type = 'individual') AS n_individual, count(*) FILTER (type = 'class') AS n_class, count(*) FILTER (type = 'subclass') AS n_subclass, avg(quality) AS mean, max(quality) AS best, min(quality) AS worst,
    stddev_pop(quality) AS std, sum(CASE type WHEN 'individual' THEN 1.0 WHEN 'class' THEN 0.3 ELSE 0.6 END * quality) / count(*) AS significance FROM ({_TYPED}) GROUP BY 1)"""
_CONCLUDED = f"""SELECT *, CASE WHEN n_individual >= 2 AND mean >= 0.85 AND significance >= 0.6 THEN 'identification' WHEN mean <= 0.30 OR (n >= 3 AND mean <= 0.5) THEN 'elimination'
    WHEN n_individual >= 1 AND mean >= 0.7 THEN 'inconclusive_a' WHEN mean >= 0.6 THEN 'inconclusive_b' ELSE 'inconclusive_c' END AS conclusion FROM ({_SUMMARY})"""


def typed(t):
    return K.typed(t.features, "ring|gear", "small|large")


def summary(t):
    return K.pair_summary(typed(t), "image_id", place="place")


def concluded(t):
    return K.conclude(summary(t), 2, 0.85, 0.6)


register("feature_typing", lambda t: typed(t).select("image_id", "kp_idx", "type"), f"SELECT image_id, kp_idx, type FROM ({_TYPED})")
register("feature_type_summary", lambda t: typed(t).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean")), f"SELECT type, count(*) AS n, round(avg(quality), 6) AS mean FROM ({_TYPED}) GROUP BY 1")
register("match_quality_summary", lambda t: summary(t).select("image_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "best", "worst", "std", "consistency")]), f"SELECT image_id, n, round(mean, 6) AS mean, round(best, 6) AS best, round(worst, 6) AS worst, round(std, 6) AS std, round(consistency, 6) AS consistency FROM ({_SUMMARY})")
register("match_significance", lambda t: summary(t).select("image_id", F.round("significance", 6).alias("significance"), F.round("chance", 6).alias("chance")), f"SELECT image_id, round(significance, 6) AS significance, round(chance, 6) AS chance FROM ({_SUMMARY})")
register("conclude_comparison", lambda t: concluded(t).select("image_id", "conclusion"), f"SELECT image_id, conclusion FROM ({_CONCLUDED})")
register("review_flag", lambda t: K.review(concluded(t)).select("image_id", "needs_review"), f"SELECT image_id, (conclusion = 'identification' AND significance < 0.95) OR (conclusion = 'elimination' AND mean > 0.4) OR std > 0.3 OR conclusion = 'inconclusive_a' AS needs_review FROM ({_CONCLUDED})")
register("audit_conclusions", lambda t: K.audit(concluded(t)).select("image_id", F.size("messages").cast("long").alias("n_messages"), "valid"), f"SELECT image_id, CAST((conclusion = 'identification' AND n_individual = 0) AS BIGINT) + CAST(n < 3 AS BIGINT) + CAST(std > 0.3 AS BIGINT) AS n_messages, NOT ((conclusion = 'identification' AND n_individual = 0) OR n < 3 OR std > 0.3) AS valid FROM ({_CONCLUDED})")
def levels(t):
    """Pairs by the level that the other row's id, else the score, gives; without a score it is the highest."""

    def count(a, b):
        far, s = B.others(a, b), B.rounded(B.cosine(a, b), 6)
        far_seen = far & ~np.isin(np.fmod(b.ids, 4), (0, 1))[None, :]
        basic, standard = (np.count_nonzero(far_seen & (s < x)) for x in (0.05, 0.2))
        seen = np.count_nonzero(far_seen)
        return {"forensic": np.count_nonzero(far) - seen, "basic": basic, "standard": standard - basic, "advanced": seen - standard}

    return B.tallies(t.vectors, t.probes, count).withColumnRenamed("kind", "level")


register("apply_level", lambda t: levels(t), "SELECT CASE WHEN id_b % 4 IN (0, 1) THEN 'forensic' WHEN score < 0.05 THEN 'basic' WHEN score < 0.2 THEN 'standard' ELSE 'advanced' END AS level, count(*) AS n FROM pairs GROUP BY 1")
_BEST = "SELECT label_a, label_b, distance FROM (SELECT label_a, label_b, distance, row_number() OVER (PARTITION BY id_a, label_b ORDER BY distance, id_b) AS rn FROM pairs) WHERE rn = 1"
_CHAIN = f"SELECT label_a, label_b, count(*) AS n, count(*) FILTER (distance < 1.25) AS good, avg(distance) AS mean FROM ({_BEST}) GROUP BY 1, 2"
_CONF = "least(1.0, (good / n + least(1.0, n / 6) + greatest(0.0, 1 - mean / 2)) / 3)"


def chain(t):
    """Matches of every pair of images of the query set, gated and scored."""
    best = M.best_of(t.vectors, t.probes)
    return best.groupBy("label_a", "label_b").agg(F.count("*").alias("n"), F.count_if(F.col("distance") < 1.25).alias("good"), F.avg("distance").alias("mean"))


register("pipeline_conclusion", lambda t: chain(t).selectExpr("label_a", "label_b", f"round({_CONF}, 6) AS confidence"), f"SELECT label_a, label_b, round({_CONF}, 6) AS confidence FROM ({_CHAIN})")
_RESULT = "CASE WHEN n < 1 THEN 'unsuitable' WHEN c >= 0.75 THEN 'identification' WHEN c >= 0.6 THEN 'inconclusive' ELSE 'elimination' END"
register("compare_collection", lambda t: chain(t).withColumn("c", F.expr(f"round({_CONF}, 6)")).selectExpr("label_a", "label_b", "n", "good", "c AS confidence", f"{_RESULT} AS conclusion"), f"SELECT label_a, label_b, n, good, c AS confidence, {_RESULT} AS conclusion FROM (SELECT *, round({_CONF}, 6) AS c FROM ({_CHAIN}))")
