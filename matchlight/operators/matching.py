"""Descriptor matching: an image's descriptors against another image's, by joins on the image pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mutual, nearest

# Bonus of an algorithm from so many good matches.
BONUS = {"ORB": (10, 1.2), "SIFT": (20, 1.1), "AKAZE": (8, 1.15)}


def nearest_two(pairs: DataFrame) -> DataFrame:
    """Of ``(id_a, id_b, label_a, label_b, distance)``: per query descriptor and train image, the two nearest as ``d1, d2``."""
    w = Window.partitionBy("id_a", "label_b").orderBy("distance", "id_b")
    ranked = pairs.withColumn("rn", F.row_number().over(w)).withColumn("d2", F.lead("distance").over(w))
    return ranked.where("rn = 1").select("label_a", "label_b", "id_a", "id_b", F.col("distance").alias("d1"), "d2")


def nearest_two_of(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``nearest_two`` of all queries beside all other rows, without a row a pair."""
    near = nearest(vectors, queries, 2, by_label=True).withColumn("d", F.sqrt("dist"))
    two = near.groupBy("id_a", "label_a", "label_b").agg(*[F.max(F.when(F.col("rank") == k, F.col(c))).alias(n) for k, c, n in ((1, "id_b", "id_b"), (1, "d", "d1"), (2, "d", "d2"))])
    return two.select("label_a", "label_b", "id_a", "id_b", "d1", "d2")


def best_of(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The nearest of ``nearest_two_of`` alone, as ``distance``: tasks keep and send one row of every label."""
    return nearest(vectors, queries, 1, by_label=True).select("label_a", "label_b", "id_a", "id_b", F.sqrt("dist").alias("distance"))


def ratio_test(pairs: DataFrame, ratio: float = 0.7) -> DataFrame:
    return distinctive(nearest_two(pairs), ratio)


def distinctive(two: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Of ``nearest_two``, those clearly nearer than the second."""
    return two.where(F.col("d1") < ratio * F.col("d2"))


def cross_check_of(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``cross_check`` of all queries beside all other rows, without a row a pair: each side's best, where they agree."""
    return mutual(vectors, queries).select("label_a", "label_b", "id_a", "id_b", F.sqrt("dist").alias("distance"))


def cross_check(pairs: DataFrame) -> DataFrame:
    """Mutual best matches between each pair of images."""
    forth, back = Window.partitionBy("id_a", "label_b").orderBy("distance", "id_b"), Window.partitionBy("id_b", "label_a").orderBy("distance", "id_a")
    return pairs.withColumn("f", F.row_number().over(forth)).withColumn("b", F.row_number().over(back)).where("f = 1 AND b = 1").select("label_a", "label_b", "id_a", "id_b", "distance")


def adaptive_filter(matches: DataFrame, scale: float = 1.0) -> DataFrame:
    """Matches within the pair's own distance limit, or its best third (10 to 50) if none are."""
    pair = Window.partitionBy("label_a", "label_b")
    d = F.col("distance") * scale
    m, s = F.avg(d).over(pair), F.stddev_pop(d).over(pair)
    limit = F.greatest(F.when(m < 5, F.greatest(m + s, F.lit(10.0))).otherwise(F.least(m - 0.3 * s, F.lit(75.0))), F.lit(0.1))
    rn = F.row_number().over(pair.orderBy("distance", "id_a", "id_b"))
    marked = matches.withColumn("ok", d <= limit).withColumn("rn", rn).withColumn("n", F.count("*").over(pair))
    marked = marked.withColumn("any_ok", F.max("ok").over(pair))
    third = F.least(F.greatest(F.floor(F.col("n") / 3), F.lit(10)), F.lit(50))
    return marked.where(F.col("ok") | (~F.col("any_ok") & (F.col("rn") <= third))).select("label_a", "label_b", "id_a", "id_b", "distance")


def distance_stats(matches: DataFrame) -> DataFrame:
    return matches.groupBy("label_a", "label_b").agg(
        F.count("*").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.min("distance").alias("least"), F.max("distance").alias("most")
    )


def score(pairs: DataFrame, good: str, kp1: str, kp2: str, algorithm: str, q1: str, q2: str) -> DataFrame:
    """``base``, ``quality`` and ``weighted`` of match counts, in 0..100."""
    base = F.col(good) / F.least(kp1, kp2)
    for name, (least, factor) in BONUS.items():
        base = F.when((F.col(algorithm) == name) & (F.col(good) >= least), F.col(good) / F.least(kp1, kp2) * factor).otherwise(base)
    total = F.col(q1) + F.col(q2)
    quality = F.when(total > 0, 2 * F.col(q1) * F.col(q2) / total).otherwise(0.0)
    capped = F.least(base * 100, F.lit(100.0))
    return pairs.withColumn("base", capped).withColumn("harmonic", quality).withColumn("weighted", capped * (0.5 + 0.5 * quality))


def confidence(good: str, every: str):
    """0..100 from the share of good matches and their number."""
    r = F.col(good) / F.col(every)
    return 100 * F.when(F.col(every) == 0, 0.0).when(F.col(good) >= 15, 0.9 * r + 0.1).when(F.col(good) >= 8, 0.7 * r + 0.1).otherwise(0.5 * r)
