"""Comparison conclusions: feature types, significance and the ladder of conclusions, per image pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of feature types and limits of the ladder.
WEIGHTS = {"individual": 1.0, "class": 0.3, "subclass": 0.6}


def typed(matches: DataFrame, individual: str, class_words: str) -> DataFrame:
    kind = F.when((F.col("quality") > 0.8) & F.col("description").rlike(individual), "individual").when(F.col("description").rlike(class_words), "class").otherwise("subclass")
    return matches.withColumn("type", kind)


def pair_summary(matches: DataFrame, *by: str, place: str) -> DataFrame:
    """Per pair: counts by type, mean, best, worst and spread of quality, significance and chance of a random match.

    The ladder's limits are met exactly by sums of doubles, so those are added in the order of
    ``place``, however the rows are dealt.
    """
    is_ = lambda k: F.col("type") == k
    w = sum((F.when(is_(k), F.lit(v)).otherwise(0.0) for k, v in WEIGHTS.items()), F.lit(0.0))
    rows = F.sort_array(F.collect_list(F.struct(place, F.col("quality").alias("q"), (w * F.col("quality")).alias("wq"))))
    total = lambda c: F.aggregate("rows", F.lit(0.0), lambda t, x: t + F.coalesce(x[c], F.lit(0.0)))
    s = matches.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(is_(k)).alias(f"n_{k}") for k in WEIGHTS], F.count("quality").alias("known"), F.max("quality").alias("best"), F.min("quality").alias("worst"),
        F.stddev_pop("quality").alias("std"), rows.alias("rows"),
    )
    s = s.withColumn("mean", F.try_divide(total("q"), "known")).withColumn("significance", F.when(F.col("known") > 0, total("wq") / F.col("n"))).drop("rows", "known")
    chance = F.when(F.col("n_individual") == 0, 0.5).otherwise(F.pow(F.lit(0.1), F.col("n_individual")) * (1 - F.col("mean")))
    return s.withColumn("consistency", F.when(F.col("mean") > 0, 1 - F.col("std") / F.col("mean")).otherwise(0.0)).withColumn("chance", chance)


def conclude(pairs: DataFrame, individual: int = 8, quality: float = 0.85, significance: float = 0.90) -> DataFrame:
    ladder = (
        F.when((F.col("n_individual") >= individual) & (F.col("mean") >= quality) & (F.col("significance") >= significance), "identification")
        .when((F.col("mean") <= 0.30) | ((F.col("n") >= 3) & (F.col("mean") <= 0.5)), "elimination")
        .when((F.col("n_individual") >= individual / 2) & (F.col("mean") >= 0.7), "inconclusive_a").when(F.col("mean") >= 0.6, "inconclusive_b").otherwise("inconclusive_c")
    )
    return pairs.withColumn("conclusion", ladder)


def review(pairs: DataFrame) -> DataFrame:
    weak = (F.col("conclusion") == "identification") & (F.col("significance") < 0.95)
    low = (F.col("conclusion") == "elimination") & (F.col("mean") > 0.4)
    return pairs.withColumn("needs_review", weak | low | (F.col("std") > 0.3) | (F.col("conclusion") == "inconclusive_a"))


def audit(pairs: DataFrame) -> DataFrame:
    messages = F.array_compact(F.array(
        F.when((F.col("conclusion") == "identification") & (F.col("n_individual") == 0), "identification without individual features"),
        F.when(F.col("n") < 3, "few features"), F.when(F.col("std") > 0.3, "uneven quality"),
    ))
    return pairs.withColumn("messages", messages).withColumn("valid", F.size("messages") == 0)
