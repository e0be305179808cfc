"""Evaluation of matchers: confusion counts, ranking curves, folds and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import placed

# Acceptance thresholds of a validation.
ACCEPT = {"accuracy": 0.95, "precision": 0.90, "recall": 0.85, "specificity": 0.95, "f1": 0.90}


def key_hash(k: str) -> Column:
    """A shuffling key in integer arithmetic, the same in any engine."""
    return (F.lit(48271) * F.col(k) + 11) % F.lit(2147483647)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by true and predicted class, with the share of the true class."""
    n = rows.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "y_true")))


def class_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Per class: support, precision, recall and F1, 0 where undefined."""
    cls = rows.select(*by, F.explode(F.array_distinct(F.array("y_true", "y_pred"))).alias("cls"), "y_true", "y_pred")
    n = cls.groupBy(*by, "cls").agg(
        F.count_if((F.col("y_true") == F.col("cls")) & (F.col("y_pred") == F.col("cls"))).alias("tp"), F.count_if(F.col("y_true") == F.col("cls")).alias("support"), F.count_if(F.col("y_pred") == F.col("cls")).alias("predicted")
    )
    p, r = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    n = n.withColumn("precision", p).withColumn("recall", r)
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def class_metrics(rows: DataFrame, *by: str) -> DataFrame:
    w = F.sum("support")
    return class_rates(rows, *by).groupBy(*by).agg(
        (F.sum("tp") / w).alias("accuracy"), *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")], *[(F.sum(F.col(m) * F.col("support")) / w).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")]
    )


def roc_points(pairs: DataFrame, score: str = "score", truth: str = "same") -> DataFrame:
    """``(score, tp, fp, fpr, tpr)`` at every distinct score, from the highest down.

    Scores are first counted, so the running sums go over distinct rounded scores: a
    table bounded by the resolution of the score, not by the pairs.
    """
    return roc_of_counts(pairs.groupBy(F.col(score).alias("score")).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n")))


def roc_of_counts(per: DataFrame) -> DataFrame:
    """``roc_points`` of scores that are counted already: ``(score, p, n)``."""
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("score", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))
    total = per.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    return run.crossJoin(F.broadcast(total)).select("score", "tp", "fp", (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"), "P", "N")


def area(points: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    w = Window.orderBy(F.desc("score"))
    return points.select((( F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))) * (F.col(y) + F.coalesce(F.lag(y).over(w), F.lit(0.0))) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def curve_summary(points: DataFrame, at: float, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """``(area, y_at)`` of a stored curve: trapezoids between its points, and linear between the neighbours of ``at``; null beyond the curve."""
    w = Window.orderBy(F.desc("score"))
    steps = points.select(F.struct(x, y).alias("p"), ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a"))
    s = steps.agg(F.sum("a").alias("area"), F.max(F.when(F.col(f"p.{x}") <= at, F.col("p"))).alias("lo"), F.min(F.when(F.col(f"p.{x}") > at, F.col("p"))).alias("hi"))
    between = F.expr(f"lo.{y} + ({at}D - lo.{x}) / (hi.{x} - lo.{x}) * (hi.{y} - lo.{y})")
    return s.select("area", F.when(F.col(f"lo.{x}") == at, F.col(f"lo.{y}")).otherwise(between).alias("y_at"))


def match_rates(pairs: DataFrame, threshold: float) -> DataFrame:
    hit, same = F.col("score") >= threshold, F.col("same")
    return rates_of_counts(pairs.agg(F.count_if(hit & same).alias("tp"), F.count_if(~hit & ~same).alias("tn"), F.count_if(hit & ~same).alias("fp"), F.count_if(~hit & same).alias("fn")))


def rates_of_kinds(kinds: DataFrame) -> DataFrame:
    """``match_rates`` of pairs that are counted already: ``(kind, n)``."""
    return rates_of_counts(kinds.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("long")).alias(k) for k in ("tp", "tn", "fp", "fn")]))


def rates_of_counts(n: DataFrame) -> DataFrame:
    div = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0D END")
    return n.select(
        "tp", "tn", "fp", "fn", div("tp + tn", "tp + tn + fp + fn").alias("accuracy"), div("tp", "tp + fp").alias("precision"), div("tp", "tp + fn").alias("recall"),
        div("tn", "tn + fp").alias("specificity"), div("2 * tp", "2 * tp + fp + fn").alias("f1"), div("fp", "fp + tn").alias("fmr"), div("fn", "fn + tp").alias("fnmr"),
    )


def cmc_curve(leading: DataFrame, ranks: int = 50) -> DataFrame:
    """Share of probes whose first gallery item of their own class comes by each rank, of ``blocks.leading``."""
    first = leading.groupBy("id_a").agg(F.min(F.when(F.col("same"), F.col("rank"))).alias("first"), F.max("any").alias("any"))
    counts = first.where("any").groupBy(F.col("first").alias("rank")).agg(F.count("*").alias("n"))  # a row per rank, and one of those that come later
    grid = leading.sparkSession.range(1, ranks + 1).withColumnRenamed("id", "rank")  # a row per rank
    both = grid.join(F.broadcast(counts), "rank", "full")
    w = Window.orderBy(F.col("rank").asc_nulls_last())
    run = both.select("rank", F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.where("rank IS NOT NULL").select("rank", (F.col("hits") / F.col("total")).alias("share"))


def folds(rows: DataFrame, key: str, label: str | None, k: int) -> DataFrame:
    """``fold`` 0..k-1, shuffled by the key's hash, stratified by ``label`` if given; a large class is many tasks."""
    at = placed(rows.withColumn("_hash", key_hash(key)), [label] if label else [], ["_hash", key])
    return at.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(k))).select(*rows.columns, "fold")


def split(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Stratified 70/15/15 by the rank of the key's hash within the class; a large class is many tasks."""
    at = placed(rows.withColumn("_hash", key_hash(key)), [label], ["_hash", key])
    p = (F.col("_rank") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
    return at.withColumn("split", F.when(p < 0.7, "train").when(p < 0.85, "val").otherwise("test")).select(*rows.columns, "split")


def longer(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.unpivot(keys, values, "metric", "value")


def across_folds(long: DataFrame, *by: str) -> DataFrame:
    return long.groupBy(*by, "metric").agg(
        F.count("value").alias("k"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", 0.5).alias("median")
    )


def reliability(long: DataFrame) -> DataFrame:
    a = long.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = a.agg(
        clip(1 - F.avg(F.col("s") / F.col("m"))).alias("reproducibility"), clip(1 - F.avg("s") / 0.1).alias("repeatability"), clip(1 - 10 * F.avg(F.col("s") * F.col("s"))).alias("stability"), clip(1 - 2 * F.avg(F.col("hi") - F.col("lo"))).alias("robustness")
    )
    return parts.withColumn("overall", F.expr("0.4 * reproducibility + 0.3 * repeatability + 0.2 * stability + 0.1 * robustness"))
