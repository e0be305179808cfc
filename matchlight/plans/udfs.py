"""Queries that go through the user-function surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import udfs as U
from ..operators import vectors as V
from .registry import register

U.MATCHERS |= {"knn": lambda v, q: V.knn_batch(v, q, 3), "cosine": lambda v, q: V.similarity(v, q, "cosine")}


def nearest_mean(rows: pd.DataFrame) -> pd.Series:
    """Predict labels by the nearer of the two class means of one feature."""
    near = (rows["x"] - rows["mean_1"]).abs() < (rows["x"] - rows["mean_0"]).abs()
    return near.astype("int64")


def classified(t):
    """Each row is predicted by a function that knows the class means of the four other folds only."""
    rows = t.predictions.selectExpr("doc_id % 5 AS fold", "doc_id AS id", "CAST(score AS DOUBLE) AS x", "y_true AS label")
    # sums per fold and class are ten rows; those of the other folds are the total less the fold's own
    sums = rows.groupBy("fold").agg(*[f(F.expr(f"CASE WHEN label = {k} THEN x END")).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.sum, "s"), (F.count, "n"))])
    total = sums.agg(*[F.sum(c).alias(f"t{c}") for c in ("s0", "n0", "s1", "n1")])
    means = sums.crossJoin(F.broadcast(total)).selectExpr("fold", *(f"(ts{k} - coalesce(s{k}, 0)) / (tn{k} - n{k}) AS mean_{k}" for k in (0, 1)))
    return U.classify(rows.join(F.broadcast(means), "fold"), nearest_mean).selectExpr("fold", "id", "label = predicted AS hit")


def mean_score(t):
    parts = {"total": (lambda x: x.sum(), "sum"), "n": (lambda x: x.count(), "sum")}
    return U.merged_pairs(t.vectors, t.probes, ["label_a"], "score", parts, F.round(F.col("total") / F.col("n"), 5), "m")


def nearness(t):
    parts = {"least": (lambda x: x.min(), "min"), "most": (lambda x: x.max(), "max")}
    return U.merged_pairs(t.vectors, t.probes, ["label_a", "label_b"], "distance", parts, F.round(1 - F.col("least") / F.col("most"), 5), "s")


register("udf_statistic", mean_score, "SELECT label_a, round(avg(score), 5) AS m FROM pairs GROUP BY 1")
register("udf_similarity", nearness, "SELECT label_a, label_b, round(1 - min(distance) / max(distance), 5) AS s FROM pairs GROUP BY 1, 2")
register(
    "udf_classifier",
    classified,
    """WITH r AS (SELECT doc_id % 5 AS fold, doc_id AS id, score AS x, y_true AS label FROM predictions),
    m AS (SELECT f.fold, avg(r.x) FILTER (r.label = 0) AS m0, avg(r.x) FILTER (r.label = 1) AS m1 FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY 1)
    SELECT fold, id, label = CASE WHEN abs(x - m1) < abs(x - m0) THEN 1 ELSE 0 END AS hit FROM r JOIN m USING (fold)""",
)
register("udf_tile", lambda t: U.on_tiles(t.pixels.selectExpr("image_id", "CAST(y AS INT) AS y", "CAST(x AS INT) AS x", "value"), 4, lambda p: p.assign(value=p["value"] - p["value"].mean())).groupBy("image_id").agg(F.round(F.sum(F.abs("value")), 4).alias("v")),
    "SELECT image_id, round(sum(abs(value - m)), 4) AS v FROM (SELECT image_id, value, avg(value) OVER (PARTITION BY image_id, y // 4, x // 4) AS m FROM pixels) GROUP BY 1")
register("udf_validator", lambda t: t.part.select("p_partkey", U.rule(lambda x: x % 2 == 0, "odd")("p_size").alias("r")).select("p_partkey", "r.ok", "r.message"), "SELECT p_partkey, p_size % 2 = 0 AS ok, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'odd' END AS message FROM part")
register("registry_matchers", lambda t: U.MATCHERS["knn"](t.vectors, t.probes).select("id_a", "id_b", "rank"), "SELECT id_a, id_b, rank FROM (SELECT id_a, id_b, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM pairs) WHERE rank <= 3")
