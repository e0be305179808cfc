"""Queries on match evaluation and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import evaluation as E
from ..operators import vectors as V
from ..operators.ranges import placed
from .registry import register


def r(*columns: str, n: int = 6):
    return [F.round(c, n).alias(c) for c in columns]


def sr(*columns: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in columns)


def roc(t):
    return E.roc_of_counts(B.score_counts(t.vectors, t.probes))


register("confusion_matrix", lambda t: E.confusion(t.predictions).select("y_true", "y_pred", "n", *r("share")), "SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true), 6) AS share FROM (SELECT y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2)")
_RATES = "SELECT {by} cls, count(*) FILTER (y_true = cls AND y_pred = cls) AS tp, count(*) FILTER (y_true = cls) AS support, count(*) FILTER (y_pred = cls) AS predicted FROM {rows}, (SELECT unnest([0, 1]) AS cls) GROUP BY ALL"
_PRF = "SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f FROM (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM ({rates}))"
_M = "sum(tp) / sum(support) AS accuracy, avg(p) AS precision_macro, avg(rc) AS recall_macro, avg(f) AS f1_macro, sum(p * support) / sum(support) AS precision_weighted, sum(rc * support) / sum(support) AS recall_weighted, sum(f * support) / sum(support) AS f1_weighted"
_NAMES = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted")
register("class_metrics", lambda t: E.class_metrics(t.predictions).select(*r(*_NAMES)), f"SELECT {sr(*_NAMES)} FROM (SELECT {_M} FROM ({_PRF.format(rates=_RATES.format(by='', rows='predictions'))}))")
_ROC = "SELECT score, tp, fp, fp / max(fp) OVER () AS fpr, tp / max(tp) OVER () AS tpr, max(tp) OVER () AS np FROM (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM (SELECT score, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM pairs GROUP BY 1))"
register("roc_points", lambda t: roc(t).select("score", *r("fpr", "tpr")), f"SELECT score, {sr('fpr', 'tpr')} FROM ({_ROC})")
_AREA = "SELECT round(sum(({x} - coalesce(lag({x}) OVER w, 0)) * ({y} + coalesce(lag({y}) OVER w, 0)) / 2), 5) AS auc FROM ({p}) WINDOW w AS (ORDER BY score DESC)"
_AREA = "SELECT round(sum(a), 5) AS auc FROM (SELECT ({x} - coalesce(lag({x}) OVER w, 0)) * ({y} + coalesce(lag({y}) OVER w, 0)) / 2 AS a FROM ({p}) WINDOW w AS (ORDER BY score DESC))"
register("roc_auc", lambda t: E.area(roc(t)).select(*r("auc", n=5)), _AREA.format(x="fpr", y="tpr", p=_ROC))
register("pr_auc", lambda t: E.area(roc(t).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))), "tpr", "precision").select(*r("auc", n=5)), _AREA.format(x="tpr", y="precision", p=f"SELECT score, tpr, tp / (tp + fp) AS precision FROM ({_ROC})"))
_CENTRES = "SELECT label AS cls, k, avg(v) AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2"
_CLASS_SCORES = f"SELECT e.vec_id, e.label, c.cls, round(sum(e.v * c.v), 6) AS s FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) e JOIN ({_CENTRES}) c USING (k) GROUP BY ALL"


def class_scores(t):
    long = t.vectors.selectExpr("vec_id", "label", "posexplode(embedding) AS (k, v)").withColumn("v", F.col("v").cast("double"))
    centres = long.groupBy(F.col("label").alias("cls"), "k").agg(F.avg("v").alias("c"))
    return long.join(F.broadcast(centres), "k").groupBy("vec_id", "label", "cls").agg(F.round(F.sum(F.col("v") * F.col("c")), 6).alias("s"))  # classes x dimensions rows


def auc_macro(t):
    w = Window.partitionBy("cls").orderBy("s")
    ranked = class_scores(t).withColumn("same", F.col("label") == F.col("cls")).withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy("cls", "s")) - 1) / 2)
    per = ranked.groupBy("cls").agg(F.sum(F.when(F.col("same"), F.col("rank"))).alias("rs"), F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"))
    return per.select(((F.col("rs") - F.expr("p * (p + 1) / 2")) / (F.col("p") * F.col("n"))).alias("a")).agg(F.round(F.avg("a"), 5).alias("auc"))


register("auc_macro", auc_macro, f"WITH s AS ({_CLASS_SCORES}), rk AS (SELECT cls, label = cls AS same, rank() OVER (PARTITION BY cls ORDER BY s) + (count(*) OVER (PARTITION BY cls, s) - 1) / 2 AS rk FROM s) SELECT round(avg(a), 5) AS auc FROM (SELECT (sum(rk) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2) / (count(*) FILTER (same) * count(*) FILTER (NOT same)) AS a FROM rk GROUP BY cls)")
register("top_k_accuracy", lambda t: class_scores(t).withColumn("rn", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "cls"))).where("cls = label").select(F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("k"), "rn").groupBy("k").agg(F.round(F.avg((F.col("rn") <= F.col("k")).cast("double")), 6).alias("accuracy")),
    f"SELECT k, round(avg(CASE WHEN rn <= k THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS rn FROM ({_CLASS_SCORES})), (SELECT unnest([1, 3, 5, 10]) AS k) WHERE cls = label GROUP BY 1")
register("optimal_threshold", lambda t: roc(t).select("score", F.round(F.col("tpr") - F.col("fpr"), 6).alias("j"), F.round(F.expr("fpr * fpr + (1 - tpr) * (1 - tpr)"), 6).alias("c")).agg(F.expr("max_by(score, struct(j, score)) AS youden"), F.expr("min_by(score, struct(c, score)) AS corner")),
    f"SELECT (SELECT score FROM ({_ROC}) ORDER BY round(tpr - fpr, 6) DESC, score DESC LIMIT 1) AS youden, (SELECT score FROM ({_ROC}) ORDER BY round(fpr * fpr + (1 - tpr) * (1 - tpr), 6), score LIMIT 1) AS corner")
register("equal_error_rate", lambda t: roc(t).agg(F.expr("min_by(struct(score AS threshold, (fpr + 1 - tpr) / 2 AS eer), struct(round(abs(fpr - (1 - tpr)), 6), score)) AS m")).select("m.threshold", F.round("m.eer", 6).alias("eer")), f"SELECT score AS threshold, round((fpr + 1 - tpr) / 2, 6) AS eer FROM ({_ROC}) ORDER BY round(abs(fpr - (1 - tpr)), 6), score LIMIT 1")
_MR = ("accuracy", "precision", "recall", "specificity", "f1", "fmr", "fnmr")
register("match_rates", lambda t: E.rates_of_kinds(B.outcomes(t.vectors, t.probes, 0.1)).select("tp", "tn", "fp", "fn", *r(*_MR)),
    f"SELECT tp, tn, fp, fn, {sr(*_MR)} FROM (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fmr, fn / (fn + tp) AS fnmr FROM (SELECT count(*) FILTER (score >= 0.1 AND same) AS tp, count(*) FILTER (score < 0.1 AND NOT same) AS tn, count(*) FILTER (score >= 0.1 AND NOT same) AS fp, count(*) FILTER (score < 0.1 AND same) AS fn FROM pairs))")
register("cmc_curve", lambda t: E.cmc_curve(B.leading(t.vectors, t.probes, 50)).select("rank", *r("share")), "WITH f AS (SELECT id_a, min(rank) FILTER (same) AS first FROM (SELECT id_a, same, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS rank FROM pairs) GROUP BY 1) SELECT rank, round(count(*) FILTER (first <= rank) / count(first), 6) AS share FROM f, (SELECT unnest(generate_series(1, 50)) AS rank) GROUP BY 1")
register("hierarchical_accuracy", lambda t: t.part.selectExpr("stack(3, 'brand', p_brand = 'Brand#2', 'type', p_type = 'ECONOMY', 'size', p_size > 25) AS (level, hit)").groupBy("level").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy")),
    "SELECT level, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT 'brand' AS level, p_brand = 'Brand#2' AS hit FROM part UNION ALL SELECT 'type', p_type = 'ECONOMY' FROM part UNION ALL SELECT 'size', p_size > 25 FROM part) GROUP BY 1")
register(
    "curve_summary",
    lambda t: E.curve_summary(roc(t), 0.1).select(F.round("area", 5).alias("area"), F.round("y_at", 5).alias("tpr_at")),
    f"""WITH roc AS ({_ROC}), lo AS (SELECT fpr, tpr FROM roc WHERE fpr <= 0.1 ORDER BY fpr DESC, tpr DESC LIMIT 1), hi AS (SELECT fpr, tpr FROM roc WHERE fpr > 0.1 ORDER BY fpr, tpr LIMIT 1),
    steps AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY score DESC))
    SELECT (SELECT round(sum(a), 5) FROM steps) AS area,
        (SELECT round(CASE WHEN lo.fpr = 0.1 THEN lo.tpr ELSE lo.tpr + (0.1 - lo.fpr) / (hi.fpr - lo.fpr) * (hi.tpr - lo.tpr) END, 5) FROM lo LEFT JOIN hi ON true) AS tpr_at""",
)

# folds
_H = "(48271 * doc_id + 11) % 2147483647"
_FOLD = f"SELECT *, (row_number() OVER (PARTITION BY y_true ORDER BY {_H}, doc_id) - 1) % 5 AS fold FROM predictions"
_FM = f"SELECT fold, {_M} FROM ({_PRF.format(rates=_RATES.format(by='fold,', rows=f'({_FOLD})'))}) GROUP BY 1"
_LONG = " UNION ALL ".join(f"SELECT fold, '{m}' AS metric, {m} AS value FROM fm" for m in _NAMES[:4])


def fold_long(t):
    return E.longer(E.class_metrics(E.folds(t.predictions, "doc_id", "y_true", 5), "fold"), ["fold"], list(_NAMES[:4]))


register("fold_assign", lambda t: E.folds(t.predictions, "doc_id", "y_true", 5).select("doc_id", F.col("fold").cast("long").alias("fold")), f"SELECT doc_id, fold FROM ({_FOLD})")
register("fold_metrics", lambda t: E.class_metrics(E.folds(t.predictions, "doc_id", "y_true", 5), "fold").select(F.col("fold").cast("long").alias("fold"), *r(*_NAMES)), f"SELECT fold, {sr(*_NAMES)} FROM ({_FM})")
_AGG = f"WITH fm AS ({_FM}), lg AS ({_LONG}), ag AS (SELECT metric, count(*) AS k, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most, median(value) AS median FROM lg GROUP BY 1)"
register("fold_aggregate", lambda t: E.across_folds(fold_long(t)).select("metric", "k", *r("mean", "std", "least", "most", "median")), f"{_AGG} SELECT metric, k, {sr('mean', 'std', 'least', 'most', 'median')} FROM ag")
register("fold_interval", lambda t: E.across_folds(fold_long(t)).selectExpr("metric", "round(std / sqrt(k), 6) AS half_over_t"), f"{_AGG} SELECT metric, round(std / sqrt(k), 6) AS half_over_t FROM ag")
register("fold_threshold_test", lambda t: E.across_folds(fold_long(t)).selectExpr("metric", "round((mean - 0.85) / (std / sqrt(k)), 4) AS t", "std / mean < 0.1 AS consistent"), f"{_AGG} SELECT metric, round((mean - 0.85) / (std / sqrt(k)), 4) AS t, std / mean < 0.1 AS consistent FROM ag")
register("class_balance", lambda t: t.labels.groupBy("quality").agg(F.count("*").alias("o")).withColumn("e", F.avg("o").over(Window.partitionBy())).agg(F.round(F.sum(F.expr("(o - e) * (o - e) / e")), 5).alias("chi2"), (F.count("*") - 1).alias("df")), "SELECT round(sum((o - e) * (o - e) / e), 5) AS chi2, count(*) - 1 AS df FROM (SELECT o, avg(o) OVER () AS e FROM (SELECT count(*) AS o FROM labels GROUP BY quality))")
_REL = ("reproducibility", "repeatability", "stability", "robustness", "overall")
register("reliability_scores", lambda t: E.reliability(fold_long(t)).select(*r(*_REL, n=5)),
    f"WITH fm AS ({_FM}), lg AS ({_LONG}), a AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS s, max(value) AS hi, min(value) AS lo FROM lg GROUP BY 1), p AS (SELECT greatest(0, least(1, 1 - avg(s / m))) AS reproducibility, greatest(0, least(1, 1 - avg(s) / 0.1)) AS repeatability, greatest(0, least(1, 1 - 10 * avg(s * s))) AS stability, greatest(0, least(1, 1 - 2 * avg(hi - lo))) AS robustness FROM a), o AS (SELECT *, 0.4 * reproducibility + 0.3 * repeatability + 0.2 * stability + 0.1 * robustness AS overall FROM p) SELECT {sr(*_REL, n=5)} FROM o")
register("uncertainty_budget", lambda t: E.across_folds(fold_long(t)).selectExpr("metric", "round(std / sqrt(k), 6) AS type_a", "round(2 * std / sqrt(k), 6) AS expanded", "round(std / mean, 6) AS cv", "round(most - least, 6) AS spread"), f"{_AGG} SELECT metric, round(std / sqrt(k), 6) AS type_a, round(2 * std / sqrt(k), 6) AS expanded, round(std / mean, 6) AS cv, round(most - least, 6) AS spread FROM ag")
_VALUES = ", ".join(f"('{k}', {v})" for k, v in E.ACCEPT.items())
register("validation_verdict", lambda t: (lambda m: m.join(F.broadcast(t.spark.createDataFrame(list(E.ACCEPT.items()), "metric string, least double")), "metric").withColumn("passed", F.col("value") >= F.col("least")).withColumn("valid", F.min("passed").over(Window.partitionBy())).select("metric", *r("value"), "passed", "valid"))(E.rates_of_kinds(B.outcomes(t.vectors, t.probes, 0.1)).drop("tp", "tn", "fp", "fn").unpivot([], ["accuracy", "precision", "recall", "specificity", "f1"], "metric", "value")),
    f"WITH c AS (SELECT count(*) FILTER (score >= 0.1 AND same) AS tp, count(*) FILTER (score < 0.1 AND NOT same) AS tn, count(*) FILTER (score >= 0.1 AND NOT same) AS fp, count(*) FILTER (score < 0.1 AND same) AS fn FROM pairs), m AS (SELECT 'accuracy' AS metric, (tp + tn) / (tp + tn + fp + fn) AS value FROM c UNION ALL SELECT 'precision', tp / (tp + fp) FROM c UNION ALL SELECT 'recall', tp / (tp + fn) FROM c UNION ALL SELECT 'specificity', tn / (tn + fp) FROM c UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM c) SELECT metric, round(value, 6) AS value, value >= least AS passed, bool_and(value >= least) OVER () AS valid FROM m JOIN (VALUES {_VALUES}) v(metric, least) USING (metric)")
register("compare_validations", lambda t: fold_long(t).groupBy("metric").agg(F.expr("CAST(max_by(fold, struct(round(value, 6), -fold)) AS BIGINT) AS best"), F.expr("CAST(min_by(fold, struct(round(value, 6), fold)) AS BIGINT) AS worst"), F.round(F.max("value") - F.min("value"), 6).alias("spread")), f"WITH fm AS ({_FM}), lg AS ({_LONG}) SELECT metric, arg_max(fold, round(value, 6) * 1000 - fold / 1000000) AS best, arg_min(fold, round(value, 6) * 1000 + fold / 1000000) AS worst, round(max(value) - min(value), 6) AS spread FROM lg GROUP BY 1")


def validation_monitor(t):
    """Slope and fit over the last ten values of each name."""
    last = placed(t.metrics, ["name"], ["sec", "event_id"]).withColumn("x", 10.0 - (F.col("_size") - F.col("_place"))).where("x > 0")
    fit = last.groupBy("name").agg(F.round(F.expr("regr_slope(value, x)"), 5).alias("slope"), F.round(F.expr("regr_r2(value, x)"), 5).alias("r2"))
    return fit.withColumn("trend", F.expr("CASE WHEN slope > 0.001 THEN 'improving' WHEN slope < -0.001 THEN 'declining' ELSE 'stable' END"))


register(
    "validation_monitor",
    validation_monitor,
    """SELECT *, CASE WHEN slope > 0.001 THEN 'improving' WHEN slope < -0.001 THEN 'declining' ELSE 'stable' END AS trend FROM (
        SELECT name, round(regr_slope(value, 11 - rn), 5) AS slope, round(regr_r2(value, 11 - rn), 5) AS r2
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sec DESC, event_id DESC) AS rn FROM metrics) WHERE rn <= 10 GROUP BY 1)""",
)
register("split_train_val_test", lambda t: E.split(t.vectors, "vec_id", "label").select("vec_id", "split"), "SELECT vec_id, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT vec_id, percent_rank() OVER (PARTITION BY label ORDER BY (48271 * vec_id + 11) % 2147483647, vec_id) AS p FROM embeddings)")


def pair_generation(t):
    """Every probe with all other rows: label 1 within a class, 0 between classes, and the first five rows of each two classes with each other."""
    others = t.vectors.selectExpr("vec_id AS id_b", "label AS lb")
    own = V.against(others, t.probes.selectExpr("vec_id AS id_a", "label AS la")).where("id_a <> id_b").selectExpr("id_a", "id_b", "CAST(la = lb AS INT) AS label")
    first = placed(t.vectors.select("vec_id", "label"), ["label"], ["vec_id"]).where("_place <= 5")
    between = first.selectExpr("vec_id AS id_a", "label AS la").join(F.broadcast(first.selectExpr("vec_id AS id_b", "label AS lb")), F.col("la") < F.col("lb"))  # five of each class
    return own.union(between.where("id_a % 20 <> 0").selectExpr("id_a", "id_b", "0 AS label"))


register(
    "pair_generation",
    pair_generation,
    """WITH f AS (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5)
    SELECT id_a, id_b, CAST(same AS INT) AS label FROM pairs UNION ALL SELECT a.vec_id, b.vec_id, 0 FROM f a JOIN f b ON a.label < b.label WHERE a.vec_id % 20 <> 0""",
)
register("triplet_mining", lambda t: B.extremes(t.vectors, t.probes),
    "SELECT id_a, first(id_b ORDER BY round(distance, 6) DESC, id_b) FILTER (same) AS positive, first(id_b ORDER BY round(distance, 6), id_b) FILTER (NOT same) AS negative FROM pairs GROUP BY 1")
register("contrastive_loss", lambda t: B.contrast(t.vectors, t.probes, 1.5).select(F.expr("round(total / nullif(n, 0), 6) AS loss")), "SELECT round(avg(CASE WHEN same THEN distance * distance ELSE pow(greatest(1.5 - distance, 0), 2) END), 6) AS loss FROM pairs")
register("model_leaderboard", lambda t: t.metrics.groupBy("name").agg(F.avg("value").alias("v"), F.count("*").alias("n")).agg(F.max_by("name", "v").alias("best"), F.min_by("name", F.struct("n", "name")).alias("fastest")), "SELECT arg_max(name, v) AS best, (SELECT name FROM metrics GROUP BY name ORDER BY count(*), name LIMIT 1) AS fastest FROM (SELECT name, avg(value) AS v FROM metrics GROUP BY 1)")
