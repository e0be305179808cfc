"""Bootstrap and permutation queries: one small sample for each probe, so the work grows with the tables.

A probe's sample is the distances of its nearest vectors. Draws are integer arithmetic,
the same in both engines; all literals are doubles in both, so expressions are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from .registry import register

#: Matches of a sample, resamples, and the normal score of the 95 % level.
MATCHES, REPLICATES, Z95 = 10, 200, "1.959963984540054e0"
#: A keyed draw: integer arithmetic below 2**63 in both engines. The product of two remainders keeps neighbouring keys from giving neighbouring draws.
_KEY = "((48271 * (((id_a % 1000003) * 1000 + rep) * 1000 + i) + 11) % 2147483647)"
_DRAW = f"(({_KEY} * ({_KEY} % 65521 + 1)) % 2147483647)"


def _cdf(z: str) -> str:
    """The normal distribution (Zelen and Severo, error below 1e-7)."""
    t = f"(1e0 / (1e0 + 2.316419e-1 * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2e0) * 3.989422804e-1 * {t} * (3.19381530e-1 + {t} * (-3.56563782e-1 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0)))))"
    return f"(CASE WHEN ({z}) >= 0 THEN 1e0 - {tail} ELSE {tail} END)"


def _quantile(p: str) -> str:
    """The normal quantile (Hastings, error below 5e-4, on the smaller tail)."""
    t = f"sqrt(-2e0 * ln(least({p}, 1e0 - ({p}))))"
    far = f"({t} - (2.515517e0 + 8.02853e-1 * {t} + 1.0328e-2 * {t} * {t}) / (1e0 + 1.432788e0 * {t} + 1.89269e-1 * {t} * {t} + 1.308e-3 * {t} * {t} * {t}))"
    return f"(CASE WHEN ({p}) < 5e-1 THEN -{far} ELSE {far} END)"


def _at(level: str, element: str) -> str:
    """Linear interpolation in the sorted means ``ms`` at a level in 0..1."""
    place = f"({level} * {REPLICATES - 1})"
    low, high = element.format(f"CAST(floor({place}) AS INT) + 1"), element.format(f"least(CAST(floor({place}) AS INT) + 2, {REPLICATES})")
    return f"({low} + ({place} - floor({place})) * ({high} - {low}))"


def sample(t, k: int = MATCHES) -> DataFrame:
    """``(id_a, i, n, x, same)``: the ``k`` nearest distances of each probe, numbered from 0, and whether labels agree."""
    near = V.knn_batch(t.vectors, t.probes, k)
    return near.select("id_a", (F.col("rank") - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("id_a")).alias("n"), F.expr("round(sqrt(dist), 6) AS x"), (F.col("label_a") == F.col("label_b")).alias("same"))


def _sample_sql(k: int = MATCHES) -> str:
    return f"""SELECT id_a, i, count(*) OVER (PARTITION BY id_a) AS n, x, same FROM
    (SELECT id_a, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) - 1 AS i, round(distance, 6) AS x, same FROM pairs) WHERE i < {k}"""


def resampled(rows: DataFrame, groups: list[str], size: str = "n") -> DataFrame:
    """``(*groups, rep, x)``: for each group, replicates of ``size`` draws with replacement from its rows ``(i, x)``."""
    draws = rows.select(*groups, "i", size).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1)))).withColumn("i", F.expr(f"{_DRAW} % {size}"))
    return draws.drop(size).join(rows.select(*groups, "i", "x"), [*groups, "i"])


_MOMENTS = "avg(x) AS theta, sum(x) AS total, sum(x * x) AS squares, sum(x * x * x) AS cubes"
#: Skewness over 6 by closed leave-one-out sums: the acceleration of the BCa interval.
_ACCELERATION = "CASE WHEN squares - n * theta * theta <= 1e-12 THEN 0e0 ELSE (cubes - 3 * theta * squares + 2 * n * theta * theta * theta) / (6 * power(squares - n * theta * theta, 1.5e0)) END"
_SHARE = f"least(greatest(below, 5e-1 / {REPLICATES}), 1e0 - 5e-1 / {REPLICATES})"
_BIAS = _quantile(_SHARE)


def _level(z: str) -> str:
    return f"least(9.99e-1, greatest(1e-3, {_cdf(f'(z0 + (z0 + {z}) / (1e0 - acc * (z0 + {z})))')}))"


def _intervals(element: str) -> list[str]:
    low, high = _at("2.5e-2", element), _at("9.75e-1", element)
    return [
        "id_a", "round(theta, 5) AS mean", "round(center - theta, 5) AS bias", "round(se, 5) AS se", f"round({low}, 5) AS low", f"round({high}, 5) AS high",
        f"round(2 * theta - {high}, 5) AS low_basic", f"round(2 * theta - {low}, 5) AS high_basic",
        f"round({_at('level_low', element)}, 5) AS low_bca", f"round({_at('level_high', element)}, 5) AS high_bca",
    ]


def levels(t) -> DataFrame:
    """Per probe: the sample's mean, the sorted means of its resamples, bias correction, acceleration and the levels of the BCa interval."""
    rows = sample(t)
    means = resampled(rows, ["id_a"]).groupBy("id_a", "rep").agg(F.avg("x").alias("m"))
    base = rows.groupBy("id_a").agg(F.max("n").alias("n"), F.avg("x").alias("theta"), F.sum(F.expr("x * x")).alias("squares"), F.sum(F.expr("x * x * x")).alias("cubes"))
    found = means.join(base, "id_a").groupBy("id_a").agg(
        F.first("n").alias("n"), F.first("theta").alias("theta"), F.first("squares").alias("squares"), F.first("cubes").alias("cubes"), F.sort_array(F.collect_list("m")).alias("ms"),
        F.avg("m").alias("center"), F.stddev_samp("m").alias("se"), F.avg(F.expr("CAST(round(m, 9) < round(theta, 9) AS DOUBLE)")).alias("below"),
    )
    found = found.selectExpr("*", f"{_ACCELERATION} AS acc", f"{_BIAS} AS z0")
    return found.selectExpr("*", f"{_level('-' + Z95)} AS level_low", f"{_level(Z95)} AS level_high")


_LEVELS = f"""WITH s AS ({_sample_sql()}), k AS (SELECT unnest(range({REPLICATES})) AS rep),
    d AS (SELECT id_a, rep, {_DRAW} % n AS i FROM s, k), b AS (SELECT d.id_a, rep, avg(x) AS m FROM d JOIN s ON s.id_a = d.id_a AND s.i = d.i GROUP BY 1, 2),
    o AS (SELECT id_a, max(n) AS n, avg(x) AS theta, sum(x * x) AS squares, sum(x * x * x) AS cubes FROM s GROUP BY 1),
    f AS (SELECT id_a, any_value(n) AS n, any_value(theta) AS theta, any_value(squares) AS squares, any_value(cubes) AS cubes, list_sort(list(m)) AS ms, avg(m) AS center, stddev_samp(m) AS se,
          avg(CAST(round(m, 9) < round(theta, 9) AS DOUBLE)) AS below FROM b JOIN o USING (id_a) GROUP BY 1),
    g AS (SELECT *, {_ACCELERATION} AS acc, {_BIAS} AS z0 FROM f), l AS (SELECT *, {_level('-' + Z95)} AS level_low, {_level(Z95)} AS level_high FROM g)"""
_SPARK, _DUCK = "element_at(ms, {})", "ms[{}]"

register("bootstrap_ci", lambda t: levels(t).selectExpr(*_intervals(_SPARK)), f"{_LEVELS} SELECT {', '.join(_intervals(_DUCK))} FROM l")
_JACK = ["id_a", "round(acc, 5) AS acceleration", "round(z0, 5) AS bias_correction", "round(level_low, 5) AS level_low", "round(level_high, 5) AS level_high"]
register("bca_jackknife", lambda t: levels(t).selectExpr(*_JACK), f"{_LEVELS} SELECT {', '.join(_JACK)} FROM l")


def _similar(element: str) -> list[str]:
    """Interval of the similarity ``1 - distance / 8``; samples of fewer than 5 matches have a fifth on both sides."""
    s = "(1e0 - theta / 8)"
    low, high = f"CASE WHEN n < 5 THEN {s} * 8e-1 ELSE 1e0 - {_at('9.75e-1', element)} / 8 END", f"CASE WHEN n < 5 THEN {s} * 1.2e0 ELSE 1e0 - {_at('2.5e-2', element)} / 8 END"
    return ["id_a", "n", f"round({s}, 5) AS similarity", f"round(greatest(0e0, {low}), 5) AS low", f"round(least(1e0, {high}), 5) AS high"]


register("similarity_interval", lambda t: levels(t).selectExpr(*_similar(_SPARK)), f"{_LEVELS} SELECT {', '.join(_similar(_DUCK))} FROM l")


def stratified(t) -> DataFrame:
    """Means of resamples drawn apart from the matches up to the median distance and beyond it, each stratum as often as it has matches."""
    one = Window.partitionBy("id_a")
    rows = sample(t).withColumn("far", F.col("x") > F.percentile("x", 0.5).over(one))
    part = Window.partitionBy("id_a", "far")
    rows = rows.withColumn("i", F.row_number().over(part.orderBy("i")) - 1).withColumn("size", F.count(F.lit(1)).over(part))
    means = resampled(rows, ["id_a", "far"], "size").groupBy("id_a", "rep").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("drawn"))
    return means.groupBy("id_a").agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.stddev_samp("m"), 5).alias("se"), F.min("drawn").alias("drawn"))


register(
    "bootstrap_stratified",
    stratified,
    f"""WITH s AS ({_sample_sql()}), h AS (SELECT *, x > median(x) OVER (PARTITION BY id_a) AS far FROM s),
    r AS (SELECT id_a, far, x, row_number() OVER (PARTITION BY id_a, far ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY id_a, far) AS size FROM h),
    d AS (SELECT id_a, far, rep, {_DRAW} % size AS i FROM r, (SELECT unnest(range({REPLICATES})) AS rep) k),
    b AS (SELECT d.id_a, rep, avg(x) AS m, count(*) AS drawn FROM d JOIN r ON r.id_a = d.id_a AND r.far = d.far AND r.i = d.i GROUP BY 1, 2)
    SELECT id_a, round(avg(m), 5) AS mean, round(stddev_samp(m), 5) AS se, min(drawn) AS drawn FROM b GROUP BY 1""",
)


def permutation(t) -> DataFrame:
    """Do a probe's matches of its own label lie nearer than the others? Share of relabelings with a difference of means at least as large."""
    rows = sample(t, 2 * MATCHES)
    mean = lambda mark: F.avg(F.when(mark, F.col("x"))) - F.avg(F.when(~mark, F.col("x")))
    real = rows.groupBy("id_a").agg(F.count_if("same").alias("own"), mean(F.col("same")).alias("real"), F.expr("transform(sort_array(collect_list(struct(i, x))), m -> m.x) AS xs")).where("real IS NOT NULL")
    mixed = real.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    order = mixed.withColumn("xs", F.expr(f"transform(sort_array(transform(xs, (x, i) -> struct({_DRAW} AS draw, i, x))), m -> m.x)"))
    sides = order.selectExpr("id_a", "real", "filter(slice(xs, 1, int(own)), x -> x IS NOT NULL) AS l", "filter(slice(xs, int(own) + 1, size(xs)), x -> x IS NOT NULL) AS r")
    each = lambda s: f"aggregate({s}, 0D, (t, x) -> t + x) / nullif(size({s}), 0)"
    tried = sides.select("id_a", "real", F.expr(f"{each('l')} - {each('r')}").alias("d"))
    return tried.groupBy("id_a").agg(F.round(F.first("real"), 5).alias("difference"), F.round(F.avg(F.expr("CAST(abs(d) >= abs(real) - 1e-9 AS DOUBLE)")), 5).alias("p"))


register(
    "permutation_test",
    permutation,
    f"""WITH s AS ({_sample_sql(2 * MATCHES)}), o AS (SELECT id_a, count(*) FILTER (same) AS own, avg(x) FILTER (same) - avg(x) FILTER (NOT same) AS difference FROM s GROUP BY 1),
    m AS (SELECT id_a, rep, x, difference, row_number() OVER (PARTITION BY id_a, rep ORDER BY {_DRAW}, i) <= own AS mark
          FROM s JOIN o USING (id_a), (SELECT unnest(range({REPLICATES})) AS rep) k WHERE difference IS NOT NULL),
    d AS (SELECT id_a, rep, any_value(difference) AS difference, avg(x) FILTER (mark) - avg(x) FILTER (NOT mark) AS d FROM m GROUP BY 1, 2)
    SELECT id_a, round(any_value(difference), 5) AS difference, round(avg(CAST(abs(d) >= abs(difference) - 1e-9 AS DOUBLE)), 5) AS p FROM d GROUP BY 1""",
)
