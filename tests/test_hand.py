"""Small tables with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchlight import plans
from matchlight.operators import catalog, cooling, evaluation, graph, rules, statistics, telemetry


def test_t_and_u(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 6)] + [("b", float(x)) for x in range(2, 7)], "grp string, x double")
    t = statistics.t_test(df, "a", "b").first()
    assert (round(t["t"], 6), t["df"], round(t["d"], 4)) == (-1.0, 8.0, -0.6325)
    assert round(t["p"], 5) == 0.34659
    assert statistics.mann_whitney(df, "a", "b").first()["u"] == 8.0


def test_tails_against_tables(spark):
    """Points of published tables, and tables of counts with known p."""
    for df, t in ((1, 12.7062047), (2, 4.30265273), (8, 2.30600414), (30, 2.04227246), (40, 2.02107539), (1e7, 1.95996422)):
        assert abs(spark.sql(f"SELECT {statistics.student_p(f'{t}D', f'{df}D')} AS p").first()["p"] - 0.05) < 1e-7
    for df, x in ((1, 3.84145882), (2, 5.99146455), (3, 7.8147279), (4, 9.48772904), (7, 14.0671404)):
        assert abs(spark.sql(f"SELECT {statistics.chi_square_p(f'{x}D', str(df))} AS p").first()["p"] - 0.05) < 1e-7
    assert abs(spark.sql(f"SELECT {statistics.kolmogorov_p('1.3580986D', '2D', '2D')} AS p").first()["p"] - 0.05) < 1e-6
    assert spark.sql(f"SELECT {statistics.normal_p('CAST(NULL AS DOUBLE)')} AS p").first()["p"] is None
    cells = spark.createDataFrame([(True, True)] * 8 + [(True, False)] * 2 + [(False, True)] + [(False, False)] * 5, "a boolean, b boolean")
    got = statistics.fisher_exact(cells, F.col("a"), F.col("b")).first()
    assert (got["odds"], round(got["p"], 5)) == (20.0, 0.03497)
    empty = statistics.fisher_exact(cells.limit(0), F.col("a"), F.col("b")).first()
    assert empty["odds"] is None
    alone = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "grp string, x double")
    for rows in (alone, alone.limit(0), alone.union(spark.createDataFrame([("b", 1.0), ("b", 1.0)], "grp string, x double"))):
        assert statistics.t_test(rows, "a", "b").first()["p"] is None
        assert statistics.t_test(rows, "a", "b", equal_var=False).first()["p"] is None
        assert statistics.mann_whitney(rows, "a", "b").first()["p"] is None
    assert statistics.ks_two_sample(alone, "a", "b").first()["p"] is None


def test_chi_square_takes_a_half_off_where_df_is_one(spark):
    cells = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 20, "a string, b string")
    got = statistics.chi_square(statistics.contingency(cells, "a", "b"), "a", "b").first()
    assert (round(got["chi2"], 6), got["df"], round(got["p"], 6)) == (1.323438, 1, 0.249976)


def test_adjusted_p(spark):
    p = spark.createDataFrame([(i, i / 100) for i in range(1, 6)], "id int, p double")
    got = lambda m: [round(r["adjusted"], 6) for r in statistics.adjust(p, m).orderBy("id").collect()]
    assert got("bonferroni") == [0.05, 0.10, 0.15, 0.20, 0.25]
    assert got("holm") == [0.05, 0.08, 0.09, 0.09, 0.09]
    assert got("hochberg") == [0.05] * 5


def test_confusion_and_roc(spark):
    rows = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 3 + [(1, 0)], "y_true int, y_pred int")
    m = evaluation.class_metrics(rows).first()
    assert (m["accuracy"], m["f1_macro"]) == (0.75, 0.75)
    pairs = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, False)], "score double, same boolean")
    assert evaluation.area(evaluation.roc_points(pairs)).first()["auc"] == 1.0


def test_cooldown_and_lockout(spark):
    at = lambda minutes: [("k", i, m * 60) for i, m in enumerate(minutes)]
    kept = cooling.cooldown(spark.createDataFrame(at([0, 2, 6, 7, 12]), "name string, event_id long, sec long"), "name", 300)
    assert sorted(r["sec"] // 60 for r in kept.collect()) == [0, 6, 12]
    fails = spark.createDataFrame([(1, i, m * 60) for i, m in enumerate([0, 3, 6, 9, 12])], "user_id long, event_id long, sec long")
    assert [(r["sec"] // 60, r["locked_until"] // 60) for r in telemetry.lockouts(fails).collect()] == [(12, 27)]


def test_suffix_and_numbers(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id int, h string")
    assert sum("_" in r["hash"] for r in catalog.suffix_repeats(df, F.col("h"), "id").collect()) == 1
    ids = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = catalog.numbered(ids, "k", 10).orderBy("k").collect()
    assert [r["new_id"] for r in got] == list(range(11, 1011))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_rules_on_absent_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("ab",), ("A-1",)], "v string")
    rule = (rules.Rule("v", required=True, min_length=3, pattern="[A-Z0-9-]+"),)
    assert [r["errors"][0]["message"] if r["errors"] else None for r in rules.validate(df, rule).collect()] == ["required", "required", "required", "too short", None]


@pytest.mark.parametrize("stream,batch", [("stream_rate_limit", "rate_limit_exact"), ("stream_sessions", "session_windows")])
def test_stream_is_batch(spark, sf_dir, stream, batch):
    a, b = plans.QUERIES[stream](spark, sf_dir), plans.QUERIES[batch](spark, sf_dir)
    assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_stream_late_rows_are_dropped(spark):
    from matchlight.streaming import jobs

    def part(*rows):
        return spark.createDataFrame(list(rows), "event_id long, t string").select("event_id", F.to_timestamp("t").alias("at"))

    parts = [
        part((1, "2024-01-01 10:00:00"), (2, "2024-01-03 12:00:00")),
        part((3, "2024-01-01 10:05:00"), (4, "2024-01-02 12:00:00"), (5, "2024-01-02 12:00:01"), (2, "2024-01-03 12:00:00")),
        part((6, "2024-01-02 13:00:00"), (7, "2024-01-05 00:00:00"), (8, None)),
    ]
    kept, dropped = jobs.retained(spark, parts)
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 5, 6, 7]  # the mark is 2 January, 12:00
    assert dropped == 2


def test_clusters_of_separate_blobs(spark):
    """Three far blobs in a row: k-means takes three, every cluster is one blob, the silhouette is near one."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    from matchlight.plans import statistics as P

    rows = spark.range(90).select(array_to_vector(F.array((F.col("id") % 3 * 10 + F.col("id") / 900).cast("double"), (F.col("id") % 3 * 7).cast("double"))).alias("features"))
    got = P.partitioned(rows, lambda k: KMeans(featuresCol="z", k=k, seed=7, initSteps=5), range(2, 6)).collect()
    assert [r["n"] for r in got] == [30, 30, 30] and got[0]["k"] == 3 and got[0]["silhouette"] > 0.95
    # bisection halves the middle blob first and so needs four
    got = P.partitioned(rows, lambda k: BisectingKMeans(featuresCol="z", k=k, seed=7), range(2, 6)).collect()
    assert sorted(r["n"] for r in got) == [15, 15, 30, 30] and got[0]["k"] == 4
    assert sum(r["n"] for r in P.mixture(rows, range(2, 4)).collect()) == 90
    assert P.elbow({2: 5.0}) == 2


def test_isolation_finds_a_far_value(spark):
    from types import SimpleNamespace

    from matchlight.plans import statistics as P

    rows = spark.range(400).select("id", F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") % 50).cast("double").alias("y"))
    assert 7 in {r["id"] for r in P.isolation(SimpleNamespace(samples=rows)).collect()}


def test_border_points_join_a_cluster(spark):
    from matchlight.plans.statistics import clustered

    at = [0.0, 0.1, 0.2, 0.3, 0.4, 1.35, 9.0]
    near = [(i, j) for i, x in enumerate(at) for j, y in enumerate(at) if i != j and abs(x - y) <= 1]
    got = clustered(spark.range(7).withColumnRenamed("id", "node"), spark.createDataFrame(near, "id_a long, id_b long")).collect()
    assert {r["node"]: r["cluster"] for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: -1}


def test_components_of_a_long_chain(spark):
    from matchlight.operators.graph import components

    got = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"), 12).collect()
    assert len(got) == 101 and {r["component"] for r in got} == {0}


def test_resamples_are_spread(spark):
    from pyspark.sql import functions as F

    from matchlight.plans.resampling import resampled

    rows = spark.createDataFrame([(20 * p, i, 10, float(i)) for p in range(20) for i in range(10)], "id_a long, i long, n long, x double")
    got = resampled(rows, ["id_a"]).groupBy("x").count().collect()
    assert len(got) == 10 and all(abs(r["count"] - 4000) < 400 for r in got)
    spread = resampled(rows, ["id_a"]).groupBy("id_a", "rep").agg(F.avg("x").alias("m")).groupBy("id_a").agg(F.stddev_samp("m").alias("s")).collect()
    assert all(0.7 < r["s"] < 1.2 for r in spread)


def test_gradient_turn_of_a_cell(spark):
    """A ramp turned by a quarter turns its gradient by a quarter, either way round."""
    from matchlight.operators import pixels as P

    right = [float(x) for y in range(8) for x in range(8)]
    images = spark.createDataFrame([(1, right), (2, [float(y) for y in range(8) for x in range(8)])], "id long, e array<double>")
    pairs = images.selectExpr("id AS id_a", "e AS ea", "3 - id AS id_b").join(images.selectExpr("id AS id_b", "e AS eb"), "id_b")
    got = {(r["id_a"], r["theta"]) for r in P.cell_table(P.cell_match(pairs)).collect()}
    assert got == {(1, -90.0), (2, 90.0)}
