"""Queries against rows in blocks, held to plain loops: ties, near copies, missing vectors and labels, and query sets that are dealt."""

from __future__ import annotations

import math

import pytest

from matchlight.operators import blocks as B
from matchlight.operators import matching as M
from matchlight.operators import vectors as V

ROWS = [(i, [float((i * 7) % 5), float((i * 3) % 4), 1.0 + (i % 3) * 1e-9], i % 3) for i in range(60)] + [(60, [0.0, 0.0, 0.0], 1), (61, None, 2), (62, [1.0, 2.0, 1.0], None)]


def distance(u, v):
    total = 0.0
    for x, y in zip(u, v, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


@pytest.fixture(params=["broadcast", "dealt"])
def tables(spark, request, monkeypatch):
    if request.param == "dealt":
        monkeypatch.setattr(B, "QUERY_ROWS", 1)
        monkeypatch.setattr(B, "PARTS", 3)
    monkeypatch.setattr(B, "LEAST", 16)
    monkeypatch.setattr(B, "STEP", 7)
    rows = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>, label int")
    return rows, rows.where("vec_id % 5 = 0")


def test_pairs_are_all_pairs(tables):
    got = {(r["id_a"], r["id_b"]): r for r in B.pairs(*tables, "id_a", "id_b", "score", "same", "distance").collect()}
    assert len(got) == 13 * 62
    for i, u, la in ROWS[::5]:
        for j, v, lb in ROWS:
            if i == j:
                continue
            r = got[i, j]
            assert r["same"] == (None if la is None or lb is None else la == lb)
            if v is None:
                assert r["distance"] is None and r["score"] is None
            else:
                assert abs(r["distance"] - distance(u, v)) < 1e-12  # near copies too
                n = math.hypot(*u) * math.hypot(*v)
                assert r["score"] is None if n == 0 else abs(r["score"] - sum(x * y for x, y in zip(u, v, strict=True)) / n) <= 5.1e-7


@pytest.mark.parametrize("by_label", [False, True])
@pytest.mark.parametrize("back", [False, True])
def test_nearest_breaks_ties_by_id(tables, by_label, back):
    got = B.nearest(*tables, 3, by_label, back).collect()
    me, it, group = ("id_b", "id_a", "label_a") if back else ("id_a", "id_b", "label_b")
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault((r[me], r[group] if by_label else 0), []).append(r[it])
    want = {}
    for i, u, _ in ROWS if back else ROWS[::5]:
        for j, v, label in ROWS[::5] if back else ROWS:
            if i != j:
                want.setdefault((i, label if by_label else 0), []).append((math.inf if u is None or v is None else distance(u, v), j))
    assert found == {k: [j for _, j in sorted(v)[:3]] for k, v in want.items()}


def test_two_nearest_and_mutual_best_equal_those_of_pairs(tables):
    whole = tables[0].where("embedding IS NOT NULL"), tables[1]
    pairs = B.pairs(*whole, "id_a", "id_b", "label_a", "label_b", "distance")
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(M.nearest_two_of(*whole)) == plain(M.nearest_two(pairs))
    ids = lambda df: plain(df.select("id_a", "id_b"))
    assert ids(M.cross_check_of(*whole)) == ids(M.cross_check(pairs))


def test_counts_of_scores(tables):
    got = {r["score"]: (r["p"], r["n"]) for r in B.score_counts(*tables).collect()}
    want = {}
    for r in B.pairs(*tables, "score", "same").collect():
        p, n = want.get(r["score"], (0, 0))
        want[r["score"]] = p + (r["same"] is True), n + (r["same"] is False)
    assert got == want


def test_a_task_sends_its_counts_in_chunks(tables, monkeypatch):
    sent, meet = [], B.meet

    def seen(*given):
        sent.append(meet(*given))
        return sent[-1]

    monkeypatch.setattr(B, "meet", seen)
    monkeypatch.setattr(B, "CHUNK", 2_100_000)
    assert B.score_counts(*tables).count() > 50
    assert sent[0].count() <= sent[0].rdd.getNumPartitions()  # all scores of a task are one row


def test_a_pair_is_no_row_where_the_result_has_none(spark, sf_dir):
    from matchlight.sources.tables import Tables

    t = Tables(spark, sf_dir)
    for made in (V.knn_batch(t.vectors, t.probes, 3), M.nearest_two_of(t.vectors, t.probes), B.score_counts(t.vectors, t.probes)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("BroadcastNestedLoopJoin")  # what meets are blocks
        assert "zip_with" not in plan
    pieces = B.meet(t.vectors, t.probes, lambda units: (x for x in ()), "n int")
    assert pieces.count() == 0


def test_vectors_of_two_lengths_are_refused(spark):
    rows = spark.createDataFrame([(0, [1.0], 1), (1, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="cannot be compared"):
        V.knn_batch(rows, rows, 1).collect()


def test_a_query_set_too_large_to_broadcast_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_ROWS", 1)
    got = V.against(spark.range(7).withColumnRenamed("id", "b"), spark.range(5).withColumnRenamed("id", "a"))
    assert sorted(map(tuple, got.select("a", "b").collect())) == [(a, b) for a in range(5) for b in range(7)]


@pytest.mark.parametrize("by_label", [False, True])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_candidates_hold_the_nearest_without_sorting_pairs(monkeypatch, by_label, k):
    import numpy as np

    def sorts(*_, **__):
        raise AssertionError("pairs are sorted")

    monkeypatch.setattr(np, "partition", sorts)
    rng = np.random.default_rng(3)
    v, labels = rng.integers(0, 3, (400, 4)).astype(float), rng.integers(0, 5, 400)  # many ties and copies
    v[7] = np.nan
    every = B.Block(np.arange(400), labels, labels > 0, v, (v * v).sum(1))
    asked = every.cut(0, 60)
    i, j = B._candidates(asked, every, k, by_label)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    d = ((v[:60, None, :] - v[None, :, :]) ** 2).sum(2)
    for a in range(60):
        assert (a, a) not in found
        for g in np.unique(every.groups()) if by_label else [None]:
            at = [b for b in range(400) if b != a and (g is None or every.groups()[b] == g)]
            best = sorted(at, key=lambda b: (math.inf if math.isnan(d[a, b]) else d[a, b], b))[:k]
            assert all((a, b) in found for b in best)


def test_aggregates_of_pairs_send_a_few_rows_a_block(spark, tables, monkeypatch):
    import pandas as pd
    from pyspark.sql import functions as F

    from matchlight.functions import udfs as U
    from matchlight.operators import evaluation as E
    from matchlight.plans import conclusions as K

    rows, asked = tables
    plain = [r.asDict() for r in B.pairs(rows, asked, "id_a", "id_b", "score", "same", "label_a", "label_b", "distance").collect()]
    told = lambda want: sum(1 for r in plain if r["score"] is not None and want(r))
    got = {r["kind"]: r["n"] for r in B.outcomes(rows, asked, 0.8).collect()}
    assert got == {
        "tp": told(lambda r: r["score"] >= 0.8 and r["same"] is True), "tn": told(lambda r: r["score"] < 0.8 and r["same"] is False),
        "fp": told(lambda r: r["score"] >= 0.8 and r["same"] is False), "fn": told(lambda r: r["score"] < 0.8 and r["same"] is True),
    }
    assert E.rates_of_kinds(B.outcomes(rows, asked, 0.8)).collect() == E.match_rates(B.pairs(rows, asked, "score", "same"), 0.8).collect()
    (r,) = B.contrast(rows, asked, 1.5).collect()
    (want,) = B.pairs(rows, asked, "same", "distance").selectExpr("CASE WHEN same THEN distance * distance ELSE pow(greatest(1.5 - distance, 0D), 2) END AS x").selectExpr("sum(x) AS x", "count(x) AS n").collect()
    assert r["n"] == want["n"] and abs(r["total"] - want["x"]) < 1e-6
    kept = sorted(map(tuple, B.unlike(rows, asked, 0.2, "7").collect()))
    assert kept == sorted((r["id_a"], r["id_b"], r["score"]) for r in plain if r["same"] is False and r["score"] is not None and r["score"] >= 0.2 and "7" in str(r["id_b"]))

    class Given:
        vectors, probes = rows, asked

    level = lambda r: "forensic" if r["id_b"] % 4 in (0, 1) else "advanced" if r["score"] is None or r["score"] >= 0.2 else "standard" if r["score"] >= 0.05 else "basic"
    assert {r["level"]: r["n"] for r in K.levels(Given).collect()} == pd.Series([level(r) for r in plain]).value_counts().to_dict()
    parts = {"total": (lambda x: x.sum(), "sum"), "n": (lambda x: x.count(), "sum"), "most": (lambda x: x.max(), "max")}
    for keys, value in ((["label_a"], "score"), (["label_a", "label_b"], "distance")):
        both = [f(keys, value, parts, F.concat_ws(" ", F.round("total", 3), "n", F.round("most", 6)), "s").collect() for f in (lambda *x: U.merged_pairs(rows, asked, *x), lambda *x: U.merged_statistic(B.pairs(rows, asked, *x[0], x[1]), *x))]
        assert sorted(map(str, both[0])) == sorted(map(str, both[1]))


@pytest.mark.parametrize("radius", [0.0, 1e-6, 2.0])
def test_rows_within_a_radius_are_all_found(tables, monkeypatch, radius):
    monkeypatch.setattr(B, "PIECE", 5)
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in B.within(*tables, radius).collect()}
    want = {(i, j): distance(u, v) for i, u, _ in ROWS[::5] for j, v, _ in ROWS if i != j and u is not None and v is not None and distance(u, v) <= radius}
    assert set(got) == set(want) and all(abs(math.sqrt(got[p]) - want[p]) < 1e-12 for p in want)


def test_relabelings_are_sorted_within_a_row(spark, sf_dir):
    from matchlight.plans.resampling import permutation
    from matchlight.sources.tables import Tables

    plan = permutation(Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert "array_sort" in plan or "sort_array" in plan
    assert windows and not any("rep#" in line for line in windows)  # no row a draw is shuffled and sorted


def test_exact_distances_in_steps_are_those_of_a_loop(monkeypatch):
    import numpy as np

    monkeypatch.setattr(B, "PIECE", 7)
    v = np.random.default_rng(2).normal(size=(40, 9))
    a = B.Block(np.arange(40), np.zeros(40, int), np.ones(40, bool), v, (v * v).sum(1))
    i, j = np.divmod(np.arange(1600), 40)
    assert B.exact_at(a, i, a, j).tolist() == [distance_square(v[x], v[y]) for x, y in zip(i, j, strict=True)]
    assert B.exact_at(a, i[:0], a, j[:0]).tolist() == []


def distance_square(u, v):
    total = 0.0
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        total += (x - y) * (x - y)
    return total


def test_confidence_of_pairs_is_made_in_the_tasks(tables):
    made = V.pair_confidence(*tables)
    got = {(r["id_a"], r["id_b"]): r for r in made.collect()}
    plain = B.pairs(*tables, "id_a", "id_b", "score", "norm_a", "norm_b").collect()
    assert len(got) == len(plain) == 13 * 62
    for p in plain:
        r, s = got[p["id_a"], p["id_b"]], p["score"]
        assert r["is_match"] == (None if s is None else s >= 0.5)
        if s is None:
            assert r["confidence"] is None and r["quality"] == 1.0
        else:
            assert abs(r["confidence"] - abs(s - 0.5) * 2) < 1e-9
            assert abs(r["quality"] - max(0.0, min(1.0, 0.7 * s + 0.3 / (1 + math.exp(10 - (p["norm_a"] + p["norm_b"]) / 2))))) <= 5.1e-7
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "rint" not in plan.lower()  # no expression over rows of pairs


@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e10, 1e20])
@pytest.mark.parametrize("k, by_label", [(1, True), (2, True), (3, False)])
def test_nearest_are_kept_over_blocks(scale, k, by_label):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, (700, 6)) + rng.integers(0, 3, (700, 6)) * 1e-9  # copies, and gaps that single precision does not tell
    v[11], v[12], v[300] = np.nan, np.nan, 0.0
    v, labels = v * scale, rng.integers(0, 5, 700)
    every = B.Block(np.arange(700), labels, labels > 0, v, (v * v).sum(1))
    asked = every.picked(np.arange(0, 700, 9))
    kept = B._Kept(asked, k)
    for start in (0, 90, 91, 500):
        kept.meet(asked, every.cut(start, {0: 90, 90: 91, 91: 500, 500: 700}[start]), by_label)
    got = {}
    for id_a, id_b, label_a, label_b, dist in (r for columns in kept.rows(False) for r in zip(*[c.to_pylist() for c in columns], strict=True)):
        assert label_a == (labels[id_a] or None) and label_b == (labels[id_b] or None)
        got.setdefault((id_a, label_b if by_label else 0), []).append((math.inf if dist is None else math.sqrt(dist), id_b))
    want = {}
    for i in range(0, 700, 9):
        for j in range(700):
            if i != j:
                d = math.inf if math.isnan(v[i, 0]) or math.isnan(v[j, 0]) else math.sqrt(distance_square(v[i], v[j]))
                want.setdefault((i, (labels[j] or None) if by_label else 0), []).append((d, j))
    assert {key: sorted(x) for key, x in got.items()} == {key: sorted(x)[:k] for key, x in want.items()}


def test_blocks_met_before_leave_few_candidates():
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(6_000, 64)).astype("f4").astype(float)
    every = B.Block(np.arange(6_000), np.arange(6_000) % 10, np.ones(6_000, bool), v, (v * v).sum(1))
    asked, kept = every.cut(0, 500), B._Kept(every.cut(0, 500), 2)
    assert B._gaps(asked, every, single=True)[0].dtype == np.float32
    for start in range(1_000, 5_000, 1_000):
        kept.meet(asked, every.cut(start, start + 1_000), True)
    i, _ = B._candidates(asked, every.cut(5_000, 6_000), 2, True, kept)
    assert len(i) < 0.6 * 500 * 10  # two of five thousand rows in the fifth thousand: 0.4 are expected


def test_the_best_match_alone_is_kept_and_sent(tables, monkeypatch):
    from matchlight.plans import vectors as P

    class Given:
        vectors, probes = tables[0].where("embedding IS NOT NULL"), tables[1]

    sent, meet = [], B.meet

    def seen(*given):
        sent.append(meet(*given))
        return sent[-1]

    monkeypatch.setattr(B, "meet", seen)
    best = P.best(Given)
    want = {(r["id_a"], r["id_b"], r["d1"]) for r in M.nearest_two(B.pairs(Given.vectors, Given.probes, "id_a", "id_b", "label_a", "label_b", "distance")).collect()}
    assert {(r["id_a"], r["id_b"], r["distance"]) for r in best.collect()} == want
    from pyspark.sql import functions as F

    held = sent[0].groupBy(F.spark_partition_id(), "id_a", "label_b").count()
    assert held.agg(F.max("count")).first()[0] == 1


def test_mutual_best_matches_meet_once(tables, monkeypatch):
    calls, meet = [], B.meet

    def seen(*given):
        calls.append(given)
        return meet(*given)

    monkeypatch.setattr(B, "meet", seen)
    found = M.cross_check_of(tables[0].where("embedding IS NOT NULL"), tables[1])
    assert len(calls) == 1
    pairs = B.pairs(tables[0].where("embedding IS NOT NULL"), tables[1], "id_a", "id_b", "label_a", "label_b", "distance")
    rows = lambda df: sorted(map(repr, df.select("label_a", "label_b", "id_a", "id_b", F.round("distance", 9)).collect()))
    from pyspark.sql import functions as F

    assert rows(found) == rows(M.cross_check(pairs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1


@pytest.mark.parametrize("k", [1, 4, 70])
def test_leading_rows_are_those_of_the_whole_order(tables, k):
    got = {}
    for r in B.leading(*tables, k).collect():
        got.setdefault(r["id_a"], {})[r["rank"]] = r["same"], r["any"]
    pairs = {}
    for r in B.pairs(*tables, "id_a", "id_b", "score", "same").collect():
        pairs.setdefault(r["id_a"], []).append((-math.inf if r["score"] is None else r["score"], r["id_b"], r["same"] is True))
    for me, rows in pairs.items():
        order = sorted(rows, key=lambda r: (-r[0], r[1]))
        assert [got[me][n + 1][0] for n in range(min(k, len(order)))] == [same for _, _, same in order[:k]], me
        assert {x[1] for x in got[me].values()} == {any(same for _, _, same in rows)}
    assert set(got) == set(pairs)


def test_the_farthest_of_one_label_and_the_nearest_of_another(tables):
    got = {r["id_a"]: (r["positive"], r["negative"]) for r in B.extremes(*tables).collect()}
    pairs = {}
    for r in B.pairs(*tables, "id_a", "id_b", "distance", "same").collect():
        pairs.setdefault(r["id_a"], []).append((r["same"], math.inf if r["distance"] is None else round(r["distance"], 6), r["id_b"]))
    for me, rows in pairs.items():
        far = min(((math.inf if d == math.inf else -d, i) for same, d, i in rows if same is True), default=(0, None))[1]
        near = min(((d, i) for same, d, i in rows if same is False), default=(0, None))[1]
        assert got[me] == (far, near), me


@pytest.mark.parametrize("name", ["cmc_curve", "triplet_mining"])
def test_pairs_are_not_sorted_or_shuffled(spark, sf_dir, name):
    from matchlight import plans

    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for kind in ("score", "distance", "same"):
        assert f"{kind}#" not in plan.split("MapInArrow")[1].split("\n")[0]  # no row a pair leaves the tasks


@pytest.mark.parametrize(("most", "held"), [(0, 1), (100, 1), (100, 300)])
def test_whole_orders(tables, monkeypatch, most, held):
    monkeypatch.setattr(B, "WHOLE_ROWS", most)
    monkeypatch.setattr(B, "HELD", held)
    monkeypatch.setattr(B, "BLOCK", 16)
    got = {}
    for r in B.orders(*tables).collect():
        got.setdefault(r["id_a"], {})[r["rank"]] = r["id_b"]
    rows = {}
    for r in B.pairs(*tables, "id_a", "id_b", "score").collect():
        rows.setdefault(r["id_a"], []).append((math.inf if r["score"] is None else -r["score"], r["id_b"]))
    assert got == {me: {n: i for n, (_, i) in enumerate(sorted(x), 1)} for me, x in rows.items()}


def test_a_whole_order_shuffles_no_pairs(spark, sf_dir):
    from matchlight import plans

    plan = plans.QUERIES["sort_results"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan.split("BroadcastNestedLoopJoin")[0]


def test_leading_rows_are_found_again_after_the_first_block(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(B, "BLOCK", 32)
    rng = np.random.default_rng(8)
    v = rng.integers(-2, 3, (300, 5)).astype(float)  # many ties, copies and rows of zeros
    rows = spark.createDataFrame([(i, v[i].tolist(), i % 7) for i in range(300)], "vec_id long, embedding array<double>, label int").coalesce(1)
    asked = rows.where("vec_id % 10 = 0")
    pairs = {}
    for r in B.pairs(rows, asked, "id_a", "id_b", "score", "same").collect():
        pairs.setdefault(r["id_a"], []).append((math.inf if r["score"] is None else -r["score"], r["id_b"], r["same"]))
    got = {(r["id_a"], r["rank"]): r["same"] for r in B.leading(rows, asked, 6).collect()}
    assert got == {(me, n): x[2] for me, found in pairs.items() for n, x in enumerate(sorted(found)[:6], 1)}
