"""Cool-down by composed chunks against a walk through each key in order."""

from __future__ import annotations

import numpy as np
import pytest

from matchlight.operators import cooling as C


def walked(rows, seconds):
    kept, last = set(), {}
    for key, event, sec in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if key not in last or sec - last[key] >= seconds:
            last[key] = sec
            kept.add((key, event, sec))
    return kept


@pytest.mark.parametrize(("span", "fan", "seconds"), [(16, 2, 7), (16, 3, 16), (4, 2, 60), (8192, 64, 30)])
def test_cooldown_is_the_walk(spark, monkeypatch, span, fan, seconds):
    monkeypatch.setattr(C, "SPAN", span)
    monkeypatch.setattr(C, "FAN", fan)
    rng = np.random.default_rng(span + seconds)
    keys = np.where(rng.random(900) < 0.4, "hot", rng.choice(["a", "b", "c"], 900)).tolist()
    secs = np.where(rng.random(900) < 0.5, rng.integers(-100, 300, 900), rng.integers(-3000, 3000, 900)).tolist()
    rows = [(k if k != "c" else None, i, s) for i, (k, s) in enumerate(zip(keys, secs, strict=True))] + [("a", 5000, None)]
    got = C.cooldown(spark.createDataFrame(rows, "name string, event_id long, sec long"), "name", seconds).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["name"], r["event_id"], r["sec"]) for r in got} == walked(rows, seconds)


def test_a_busy_key_is_many_tasks(spark):
    """A million events of one key, a second apart: every 3,600th stays, and no group holds more than a chunk's seconds."""
    events = spark.range(1_000_000).selectExpr("'k' AS name", "id AS event_id", "id + 1700000000 AS sec")
    got = C.cooldown(events, "name", 3600)
    assert sorted(r["event_id"] for r in got.collect()) == list(range(0, 1_000_000, 3600))


def test_hard_tables(spark):
    of = lambda rows, seconds: C.cooldown(spark.createDataFrame(rows, "name string, event_id long, sec long"), "name", seconds).count()
    assert of([], 5) == 0
    assert of([("a", 1, None)], 5) == 0
    assert of([("a", 1, 3), ("a", 1, 3), ("a", 2, 3)], 5) == 1
    assert of([("a", 1, 3), ("a", 2, 3)], 0) == 2


@pytest.mark.parametrize("columns", [["name", "event_id"], ["name", "sec"], ["event_id"]])
def test_any_columns_may_be_read(spark, columns):
    got = C.cooldown(spark.range(100).selectExpr("'k' AS name", "id AS event_id", "id AS sec"), "name", 60)
    assert [r[0] if len(columns) == 1 else r[1] for r in sorted(got.select(*columns).collect())] == [0, 60]
