"""Streams over several batches and restarts: batch results, batches that run again, and state that ends."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.operators import telemetry
from matchlight.operators.cooling import cooldown
from matchlight.streaming import carried as C
from matchlight.streaming import jobs as J

SCHEMA = "event_id long, at timestamp, user_id long, name string, event_type string, value double"
START = datetime(2024, 1, 1)


def made(n: int = 600, seed: int = 3) -> list[tuple]:
    """Events in time order, two in three of one name and user; every tenth swaps places with the next, within the watermark's delay."""
    rng = np.random.default_rng(seed)
    secs = np.cumsum(rng.choice([0, 1, 20, 90, 4000], n, p=[0.2, 0.3, 0.3, 0.18, 0.02])).tolist()
    who = np.where(rng.random(n) < 0.67, 1, rng.integers(2, 6, n)).tolist()
    rows = [(i, START + timedelta(seconds=s), w, f"m{w}", f"m{w}", float(v)) for i, (s, w, v) in enumerate(zip(secs, who, rng.integers(0, 100, n), strict=True))]
    for i in range(0, n - 1, 10):
        if (rows[i + 1][1] - rows[i][1]).seconds < 500:
            rows[i], rows[i + 1] = rows[i + 1], rows[i]
    return rows


class Inbox:
    """A folder of event files that a stream reads; each ``add`` is a batch of its own when drained."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(self.path).withWatermark("at", "10 minutes")


def run_last_batch_again(marks):
    """Take away the last commit, as if the job had died after its writes."""
    done = sorted(int(f) for f in os.listdir(f"{marks}/commits") if f.isdigit())
    for f in (str(done[-1]), f".{done[-1]}.crc"):
        if os.path.exists(f"{marks}/commits/{f}"):
            os.remove(f"{marks}/commits/{f}")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CARRIED = {
    "cooldown": ("name string, event_id long", "name string, free long", lambda: C.cooldown_step("name", 60)),
    "trend": ("name string, event_id long, slope double", "name string, event_id long, sec long, value double", lambda: C.trend_step(7)),
    "sessions": ("user_id long, first timestamp, last timestamp, n long",) * 2 + (lambda: C.session_step("user_id", 100),),
}


def batch_of(kind, events):
    sec = events.withColumn("sec", F.unix_seconds("at"))
    if kind == "cooldown":
        return cooldown(sec, "name", 60).select("name", "event_id")
    if kind == "trend":
        return telemetry.trend(sec, 7).select("name", "event_id", F.coalesce("slope", F.lit(0.0)))
    return events.groupBy("user_id", F.session_window("at", "100 seconds")).agg(F.min("at"), F.max("at"), F.count("*")).drop("session_window")


@pytest.mark.parametrize("kind", list(CARRIED))
def test_carried_batches_are_the_whole(spark, tmp_path, kind):
    rows, state, step = CARRIED[kind]
    # each part ends before a pair that may swap, so that parts are in order
    all_rows, inbox, root = made(), Inbox(spark, tmp_path / "in"), str(tmp_path / "job")
    for part in (all_rows[:200], all_rows[200:210], all_rows[210:]):
        inbox.add(part)
        got, held = C.drain(inbox.stream(), root, rows, state, step())
    both = lambda: got.unionByName(held) if kind == "sessions" else got
    before, want = rows_of(both().select(*[c.split()[0] for c in rows.split(", ")])), rows_of(batch_of(kind, spark.createDataFrame(all_rows, SCHEMA)))
    assert len(before) == len(want)
    for a, b in zip(before, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == (pytest.approx(b[2:], abs=1e-9) if kind == "trend" else b[2:])
    run_last_batch_again(f"{root}/marks")
    got, held = C.drain(inbox.stream(), root, rows, state, step())
    assert rows_of(both().select(*[c.split()[0] for c in rows.split(", ")])) == before
    # a month later only the new event is held, and an event from before is dropped
    inbox.add([(9001, START + timedelta(days=40), 9, "z", "z", 1.0)])
    C.drain(inbox.stream(), root, rows, state, step())
    inbox.add([(9002, START + timedelta(days=30), 8, "y", "y", 1.0)])
    got, held = C.drain(inbox.stream(), root, rows, state, step())
    assert held.count() == 1
    assert got.where("event_id = 9002").count() == 0 if kind != "sessions" else got.where("user_id = 8").count() == 0


@pytest.mark.parametrize("kind", list(CARRIED))
def test_carried_without_events(spark, tmp_path, kind):
    rows, state, step = CARRIED[kind]
    inbox = Inbox(spark, tmp_path / "in")
    inbox.add([])
    inbox.add([(1, None, 1, None, None, None)])
    got, held = C.drain(inbox.stream(), str(tmp_path / "job"), rows, state, step())
    assert (got.count(), held.count()) == (0, 0)


def test_updates_are_upserts(spark, tmp_path):
    all_rows, inbox, root = made(), Inbox(spark, tmp_path / "in"), str(tmp_path / "job")
    for part in (all_rows[:200], all_rows[200:210], all_rows[210:]):
        inbox.add(part)
        got = J.updated(J.tumbling(inbox.stream()), "t", ["name", "start"], root)
    before = rows_of(got)
    assert before == rows_of(J.tumbling(spark.createDataFrame(all_rows, SCHEMA)))
    run_last_batch_again(f"{root}/marks")
    assert rows_of(J.updated(J.tumbling(inbox.stream()), "t", ["name", "start"], root)) == before


def walked_rate(rows, limits):
    taken, out = {}, []
    for i, at, user, *_ in sorted(rows, key=lambda r: (int((r[1] - START).total_seconds()), r[0])):
        sec, mine = int((at - START).total_seconds()), taken.setdefault(user, [])
        ok = all(sum(x > sec - w for x in mine) < n for w, n in limits.items())
        mine += [sec] * ok
        out.append((user, i, ok))
    return sorted(out, key=str)


def drained(stream, root):
    """Rows so far, and the number of keys in the state store at the end."""
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out"), query.lastProgress.stateOperators[0].numRowsTotal


@pytest.mark.parametrize("kind", ["rate", "lockout"])
def test_timers_empty_the_state(spark, tmp_path, kind):
    limits = {30: 3, 300: 8}
    job = {"rate": lambda s: J.stateful(s, "allowed boolean", J.rate_step(limits), 300), "lockout": lambda s: J.stateful(s, "until long", J.lockout_step(3, 300), 300)}[kind]
    all_rows, inbox, root = made(), Inbox(spark, tmp_path / "in"), str(tmp_path / "job")
    for part in (all_rows[:200], all_rows[200:210], all_rows[210:]):
        inbox.add(part)
        got, held = drained(job(inbox.stream()), root)
    assert held > 0
    if kind == "rate":
        assert rows_of(got) == walked_rate(all_rows, limits)
    inbox.add([(9001, START + timedelta(days=40), 9, "z", "z", 1.0)])
    got, held = drained(job(inbox.stream()), root)
    assert held == 1
    inbox.add([(9002, START + timedelta(days=30), 8, "y", "y", 1.0)])
    got, held = drained(job(inbox.stream()), root)
    assert held == 1 and got.where("event_id = 9002").count() == 0
