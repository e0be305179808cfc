"""Cool-down of events per key, by chunks of time whose effects compose: a busy key is many tasks.

All that a chunk hears from before is the second from which an event may be kept again.
What it passes on is a step function of that: each event that can be its first kept one
leads to a last kept one. Functions of ``FAN`` neighbouring chunks compose into one, and so
on up to one per key; on the way down each chunk learns its own beginning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import saved

#: Least seconds of a chunk (at least the cool-down itself), and chunks that one task composes.
SPAN, FAN = 65536, 256
#: Before any time.
_NEVER = -(2**62)


def steps(sec: np.ndarray, seconds: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Events of ascending ``sec`` in a chunk from ``begin`` that can be kept first, and the second from which the next chunk may keep one."""
    n = len(sec)
    after = np.searchsorted(sec, sec + seconds)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    can = min(n, int(np.searchsorted(sec, begin + seconds)) + 1)
    return sec[:can], sec[last[:can]] + seconds


def through(first: np.ndarray, then: np.ndarray, free: int) -> int:
    """What a step function makes of ``free``; without an event from then on, ``free`` itself."""
    at = int(np.searchsorted(first, free))
    return int(then[at]) if at < len(first) else free


def composed(left: tuple, right: tuple, seconds: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """``left`` and then ``right``; ``begin`` is where the left one's time begins."""
    first = np.array(left[0])
    then = np.array([through(right[0], right[1], int(t)) for t in left[1]], dtype=np.int64)
    if (not len(first) or first[-1] < begin + seconds) and len(right[0]):
        # nothing kept on the left: chunks are no shorter than the cool-down, so the right begins with its first event
        first, then = np.append(first, right[0][0]), np.append(then, right[1][0])
    return first, then


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return on


def cooldown(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """``(key, event_id, sec)`` of the events of which none follows a kept one of its key within ``seconds``.

    ``sec`` is in whole seconds; rows without one are left out, a null key is a key like
    any other, and of events in one second the least ``event_id`` counts. Seconds are
    distinct before anything else, so a chunk holds as many rows as it has seconds at most.
    """
    at = events.where("sec IS NOT NULL").select(F.col(key).alias("key"), F.col("sec").cast("long").alias("sec"), "event_id")
    if seconds < 1:
        return at.select(F.col("key").alias(key), "event_id", "sec")
    span = max(SPAN, seconds)
    start = at.agg(F.min("sec")).first()[0] or 0
    once = at.groupBy("key", "sec").agg(F.min("event_id").alias("event_id")).withColumn("c", F.floor((F.col("sec") - start) / span))
    chunks = once.groupBy("key", "c").agg(F.sort_array(F.collect_list(F.struct("sec", "event_id"))).alias("r"))
    chunks = saved(chunks.select("key", "c", F.col("r.sec").alias("secs"), F.col("r.event_id").alias("ids")), "chunks")

    @F.pandas_udf("first array<long>, then array<long>")
    def of_chunk(secs: pd.Series, c: pd.Series) -> pd.DataFrame:
        made = [steps(np.asarray(s, np.int64), seconds, start + int(k) * span) for s, k in zip(secs, c, strict=True)]
        return pd.DataFrame({"first": [m[0] for m in made], "then": [m[1] for m in made]})

    def joined(width: int):
        @F.pandas_udf("first array<long>, then array<long>")
        def of_chunks(cs: pd.Series, firsts: pd.Series, thens: pd.Series) -> pd.DataFrame:
            out = []
            for c, first, then in zip(cs, firsts, thens, strict=True):
                got, begin = (np.asarray(first[0], np.int64), np.asarray(then[0], np.int64)), start + int(c[0]) * width
                for i in range(1, len(c)):
                    got = composed(got, (np.asarray(first[i], np.int64), np.asarray(then[i], np.int64)), seconds, begin)
                out.append(got)
            return pd.DataFrame({"first": [m[0] for m in out], "then": [m[1] for m in out]})

        return of_chunks

    @F.pandas_udf("array<long>")
    def begins(firsts: pd.Series, thens: pd.Series, free: pd.Series) -> pd.Series:
        out = []
        for first, then, now in zip(firsts, thens, free, strict=True):
            given = []
            for f, t in zip(first, then, strict=True):
                given.append(now)
                now = through(np.asarray(f, np.int64), np.asarray(t, np.int64), now)
            out.append(given)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def kept(secs: pd.Series, free: pd.Series) -> pd.Series:
        out = []
        for s, now in zip(secs, free, strict=True):
            s, found = np.asarray(s, np.int64), []
            i = int(np.searchsorted(s, now))
            while i < len(s):
                found.append(i)
                i = int(np.searchsorted(s, s[i] + seconds))
            out.append(found)
        return pd.Series(out)

    maps = chunks.withColumn("m", of_chunk("secs", "c")).select("key", "c", "m.first", "m.then")
    levels, width = [], span
    while True:
        maps = saved(maps, "steps")
        if not maps.agg(F.max("c")).first()[0]:  # chunks are counted from 0, where all meet
            break
        held = maps.groupBy("key", F.floor(F.col("c") / FAN).alias("p")).agg(F.sort_array(F.collect_list(F.struct("c", "first", "then"))).alias("g"))
        levels.append(held)
        maps = held.withColumn("m", joined(width)("g.c", "g.first", "g.then")).select("key", F.col("p").alias("c"), "m.first", "m.then")
        width *= FAN
    free = maps.select("key", "c", F.lit(_NEVER).cast("long").alias("free"))
    for held in reversed(levels):
        up = free.select(F.col("key").alias("_key"), F.col("c").alias("_p"), "free")
        down = held.join(up, _same(held, up, "key", "p")).withColumn("b", begins("g.first", "g.then", "free"))
        free = saved(down.select("key", F.explode(F.arrays_zip(F.col("g.c").alias("c"), F.col("b").alias("free"))).alias("x")).select("key", "x.c", "x.free"), "begins")
    up = free.select(F.col("key").alias("_key"), F.col("c").alias("_c"), "free")
    own = chunks.join(up, _same(chunks, up, "key", "c")).withColumn("at", kept("secs", "free"))
    # entries are paired before the explode: an index exploded beside its arrays fails to plan where only one of them is read
    rows = own.select("key", F.explode(F.transform("at", lambda i: F.struct(F.get("ids", i).alias("event_id"), F.get("secs", i).alias("sec")))).alias("x"))
    return rows.select(F.col("key").alias(key), "x.event_id", "x.sec")
