"""Batch telemetry: metric statistics, alerts, sessions, lockouts."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .ranges import framed, running

# Warning and critical limits in milliseconds by operation type.
DURATION_LIMITS = {
    "image_analysis": (30000, 60000), "image_processing": (10000, 20000), "database_operation": (5000, 15000), "image_comparison": (20000, 45000),
    "nist_validation": (8000, 15000), "pipeline_execution": (45000, 90000), "feature_extraction": (15000, 30000), "report_generation": (5000, 12000),
}


_ORDER = ["name", "sec", "event_id"]


def _before(last: int, first: int = 0):
    """Rows of one metric in a chunk, from ``last`` to ``first`` before the current one."""
    return Window.partitionBy("_chunk", "name").orderBy("_n").rowsBetween(-last, -first)


def trend(metrics: DataFrame, n: int = 50, least: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Slope, fit and direction over the last ``n`` samples at each sample of a metric; chunks of samples, not metrics, are tasks. Columns named in ``keep`` stay."""
    w = _before(n - 1)
    x = framed(metrics, _ORDER, n - 1).withColumn("rn", F.col("_n").cast("double"))
    out = x.select(
        "name", "event_id", "_halo", *keep, F.count("*").over(w).alias("n"), F.try_divide(F.covar_pop("rn", "value").over(w), F.var_pop("rn").over(w)).alias("slope"),
        F.pow(F.corr("rn", "value").over(w), F.lit(2)).alias("r2"), F.try_divide(F.stddev_pop("value").over(w), F.avg("value").over(w)).alias("volatility"),
    )
    kind = F.when(F.col("n") < least, "insufficient").when(F.col("volatility") > 0.2, "volatile").when(F.abs("slope") < 0.01, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return out.where(~F.col("_halo")).drop("_halo").withColumn("trend", kind)


def anomaly(metrics: DataFrame, n: int = 100) -> DataFrame:
    """Robust z of a value against the metric's ``n`` samples before it."""
    held = framed(metrics, _ORDER, n).withColumn("before", F.collect_list("value").over(_before(n, 1))).where(~F.col("_halo") & (F.size("before") >= 10))
    middle = lambda a: (F.get(F.sort_array(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int"))) / 2
    med = held.withColumn("med", middle(F.col("before")))
    return med.withColumn("mad", middle(F.transform("before", lambda v: F.abs(v - F.col("med"))))).select("name", "event_id", F.try_divide(0.6745 * (F.col("value") - F.col("med")), F.col("mad")).alias("z"))


def lifecycle(metrics: DataFrame, limit: float) -> DataFrame:
    """Runs of samples above ``limit``: ``(name, opened, resolved, n)``; ``resolved`` is when the next run begins, null for the last of a metric.

    A sample without a value is a run of its own, so it resolves the one before it.
    """
    seen = framed(metrics.withColumn("bad", F.col("value") > limit), _ORDER, 1)
    first = F.coalesce((F.col("bad") != F.lag("bad").over(Window.partitionBy("_chunk", "name").orderBy("_n"))).cast("long"), F.lit(1).cast("long"))
    marked = seen.withColumn("first", first).where(~F.col("_halo"))
    runs = running(marked, _ORDER, "sum", run=F.col("first")).groupBy("name", "run", "bad").agg(F.min("sec").alias("opened"), F.count("*").alias("n"))
    runs = saved(runs, "runs")
    after = runs.select((F.col("run") - 1).alias("_run"), F.col("name").alias("_name"), F.col("opened").alias("resolved"))
    bad = runs.where("bad")
    return bad.join(after, (bad["run"] == after["_run"]) & bad["name"].eqNullSafe(after["_name"]), "left").select("name", "opened", "resolved", "n")


def lockouts(attempts: DataFrame, limit: int = 5, seconds: int = 900) -> DataFrame:
    """Failures that are the ``limit``-th within ``seconds``, and the end of the lock."""
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-seconds, 0)
    return attempts.withColumn("n", F.count("*").over(w)).where(F.col("n") >= limit).select("user_id", "event_id", "sec", (F.col("sec") + seconds).alias("locked_until"))


def rate_bound(requests: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Requests that would break a limit if all earlier ones counted: an upper bound on refusals."""
    over: Column = F.lit(False)
    for seconds, n in limits.items():
        over = over | (F.count("*").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-(seconds - 1), 0)) > n)
    return requests.withColumn("over", over)


def rate_limit(requests: DataFrame, limits: dict[int, int]) -> DataFrame:
    """The exact rule: refused requests are not counted. One group per client, read in time order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sec", "event_id"])
        taken: list[int] = []
        allowed = []
        for at in rows["sec"].tolist():
            ok = all(sum(1 for x in reversed(taken[-n:]) if x > at - s) < n for s, n in limits.items())
            allowed.append(ok)
            if ok:
                taken.append(at)
        return rows.assign(allowed=allowed)[["user_id", "event_id", "allowed"]]

    return requests.select("user_id", "event_id", "sec").groupBy("user_id").applyInPandas(run, "user_id long, event_id long, allowed boolean")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user's events, with start, number and length in seconds."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    out = at.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return out.select("user_id", F.unix_timestamp("first").alias("start"), "n", (F.unix_timestamp("last") - F.unix_timestamp("first")).alias("seconds"))


