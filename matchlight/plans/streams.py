"""Queries on streams: each drains the event files and returns the table written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import carried as C
from ..streaming import jobs as J
from .registry import register
from .telemetry import _SESS, _TREND, ALERT_COOLDOWN, LOGIN_LOCKOUT

_HOUR = "SELECT event_type AS name, (epoch_us(ts) // 1000000) // 3600 * 3600 AS start, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2"


def events(t):
    return J.source(t.spark, t.sf_dir)


register("stream_metric_tumbling", lambda t: J.updated(J.tumbling(events(t)), "tumbling", ["name", "start"]), _HOUR)
register(
    "stream_metric_sliding",
    lambda t: J.updated(J.tumbling(events(t), "15 minutes", "5 minutes"), "sliding", ["name", "start"]),
    """SELECT event_type AS name, start, count(*) AS n, round(avg(value), 5) AS mean
    FROM (SELECT *, unnest([(epoch_us(ts) // 1000000) // 300 * 300, (epoch_us(ts) // 1000000) // 300 * 300 - 300, (epoch_us(ts) // 1000000) // 300 * 300 - 600]) AS start FROM events) GROUP BY 1, 2""",
)


def sessions(t):
    """Closed sessions and those still open."""
    schema = "user_id long, first timestamp, last timestamp, n long"
    closed, still = C.drain(events(t), J.folder(t.spark, "sessions"), schema, schema, C.session_step("user_id", 12 * 3600))
    return closed.unionByName(still).select("user_id", F.unix_seconds("first").alias("start"), "n", (F.unix_seconds("last") - F.unix_seconds("first")).alias("seconds"))


def alert_cooldown(t):
    above = events(t).where("value > 90").withColumnRenamed("event_type", "name")
    return C.drain(above, J.folder(t.spark, "cooldown"), "name string, event_id long", "name string, free long", C.cooldown_step("name", 3600))[0]


def trend(t):
    samples = events(t).withColumnRenamed("event_type", "name")
    rows, _ = C.drain(samples, J.folder(t.spark, "trend"), "name string, event_id long, slope double", "name string, event_id long, sec long, value double", C.trend_step())
    return rows.select("event_id", F.round("slope", 5).alias("slope"))


def lockout(t):
    failures = events(t).where("event_type = 'error'")
    return J.run(J.stateful(failures, "locked_until long", J.lockout_step(2, 900), 900), "lockout").where("locked_until IS NOT NULL").select("event_id", "locked_until")


def rate_limit(t):
    limits = {3600: 2, 86400: 5}
    return J.run(J.stateful(events(t), "allowed boolean", J.rate_step(limits), max(limits)), "rate")


register("stream_sessions", sessions, _SESS.format(us=12 * 3600 * 1000000))
register("stream_alert_cooldown", alert_cooldown, ALERT_COOLDOWN)
register("stream_trend", trend, f"SELECT event_id, CASE WHEN n > 1 THEN round(slope, 5) ELSE 0 END AS slope FROM ({_TREND})")
register("stream_login_lockout", lockout, LOGIN_LOCKOUT)
register("stream_rate_limit", rate_limit)
register("stream_threshold_alerts", lambda t: J.run(J.threshold_alerts(events(t), t.spark.createDataFrame([("error", 60.0, 90.0), ("view", 80.0, 95.0)], "event_type string, warn double, crit double")), "alerts"), "SELECT event_id, CASE WHEN value >= CASE event_type WHEN 'error' THEN 90 ELSE 95 END THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE (event_type = 'error' AND value >= 60) OR (event_type = 'view' AND value >= 80)")
register("stream_dedup", lambda t: J.run(events(t).unionByName(events(t)).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "dedup"), "SELECT event_id, event_type FROM events")


def late_data(t):
    """Events by day when every tenth id arrives after the rest: those older than a day by then are dropped, and counted in each row."""
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("at"))
    kept, late = J.retained(t.spark, [rows.where("event_id % 10 <> 0"), rows.where("event_id % 10 = 0")])
    return kept.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).withColumn("late", F.lit(late).cast("long"))


register("stream_late_data", late_data, """WITH m AS (SELECT (max(epoch_us(ts)) // 1000 - 86400000) * 1000 AS mark FROM events WHERE event_id % 10 <> 0),
    e AS (SELECT ts, event_id % 10 <> 0 OR epoch_us(ts) > mark AS kept FROM events, m WHERE ts IS NOT NULL)
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, (SELECT count(*) FROM e WHERE NOT kept) AS late FROM e WHERE kept GROUP BY 1""")
register("stream_daily_sink", lambda t: J.run(events(t).select("event_id", F.date_format("at", "yyyyMMdd").alias("event_date")), "daily").groupBy("event_date").agg(F.count("*").alias("n")), "SELECT strftime(ts, '%Y%m%d') AS event_date, count(*) AS n FROM events GROUP BY 1")
register("stream_notify_sink", lambda t: J.run(events(t).where("value > 90").select("event_id", F.expr("explode(slice(array('log', 'mail', 'page'), 1, CASE WHEN value > 95 THEN 3 ELSE 2 END)) AS channel")), "notify").groupBy("channel").agg(F.count("*").alias("n")), "SELECT channel, count(*) AS n FROM (SELECT unnest(CASE WHEN value > 95 THEN ['log', 'mail', 'page'] ELSE ['log', 'mail'] END) AS channel FROM events WHERE value > 90) GROUP BY 1")
