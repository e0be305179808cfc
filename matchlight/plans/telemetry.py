"""Queries on telemetry, monitoring and audit, in batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import halfspaces as H
from ..operators import telemetry as T
from ..operators.cooling import cooldown
from ..operators.ranges import placed
from .registry import register

ALERT_COOLDOWN = "WITH RECURSIVE c AS (SELECT name, event_id, sec, row_number() OVER (PARTITION BY name ORDER BY sec, event_id) AS rn FROM metrics WHERE value > 90), k AS (SELECT name, event_id, sec, rn, true AS kept, sec AS last FROM c WHERE rn = 1 UNION ALL SELECT c.name, c.event_id, c.sec, c.rn, c.sec - k.last >= 3600, CASE WHEN c.sec - k.last >= 3600 THEN c.sec ELSE k.last END FROM k JOIN c ON c.name = k.name AND c.rn = k.rn + 1) SELECT name, event_id FROM k WHERE kept"
LOGIN_LOCKOUT = "SELECT event_id, sec + 900 AS locked_until FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS n FROM metrics WHERE name = 'error') WHERE n >= 2"
_NOW = "(SELECT max(sec) FROM metrics)"


def now(df):
    """``df`` with ``now``, the latest second."""
    return df.crossJoin(F.broadcast(df.agg(F.max("sec").alias("now"))))  # one row


register("session_analytics", lambda t: t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("rank <= 3"),
    "SELECT * FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 3")
register("feature_usage", lambda t: t.metrics.groupBy("name").agg(F.count("*").alias("n"), F.max("sec").alias("last")), "SELECT name, count(*) AS n, max(sec) AS last FROM metrics GROUP BY 1")
_OPS = {"click": "database_operation", "error": "nist_validation", "purchase": "report_generation", "signup": "image_processing", "view": "feature_extraction"}


def limits(t):
    return F.broadcast(t.spark.createDataFrame([(k, *T.DURATION_LIMITS[v]) for k, v in _OPS.items()], "name string, warn int, crit int"))


_LIMITS = ", ".join(f"('{k}', {T.DURATION_LIMITS[v][0]}, {T.DURATION_LIMITS[v][1]})" for k, v in _OPS.items())
register("operation_alerts", lambda t: t.metrics.join(limits(t), "name").withColumn("ms", F.col("value") * 100).withColumn("severity", F.expr("CASE WHEN ms >= crit THEN 'critical' WHEN ms >= warn THEN 'warning' END")).where("severity IS NOT NULL").select("event_id", "severity"),
    f"SELECT event_id, CASE WHEN value * 100 >= crit THEN 'critical' ELSE 'warning' END AS severity FROM metrics JOIN (VALUES {_LIMITS}) l(name, warn, crit) USING (name) WHERE value * 100 >= warn")
register("operation_statistics", lambda t: t.metrics.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("name") != "error").alias("ok"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")), "SELECT user_id, count(*) AS total, count(*) FILTER (name <> 'error') AS ok, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM metrics GROUP BY 1")
register("metric_latest", lambda t: t.metrics.groupBy("name").agg(F.max_by("value", F.struct("sec", "event_id")).alias("value")), "SELECT name, first(value ORDER BY sec DESC, event_id DESC) AS value FROM metrics GROUP BY 1")
register("metric_history", lambda t: now(t.metrics.where("name = 'click'")).where("sec >= now - 86400").orderBy(F.desc("sec"), F.desc("event_id")).limit(100).select("event_id", "value"), "SELECT event_id, value FROM metrics WHERE name = 'click' AND sec >= (SELECT max(sec) FROM metrics WHERE name = 'click') - 86400 ORDER BY sec DESC, event_id DESC LIMIT 100")
register("metric_statistics", lambda t: t.metrics.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("std")), "SELECT name, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM metrics GROUP BY 1")
register("metric_flatten", lambda t: t.events.select("event_id", "event_type", F.explode(F.from_json("props", "map<string,double>")).alias("k", "value")).select("event_id", F.concat_ws(".", "event_type", "k").alias("name"), "value"), "SELECT event_id, event_type || '.k' AS name, CAST(props->>'$.k' AS DOUBLE) AS value FROM events")
register("health_score", lambda t: t.metrics.groupBy("name").agg(F.max_by("value", F.struct("sec", "event_id")).alias("v")).agg(F.coalesce(F.round(F.avg(F.greatest(F.lit(0.0), 100 - F.col("v"))), 6), F.lit(100.0)).alias("health")), "SELECT coalesce(round(avg(greatest(0, 100 - v)), 6), 100) AS health FROM (SELECT name, first(value ORDER BY sec DESC, event_id DESC) AS v FROM metrics GROUP BY 1)")
register("threshold_alerts", lambda t: t.metrics.where("value > 70").selectExpr("event_id", "name", "CASE WHEN value > 95 THEN 'critical' ELSE 'warning' END AS severity"), "SELECT event_id, name, CASE WHEN value > 95 THEN 'critical' ELSE 'warning' END AS severity FROM metrics WHERE value > 70")
_TREND = "SELECT name, event_id, count(*) OVER w AS n, covar_pop(rn, value) OVER w / var_pop(rn) OVER w AS slope, corr(rn, value) OVER w AS c, stddev_pop(value) OVER w / avg(value) OVER w AS volatility FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sec, event_id) AS rn FROM metrics) WINDOW w AS (PARTITION BY name ORDER BY sec, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
register("metric_trend", lambda t: T.trend(t.metrics).where("n >= 10").select("event_id", "n", F.round("slope", 4).alias("slope"), F.round("volatility", 4).alias("volatility"), "trend"), f"SELECT event_id, n, round(slope, 4) AS slope, round(volatility, 4) AS volatility, CASE WHEN volatility > 0.2 THEN 'volatile' WHEN abs(slope) < 0.01 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM ({_TREND}) WHERE n >= 10")
_Z = "SELECT name, event_id, 0.6745 * (value - med) / list_median(list_transform(b, lambda v: abs(v - med))) AS z FROM (SELECT *, list_median(b) AS med FROM (SELECT *, list(value) OVER (PARTITION BY name ORDER BY sec, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS b FROM metrics) WHERE len(b) >= 10)"
register("metric_anomaly", lambda t: T.anomaly(t.metrics).select("event_id", F.round("z", 4).alias("z")), f"SELECT event_id, round(z, 4) AS z FROM ({_Z})")
register("metric_anomaly_forest", lambda t: H.anomalies(t.metrics).select("event_id", "mass", "is_anomaly"), H.anomalies_sql())
register("alert_rules", lambda t: T.trend(t.metrics).join(t.metrics.select("event_id", "value"), "event_id").select("event_id", F.coalesce(F.when(F.col("value") > 95, "critical"), F.when(F.col("value") > 70, "warning"), F.when((F.col("n") >= 10) & (F.col("slope") > 1.0), "medium")).alias("severity")).where("severity IS NOT NULL"),
    f"SELECT event_id, CASE WHEN value > 95 THEN 'critical' WHEN value > 70 THEN 'warning' ELSE 'medium' END AS severity FROM ({_TREND}) JOIN (SELECT event_id, value FROM metrics) USING (event_id) WHERE value > 70 OR (n >= 10 AND slope > 1.0)")
register("alert_cooldown", lambda t: cooldown(t.metrics.where("value > 90"), "name", 3600).select("name", "event_id"),
    ALERT_COOLDOWN)

register("alert_lifecycle", lambda t: T.lifecycle(t.metrics, 60), "WITH f AS (SELECT name, sec, event_id, value > 60 AS bad FROM metrics), g AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY sec, event_id) AS run FROM (SELECT *, CASE WHEN bad IS NOT DISTINCT FROM lag(bad) OVER (PARTITION BY name ORDER BY sec, event_id) THEN 0 ELSE 1 END AS n FROM f)), r AS (SELECT name, run, bad, min(sec) AS opened, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT name, opened, resolved, n FROM (SELECT *, lead(opened) OVER (PARTITION BY name ORDER BY run) AS resolved FROM r) WHERE bad")
register("alert_statistics", lambda t: now(t.metrics.where("value > 70")).groupBy("name").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 95).alias("critical"), F.count_if(F.col("sec") >= F.col("now") - 86400).alias("last_day")), "SELECT name, count(*) AS total, count(*) FILTER (value > 95) AS critical, count(*) FILTER (sec >= (SELECT max(sec) FROM metrics WHERE value > 70) - 86400) AS last_day FROM metrics WHERE value > 70 GROUP BY 1")
register("system_status", lambda t: now(t.metrics).where("sec >= now - 3600").agg(F.max(F.expr("CASE WHEN value > 95 THEN 3 WHEN value > 70 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END")).alias("m")).selectExpr("CASE m WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'caution' ELSE 'healthy' END AS status"), f"SELECT CASE max(CASE WHEN value > 95 THEN 3 WHEN value > 70 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'caution' ELSE 'healthy' END AS status FROM metrics WHERE sec >= {_NOW} - 3600")


def correlation(t):
    back = placed(t.metrics, ["name"], ["sec", "event_id"]).withColumn("rn", F.col("_size") - F.col("_place"))
    a, b = back.select(F.col("name").alias("a"), "rn", F.col("value").alias("va")), back.select(F.col("name").alias("b"), "rn", F.col("value").alias("vb"))
    return a.join(b, "rn").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.corr("va", "vb"), 5).alias("r")).where("n > 10")


register("metric_correlation", correlation, "WITH k AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY sec DESC, event_id DESC) AS rn FROM metrics) SELECT x.name AS a, y.name AS b, count(*) AS n, round(corr(x.value, y.value), 5) AS r FROM k x JOIN k y USING (rn) WHERE x.name < y.name GROUP BY 1, 2 HAVING count(*) > 10")
register("retention_cut", lambda t: now(t.metrics).where("sec >= now - 7 * 86400").groupBy("name").agg(F.count("*").alias("n")), f"SELECT name, count(*) AS n FROM metrics WHERE sec >= {_NOW} - 7 * 86400 GROUP BY 1")
register("notification_stats", lambda t: now(t.metrics).where("sec + 20 * 86400 > now").groupBy("name").agg(F.count("*").alias("total"), F.count_if(F.col("value") < 20).alias("acknowledged")), f"SELECT name, count(*) AS total, count(*) FILTER (value < 20) AS acknowledged FROM metrics WHERE sec + 20 * 86400 > {_NOW} GROUP BY 1")
_TRIAGE = "CASE WHEN value > 300 THEN 'critical' WHEN user_id % 3 = 0 AND value > 100 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END"
register("error_triage", lambda t: t.metrics.where("name = 'error'").selectExpr("event_id", f"{_TRIAGE} AS severity", "CASE WHEN value > 300 THEN 'abort' WHEN value > 50 THEN 'retry' ELSE 'ignore' END AS strategy"), f"SELECT event_id, {_TRIAGE} AS severity, CASE WHEN value > 300 THEN 'abort' WHEN value > 50 THEN 'retry' ELSE 'ignore' END AS strategy FROM metrics WHERE name = 'error'")
register("error_statistics", lambda t: F.broadcast(t.spark.createDataFrame([(x,) for x in ("critical", "high", "medium", "low", "info")], "severity string")).join(t.metrics.where("name = 'error'").selectExpr(f"{_TRIAGE} AS severity").groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n")),
    f"SELECT s.severity, coalesce(n, 0) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN (SELECT {_TRIAGE} AS severity, count(*) AS n FROM metrics WHERE name = 'error' GROUP BY 1) e USING (severity)")
register("security_report", lambda t: now(t.metrics).agg(F.count_if(F.expr("sec >= now - 86400")).alias("day"), F.count_if(F.expr("sec >= now - 7 * 86400")).alias("week"), F.count_if(F.expr("name = 'error'")).alias("failed"), F.count_distinct(F.expr("CASE WHEN sec >= now - 86400 THEN user_id END")).alias("active")), f"SELECT count(*) FILTER (sec >= {_NOW} - 86400) AS day, count(*) FILTER (sec >= {_NOW} - 7 * 86400) AS week, count(*) FILTER (name = 'error') AS failed, count(DISTINCT CASE WHEN sec >= {_NOW} - 86400 THEN user_id END) AS active FROM metrics")
register("login_lockout", lambda t: T.lockouts(t.metrics.where("name = 'error'"), 2, 900).select("event_id", "locked_until"), LOGIN_LOCKOUT)
register("rate_limit", lambda t: T.rate_bound(t.metrics, {3600: 2, 86400: 5}).select("event_id", "over"), "SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) > 2) OR (count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) > 5) AS over FROM metrics")
register("rate_limit_exact", lambda t: T.rate_limit(t.metrics, {3600: 2, 86400: 5}))
register("request_metrics", lambda t: t.metrics.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("value", "event_id"))).withColumn("n", F.count("*").over(Window.partitionBy("name"))).groupBy("name").agg(F.max("n").alias("n"), F.max(F.expr("CASE WHEN rn = CAST(floor(n * 0.95) AS INT) + 1 THEN value END")).alias("p95"), F.max(F.expr("CASE WHEN rn = CAST(floor(n * 0.99) AS INT) + 1 THEN value END")).alias("p99")),
    "SELECT name, max(n) AS n, max(value) FILTER (rn = floor(n * 0.95) + 1) AS p95, max(value) FILTER (rn = floor(n * 0.99) + 1) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY name) AS n FROM metrics) GROUP BY 1")
register("access_hot_cold", lambda t: now(t.metrics).groupBy("user_id").agg(F.count_if(F.expr("sec >= now - 86400")).alias("recent"), F.max("sec").alias("last")).selectExpr("user_id", "recent", "CASE WHEN recent > 3 THEN 'hot' WHEN recent = 0 THEN 'cold' ELSE 'warm' END AS kind"), f"SELECT user_id, recent, CASE WHEN recent > 3 THEN 'hot' WHEN recent = 0 THEN 'cold' ELSE 'warm' END AS kind FROM (SELECT user_id, count(*) FILTER (sec >= {_NOW} - 86400) AS recent FROM metrics GROUP BY 1)")
register("access_forecast", lambda t: now(t.metrics).groupBy("user_id").agg(F.count_if(F.expr("sec >= now - 172800")).alias("late"), F.count_if(F.expr("sec < now - 172800 AND sec >= now - 345600")).alias("early")).where("late + early >= 3").selectExpr("user_id", "CASE WHEN late > 1.5 * early THEN 'hot' WHEN late < 0.5 * early THEN 'cold' ELSE 'steady' END AS forecast"), f"SELECT user_id, CASE WHEN late > 1.5 * early THEN 'hot' WHEN late < 0.5 * early THEN 'cold' ELSE 'steady' END AS forecast FROM (SELECT user_id, count(*) FILTER (sec >= {_NOW} - 172800) AS late, count(*) FILTER (sec < {_NOW} - 172800 AND sec >= {_NOW} - 345600) AS early FROM metrics GROUP BY 1) WHERE late + early >= 3")
register("query_intervals", lambda t: t.metrics.withColumn("gap", F.col("sec") - F.lag("sec").over(Window.partitionBy("user_id").orderBy("sec", "event_id"))).groupBy("user_id").agg(F.count("*").alias("runs"), F.round(F.avg("gap"), 4).alias("mean_gap"), F.max("sec").alias("last")), "SELECT user_id, count(*) AS runs, round(avg(gap), 4) AS mean_gap, max(sec) AS last FROM (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS gap FROM metrics) GROUP BY 1")
register("history_report", lambda t: t.events.select("event_type", F.coalesce(F.get_json_object("props", "$.similarity"), F.get_json_object("props", "$.score"), F.get_json_object("props", "$.k")).try_cast("double").alias("s")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean")), "SELECT event_type, count(*) AS n, round(avg(CAST(coalesce(props->>'$.similarity', props->>'$.score', props->>'$.k') AS DOUBLE)), 6) AS mean FROM events GROUP BY 1")
register("history_metric_means", lambda t: t.events.select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v")).groupBy("key").agg(F.round(F.avg(F.col("v").try_cast("double")), 6).alias("mean")), "SELECT 'k' AS key, round(avg(CAST(props->>'$.k' AS DOUBLE)), 6) AS mean FROM events")
register("batch_report", lambda t: t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("batch")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.count_if(F.col("o_orderstatus") == "P").alias("pending")), "SELECT strftime(o_orderdate, '%Y-%m') AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
_SESS = "SELECT user_id, min(sec) AS start, count(*) AS n, max(sec) - min(sec) AS seconds FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {us} THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run"
register("session_windows", lambda t: T.sessions(t.events, "12 hours"), _SESS.format(us=12 * 3600 * 1000000))
