"""Streams over event files: windows, sessions, alerts, state per key, sinks.

Rows later than the watermark are dropped. ``run`` drains a query with
``availableNow`` into a table of files, ``updated`` one of groups; batch forms are in
``operators.telemetry``. Streams with hot keys are in ``carried``.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import shared_dir

DELAY = "10 minutes"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of its files, with event time and watermark."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path}*")
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", DELAY)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet, exactly once by its checkpoint, and read the table.

    In append mode groups stay open, and out of the table, until the watermark passes
    them.
    """
    spark = stream.sparkSession
    out, marks = folder(spark, name), folder(spark, f"{name}-marks")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def updated(stream: DataFrame, name: str, keys: list[str], root: str | None = None) -> DataFrame:
    """Drain an aggregated stream in update mode: each batch writes the groups it has changed, and a group's row is that of its last batch.

    A batch overwrites the folder of its own number, so one that runs again changes
    nothing. Groups that the watermark has passed leave the state. A later call with the
    same ``root`` goes on where this one ended.
    """
    spark = stream.sparkSession
    root = root or folder(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/marks").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values]).select(*stream.columns)


def retained(spark: SparkSession, parts: list[DataFrame], horizon: str = "24 hours") -> tuple[DataFrame, int]:
    """Events ``(event_id, at)`` that arrive in ``parts``, one after the other, kept unless older than the horizon; and the number dropped.

    Each part is drained by a restart of the same query, so that the watermark comes
    from its checkpoint. Repeats of an id within the horizon are kept once and don't
    count as dropped; an event without a time is dropped.
    """
    inbox, out, marks = folder(spark, "late-in"), folder(spark, "late"), folder(spark, "late-marks")
    dropped = 0
    for part in parts:
        part.where("at IS NOT NULL").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(part.schema).parquet(inbox).withWatermark("at", horizon).dropDuplicatesWithinWatermark(["event_id"])
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    return spark.read.schema(parts[0].schema).parquet(out), dropped


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return events.groupBy(F.col("event_type").alias("name"), window.alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean")).select("name", F.unix_timestamp("w.start").alias("start"), "n", "mean")


def threshold_alerts(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Stateless limits ``(event_type, warn, crit)`` on each arriving sample."""
    return events.join(F.broadcast(limits), "event_type").where("value >= warn").select("event_id", F.expr("CASE WHEN value >= crit THEN 'critical' ELSE 'warning' END AS severity"))


def stateful(events: DataFrame, output: str, step: Callable[[list[int], list[int], list[int]], tuple[list[int], list]], horizon: int, delay: int = 600) -> DataFrame:
    """Per ``user_id``, ``step(held, ids, seconds)`` on a batch's events in time order, giving the seconds to hold and a value for each event.

    ``output`` is the value's name and type. The state is an array of seconds: those that an
    event after the watermark can reach back to, ``horizon`` seconds. A timer at the
    horizon after a user's last event takes the user out of the state store. Late events
    are dropped. A user's events of one batch are one task's, as the steps are sequential.
    """
    name = output.split()[0]

    def run_key(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        held = [int(s) for s in state.get[0]] if state.exists else []
        newest = max([int(rows["sec"].iloc[-1]), *held])
        held, values = step(held, rows["event_id"].tolist(), rows["sec"].tolist())
        state.update(([s for s in held if s >= newest - horizon - delay],))
        state.setTimeoutTimestamp(max((newest + horizon + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": k[0], "event_id": rows["event_id"], name: values})

    timed = events.select("user_id", "event_id", F.unix_seconds("at").alias("sec"), "at")
    return timed.groupBy("user_id").applyInPandasWithState(run_key, f"user_id long, event_id long, {output}", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def lockout_step(limit: int, seconds: int) -> Callable:
    """The end of the lock at the ``limit``-th failure within ``seconds``, those of the same second included; else null."""

    def step(held: list[int], ids: list[int], secs: list[int]) -> tuple[list[int], list]:
        held = sorted(held + secs)
        return held, [s + seconds if bisect_right(held, s) - bisect_left(held, s - seconds) >= limit else None for s in secs]

    return step


def rate_step(limits: dict[int, int]) -> Callable:
    """Whether a request is allowed: fewer than ``n`` allowed ones in the ``seconds`` up to it, for each of ``limits``."""

    def step(held: list[int], ids: list[int], secs: list[int]) -> tuple[list[int], list]:
        held, out = sorted(held), []
        for s in secs:
            to = bisect_right(held, s)
            out.append(all(to - bisect_right(held, s - w) < n for w, n in limits.items()))
            if out[-1]:
                held.insert(to, s)
        return held, out

    return step
