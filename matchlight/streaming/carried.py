"""Streams whose state is a table: a micro-batch meets what the batches before it left, by batch operators.

A hot key of a micro-batch is as many tasks as in batch, which state kept per key can't
give. Batch ``n`` reads the state of batch ``n - 1`` and writes rows and state to places
that its number names, so a batch that runs again after a failure changes nothing. Two
states are held, turn by turn. Events at or before the watermark, the latest time of
earlier batches less ``delay`` seconds, are dropped, as are those without a time; what
no later event can meet leaves the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cooling import cooldown
from ..operators.ranges import ranged, running
from ..operators.telemetry import trend

DELAY = 600

#: From events, state and watermark in microseconds to new rows and state.
Step = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of ``path``, or none where nothing has been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*spark.createDataFrame([], schema).columns)


def drain(stream: DataFrame, root: str, rows: str, state: str, step: Step, delay: int = DELAY) -> tuple[DataFrame, DataFrame]:
    """Apply ``step`` to what is new in ``stream(at, ...)``; all rows so far and the state now, of schemas ``rows`` and ``state``.

    A later call with the same ``root`` goes on where this one ended.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        before, here = (n - 1) % 2, n % 2
        held = _read(spark, f"{root}/mark-{before}", "n long, mark long").where(F.col("n") == n - 1).first() if n else None
        old = _read(spark, f"{root}/state-{before}", state) if n else spark.createDataFrame([], state)
        events = batch.where("at IS NOT NULL")
        if held is not None and held["mark"] is not None:
            events = events.where(F.unix_micros("at") > held["mark"])
        latest = events.agg(F.max(F.unix_micros("at"))).first()[0]
        marks = [m for m in (held["mark"] if held else None, None if latest is None else latest - delay * 1_000_000) if m is not None]
        mark = max(marks, default=None)
        new, left = step(events, old, -(2**62) if mark is None else mark)
        new.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        left.write.mode("overwrite").parquet(f"{root}/state-{here}")
        spark.createDataFrame([(n, mark)], "n long, mark long").coalesce(1).write.mode("overwrite").parquet(f"{root}/mark-{here}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    ends = [(m["n"], at) for at in (0, 1) if (m := _read(spark, f"{root}/mark-{at}", "n long, mark long").first()) is not None]
    now = _read(spark, f"{root}/state-{max(ends)[1]}", state) if ends else spark.createDataFrame([], state)
    return _read(spark, f"{root}/rows", rows), now


def _keyed(a: DataFrame, b: DataFrame, key: str) -> Column:
    return a[key].eqNullSafe(b[f"_{key}"])


def cooldown_step(key: str, seconds: int) -> Step:
    """``(key, event_id)`` of events of which none follows a kept one within ``seconds``; the state is ``(key, free)``, from when one may be kept again.

    An event that comes late, before one already kept, is taken to be in its cool-down.
    """

    def step(events: DataFrame, state: DataFrame, mark: int) -> tuple[DataFrame, DataFrame]:
        at = events.select(key, "event_id", F.unix_seconds("at").alias("sec"))
        held = state.select(F.col(key).alias(f"_{key}"), "free")
        free = at.join(held, _keyed(at, held, key), "left").where("free IS NULL OR sec >= free").select(key, "event_id", "sec")
        kept = cooldown(free, key, seconds)
        ends = kept.select(key, (F.col("sec") + seconds).alias("free")).unionByName(state).groupBy(key).agg(F.max("free").alias("free"))
        return kept.select(key, "event_id"), ends.where(F.col("free") > F.floor(F.lit(mark) / 1_000_000))

    return step


def trend_step(n: int = 50, horizon: int = 86400) -> Step:
    """``(name, event_id, slope)`` over the last ``n`` samples that had come by then; the state holds samples after the watermark and the ``n - 1`` of a name before it.

    A name without samples for ``horizon`` seconds is forgotten: it may start anew.
    """
    columns = ["name", "event_id", "sec", "value"]

    def step(events: DataFrame, state: DataFrame, mark: int) -> tuple[DataFrame, DataFrame]:
        came = events.select("name", "event_id", F.unix_seconds("at").alias("sec"), "value")
        both = came.withColumn("new", F.lit(True)).unionByName(state.withColumn("new", F.lit(False)))
        rows = trend(both, n, keep=("new",)).where("new").select("name", "event_id", F.coalesce("slope", F.lit(0.0)).alias("slope"))
        at = mark // 1_000_000
        order = ["name", "sec", "event_id"]
        ranked = running(ranged(both.select(*columns), *order), order, "sum", rn=F.lit(1).cast("long"))
        ends = ranked.groupBy(F.col("name").alias("_name")).agg(F.coalesce(F.max(F.when(F.col("sec") < at, F.col("rn"))), F.lit(0)).alias("top"), F.max("sec").alias("last"))
        left = ranked.join(ends, _keyed(ranked, ends, "name")).where((F.col("last") + horizon > at) & ((F.col("sec") >= at) | (F.col("rn") > F.col("top") - (n - 1))))
        return rows, left.select(*columns)

    return step


def session_step(key: str, gap: int) -> Step:
    """Closed sessions ``(key, first, last, n)``; the state holds the open ones, alike.

    Events of one stretch of ``gap`` seconds are one session whatever else there is, so
    they are added up before the shuffle; a held session is a row whose own length
    widens its gap.
    """
    micros = gap * 1_000_000

    def step(events: DataFrame, state: DataFrame, mark: int) -> tuple[DataFrame, DataFrame]:
        short = events.groupBy(key, F.floor(F.unix_micros("at") / micros).alias("_stretch")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("_stretch")
        both = short.unionByName(state).withColumn("_gap", F.expr(f"make_interval(0, 0, 0, 0, 0, 0, CAST((unix_micros(last) - unix_micros(first) + {micros}) / 1000000BD AS DECIMAL(18, 6)))"))
        held = both.groupBy(key, F.session_window("first", F.col("_gap")).alias("_w")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_w")
        closed = F.unix_micros("last") + micros <= mark
        return held.where(closed), held.where(~closed)

    return step
