"""Shared plumbing of the training-data operators: tables, durable cuts, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an id list is broadcast (8 bytes a row); above it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows in one Arrow batch to Python workers; texts can be very long.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in a local session."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/matchlight-checkpoints"
    return f"{base.rstrip('/')}/matchlight"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Like ``checkpoint()`` it ends the lineage, but each task runs once only and
    the copy is columnar; it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows.

    Give it narrow frames (ids, keys) that are cheap to count, e.g. after ``cut``.
    """
    return F.broadcast(df) if df.count() <= rows else df


def apart(docs: DataFrame, own: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns of the names ``own`` (in any case) named otherwise, and what gives them their names back."""
    taken, renamed = {c.lower() for c in docs.columns} | own, {}
    for c in docs.columns:
        if c.lower() in own:
            other = f"_in_{c}"
            while other.lower() in taken:
                other = f"_{other}"
            taken.add(other.lower())
            renamed[c] = other
    back = {v: k for k, v in renamed.items()}
    return docs.withColumnsRenamed(renamed), lambda df: df.withColumnsRenamed(back)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` of longs: ``(node, component)``, component = least node.

    Each round every node takes the least label among its neighbours and its own
    label's label (pointer jumping); labels are cut to the shared folder. All
    aggregates are minima with map-side combine, so a hub does not meet in one task.
    """
    both = cut(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
            .unionByName(labels)
            .groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("old"))
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = cut(
            near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"),
            "labels",
        )
        moved = after.where("label <> old").limit(1).count()
        labels = after.drop("old")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


__all__ = ["ARROW_ROWS", "BROADCAST_ROWS", "apart", "bounded_broadcast", "components", "cut", "shared_dir", "table"]
