"""Connected components of an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in a local session."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/matchlight-checkpoints"
    return f"{base.rstrip('/')}/matchlight"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder executors share, and read back: the lineage ends, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of ``edges(a, b)``; the component is its least node.

    Each round a node takes the least label among its neighbours, then that label's own
    label (pointer jumping), so a chain of n nodes takes some log(n) rounds.
    """
    both = saved(edges.union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", F.least("component", "heard").alias("step"), "component")
        far = labels.select(F.col("node").alias("step"), F.col("component").alias("far"))
        after = near.join(far, "step", "left").select("node", F.least("step", F.coalesce("far", "step")).alias("component"), F.col("component").alias("before"))
        after = saved(after, "labels")
        moved = after.where("component <> before").limit(1).count()
        labels = after.drop("before")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
