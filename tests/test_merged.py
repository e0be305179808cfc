"""A user's statistic from pieces: groups over many batches, null keys and values, keys of several types."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.functions import udfs as U

SCHEMA = "k long, s string, x double"
PARTS = {"total": (lambda x: x.sum(), "sum"), "n": (lambda x: x.count(), "sum"), "least": (lambda x: x.min(), "min"), "most": (lambda x: x.max(), "max")}


def test_pieces_make_the_group(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k == 3 else int(k) + 2**60, None if k % 2 else "é", None if v < 0.1 else float(v)) for k, v in zip(rng.integers(0, 5, 500), rng.random(500), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = U.merged_statistic(df, ["k", "s"], "x", PARTS, F.struct(F.col("total") / F.col("n"), "least", "most"), "v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for k, s, x in rows:
        if x is not None:
            held.setdefault((k, s), []).append(x)
    assert {(r["k"], r["s"]): tuple(r["v"]) for r in got} == {key: pytest.approx((np.mean(xs), min(xs), max(xs))) for key, xs in held.items()}


def test_without_values(spark):
    of = lambda rows: U.merged_statistic(spark.createDataFrame(rows, SCHEMA), ["k"], "x", PARTS, F.col("n"), "v").collect()
    assert of([]) == [] and of([(1, "a", None)]) == []


def test_tiles_are_whole_across_batches(spark):
    import pandas as pd

    from matchlight.functions import udfs

    grid = spark.range(64).selectExpr("CAST(id DIV 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x", "CAST(id AS DOUBLE) AS value")
    pixels = spark.createDataFrame([(i,) for i in (1, 2, 5, None)], "image_id long").crossJoin(grid)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def seen(tile: pd.DataFrame) -> pd.DataFrame:
        return tile.assign(value=float(len(tile)))

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        made = udfs.on_tiles(pixels, 4, seen)
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 256 and {r["value"] for r in got} == {16.0} and sum(r["image_id"] is None for r in got) == 64
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()  # a call a tile to Python cost more than the tile
