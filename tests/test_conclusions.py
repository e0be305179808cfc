"""Sums that meet the ladder's limits exactly: the same however the table's rows are dealt."""

from __future__ import annotations

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from matchlight import plans
from matchlight.operators import conclusions as K

from . import oracle


def test_sums_go_in_the_order_of_the_rows(spark):
    rows = [(1, k, x, "class") for k, x in enumerate([1e16, 1.0, -1e16, 4.0, None])] + [(2, 0, None, "class")]
    forth = spark.createDataFrame(rows, "image_id long, place long, quality double, type string")
    for dealt in (forth.repartition(1), forth.repartition(5), forth.orderBy(F.desc("place"))):
        got = {r["image_id"]: r for r in K.pair_summary(dealt, "image_id", place="place").collect()}
        assert got[1]["mean"] == 1.0  # ((1e16 + 1) - 1e16 + 4) / 4
        assert (got[2]["n"], got[2]["mean"], got[2]["significance"]) == (1, None, None)


@pytest.fixture(scope="module")
def dealt(tmp_path_factory, sf_dir):
    """The smallest tables, with line items in six files of small row groups."""
    to = str(tmp_path_factory.mktemp("dealt"))
    shutil.copytree(sf_dir, to, dirs_exist_ok=True, ignore=shutil.ignore_patterns("lineitem.parquet"))
    os.mkdir(f"{to}/lineitem.parquet")
    with duckdb.connect() as con:
        for k in range(6):
            con.execute(f"COPY (SELECT * FROM read_parquet('{sf_dir}/lineitem.parquet', file_row_number = true) WHERE file_row_number // 1000 = {k}) TO '{to}/lineitem.parquet/{k}.parquet' (ROW_GROUP_SIZE 512)")
    return to


@pytest.mark.parametrize("name", ["conclude_comparison", "review_flag"])
def test_same_as_sql_on_one_thread_when_dealt(spark, dealt, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table in oracle.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{dealt}/{table}.parquet{'/*.parquet' if table == 'lineitem' else ''}'")
    want = dict(con.execute(plans.ORACLES[name]).fetchall())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert {r[0]: r[1] for r in plans.QUERIES[name](spark, dealt).repartition(3).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
