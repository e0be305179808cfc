"""File sources and sinks: image folders, exchange records in XML and JSON, dated exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_dir

# Limits of incoming files.
EXTENSIONS = r"\.(jpg|jpeg|png|tif|tiff|bmp)$"
MAX_BYTES = 50 * 1024 * 1024

RECORD = (
    "struct<schema_version:string,metadata:struct<image_id:bigint,evidence_type:string,created:string>,"
    "features:array<struct<kp_idx:int,x:double,y:double>>>"
)


def shared_folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/files"


def write_sample_images(vectors: DataFrame) -> str:
    """A folder with one sub-folder per class and a small text file for each part of it, as a source of files."""
    path = f"{shared_folder(vectors)}/images-{uuid.uuid4().hex}"
    vectors.selectExpr("concat('class_', label) AS folder", "CAST(vec_id AS STRING) AS value").repartition("folder").write.mode("overwrite").partitionBy("folder").text(path)
    return path


def scan_image_dir(path: str, extensions: str = r"\.(jpg|jpeg|png|tiff|txt)$") -> DataFrame:
    """``(path, class, label)``: one sub-folder per class, numbered in the order of their names."""
    files = SparkSession.active().read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(extensions)).select("path", "length")
    named = files.withColumn("class", F.element_at(F.split("path", "/"), -2))
    order = named.select("class").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("class")) - 1)  # a row per class
    return named.join(F.broadcast(order), "class").select("class", "label", "length")


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes by reason: extension, too large, empty or valid, in the order of the checks."""
    reason = F.when(~F.lower("path").rlike(EXTENSIONS), "extension").when(F.col("length") > MAX_BYTES, "too large").when(F.col("length") == 0, "empty").otherwise("valid")
    return files.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("total_size"))


def evidence_records(images: DataFrame, features: DataFrame) -> DataFrame:
    """``(image_id, record)``: the nested exchange record of each image with its features."""
    points = features.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("kp_idx"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")))).alias("features"))
    meta = F.struct(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("evidence_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))
    joined = images.join(points, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = F.array().cast("array<struct<kp_idx:int,x:double,y:double>>")
    return joined.select(F.col("o_orderkey").alias("image_id"), F.struct(F.lit("1.0").alias("schema_version"), meta.alias("metadata"), F.coalesce("features", empty).alias("features")).alias("record"))


def read_evidence(bodies: DataFrame, kind: str) -> DataFrame:
    """``(image_id, n_features)`` of records in ``body`` as XML or JSON."""
    ddl = RECORD[len("struct<") : -1].replace("schema_version:", "schema_version ").replace("metadata:struct", "metadata struct").replace("features:array", "features array")
    read = F.from_xml("body", ddl) if kind == "xml" else F.from_json("body", ddl)
    return bodies.select(read.alias("r")).select(F.col("r.metadata.image_id").alias("image_id"), F.coalesce(F.size("r.features"), F.lit(0)).cast("long").alias("n_features"))


def date_range(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events from ``start`` to ``end``, both inclusive and optional."""
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return events


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyyMMdd").alias("event_date")).agg(F.count("*").alias("n"))


def write_daily(events: DataFrame, path: str) -> None:
    """One folder per day of events, as JSON."""
    events.withColumn("event_date", F.date_format("ts", "yyyyMMdd")).write.mode("append").partitionBy("event_date").json(path)
