"""The tables that operators read, derived from the given ones, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Derived tables in SQL, each with the tables it needs named in it.
DERIVED: dict[str, str] = {
    "cases": """SELECT c_custkey AS case_id, replace(c_name, '#', '-') AS case_number, n_name AS investigator, c_mktsegment AS weapon_type,
        CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'archived' END AS status, f.date_created
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN
        (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS date_created FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey""",
    "images": """SELECT o_orderkey AS image_id, o_custkey AS case_id, o_orderpriority AS evidence_type, o_orderstatus AS status,
        strftime(o_orderdate, '%Y-%m-%d') AS date_added, o_totalprice AS file_size FROM orders""",
    "features": """SELECT l_orderkey AS image_id, l_linenumber AS kp_idx, 1 - l_discount * 5 AS quality, l_tax * 10 AS confidence, p_name AS description,
        l_suppkey AS partner FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
    "pixels": """SELECT image_id, pos // 8 AS y, pos % 8 AS x, value FROM (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS value,
        CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)""",
    "probes": "SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0",
    "pairs": """SELECT p.vec_id AS id_a, g.vec_id AS id_b, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), 6) AS score,
        p.label = g.label AS same, p.label AS label_a, g.label AS label_b, sqrt(list_sum(list_transform(list_zip(CAST(p.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
        FROM probes p, embeddings g WHERE p.vec_id <> g.vec_id""",
    "predictions": "SELECT doc_id, quality AS y_true, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS y_pred, n_chars AS score FROM labels JOIN documents USING (doc_id)",
    "metrics": "SELECT event_id, event_type AS name, epoch_us(ts) // 1000000 AS sec, value, user_id FROM events",
    "samples": "SELECT l_returnflag AS grp, l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y, l_discount AS d, l_tax AS t FROM lineitem",
    "regions": """SELECT l_orderkey AS image_id, l_linenumber AS region_id, CAST(l_partkey % 100 AS DOUBLE) AS cx, CAST(l_suppkey % 100 AS DOUBLE) AS cy, l_quantity AS radius,
        l_extendedprice / 20 AS area, 1 - l_discount AS circularity, l_tax * 10 AS eccentricity, 1 + l_discount * 30 AS aspect, 1 - l_tax * 5 AS confidence FROM lineitem""",
}


def with_tables(sql: str) -> str:
    """``sql`` preceded by the derived tables it names, and those that they name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in DERIVED.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|from|join|,)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({DERIVED[n]})" for n in needed)
    rest = sql.strip()
    return f"WITH {head}, {rest[5:]}" if rest.upper().startswith("WITH ") and not rest.upper().startswith("WITH RECURSIVE") else (
        f"WITH RECURSIVE {head}, {rest[15:]}" if rest.upper().startswith("WITH RECURSIVE") else f"WITH {head} {rest}"
    )


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"


class Tables:
    """DataFrames of the given tables (as attributes) and of the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def cases(self) -> DataFrame:
        first = self.orders.groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date_created"))
        nation = F.broadcast(self.nation.select("n_nationkey", "n_name"))  # 25 rows by definition
        return (
            self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("case_id"), F.expr("replace(c_name, '#', '-') AS case_number"), F.col("n_name").alias("investigator"),
                F.col("c_mktsegment").alias("weapon_type"), F.expr("CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'archived' END AS status"), "date_created",
            )
        )

    @property
    def images(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS image_id", "o_custkey AS case_id", "o_orderpriority AS evidence_type", "o_orderstatus AS status",
            "date_format(o_orderdate, 'yyyy-MM-dd') AS date_added", "o_totalprice AS file_size",
        )

    @property
    def features(self) -> DataFrame:
        """Beside the columns of the SQL, ``place``: where the row lies in the table, by file and row."""
        lines = self.lineitem
        file = "''" if len(lines.inputFiles()) == 1 else "_metadata.file_path"
        lines = lines.selectExpr("*", f"struct({file} AS file, _metadata.row_index AS row) AS place")
        return lines.join(self.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "l_orderkey AS image_id", "l_linenumber AS kp_idx", "1 - l_discount * 5 AS quality", "l_tax * 10 AS confidence", "p_name AS description", "l_suppkey AS partner", "place",
        )

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", "embedding", "label")

    @property
    def pixels(self) -> DataFrame:
        return self.embeddings.selectExpr("vec_id AS image_id", "posexplode(embedding) AS (pos, v)").selectExpr(
            "image_id", "pos DIV 8 AS y", "pos % 8 AS x", "CAST(v AS DOUBLE) AS value"
        )

    @property
    def probes(self) -> DataFrame:
        """The stated query set: every vector whose id is divisible by 20."""
        return self.vectors.where("vec_id % 20 = 0")

    @property
    def pairs(self) -> DataFrame:
        """Every probe against every other vector, with cosine and distance."""
        return self.pair_columns("id_a", "id_b", "score", "same", "label_a", "label_b", "distance")

    def pair_columns(self, *names: str) -> DataFrame:
        """The named columns of ``pairs``; others are not computed."""
        from ..operators.blocks import pairs

        return pairs(self.vectors, self.probes, *names)

    @property
    def predictions(self) -> DataFrame:
        return self.labels.join(self.documents.select("doc_id", "n_chars"), "doc_id").selectExpr(
            "doc_id", "quality AS y_true", "CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS y_pred", "n_chars AS score"
        )

    @property
    def metrics(self) -> DataFrame:
        return self.events.selectExpr("event_id", "event_type AS name", "CAST(CAST(ts AS TIMESTAMP) AS BIGINT) AS sec", "value", "user_id")

    @property
    def samples(self) -> DataFrame:
        return self.lineitem.selectExpr("l_returnflag AS grp", "l_orderkey * 8 + l_linenumber AS id", "l_quantity AS x", "l_extendedprice AS y", "l_discount AS d", "l_tax AS t")

    @property
    def regions(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey AS image_id", "l_linenumber AS region_id", "CAST(l_partkey % 100 AS DOUBLE) AS cx", "CAST(l_suppkey % 100 AS DOUBLE) AS cy", "l_quantity AS radius",
            "l_extendedprice / 20 AS area", "1 - l_discount AS circularity", "l_tax * 10 AS eccentricity", "1 + l_discount * 30 AS aspect", "1 - l_tax * 5 AS confidence",
        )
