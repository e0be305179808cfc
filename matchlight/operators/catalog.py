"""Catalog queries: duplicates, appends, look-ups, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import placed

#: Rows of an id list that is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where it is counted to be small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def numbered(df: DataFrame, order: str, start: int = 0, name: str = "new_id") -> DataFrame:
    """Gapless numbers from ``start + 1`` in the order of ``order``, without a one-partition window.

    Rows are dealt into ranges that are written once, so that rows and counts see the same
    ranges; each range is numbered and shifted by the rows of those before it.
    """
    return placed(df, [], [order]).withColumn(name, F.col("_place") + start).drop("_place", "_rank", "_size")


def new_keys(incoming: DataFrame, stored: DataFrame, key: str, order: str, mode: str = "reject") -> DataFrame:
    """Rows with keys that are new; a key repeated among them is refused, or given a suffix in mode ``suffix``."""
    fresh = incoming.join(stored.select(key).distinct(), key, "left_anti").withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    if mode == "reject":
        return fresh.where("_rn = 1").drop("_rn")
    return fresh.withColumn(key, F.when(F.col("_rn") > 1, F.concat_ws("_", key, F.col("_rn") - 1)).otherwise(F.col(key))).drop("_rn")


def suffix_repeats(df: DataFrame, key: Column, order: str, name: str = "hash") -> DataFrame:
    """``key``, with 8 hex digits of the id's digest where an earlier row has the same one."""
    rn = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    keyed = df.withColumn("_key", key).withColumn("_rn", rn)
    return keyed.withColumn(name, F.when(F.col("_rn") > 1, F.concat_ws("_", "_key", F.substring(F.md5(F.col(order).cast("string")), 1, 8))).otherwise(F.col("_key"))).drop("_key", "_rn")


def search(text: Column, query: str, case_sensitive: bool = False, whole_word: bool = False, regex: bool = False) -> Column:
    """Free-text predicate; ``*`` is a wildcard."""
    if regex:
        return text.rlike(query if case_sensitive else f"(?i){query}")
    if not case_sensitive:
        text, query = F.lower(text), query.lower()
    if whole_word:
        return text.rlike(rf"(^|[^a-z0-9_]){query}($|[^a-z0-9_])")
    return text.like("%" + query.replace("*", "%") + "%") if "*" in query else text.contains(query)


def facets(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Conjunction of equalities; ``all`` or None does not filter."""
    for column, value in wanted.items():
        if value not in (None, "all"):
            df = df.where(F.col(column) == value)
    return df


def latest(df: DataFrame, by: str, n: int, condition: str = "true", tie: str = "event_id") -> DataFrame:
    return df.where(condition).orderBy(F.desc(by), F.desc(tie)).limit(n)


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """Rows with the values of ``changes`` where it has the key; rows of ``deleted`` leave."""
    named = small(changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]))
    out = df.join(named, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out if deleted is None else out.join(small(deleted.select(key)), key, "left_anti")
