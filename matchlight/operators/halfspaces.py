"""Half-space trees over each metric: counts of samples by halves of halves of its range, merged over all tasks.

A tree halves a metric's range ``DEPTH`` times; trees differ by where their range lies
about that of the metric. A sample's score is, summed over trees, the count of the first
half-space on its path that holds few samples, times two to its depth: a lone value far
off is told apart early, so its score is low. Counts are sums, so no task holds a metric;
per metric there are ``trees * 2 ** DEPTH`` numbers, which meet the samples by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

#: Halvings of a tree, and of how many leaves it therefore has.
DEPTH = 8
LEAVES = 2**DEPTH


def tree_ranges(trees: int) -> list[tuple[float, float]]:
    """``(low, width)`` of each tree's range in units of the metric's own: about places that the golden ratio spreads over it."""
    places = [(t + 1) * 0.6180339887498949 % 1 for t in range(trees)]
    return [(round(s - 2 * max(s, 1 - s), 12), round(4 * max(s, 1 - s), 12)) for s in places]


def _leaf(low: float, width: float) -> Column:
    return F.least(F.lit(LEAVES - 1), F.floor((F.col("_x") - low) / width * LEAVES))


def scored(metrics: DataFrame, trees: int = 25, few: float = 0.01) -> DataFrame:
    """``metrics(name, value, ...)`` with ``mass``, low where a value lies apart from the others of its metric.

    A half-space with no more than the share ``few`` of a metric's samples ends a path.
    Samples whose value is null, NaN or infinite are left out; a null name is a name like
    any other; a metric of one value has equal scores.
    """
    good = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    per = good.groupBy(F.col("name").alias("_name")).agg(F.min("value").alias("_least"), F.max("value").alias("_most"), F.count("*").alias("_n"))
    per = saved(per, "metrics")
    x = F.coalesce(F.try_divide(F.col("value") / 2 - F.col("_least") / 2, F.col("_most") / 2 - F.col("_least") / 2), F.lit(0.0))  # halves: the range of doubles may pass the largest one
    # a place of all trees' leaves in one array: tree by tree
    places = F.array(*[_leaf(low, width) + t * LEAVES for t, (low, width) in enumerate(tree_ranges(trees))])
    dealt = good.join(per, good["name"].eqNullSafe(per["_name"])).withColumn("_x", x).withColumn("_places", places)
    counts = dealt.select("_name", "_n", F.explode("_places").alias("_place")).groupBy("_name", "_n", "_place").agg(F.count("*").alias("_mass"))

    leaf, tree = F.pmod("_place", F.lit(LEAVES)), F.floor(F.col("_place") / LEAVES)
    nodes = saved(counts, "leaves").select("*", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("_depth"))
    node = F.floor(leaf / F.pow(F.lit(2), DEPTH - F.col("_depth")))
    # at most the leaves of one tree below a node
    masses = nodes.withColumn("_node", node).withColumn("_tree", tree).withColumn("_all", F.sum("_mass").over(Window.partitionBy("_name", "_tree", "_depth", "_node")))
    ends = masses.where((F.col("_all") <= F.col("_n") * few) | (F.col("_depth") == DEPTH))
    told = ends.groupBy("_name", "_place").agg(F.min_by(F.col("_all") * F.pow(F.lit(2), "_depth").cast("long"), "_depth").alias("_score"))
    grid = per.select("_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees * LEAVES - 1).cast("long"))).alias("_place"))
    held = grid.join(told.withColumnRenamed("_name", "_own"), grid["_name"].eqNullSafe(F.col("_own")) & (grid["_place"] == told["_place"]), "left").select(grid["_name"], grid["_place"], "_score")
    tables = saved(held.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_place", "_score"))).alias("_t")).select(F.col("_name").alias("_whose"), F.col("_t._score").alias("_scores")), "trees")
    met = dealt.join(tables, dealt["name"].eqNullSafe(tables["_whose"]))
    mass = F.aggregate("_places", F.lit(0).cast("long"), lambda s, p: s + F.get("_scores", p.cast("int")))
    return met.withColumn("mass", mass).select(*metrics.columns, "mass")


def anomalies(metrics: DataFrame, share: float = 0.01, trees: int = 25, few: float = 0.01) -> DataFrame:
    """``scored`` samples with ``is_anomaly``: those of the least masses that make up no more than ``share`` of their metric.

    Equal masses go together, so where they would make up more, none of them is one. The
    distinct masses of a metric are no more than the pieces into which its trees cut it.
    """
    rows = saved(scored(metrics, trees, few), "scored")
    kinds = rows.groupBy("name", "mass").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("name").orderBy("mass")
    ranked = kinds.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("name")))
    limits = ranked.where(F.col("upto") <= F.col("total") * share).groupBy(F.col("name").alias("_name")).agg(F.max("mass").alias("_limit"))
    met = rows.join(limits, rows["name"].eqNullSafe(limits["_name"]), "left")
    return met.withColumn("is_anomaly", F.coalesce(F.col("mass") <= F.col("_limit"), F.lit(False))).select(*rows.columns, "is_anomaly")


def anomalies_sql(trees: int = 25, few: float = 0.01, share: float = 0.01) -> str:
    """The same over a table ``metrics(name, event_id, value)``: ``(event_id, mass, is_anomaly)``."""
    ranges = ", ".join(f"({t}, {low}::DOUBLE, {width}::DOUBLE)" for t, (low, width) in enumerate(tree_ranges(trees)))
    return f"""WITH per AS (SELECT name, min(value) AS lo, max(value) AS hi, count(*) AS n FROM metrics GROUP BY 1),
    x AS (SELECT m.name, event_id, n, CASE WHEN hi > lo THEN (value / 2 - lo / 2) / (hi / 2 - lo / 2) ELSE 0 END AS x FROM metrics m JOIN per USING (name)),
    spot AS (SELECT name, event_id, n, t, least({LEAVES - 1}, CAST(floor((x - low) / width * {LEAVES}) AS BIGINT)) AS leaf FROM x, (VALUES {ranges}) r(t, low, width)),
    node AS (SELECT name, n, t, d, leaf >> ({DEPTH} - d) AS node, count(*) AS mass FROM spot, (SELECT unnest(range({DEPTH + 1})) AS d) GROUP BY ALL),
    ends AS (SELECT event_id, spot.name, spot.t, first(mass * (1 << d) ORDER BY d) AS score FROM spot JOIN node ON node.name = spot.name AND node.t = spot.t AND node.node = spot.leaf >> ({DEPTH} - d)
        WHERE mass <= spot.n * {few} OR d = {DEPTH} GROUP BY 1, 2, 3),
    s AS (SELECT event_id, name, CAST(sum(score) AS BIGINT) AS mass FROM ends GROUP BY 1, 2),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY name ORDER BY mass) AS upto, count(*) OVER (PARTITION BY name) AS total FROM s)
    SELECT event_id, mass, upto <= total * {share} AS is_anomaly FROM ranked"""
