"""Queries on pixels, cells, tiles and regions. An embedding of 64 values is an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pixels as P
from .registry import register


def rr(*columns: str, n: int = 5):
    return [F.round(c, n).alias(c) for c in columns]


def sr(*columns: str, n: int = 5) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in columns)


register("pixel_stats", lambda t: t.pixels.groupBy("image_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.99).alias("p99"), F.kurtosis("value").alias("kurt")).select("image_id", *rr("mean", "std", "least", "most", "median", "p99", "kurt", n=4)),
    f"SELECT image_id, {sr('mean', 'std', 'least', 'most', 'median', 'p99', 'kurt', n=4)} FROM (SELECT image_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS least, max(value) AS most, median(value) AS median, quantile_cont(value, 0.99) AS p99, kurtosis_pop(value) AS kurt FROM pixels GROUP BY 1)")
_HIST = "SELECT image_id, least(greatest(CAST(floor((value + 0.5) / 1.0 * 16) AS BIGINT), 0), 15) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2"
register("pixel_histogram", lambda t: P.histogram(t.pixels, 16, -0.5, 0.5), _HIST)
register("pixel_entropy", lambda t: P.entropy(P.histogram(t.pixels, 16, -0.5, 0.5)).select("image_id", *rr("entropy", "uniformity")), f"SELECT image_id, round(-sum(p * log2(p)), 5) AS entropy, round(sum(p * p), 5) AS uniformity FROM (SELECT image_id, n / sum(n) OVER (PARTITION BY image_id) AS p FROM ({_HIST})) GROUP BY 1")
register("pixel_contrast", lambda t: t.pixels.groupBy("image_id").agg(F.stddev_pop("value").alias("rms"), F.expr("CASE WHEN max(value) + min(value) + 1 = 0 THEN 0D ELSE (max(value) - min(value)) / (max(value) + min(value) + 1) END AS michelson")).select("image_id", *rr("rms", "michelson")), "SELECT image_id, round(stddev_pop(value), 5) AS rms, round((max(value) - min(value)) / (max(value) + min(value) + 1), 5) AS michelson FROM pixels GROUP BY 1")
_N = "SELECT c.image_id, c.y, c.x, c.value, " + ", ".join(f"{k}.value AS {k}" for k in P.RING) + " FROM pixels c " + " ".join(f"JOIN pixels {k} ON {k}.image_id = c.image_id AND {k}.y = c.y + {dy} AND {k}.x = c.x + {dx}" for k, (dy, dx) in P.RING.items())
_SOBEL = f"SELECT image_id, y, x, (ne + 2 * e + se) - (nw + 2 * w + sw) AS gx, (sw + 2 * s + se) - (nw + 2 * n + ne) AS gy FROM ({_N})"
_GRAD = f"SELECT image_id, sqrt(gx * gx + gy * gy) AS magnitude FROM ({_SOBEL})"
register("gradient_stats", lambda t: P.sobel(t.pixels).groupBy("image_id").agg(F.round(F.avg("magnitude"), 5).alias("mean"), F.round(F.stddev_pop("magnitude"), 5).alias("std"), F.round(F.max("magnitude"), 5).alias("most")), f"SELECT image_id, round(avg(magnitude), 5) AS mean, round(stddev_pop(magnitude), 5) AS std, round(max(magnitude), 5) AS most FROM ({_GRAD}) GROUP BY 1")
register("contrast_mix", lambda t: t.pixels.groupBy("image_id").agg(F.stddev_pop("value").alias("rms"), F.expr("(max(value) - min(value)) / 2 AS mi")).join(P.sobel(t.pixels).groupBy("image_id").agg(F.avg("magnitude").alias("g")), "image_id").selectExpr("image_id", "round(least(1D, greatest(0D, 0.4D * rms + 0.3D * mi + 0.3D * g)), 5) AS contrast"),
    f"SELECT image_id, round(least(1.0, greatest(0.0, 0.4 * rms + 0.3 * mi + 0.3 * g)), 5) AS contrast FROM (SELECT image_id, stddev_pop(value) AS rms, (max(value) - min(value)) / 2 AS mi FROM pixels GROUP BY 1) JOIN (SELECT image_id, avg(magnitude) AS g FROM ({_GRAD}) GROUP BY 1) USING (image_id)")
_CROSS = "SELECT c.image_id, n.value + s.value + e.value + w.value - 4 * c.value AS lap FROM pixels c " + " ".join(f"JOIN pixels {k} ON {k}.image_id = c.image_id AND {k}.y = c.y + {P.RING[k][0]} AND {k}.x = c.x + {P.RING[k][1]}" for k in "nsew")
register("laplacian_sharpness", lambda t: P.laplacian(t.pixels).groupBy("image_id").agg(F.round(F.var_pop("lap"), 5).alias("sharpness")), f"SELECT image_id, round(var_pop(lap), 5) AS sharpness FROM ({_CROSS}) GROUP BY 1")
register("block_snr", lambda t: t.pixels.withColumn("all", F.var_pop("value").over(Window.partitionBy("image_id"))).groupBy("image_id", F.expr("y DIV 2"), F.expr("x DIV 2")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("all").alias("a")).groupBy("image_id").agg(F.round(F.coalesce(F.avg(F.when((F.col("s") * F.col("s") < F.col("a") / 2) & (F.col("s") > 0) & (F.col("m") > 0), 20 * F.log10(F.expr("try_divide(m, s)")))), F.lit(20.0)), 4).alias("snr")),
    "SELECT image_id, round(coalesce(avg(CASE WHEN s * s < a / 2 AND s > 0 AND m > 0 THEN 20 * log10(m / s) END), 20.0), 4) AS snr FROM (SELECT image_id, avg(value) AS m, stddev_pop(value) AS s, max(a) AS a FROM (SELECT *, var_pop(value) OVER (PARTITION BY image_id) AS a FROM pixels) GROUP BY image_id, y // 2, x // 2) GROUP BY 1")
_CELLS = "SELECT p.*, cy, cx FROM pixels p, (SELECT unnest(range(0, 3)) AS cy) a, (SELECT unnest(range(0, 3)) AS cx) b WHERE y >= cy * 2 AND y < cy * 2 + 4 AND x >= cx * 2 AND x < cx * 2 + 4"
register("illumination_uniformity", lambda t: P.cells(t.pixels.withColumn("value", F.col("value") + 1), 4, 2, 2).groupBy("image_id", "cy", "cx").agg(F.avg("value").alias("m")).groupBy("image_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop("m") / F.avg("m") / 0.1)), 5).alias("uniformity")), f"SELECT image_id, round(greatest(0.0, least(1.0, 1 - stddev_pop(m) / avg(m) / 0.1)), 5) AS uniformity FROM (SELECT image_id, cy, cx, avg(value + 1) AS m FROM ({_CELLS}) GROUP BY ALL) GROUP BY 1")
_BITS = [f"CAST({k} >= value AS INT)" for k in P.RING]
_CHANGES = " + ".join(f"CAST({_BITS[i]} <> {_BITS[(i + 1) % 8]} AS INT)" for i in range(8))
register("lbp_histogram", lambda t: P.local_binary(t.pixels).groupBy("image_id", "code").agg(F.count("*").alias("n")), f"SELECT image_id, CASE WHEN {_CHANGES} <= 2 THEN {' + '.join(_BITS)} ELSE 9 END AS code, count(*) AS n FROM ({_N}) GROUP BY 1, 2")


register("tile_grid", lambda t: t.part.selectExpr("p_partkey", "p_size", "explode(sequence(0, p_size * 10, 64)) AS y0").selectExpr("p_partkey", "CAST(y0 AS BIGINT) AS y0", "CAST(least(y0 + 80, p_size * 10) AS BIGINT) AS y1"), "SELECT p_partkey, y0, least(y0 + 80, p_size * 10) AS y1 FROM (SELECT p_partkey, p_size, unnest(generate_series(0, p_size * 10, 64)) AS y0 FROM part)")
register("tile_blend", lambda t: P.cells(t.pixels, 4, 2, 2).withColumn("w", F.expr("1 + least(y - cy * 2, 3 - (y - cy * 2)) + least(x - cx * 2, 3 - (x - cx * 2))")).groupBy("image_id", "y", "x").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 5).alias("v")), f"SELECT image_id, y, x, round(sum(value * w) / sum(w), 5) AS v FROM (SELECT *, 1 + least(y - cy * 2, 3 - (y - cy * 2)) + least(x - cx * 2, 3 - (x - cx * 2)) AS w FROM ({_CELLS})) GROUP BY 1, 2, 3")
register("cell_grid", lambda t: P.cells(t.pixels, 4, 2, 2).groupBy("image_id", "cy", "cx").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total")), f"SELECT image_id, cy, cx, count(*) AS n, round(sum(value), 5) AS total FROM ({_CELLS}) GROUP BY 1, 2, 3")
register("cell_valid_ratio", lambda t: P.cells(t.pixels, 4, 2, 2).groupBy("image_id", "cy", "cx").agg((F.count_if(F.col("value") > 0) / F.count("*")).alias("valid")).where("1 - valid <= 0.85"), f"SELECT image_id, cy, cx, valid FROM (SELECT image_id, cy, cx, count(*) FILTER (value > 0) / count(*) AS valid FROM ({_CELLS}) GROUP BY 1, 2, 3) WHERE 1 - valid <= 0.85")


# quality records of an image, from its pixels
_QUAL = "SELECT image_id, 10 + 300 * avg(abs(value)) AS snr, least(1.0, stddev_pop(value) * 4) AS contrast, 1 - abs(avg(value)) AS uniformity, least(1.0, (max(value) - min(value)) / 1.2) AS sharpness FROM pixels GROUP BY 1"


def records(t):
    return t.pixels.groupBy("image_id").agg(F.expr("10 + 300 * avg(abs(value)) AS snr"), F.expr("least(1D, stddev_pop(value) * 4) AS contrast"), F.expr("1 - abs(avg(value)) AS uniformity"), F.expr("least(1D, (max(value) - min(value)) / 1.2D) AS sharpness"))


_QS = "100 * (0.3 * least(1.0, snr / 40) + 0.25 * contrast + 0.25 * uniformity + 0.2 * sharpness)"
_QD = _QS.replace("0.3", "0.3D").replace("0.25", "0.25D").replace("0.2 ", "0.2D ").replace("1.0", "1.0D")
register("quality_score", lambda t: records(t).selectExpr("image_id", f"round({_QD}, 5) AS score"), f"SELECT image_id, round({_QS}, 5) AS score FROM ({_QUAL})")
_VOTES = "CAST(snr >= {0} AS INT) + CAST(contrast >= {1} AS INT) + CAST(uniformity >= {2} AS INT) + CAST(sharpness >= {3} AS INT)"
_LEVEL = f"CASE WHEN {_VOTES.format(42, 0.5, 0.99, 0.55)} >= 3 THEN 'excellent' WHEN {_VOTES.format(40, 0.49, 0.98, 0.5)} >= 2 THEN 'good' WHEN {_VOTES.format(38, 0.4, 0.9, 0.4)} >= 1 THEN 'fair' ELSE 'poor' END"
register("quality_level", lambda t: records(t).selectExpr("image_id", f"{_LEVEL} AS level"), f"SELECT image_id, {_LEVEL} AS level FROM ({_QUAL})")
register("quality_gate", lambda t: records(t).where(f"{_QD} >= 75").select("image_id"), f"SELECT image_id FROM ({_QUAL}) WHERE {_QS} >= 75")
register("quality_compare", lambda t: (lambda q: q.selectExpr("image_id AS id_a", "image_id + 1 AS image_id", "s AS sa").join(q, "image_id").selectExpr("id_a", "image_id AS id_b", "round(sa - s, 5) AS diff", "CASE WHEN sa >= s THEN id_a ELSE image_id END AS better"))(records(t).selectExpr("image_id", f"{_QD} AS s")), f"WITH q AS (SELECT image_id, {_QS} AS s FROM ({_QUAL})) SELECT a.image_id AS id_a, b.image_id AS id_b, round(a.s - b.s, 5) AS diff, CASE WHEN a.s >= b.s THEN a.image_id ELSE b.image_id END AS better FROM q a JOIN q b ON b.image_id = a.image_id + 1")
_COMP = "(0.3 * least(1.0, snr / 45) + 0.3 * least(1.0, contrast / 0.6) + 0.2 * least(1.0, uniformity / 0.95) + 0.2 * least(1.0, sharpness / 0.6)) / 1.0"
register("compliance_score", lambda t: records(t).unpivot(["image_id"], ["snr", "contrast", "uniformity", "sharpness"], "metric", "v").join(F.broadcast(t.spark.createDataFrame([("snr", 45.0, 0.3), ("contrast", 0.6, 0.3), ("uniformity", 0.95, 0.2), ("sharpness", 0.6, 0.2)], "metric string, least double, w double")), "metric").groupBy("image_id").agg((F.sum(F.col("w") * F.least(F.lit(1.0), F.col("v") / F.col("least"))) / F.sum("w")).alias("s")).selectExpr("image_id", "round(s, 5) AS score", "CASE WHEN s >= 0.9 THEN 'full' WHEN s >= 0.7 THEN 'partial' ELSE 'none' END AS level"),
    f"SELECT image_id, round(s, 5) AS score, CASE WHEN s >= 0.9 THEN 'full' WHEN s >= 0.7 THEN 'partial' ELSE 'none' END AS level FROM (SELECT image_id, {_COMP} AS s FROM ({_QUAL}))")
register("compliance_overall", lambda t: records(t).selectExpr("image_id", "0.5D * contrast + 0.5D * uniformity AS o", "sharpness").selectExpr("image_id", "round(o, 5) AS overall", "o >= 0.7 AND sharpness >= 0.5 AS compliant"), f"SELECT image_id, round(0.5 * contrast + 0.5 * uniformity, 5) AS overall, 0.5 * contrast + 0.5 * uniformity >= 0.7 AND sharpness >= 0.5 AS compliant FROM ({_QUAL})")
register("compliance_summary", lambda t: t.events.agg(F.count("*").alias("n"), F.round(F.avg(F.expr("CASE WHEN event_type <> 'error' THEN 1D ELSE 0D END")), 6).alias("rate"), F.round(F.avg("value"), 5).alias("mean_time")).withColumn("status", F.when(F.col("rate") >= 0.8, "GOOD").otherwise("CHECK")), "SELECT count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(value), 5) AS mean_time, CASE WHEN avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'GOOD' ELSE 'CHECK' END AS status FROM events")
_CAL = "CASE WHEN l_quantity * 25.4 < 1000 THEN 0.4 ELSE 0 END - CASE WHEN 1 - l_discount * 5 < 0.8 THEN 0.2 ELSE 0 END"
register("calibration_check", lambda t: t.lineitem.selectExpr("l_orderkey", "l_linenumber", "round(l_quantity * 25.4D, 4) AS dpi", "round(1D - CASE WHEN l_quantity * 25.4D < 1000 THEN 0.4D ELSE 0D END - CASE WHEN 1 - l_discount * 5 < 0.8 THEN 0.2D ELSE 0D END, 4) AS score"), f"SELECT l_orderkey, l_linenumber, round(l_quantity * 25.4, 4) AS dpi, CAST(round(1 - {_CAL}, 4) AS DOUBLE) AS score FROM lineitem")
register("image_size_score", lambda t: t.part.selectExpr("p_partkey", "round(0.6D * least(p_size * p_size * 1600D / 4194304, 1D) + 0.4D * least(p_retailprice / 300, 1D), 6) AS score"), "SELECT p_partkey, round(0.6 * least(p_size * p_size * 1600.0 / 4194304, 1.0) + 0.4 * least(p_retailprice / 300, 1.0), 6) AS score FROM part")

# regions
register("region_filter", lambda t: t.regions.where("area BETWEEN 500 AND 4000 AND circularity >= 0.95 AND eccentricity <= 0.5").select("image_id", "region_id"), "SELECT image_id, region_id FROM regions WHERE area BETWEEN 500 AND 4000 AND circularity >= 0.95 AND eccentricity <= 0.5")
_TYPE = "CASE WHEN circularity > 0.97 AND area < 1000 THEN 'firing_pin' WHEN circularity > 0.95 AND area > 3000 THEN 'breech_face' WHEN aspect > 2.5 THEN 'striation' WHEN eccentricity > 0.6 THEN 'ejector' ELSE 'surface' END"
register("region_classify", lambda t: t.regions.selectExpr("image_id", "region_id", f"{_TYPE} AS type"), f"SELECT image_id, region_id, {_TYPE} AS type FROM regions")
register("region_confidence", lambda t: t.regions.selectExpr("image_id", "region_id", "round(0.3D * exp(-pow(area / 5000 - 0.3D, 2) / 0.08D) + 0.4D * circularity + 0.3D * greatest(0D, 1 - eccentricity), 6) AS c"), "SELECT image_id, region_id, round(0.3 * exp(-pow(area / 5000 - 0.3, 2) / 0.08) + 0.4 * circularity + 0.3 * greatest(0.0, 1 - eccentricity), 6) AS c FROM regions")
_OVER = "greatest(0.0, least(1.0, (a.radius + b.radius - sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) / (2 * least(a.radius, b.radius))))"
register("region_overlap", lambda t: t.regions.alias("a").join(t.regions.alias("b"), F.expr("a.image_id = b.image_id AND a.region_id < b.region_id")).selectExpr("a.image_id", "a.region_id AS ra", "b.region_id AS rb", f"round({_OVER}, 5) AS overlap"), f"SELECT a.image_id, a.region_id AS ra, b.region_id AS rb, round({_OVER}, 5) AS overlap FROM regions a JOIN regions b ON a.image_id = b.image_id AND a.region_id < b.region_id")


def suppress(t):
    """Greedy suppression within each image, as a fold over its few regions from the most confident."""
    one = F.struct((-F.col("confidence")).alias("c"), "region_id", "cx", "cy", "radius")
    near = lambda a, b: (a["radius"] + b["radius"] - F.sqrt(F.pow(a["cx"] - b["cx"], F.lit(2)) + F.pow(a["cy"] - b["cy"], F.lit(2)))) / (2 * F.least(a["radius"], b["radius"])) > 0.3
    rows = t.regions.groupBy("image_id").agg(F.sort_array(F.collect_list(one)).alias("r"))
    kept = F.aggregate("r", F.filter("r", lambda x: F.lit(False)), lambda k, r: F.when(F.exists(k, lambda o: near(o, r)), k).otherwise(F.array_append(k, r)))
    return rows.select("image_id", F.explode(kept).alias("k")).select("image_id", "k.region_id")


_ONE = "{'r': o.region_id, 'cx': o.cx, 'cy': o.cy, 'radius': o.radius}"
register("region_suppress", suppress, f"""WITH RECURSIVE o AS (SELECT image_id, region_id, cx, cy, radius, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, region_id, cx, cy, radius) AS rn FROM regions),
    k AS (SELECT image_id, rn, [{_ONE}] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.image_id, o.rn, CASE WHEN len(list_filter(k.kept, lambda p: (p.radius + o.radius - sqrt((p.cx - o.cx) * (p.cx - o.cx) + (p.cy - o.cy) * (p.cy - o.cy))) / (2 * least(p.radius, o.radius)) > 0.3)) > 0
    THEN k.kept ELSE list_append(k.kept, {_ONE}) END FROM k JOIN o ON o.image_id = k.image_id AND o.rn = k.rn + 1) SELECT image_id, x.r AS region_id FROM (SELECT image_id, unnest(arg_max(kept, rn)) AS x FROM k GROUP BY 1)""")
register("region_image_confidence", lambda t: t.regions.withColumn("type", F.expr(_TYPE)).groupBy("image_id").agg(F.round(F.least(F.lit(1.0), F.avg("confidence") + 0.1 * F.count_distinct("type")), 6).alias("c")), f"SELECT image_id, round(least(1.0, avg(confidence) + 0.1 * count(DISTINCT type)), 6) AS c FROM (SELECT *, {_TYPE} AS type FROM regions) GROUP BY 1")
register("region_texture", lambda t: t.pixels.where("y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6").groupBy("image_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(2 * F.stddev_pop("value"), 6).alias("contrast")), "SELECT image_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(2 * stddev_pop(value), 6) AS contrast FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6 GROUP BY 1")
