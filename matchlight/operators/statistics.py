"""Statistics as distributed aggregations; only last scalars would leave Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .ranges import ranged, running


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, to 7.5e-8 (five-term rational approximation)."""
    # Coefficients of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    k = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * sum((F.lit(c) * F.pow(k, F.lit(float(i + 1))) for i, c in enumerate(b)), F.lit(0.0))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


#: Steps of the quadratures below; their error is under 1e-8 in the whole range.
STEPS = 2000


def _simpson(f: str, upto: str) -> str:
    """Simpson's sum, without the factor of the width, of ``f`` of ``x`` from 0 to ``upto``."""
    inner = f.replace("{x}", f"(({upto}) * i / {STEPS})")
    return f"aggregate(sequence(0, {STEPS}), CAST(0 AS DOUBLE), (s, i) -> s + (CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {inner})"


def normal_p(z: str) -> str:
    """SQL of the two-sided p-value of a normal statistic; null stays null. Absolute error under 1e-8."""
    body = _simpson("exp(-0.5 * {x} * {x})", f"least(abs({z}), 40D)")
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0D, 1 - 2 * least(abs({z}), 40D) / {3 * STEPS} * {body} / {math.sqrt(2 * math.pi)!r}) END"


def student_p(t: str, df: str) -> str:
    """SQL of the two-sided p-value of Student's t with ``df`` >= 1; null stays null.

    With t = sqrt(df) tan(a) the density is a power of cos(a), so the p-value is a
    ratio of two integrals over an angle and needs no gamma function. Beyond ``far``
    the power is below exp(-40).
    """
    angle, far = f"atan(abs({t}) / sqrt({df}))", f"CASE WHEN {df} > 34 THEN sqrt(80D / ({df} - 1)) ELSE {math.pi / 2!r} END"
    power = f"pow(cos({{x}}), {df} - 1)"
    near = f"least({angle}, {far})"
    return f"CASE WHEN {t} IS NOT NULL THEN greatest(0D, 1 - ({near}) * {_simpson(power, near)} / (({far}) * {_simpson(power, far)})) END"


def chi_square_p(chi2: str, df: str) -> str:
    """SQL of the upper tail of chi-squared with whole ``df`` >= 1: the finite sums of half-integer orders."""
    h = f"({chi2} / 2)"
    even = f"exp(-{h}) * aggregate(sequence(1, greatest(1, int({df} / 2))), struct(0D AS s, 1D AS term), (a, k) -> struct(a.s + a.term AS s, a.term * {h} / k AS term), a -> a.s)"
    odd = f"{normal_p(f'sqrt({chi2})')} + CASE WHEN {df} = 1 THEN 0D ELSE exp(-{h}) * sqrt({h}) * {2 / math.sqrt(math.pi)!r} * aggregate(sequence(1, greatest(1, int(({df} - 1) / 2))), struct(0D AS s, 1D AS term), (a, k) -> struct(a.s + a.term AS s, a.term * {h} / (k + 0.5D) AS term), a -> a.s) END"
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


def kolmogorov_p(d: str, n1: str, n2: str) -> str:
    """SQL of the limiting distribution of the two-sample gap ``d``."""
    lam = f"({d} * {d} * {n1} * {n2} / ({n1} + {n2}))"
    return f"CASE WHEN {lam} IS NULL THEN NULL WHEN {lam} < 0.04 THEN 1D ELSE least(1D, greatest(0D, 2 * aggregate(sequence(1, 100), 0D, (s, k) -> s + (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {lam})))) END"


def two_groups(df: DataFrame, a: str, b: str, value: str = "x") -> DataFrame:
    """One row: number, mean and sample variance of two groups."""
    g = df.where(F.col("grp").isin(a, b))
    side = lambda k, s: [F.count(F.when(F.col("grp") == k, F.col(value))).alias(f"n{s}"), F.avg(F.when(F.col("grp") == k, F.col(value))).alias(f"m{s}"), F.var_samp(F.when(F.col("grp") == k, F.col(value))).alias(f"v{s}")]
    return g.agg(*side(a, 1), *side(b, 2))


def t_test(df: DataFrame, a: str, b: str, value: str = "x", equal_var: bool = True) -> DataFrame:
    """One row: t, degrees of freedom, two-sided p, Cohen's d, and Welch's 95 % interval of the difference (either way); null where a group is missing or without spread."""
    s = two_groups(df, a, b, value).withColumn("pooled", F.expr("((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)"))
    welch_df = "pow(v1 / n1 + v2 / n2, 2) / nullif(pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1), 0)"
    error, df_ = ("sqrt(pooled * (1 / nullif(n1, 0) + 1 / nullif(n2, 0)))", "CAST(n1 + n2 - 2 AS DOUBLE)") if equal_var else ("sqrt(v1 / n1 + v2 / n2)", welch_df)
    s = s.withColumn("t", F.expr(f"(m1 - m2) / nullif({error}, 0)")).withColumn("df", F.expr(df_)).withColumn("w", F.expr(welch_df))
    half = f"{quantile('w')} * sqrt(v1 / n1 + v2 / n2)"
    return s.select(
        "t", "df", F.expr(student_p("t", "df")).alias("p"), F.expr("(m1 - m2) / nullif(sqrt(pooled), 0)").alias("d"),
        F.expr(f"m1 - m2 - {half}").alias("low"), F.expr(f"m1 - m2 + {half}").alias("high"),
    )


def quantile(df: str) -> str:
    """SQL of the 97.5 % point of Student's t, by its expansion about the normal point (1e-5 from 12 degrees of freedom on)."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return f"({z!r}D + " + " + ".join(f"{c!r}D / pow({df}, {k + 1})" for k, c in enumerate(terms)) + ")"


def average_rank(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Average ranks of tied values without ranking rows in one task.

    Values are counted first; the running count goes over the distinct values, by
    ranges where there is no key.
    """
    per = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    if not by:
        ranks = running(ranged(per, value), [value], "sum", _upto=F.col("_n")).select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))
        return df.join(ranks, value)
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = per.withColumn("rank", F.sum("_n").over(w) - (F.col("_n") - 1) / 2)
    return df.join(ranks.drop("_n"), [*by, value])


def mann_whitney(df: DataFrame, a: str, b: str, value: str = "x") -> DataFrame:
    """U, z, and the two-sided p and effect of z with the continuity correction; null where all values are equal."""
    g = df.where(F.col("grp").isin(a, b)).select("grp", value)
    per = g.groupBy(value).agg(F.count("*").alias("c"), F.count_if(F.col("grp") == a).alias("ca"))
    ranked = running(ranged(per, value), [value], "sum", upto=F.col("c")).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("ca")).alias("r"), F.sum("ca").cast("double").alias("n1"), F.sum("c").cast("double").alias("n"), F.sum(F.expr("CAST(c AS DOUBLE) * c * c - c")).alias("ties"))
    s = s.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.expr("r - n1 * (n1 + 1) / 2"))
    s = s.withColumn("sd", F.expr("sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))")).withColumn("z", F.expr("(u - n1 * n2 / 2) / nullif(sd, 0)"))
    s = s.withColumn("zc", F.expr("greatest(0D, abs(u - n1 * n2 / 2) - 0.5D) / nullif(sd, 0)"))
    return s.select("u", "z", F.expr(normal_p("zc")).alias("p"), (F.col("zc") / F.sqrt("n")).alias("effect"))


def wilcoxon(df: DataFrame, difference: Column) -> DataFrame:
    """Rank sums by sign without zeros, z with the correction for ties, two-sided p."""
    d = df.select(difference.alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    per = d.groupBy("m").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("pos"))
    ranked = running(ranged(per, "m"), ["m"], "sum", upto=F.col("c")).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    s = ranked.agg(
        F.sum(F.col("rank") * F.col("pos")).alias("plus"), F.sum(F.col("rank") * (F.col("c") - F.col("pos"))).alias("minus"), F.sum("c").alias("n"),
        F.sum(F.expr("CAST(c AS DOUBLE) * c * c - c")).alias("ties"),
    )
    z = "(plus - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24)"
    return s.withColumn("z", F.expr(z)).select("plus", "minus", "n", "z", F.expr(normal_p("z")).alias("p"))


def ks_two_sample(df: DataFrame, a: str, b: str, value: str = "x") -> DataFrame:
    """The largest gap of two distribution functions and its p in the limit of large groups; null where one is empty."""
    per = df.where(F.col("grp").isin(a, b)).groupBy(value).agg(F.count_if(F.col("grp") == a).alias("a"), F.count_if(F.col("grp") == b).alias("b"))
    run = running(ranged(per, value), [value], "sum", ra=F.col("a"), rb=F.col("b"))
    total = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    got = run.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.expr("ra / nullif(ta, 0) - rb / nullif(tb, 0)"))).alias("d"), F.max(F.col("ta").cast("double")).alias("n1"), F.max(F.col("tb").cast("double")).alias("n2"))
    return got.select("d", F.expr(kolmogorov_p("d", "n1", "n2")).alias("p"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    n = df.groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = df.groupBy(a).agg(F.count("*").alias("na")), df.groupBy(b).agg(F.count("*").alias("nb"))
    grid = ra.crossJoin(F.broadcast(rb)).crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))  # class margins
    return grid.join(n, [a, b], "left").select(a, b, F.coalesce("o", F.lit(0)).alias("o"), (F.col("na") * F.col("nb") / F.col("n")).alias("e"), "n")


def chi_square(cells: DataFrame, a: str, b: str) -> DataFrame:
    """One row from ``contingency``: chi2 (less a half per cell where df is 1), df, p and Cramer's V."""
    s = cells.agg(F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"), F.max("n").alias("n"), F.sum(F.expr("(o - e) * (o - e) / e")).alias("plain"), F.sum(F.expr("pow(abs(o - e) - least(0.5D, abs(o - e)), 2) / e")).alias("less"))
    s = s.withColumn("df", F.expr("(ka - 1) * (kb - 1)")).withColumn("chi2", F.expr("CASE WHEN df = 1 THEN less ELSE plain END"))
    return s.select("chi2", "df", F.expr(f"CASE WHEN df > 0 THEN {chi_square_p('chi2', 'df')} ELSE 1D END").alias("p"), F.expr("CASE WHEN df > 0 THEN sqrt(chi2 / (n * (least(ka, kb) - 1))) ELSE 0D END").alias("v"))


def log_gamma(x: str) -> str:
    """SQL of the logarithm of the gamma function for ``x`` >= 1: Stirling's series after seven steps up."""
    y = f"(CAST({x} AS DOUBLE) + 7)"
    steps = " * ".join(f"(CAST({x} AS DOUBLE) + {k})" for k in range(7))
    return f"(({y} - 0.5) * ln({y}) - {y} + {math.log(2 * math.pi) / 2!r} + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - ln({steps}))"


def fisher_exact(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Odds ratio and two-sided p of a table of two truth values: the sum of all tables with the same margins that are no likelier.

    The tables lie in rows of their own, so wide margins are summed by many tasks;
    those over 40 standard deviations from the mean add less than 1e-300.
    """
    n = df.agg(*[F.count_if(cell).alias(name) for name, cell in (("p", a & b), ("q", a & ~b), ("r", ~a & b), ("s", ~a & ~b))])
    n = n.selectExpr("*", "p + q AS row", "p + r AS col", "p + q + r + s AS n").selectExpr("*", "CAST(row AS DOUBLE) * col / nullif(n, 0) AS mean", "sqrt(CAST(row AS DOUBLE) * col / nullif(n, 0) * (n - row) / nullif(n, 0) * (n - col) / greatest(n - 1, 1)) AS sd")
    n = n.selectExpr("*", "greatest(0, row + col - n, CAST(floor(mean - 40 * sd - 2) AS BIGINT)) AS first", "least(row, col, CAST(ceil(mean + 40 * sd + 2) AS BIGINT)) AS last")
    weight = lambda k: f"-({' + '.join(log_gamma(f'({v} + 1)') for v in (k, f'row - {k}', f'col - {k}', f'n - row - col + {k}'))})"
    tables = n.withColumn("first", F.least("first", "p")).withColumn("k", F.explode(F.expr("sequence(first, greatest(last, p))"))).withColumn("w", F.expr(f"{weight('k')} - ({weight('p')})"))
    return tables.agg(F.expr("any_value(CAST(p AS DOUBLE) * s / nullif(CAST(q AS DOUBLE) * r, 0))").alias("odds"), (F.sum(F.expr("CASE WHEN w <= 1e-7 THEN exp(w) END")) / F.sum(F.expr("exp(w)"))).alias("pv")).select("odds", F.col("pv").alias("p"))


def adjust(p: DataFrame, method: str, alpha: float = 0.05) -> DataFrame:
    """``adjusted`` and ``rejected`` of ``p(id, p)``; the step-up method keeps a running maximum of ascending values.

    Ranks and running maxima go by ranges of (p, id), so no task sees the whole family.
    """
    size = p.agg(F.count("*").alias("m"))
    rows = p.crossJoin(F.broadcast(size))  # one row
    if method == "bonferroni":
        return rows.withColumn("adjusted", F.least(F.col("p") * F.col("m"), F.lit(1.0))).withColumn("rejected", F.col("adjusted") < alpha)
    if method == "sidak":
        return rows.withColumn("adjusted", 1 - F.pow(1 - F.col("p"), F.col("m"))).withColumn("rejected", F.col("p") <= 1 - F.pow(F.lit(1 - alpha), 1 / F.col("m")))
    order = ["p", "id"]
    rows = running(ranged(rows, *order), order, "sum", i=F.lit(1).cast("long"))
    if method == "holm":
        top = running(rows, order, "max", top=F.col("p") * (F.col("m") - F.col("i") + 1))
        return top.withColumn("adjusted", F.least("top", F.lit(1.0))).withColumn("rejected", F.col("adjusted") <= alpha)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, k: s + 1 / k) if method == "yekutieli" else F.lit(1.0)
    rows = rows.crossJoin(F.broadcast(size.select(harmonic.alias("h"))))
    last = rows.where(F.col("p") <= F.col("i") * alpha / F.col("m") / F.col("h")).agg(F.max("i").alias("last"))
    top = running(rows, order, "max", top=F.col("p") * F.col("m") / F.col("i")).crossJoin(F.broadcast(last))
    return top.withColumn("adjusted", F.least("top", F.lit(1.0))).withColumn("rejected", F.coalesce(F.col("i") <= F.col("last"), F.lit(False)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's matrix in long form from one pass."""
    got = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a in columns for b in columns if a < b], F.count("*").alias("n"))
    long = got.unpivot(["n"], [c for c in got.columns if c != "n"], "pair", "r")
    return long.select(F.split("pair", "~")[0].alias("a"), F.split("pair", "~")[1].alias("b"), "r", (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"), "n").select("a", "b", "r", "t", F.expr(student_p("t", "(n - 2)")).alias("p"))


#: Ranges that values are counted in at a time, and distinct values that are looked at one by one.
RANGES, LOOKED_AT = 4096, 20_000


def order_statistics(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at zero-based ``ranks`` of the finite non-null ones, by counting in ranges that narrow about each rank.

    A round counts equal ranges of what is left with partial sums in every task, so no
    task gets all rows; ``RANGES`` counts, and at the end at most ``LOOKED_AT`` counted
    values, come to the driver. Ranges that no longer divide hold one value.
    """
    x = saved(df.select(value.cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)"), "values")
    ends = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    found: dict[int, float] = {}
    for rank in sorted(set(ranks)):
        low, high, before, n = ends["low"], ends["high"], 0, ends["n"]
        while n > LOOKED_AT and low < high:
            width = (high - low) / RANGES
            if low + width <= low or high - width >= high:
                break
            place = F.least(F.floor((F.col("x") - low) / width), F.lit(RANGES - 1))
            counts = {r["k"]: (r["n"], r["low"], r["high"]) for r in x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(place.alias("k")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
            for k in sorted(counts):
                n, low, high = counts[k]
                if before + n > rank:
                    break
                before += n
        for r in x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").toLocalIterator():
            if before + r["n"] > rank:
                found[rank] = r["x"]
                break
            before += r["n"]
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Quantiles between neighbouring ranks; null where there are no values."""
    n = df.agg(F.count(F.when(~F.isnan(value.cast("double")), value))).first()[0]
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    low = [min(int(math.floor(a)), n - 1) for a in at]
    got = order_statistics(df, value, [*low, *[min(k + 1, n - 1) for k in low]])
    return [a + (b - a) * (p - k) for a, b, p, k in zip(got[: len(low)], got[len(low) :], at, low, strict=True)]


def outlier_flags(df: DataFrame, value: str, z: float = 1.959963984540054, kinds: tuple[str, ...] = ("iqr", "z", "mad")) -> DataFrame:
    """``df`` with the flags ``by_iqr`` (quartiles), ``by_z`` and ``by_mad`` (median absolute deviation) that are asked for."""
    x, flags = F.col(value), {}
    if "iqr" in kinds or "mad" in kinds:
        low, middle, high = (F.lit(q).cast("double") for q in quantiles(df, x, [0.25, 0.5, 0.75]))
    if "iqr" in kinds:
        flags["by_iqr"] = (x < low - 1.5 * (high - low)) | (x > high + 1.5 * (high - low))
    if "z" in kinds:
        m = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
        flags["by_z"] = F.abs((x - F.lit(m["m"]).cast("double")) / F.lit(m["s"]).cast("double")) > z
    if "mad" in kinds:
        (mad,) = quantiles(df, F.abs(x - middle), [0.5])
        flags["by_mad"] = F.abs(0.6745 * (x - middle) / F.lit(mad).cast("double")) > 3.5
    return df.select(*df.columns, *[c.alias(k) for k, c in flags.items()])


def moments(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.99)))).alias("q"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
