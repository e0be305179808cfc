"""Queries on hypothesis tests: statistic, two-sided p-value and effect of two groups or of a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..sources.tables import Tables
from .registry import register


def rounded(df: DataFrame, *columns: str, n: int = 5) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) for c in columns])


#: DuckDB: two-sided p-values by Simpson's rule on the densities themselves.
MACROS = {
    "normal": "greatest(0, 1 - 2 * {z} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow({z} * i / 2000, 2)))) / sqrt(2 * pi()))",
    "student": """greatest(0, 1 - 2 * {t} / 6000 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())
        * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * pow(1 + pow({t} * i / 2000, 2) / {df}, -({df} + 1) / 2))))""",
}


def normal_sql(z: str) -> str:
    return MACROS["normal"].format(z=f"least(abs({z}), 40)")


def student_sql(t: str, df: str) -> str:
    return MACROS["student"].format(t=f"least(abs({t}), 60)", df=df)


GROUPS = """
    SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled,
        v1 / n1 + v2 / n2 AS e2,
        pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS w
    FROM (SELECT count(x) FILTER (grp = 'A') AS n1, avg(x) FILTER (grp = 'A') AS m1, var_samp(x) FILTER (grp = 'A') AS v1,
        count(x) FILTER (grp = 'R') AS n2, avg(x) FILTER (grp = 'R') AS m2, var_samp(x) FILTER (grp = 'R') AS v2 FROM samples)"""
_Z = 1.959963984540054
QUANTILE = f"({_Z} + {(_Z**3 + _Z) / 4} / w + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / pow(w, 2) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / pow(w, 3))"


def t_sql(t: str, df: str) -> str:
    return f"""WITH g AS ({GROUPS}), s AS (SELECT *, {t} AS t, {df} AS df FROM g)
        SELECT round(t, 4) AS t, round(df, 4) AS df, round({student_sql('t', 'df')}, 5) AS p, round((m1 - m2) / sqrt(pooled), 4) AS d,
            round(m1 - m2 - {QUANTILE} * sqrt(e2), 4) AS low, round(m1 - m2 + {QUANTILE} * sqrt(e2), 4) AS high FROM s"""


def t_query(equal_var: bool):
    def query(t: Tables) -> DataFrame:
        got = S.t_test(t.samples, "A", "R", equal_var=equal_var)
        return got.select(*[F.round(c, 5 if c == "p" else 4).alias(c) for c in got.columns])

    return query


POOLED_T = "(m1 - m2) / sqrt(pooled * (1 / n1 + 1 / n2))"
register("t_test", t_query(True), t_sql(POOLED_T, "CAST(n1 + n2 - 2 AS DOUBLE)"))
register("t_test_welch", t_query(False), t_sql("(m1 - m2) / sqrt(e2)", "w"))

RANKS = """
    p AS (SELECT x, count(*) AS c, count(*) FILTER (grp = 'A') AS ca FROM samples WHERE grp IN ('A', 'R') GROUP BY 1),
    r AS (SELECT *, sum(c) OVER (ORDER BY x) - (c - 1) / 2 AS rk FROM p),
    s AS (SELECT sum(rk * ca) AS r, CAST(sum(ca) AS DOUBLE) AS n1, CAST(sum(c) AS DOUBLE) AS n, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM r),
    u AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2 AS u FROM s),
    z AS (SELECT *, sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd, u - n1 * n2 / 2 AS off FROM u)"""


def mann_whitney(t: Tables) -> DataFrame:
    return rounded(S.mann_whitney(t.samples, "A", "R"), "u", "z", "p", "effect")


register("mann_whitney", mann_whitney, f"""WITH {RANKS}, c AS (SELECT *, greatest(0, abs(off) - 0.5) / sd AS zc FROM z)
    SELECT round(u, 5) AS u, round(off / sd, 5) AS z, round({normal_sql('zc')}, 5) AS p, round(zc / sqrt(n), 5) AS effect FROM c""")


def wilcoxon(t: Tables) -> DataFrame:
    got = S.wilcoxon(t.samples, F.round(F.col("d") * 100 - F.col("t") * 100, 0))
    return got.select("n", *[F.round(c, 5).alias(c) for c in ("plus", "minus", "z", "p")])


register("wilcoxon", wilcoxon, f"""WITH d AS (SELECT round(d * 100 - t * 100, 0) AS d FROM samples),
    p AS (SELECT abs(d) AS m, count(*) AS c, count(*) FILTER (d > 0) AS pos FROM d WHERE d <> 0 GROUP BY 1),
    r AS (SELECT *, sum(c) OVER (ORDER BY m) - (c - 1) / 2 AS rk FROM p),
    s AS (SELECT sum(rk * pos) AS plus, sum(rk * (c - pos)) AS minus, CAST(sum(c) AS DOUBLE) AS n, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM r),
    z AS (SELECT *, (plus - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s)
    SELECT round(plus, 5) AS plus, round(minus, 5) AS minus, CAST(n AS BIGINT) AS n, round(z, 5) AS z, round({normal_sql('z')}, 5) AS p FROM z""")


def ks_sql(value: str) -> str:
    return f"""
        SELECT max(abs(ra / ta - rb / tb)) AS d, CAST(max(ta) AS DOUBLE) * max(tb) / (max(ta) + max(tb)) AS m
        FROM (SELECT sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb, sum(a) OVER () AS ta, sum(b) OVER () AS tb
            FROM (SELECT {value} AS v, count(*) FILTER (grp = 'A') AS a, count(*) FILTER (grp = 'R') AS b FROM samples WHERE grp IN ('A', 'R') GROUP BY 1))"""


KOLMOGOROV = """CASE WHEN d * d * m < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * d * d * m))))) END"""


def ks_two_sample(t: Tables) -> DataFrame:
    return rounded(S.ks_two_sample(t.samples, "A", "R", "y"), "d", "p")


register("ks_two_sample", ks_two_sample, f"SELECT round(d, 5) AS d, round({KOLMOGOROV}, 5) AS p FROM ({ks_sql('y')})")


def chi_square(t: Tables) -> DataFrame:
    cells = S.contingency(t.lineitem.selectExpr("l_returnflag AS a", "l_linestatus AS b"), "a", "b")
    return S.chi_square(cells, "a", "b").select(F.round("chi2", 5).alias("chi2"), "df", F.round("p", 5).alias("p"), F.round("v", 5).alias("v"))


# three flags by two states: two degrees of freedom, whose tail is exp(-x / 2)
register("chi_square", chi_square, """WITH q AS (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem),
    o AS (SELECT a, b, count(*) AS o FROM q GROUP BY 1, 2),
    e AS (SELECT a, b, na * nb / (SELECT count(*) FROM q) AS e FROM (SELECT a, count(*) AS na FROM q GROUP BY 1), (SELECT b, count(*) AS nb FROM q GROUP BY 1)),
    j AS (SELECT e.a, e.b, coalesce(o, 0) AS o, e FROM e LEFT JOIN o ON e.a = o.a AND e.b = o.b),
    s AS (SELECT sum((o - e) * (o - e) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, sum(o) AS n FROM j)
    SELECT round(chi2, 5) AS chi2, df, round(CASE df WHEN 2 THEN exp(-chi2 / 2) END, 5) AS p, round(sqrt(chi2 / n), 5) AS v FROM s""")


def fisher_exact(t: Tables) -> DataFrame:
    return rounded(S.fisher_exact(t.labels, F.col("quality") == 1, F.col("toxic") == 1), "odds", "p", n=6)


register("fisher_exact", fisher_exact, """WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS p, count(*) FILTER (quality = 1 AND toxic <> 1) AS q,
        count(*) FILTER (quality <> 1 AND toxic = 1) AS r, count(*) FILTER (quality <> 1 AND toxic <> 1) AS s FROM labels),
    m AS (SELECT *, p + q AS a, p + r AS b, p + q + r + s AS n FROM n),
    k AS (SELECT *, unnest(range(greatest(0, a + b - n), least(a, b) + 1)) AS k FROM m),
    w AS (SELECT *, -(lgamma(k + 1) + lgamma(a - k + 1) + lgamma(b - k + 1) + lgamma(n - a - b + k + 1))
        + lgamma(p + 1) + lgamma(q + 1) + lgamma(r + 1) + lgamma(s + 1) AS w FROM k)
    SELECT round(any_value(p * s / (q * r)), 6) AS odds, round(sum(exp(w)) FILTER (w <= 1e-7) / sum(exp(w)), 6) AS p FROM w""")


def battery(t: Tables) -> DataFrame:
    """The tests of two groups in one report: name, statistic, p."""
    parts = [("t", S.t_test(t.samples, "A", "R"), "t"), ("ks", S.ks_two_sample(t.samples, "A", "R"), "d"), ("mw", S.mann_whitney(t.samples, "A", "R"), "z")]
    rows = [df.select(F.lit(name).alias("test"), F.round(value, 5).alias("value"), F.round("p", 5).alias("p")) for name, df, value in parts]
    return rows[0].union(rows[1]).union(rows[2])


register("test_battery", battery, f"""WITH {RANKS}, c AS (SELECT off / sd AS z, greatest(0, abs(off) - 0.5) / sd AS zc FROM z),
    g AS ({GROUPS}), s2 AS (SELECT {POOLED_T} AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM g), k AS ({ks_sql('x')})
    SELECT 'mw' AS test, round(z, 5) AS value, round({normal_sql('zc')}, 5) AS p FROM c
    UNION ALL SELECT 't', round(t, 5), round({student_sql('t', 'df')}, 5) FROM s2
    UNION ALL SELECT 'ks', round(d, 5), round({KOLMOGOROV}, 5) FROM k""")

MEASURES = ["x", "y", "d", "t"]
PAIRS = [(a, b) for a in MEASURES for b in MEASURES if a < b]
PEARSON = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM samples" for a, b in PAIRS)
PEARSON_T = f"SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({PEARSON})"


def pearson(t: Tables) -> DataFrame:
    return S.correlations(t.samples, MEASURES).select("a", "b", F.round("r", 5).alias("r"), F.round("t", 3).alias("t"), F.round("p", 5).alias("p"))


def strong_pairs(t: Tables) -> DataFrame:
    return S.correlations(t.samples, MEASURES).where("abs(r) >= 0.7").select("a", "b", F.round("r", 5).alias("r"))


def spearman(t: Tables) -> DataFrame:
    ranks = S.average_rank(S.average_rank(t.samples, "x").withColumnRenamed("rank", "rx"), "d")
    got = ranks.agg(F.corr("rx", "rank").alias("r"), F.count("*").alias("n")).withColumn("t", F.expr("r * sqrt((n - 2) / (1 - r * r))"))
    return got.select(F.round("r", 5).alias("r"), F.round(F.expr(S.student_p("t", "(n - 2)")), 5).alias("p"))


register("correlation_pearson", pearson, f"SELECT a, b, round(r, 5) AS r, round(t, 3) AS t, round({student_sql('t', '(n - 2)')}, 5) AS p FROM ({PEARSON_T})")
register("correlation_strong_pairs", strong_pairs, f"SELECT a, b, round(r, 5) AS r FROM ({PEARSON}) WHERE abs(r) >= 0.7")
register("correlation_spearman", spearman, f"""WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
        rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS rd FROM samples),
    c AS (SELECT corr(rx, rd) AS r, count(*) AS n FROM r), s AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
    SELECT round(r, 5) AS r, round({student_sql('t', '(n - 2)')}, 5) AS p FROM s""")
