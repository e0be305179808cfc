"""Quality rules: text statistics and a learned decision list, all in DataFrame functions.

``statistics`` counts words, symbols, repeated lines and words in repeated three-word
windows. ``learn`` grows an ordered list of rules by sequential covering: a rule is a
conjunction of thresholds on the statistics, grown condition by condition for the
best gain on two thirds of the labelled rows and pruned on the last third; rows it
covers leave, and the next rule is grown. All counts are ``groupBy`` jobs on binned
statistics. ``verdict`` emits the list as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, cut

#: Labelled documents that the rules are learned from: those of the least crc32(doc_id).
FIT_ROWS = 6000
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_COVER = 8
#: Share of rejected rows of the pruning third that must be labelled bad.
MIN_PRECISION = 0.9

#: Different repeated windows up to which they are looked up one by one.
FEW_REPEATS = 12
#: Statistics that rules may use, as shares so that they do not depend on length.
FEATURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / n_words",
    "bangs_per_word": "n_bangs / n_words",
    "upper_share": "n_upper / word_chars",
    "chars_per_word": "word_chars / n_words",
    "distinct_share": "n_windows / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return F.coalesce(x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold), F.lit(False))


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` and the counts that rules use.

    A null text is as an empty one: all counts 0, ``base_failed`` true. Columns of
    these names in the input are replaced, all others stay. Words in repeated windows are counted once
    each, however many windows they lie in.
    """
    docs, named = apart(docs, OWN)
    names = [c for c in docs.columns if c.lower() not in STATISTICS]
    text = F.coalesce(F.col("text"), F.lit(""))
    # one split at single spaces after the other white space has become spaces
    words = F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")
    split = docs.select(*names, text.alias("_text"), words.alias("_words"))
    windows = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    counted = split.withColumn("_windows", windows).withColumn("_n_windows", F.size(F.array_distinct("_windows")))
    sorted_windows = F.when(F.size("_windows") > F.col("_n_windows"), F.sort_array("_windows"))
    ordered = counted.withColumn("_sorted", sorted_windows)
    twice = F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (F.get("_sorted", F.greatest(i - 1, F.lit(0))) == x)))
    marked = ordered.withColumn("_twice", twice)
    # few different repeated windows: look each window up; many: sort windows with their places
    few = F.filter(F.transform("_windows", lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull())
    runs = F.when(F.size("_twice") > FEW_REPEATS, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))
    placed = marked.withColumn("_runs", runs)
    many = F.transform(
        F.filter(
            "_runs",
            lambda p, i: ((i > 0) & (F.get("_runs", F.greatest(i - 1, F.lit(0)))["h"] == p["h"])) | F.coalesce(F.get("_runs", i + 1)["h"] == p["h"], F.lit(False)),
        ),
        lambda p: p["at"],
    )
    starts = F.when(F.col("_twice").isNull(), F.array().cast("array<int>")).when(F.col("_runs").isNull(), few).otherwise(many)
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    final = placed.withColumn("_lines", lines)
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("_n_windows").cast("long").alias("n_windows"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    # explode of one struct: filters on the counts stay above it instead of being
    # pushed down as copies of the expressions, which would count once for each use
    out = final.select(*names, F.explode(F.array(counts)).alias("_counts")).select(*names, "_counts.*")
    return named(out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))


OWN = {"_counts", "_lines", "_n_windows", "_runs", "_sorted", "_text", "_twice", "_windows", "_words"}
STATISTICS = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_windows", "n_bangs", "n_upper", "base_failed"}


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """The ordered rules that reject, learned from ``labels(doc_id, quality)``; none where labels have one kind only."""
    code = F.crc32(F.col("doc_id").cast("string"))
    sample = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
        .withColumn("fold", code % 3).orderBy(code, "doc_id").limit(rows)
    )
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).where("not base_failed")
    known = cut(known.select("bad", "fold", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]), "rules").coalesce(4).cache()
    try:
        quantiles = [i / BINS for i in range(BINS + 1)]
        got = known.groupBy("bad").agg(*[F.percentile_approx(f, F.array(*map(F.lit, quantiles)), 10000).alias(f) for f in FEATURES]).collect()
        steps = {f: _between([x for r in got for x in r[f] or []]) for f in FEATURES}
        rules: list[Rule] = []
        left = known
        while len(rules) < MAX_RULES:
            rule = _prune(left, _grow(left.where("fold <> 0"), steps))
            if not rule:
                break
            rules.append(rule)
            left = left.where(~_holds(rule, plain=True))
        return rules
    finally:
        known.unpersist()


def _between(values: list[float]) -> list[float]:
    """Thresholds half-way between neighbouring distinct values."""
    v = sorted(set(values))
    return [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]


def _plain(c: Condition) -> Column:
    x = F.col(c.feature)
    return F.coalesce(x > c.threshold if c.above else x <= c.threshold, F.lit(False))


def _holds(rule: Rule, plain: bool = False) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & (_plain(c) if plain else c.column())
    return out


def _grow(rows: DataFrame, steps: dict[str, list[float]]) -> Rule:
    """Conditions added one by one for the best gain in information on bad rows."""
    rule: Rule = ()
    if not any(steps.values()):
        return rule
    for _ in range(MAX_CONDITIONS):
        inside = rows.where(_holds(rule, plain=True))
        places = F.array(*[
            F.struct(F.lit(f).alias("feature"), sum((F.when(F.col(f) > t, 1).otherwise(0) for t in cuts), F.lit(0)).alias("bin"))
            for f, cuts in steps.items() if cuts
        ])
        got = (
            inside.select("bad", F.explode(places).alias("p")).groupBy("p.feature", "p.bin")
            .agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        )
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for r in got:
            counts.setdefault(r["feature"], {})[r["bin"]] = (r["bad"], r["good"])
        if not counts:
            return rule
        some = next(iter(counts.values())).values()
        bad, good = sum(x[0] for x in some), sum(x[1] for x in some)
        if not bad or not good:
            return rule
        now, best, ties = math.log2(bad / (bad + good)), 1e-9, []
        for feature in sorted(counts):
            b = g = 0
            for i, threshold in enumerate(steps[feature]):
                at = counts[feature].get(i, (0, 0))
                b, g = b + at[0], g + at[1]
                for above, pb, pg in ((False, b, g), (True, bad - b, good - g)):
                    if pb >= MIN_COVER:
                        gain = pb * (math.log2(pb / (pb + pg)) - now)
                        if gain > best + 1e-9:
                            best, ties = gain, []
                        if gain >= best - 1e-9 and (not ties or (ties[0].feature, ties[0].above) == (feature, above)):
                            ties.append(Condition(feature, above, float(threshold)))
        if not ties:
            return rule
        rule = (*rule, ties[len(ties) // 2])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The beginning of the rule that does best on the pruning third; none if too few or too mixed rows are covered."""
    if not rule:
        return ()
    held = rows.where("fold = 0")
    ks = range(1, len(rule) + 1)
    got = held.agg(*[F.count_if(_holds(rule[:k], plain=True) & (F.col("bad") == b)).alias(f"{n}{k}") for k in ks for n, b in (("b", True), ("g", False))]).first()
    value = {k: (got[f"b{k}"] - got[f"g{k}"]) / max(1, got[f"b{k}"] + got[f"g{k}"]) for k in ks}
    k = max(ks, key=lambda k: (value[k], -k))
    bad, good = got[f"b{k}"], got[f"g{k}"]
    return rule[:k] if bad >= max(2, MIN_COVER // 2) and bad >= MIN_PRECISION * (bad + good) else ()


def verdict(rules: list[Rule]) -> Column:
    """``true`` keeps: the first rule that holds rejects, else the row is kept."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule), False) if out is None else out.when(_holds(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``statistics`` with ``kept``: false where ``base_failed``, else the decision list's verdict; an input column of that name is replaced."""
    return statistics(docs.drop("kept")).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones; the columns stay as they are."""
    names = docs.columns
    renamed = docs.select(*[F.col(c).alias(f"_in_{c}") for c in names], F.col("text").alias("text"), F.col("doc_id").alias("doc_id"))
    return judge(renamed, learn(docs, labels)).where("kept").select(*[F.col(f"_in_{c}").alias(c) for c in names])
