"""Toxicity by maximum-scoring segments.

Units are words and their prefixes of 4 to 6 letters. Each unit's log-odds between
toxic and other labelled documents has an informative Dirichlet prior (proportional
to the unit's share of both), and only units whose log-odds stand ``MIN_Z`` standard
errors and ``MIN_ODDS`` from zero are kept. A word scores the log-odds of its longest kept unit, any
other word a small negative drift. One linear scan finds all maximal-scoring
segments of a document (the stack algorithm for all maximal scoring subsequences).
A segment's score S in n words has the extreme-value expectation
``E = n * exp(-lambda * S)`` with lambda solved from the scores of words in
documents that are not toxic; segments with ``E < E_VALUE`` are toxic passages.
A logistic curve over the evidence of the strongest passage, of all passages and
their number gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut

#: Labelled documents that the model is fitted on: those of the least crc32(doc_id).
FIT_ROWS = 8000
#: Units kept at most, by |z|.
LEXICON = 5000
PREFIXES = (6, 5, 4)
MIN_Z = 3.0
MIN_ODDS = 3.0
MIN_DOCS = 5
PRIOR_SHARE = 0.1
DRIFT = -0.5
CLIP = 6.0
E_VALUE = 0.01
CACHE_WORDS = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    weights: tuple[float, ...] = (-8.0, 0.0, 0.0, 0.0)


def units(text: str | None) -> set[str]:
    """Words ``w:`` and prefixes ``4:``, ``5:``, ``6:`` of a text, each once."""
    out: set[str] = set()
    for word in set(_LETTERS.findall((text or "").lower())):
        out.add("w:" + word)
        out.update(f"{k}:{word[:k]}" for k in PREFIXES if len(word) >= k)
    return out


class Scorer:
    """Word scores under a model, with the words seen kept."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.seen = lexicon, {}

    def word(self, piece: str) -> float:
        best = DRIFT
        for word in _LETTERS.findall(piece.lower()):
            for name in ("w:" + word, *(f"{k}:{word[:k]}" for k in PREFIXES if len(word) >= k)):
                if name in self.lexicon:
                    best = max(best, self.lexicon[name])
                    break
        return best

    def words(self, text: str) -> list[float]:
        seen, out = self.seen, []
        for piece in text.split():
            s = seen.get(piece)
            if s is None:
                s = self.word(piece)
                if len(piece) < 60:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen[piece] = s
            out.append(s)
        return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, end exclusive, in one pass."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        now = (i, i + 1, before, total)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= now[2]:
                j -= 1
            if j < 0 or kept[j][3] >= now[3]:
                kept.append(now)
                break
            now = (kept[j][0], now[1], kept[j][2], now[3])
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r in kept]


def passages(scores: list[float], rate: float) -> list[tuple[int, int, float]]:
    """Significant segments ``(start, end, evidence)``; evidence is ``-ln E``."""
    if not scores or max(scores) <= 0:
        return []
    n = math.log(len(scores))
    found = [(a, b, rate * s - n) for a, b, s in maximal_segments(scores)]
    return [x for x in found if x[2] > -math.log(E_VALUE)]


def evidence(found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Of the strongest passage, of all, and how many there are."""
    if not found:
        return 0.0, 0.0, 0.0
    return min(max(x[2] for x in found), 60.0), math.log1p(sum(x[2] for x in found)), math.log1p(len(found))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``(toxic, text)`` of at most ``rows`` labelled documents outside the held-out fifth."""
    code = F.crc32(F.col("doc_id").cast("string"))
    sample = (
        labels.where("toxic is not null and doc_id is not null").where(code % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(code, "doc_id").limit(rows)
    )
    return cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Lexicon, rate of the extreme-value law and the logistic curve, from ``labelled`` rows.

    Without labelled rows of both kinds the model finds nothing.
    """
    sample = labelled(docs, labels, rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                for u in units(text):
                    tally.setdefault(u, [0, 0])[toxic] += 1
        yield pd.DataFrame([(u, a, b) for u, (a, b) in tally.items()], columns=["unit", "y0", "y1"])

    counts = sample.mapInPandas(count, "unit string, y0 long, y1 long").groupBy("unit").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    counts = cut(counts, "units")
    n0, n1 = (x or 0 for x in counts.agg(F.sum("y0"), F.sum("y1")).first())
    if not n0 or not n1:
        return Model()
    mass = PRIOR_SHARE * (n0 + n1)
    prior = F.lit(PRIOR_SHARE) * (F.col("y0") + F.col("y1"))
    a1, a0 = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a1 / (n1 + mass - a1)) - F.log(a0 / (n0 + mass - a0))
    best = (
        counts.where(F.col("y0") + F.col("y1") >= MIN_DOCS)
        .select("unit", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
        .where((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS)).orderBy(F.abs("z").desc(), "unit").limit(LEXICON)
    )
    lexicon = {r["unit"]: max(-CLIP, min(CLIP, r["odds"])) for r in best.collect()}

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        tally: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                if not toxic:
                    tally.update(round(s, 1) for s in scorer.words(text or ""))
        yield pd.DataFrame(list(tally.items()), columns=["s", "n"])

    law = [(r["s"], r["n"]) for r in sample.mapInPandas(profile, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()]
    rate = _rate(law, max([1.0, *lexicon.values()]))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for batch in batches:
            rows = [(int(t), *evidence(passages(scorer.words(text or ""), rate))) for t, text in zip(batch["toxic"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["toxic", "f1", "f2", "f3"])

    x = np.array([tuple(r) for r in sample.mapInPandas(features, "toxic int, f1 double, f2 double, f3 double").collect()])
    return Model(lexicon, rate, _logistic(x[:, 1:], x[:, 0]))


def _rate(law: list[tuple[float, int]], highest: float) -> float:
    """The positive root of ``sum p(s) exp(rate * s) = 1``; one pseudo-word has the lexicon's highest score."""
    s = np.array([x[0] for x in law] + [highest])
    p = np.array([x[1] for x in law] + [1], float)
    p /= p.sum()
    low, high = 1e-6, 50.0
    if (p * s).sum() >= 0:
        return low
    for _ in range(100):
        mid = (low + high) / 2
        if (p * np.exp(np.minimum(mid * s, 600))).sum() > 1:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights with the intercept first, by Newton steps on the ridge-penalised likelihood."""
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack((np.ones(len(x)), x / scale))
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(float(v) for v in w[1:] / scale))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` double in 0..1, ``predicted`` int and ``passages`` (word ranges and evidence).

    Only the text is read. A null, empty or wordless text has no passage and the
    score of none; rows that repeat an id are scored each; an empty table gives none.
    """
    clash = [c for c in ("score", "predicted", "passages") if c in docs.columns]
    docs, named = apart(docs.drop(*clash), {"_judged"})
    lexicon, rate, weights = model.lexicon, model.rate, model.weights
    kind = "struct<score:double,passages:array<struct<start:int,end:int,evidence:double>>>"

    @F.pandas_udf(kind)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for batch in texts:
            scores, spans = [], []
            for text in batch:
                found = passages(scorer.words(text), rate) if text else []
                z = weights[0] + sum(w * f for w, f in zip(weights[1:], evidence(found), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                spans.append([{"start": a, "end": b, "evidence": e} for a, b, e in found])
            yield pd.DataFrame({"score": scores, "passages": spans})

    return named(
        docs.withColumn("_judged", judged("text"))
        .withColumn("score", F.col("_judged.score")).withColumn("predicted", (F.col("_judged.score") >= 0.5).cast("int"))
        .withColumn("passages", F.col("_judged.passages")).drop("_judged")
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the fitted model calls toxic; all columns stay as they are, also those named like the model's."""
    names = docs.columns
    held = docs.select(F.struct(*names).alias("_in"), F.col("text").alias("text"))
    return score(held, fit(docs, labels)).where("predicted = 0").select(*[F.col("_in")[c].alias(c) for c in names])
