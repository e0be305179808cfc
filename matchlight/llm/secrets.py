"""Secrets by patterns and a randomness test battery, all in DataFrame functions.

Patterns find assignments, access keys and long hexadecimal runs. Every run of 16 or
more characters of base-64 kind with a letter and a digit is a candidate, within and
outside those. Its encoding is inferred (hexadecimal, base 32, base 64) and three tests
ask whether it can be uniform noise in that alphabet: chi-squared on symbol counts, runs
above and below the middle of the alphabet, and serial correlation; their squared
normal scores add up to the battery's p-value.

Two false-discovery controls (Benjamini-Hochberg) run over all candidates of the
corpus, each within classes of length (16, 32, 64, ... characters), since a short token
tells less. The first is on the battery's p-values: at ``REJECT``, what it finds is not
noise and goes. The second asks whether the rest may be *ordinary text* of that length:
its p-value is bounded by ``exp(-L)`` (Markov's inequality), L being the log-likelihood
ratio of uniform noise to the corpus's character classes; at ``LEVEL``, what it finds
is random. Such candidates become ``random`` spans, or confirm the rules' spans that
they overlap. Texts are read once: what both controls need is kept for each candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: False-discovery levels: of tokens thrown out as not noise, and of tokens found random.
REJECT, LEVEL = 0.05, 0.01
#: Bins of L and of -10 log10(p); the last holds all above.
MAX_L, MAX_P = 400, 300
CLASSES = {"lower": ("[a-z]", 26), "upper": ("[A-Z]", 26), "digit": ("[0-9]", 10), "other": ("[+/_-]", 4)}


def _places(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of ``(start, end, n, m)`` of the leftmost matches: code points, length of ``group``, the match.

    The matches and the texts between them alternate, so starts are sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else F.transform(matches, F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    rows = F.arrays_zip(gaps.alias("gap"), matches.alias("m"), inner.alias("n"))
    empty = F.array().cast("array<struct<start:int,end:int,n:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["n"].alias("n"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out")))

    def placed(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    # in parts of the root of their number, as appending copies: each part from 0, then moved by the lengths of those before
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(rows))).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), F.size(rows), width), lambda k: placed(F.slice(rows, k, width)))
    moved = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,n:int,m:string>>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["at"]).alias("at"),
            F.array_append(acc["out"], F.transform(p["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["n"].alias("n"), x["m"].alias("m")))).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(text.rlike(pattern), moved).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(N > z), by the tanh approximation."""
    return (1 - F.tanh(F.lit(math.sqrt(2 / math.pi)) * (z + 0.044715 * z * z * z))) / 2


def _cube_root_score(x: Column, df: Column) -> Column:
    """The normal score of a chi-squared value (Wilson and Hilferty)."""
    return (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def _tests(token: Column) -> Column:
    """Of a candidate: the battery's p-value as noise, the size of its alphabet and its characters by class."""
    alphabet = (
        F.when(token.rlike("^[0-9a-f]+$"), DIGIT + LOWER[:6]).when(token.rlike("^[0-9A-F]+$"), DIGIT + UPPER[:6])
        .when(token.rlike("^[A-Z2-7]+=*$"), UPPER + "234567").otherwise(UPPER + LOWER + DIGIT + "+/")
    )
    body = F.translate(F.rtrim(token, F.lit("=")), "-_=", "+//")
    # bound in turn through one-element arrays, so that each is worked out once a token
    bound = F.struct(
        F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c) - 1).alias("codes"),
        F.char_length(alphabet).cast("double").alias("size"), F.char_length(body).cast("double").alias("n"),
    )

    def scores(b: Column) -> Column:
        codes, size, n = b["codes"], b["size"], b["n"]
        squares = F.aggregate(
            F.transform(F.array_distinct(codes), lambda k: F.size(F.filter(codes, lambda c: c == k)).cast("double")), F.lit(0.0), lambda a, x: a + x * x
        )
        chi = _cube_root_score(F.greatest(size / n * squares - n, F.lit(0.0)), size - 1)
        high = F.transform(codes, lambda c: (c * 2 >= size).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
        n0 = n - n1
        runs = 1 + F.aggregate(
            F.transform(high, lambda x, i: F.when((i > 0) & (x != F.get(high, F.greatest(i - 1, F.lit(0)))), 1).otherwise(0)), F.lit(0), lambda a, x: a + x
        )
        mean = 2 * n1 * n0 / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-6))
        run_score = (runs - mean) / F.sqrt(spread)
        middle = (size - 1) / 2
        lagged = F.aggregate(
            F.transform(codes, lambda c, i: F.when(i > 0, (c - middle) * (F.get(codes, F.greatest(i - 1, F.lit(0))) - middle)).otherwise(0.0)),
            F.lit(0.0), lambda a, x: a + x,
        )
        serial = lagged / (F.sqrt(n - 1) * (size * size - 1) / 12)
        total = F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2)) + run_score * run_score + serial * serial
        counts = [F.regexp_count(token, F.lit(pattern)).alias(k) for k, (pattern, _) in CLASSES.items()]
        return F.struct(_normal_tail(_cube_root_score(total, F.lit(3.0))).alias("p"), size.alias("size"), n.alias("n"), *counts)

    return F.get(F.transform(F.array(bound), scores), F.lit(0))


def _candidates(text: Column) -> Column:
    tokens = F.filter(_places(text, CANDIDATE), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike("^=*$"))
    return F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _tests(x["m"]).alias("t")))


def _rules(text: Column) -> Column:
    as_kind = lambda a, k: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    return F.sort_array(F.concat(
        as_kind(F.filter(_places(text, ASSIGN, 1), lambda x: x["n"] >= 12), 0), as_kind(_places(text, ACCESS), 1), as_kind(_places(text, HEX), 2)
    ))


@dataclass(frozen=True)
class Limits:
    """What the corpus fixes: the share of one character of each class, and by class of length the least L and the bin of p from which a token is not noise."""

    shares: dict[str, float]
    least: dict[int, int]
    reject: dict[int, int]


def _length_class(t: Column) -> Column:
    return F.floor(F.log2(t["n"])).cast("int")


def _p_bin(t: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(F.greatest(t["p"], F.lit(1e-40)))), F.lit(MAX_P)).cast("int")


def _ratio(t: Column, shares: dict[str, float]) -> Column:
    return sum((t[k] * (-F.log(t["size"]) - F.lit(math.log(shares[k]))) for k in CLASSES), F.lit(0.0))


def _looked_up(table: dict[int, int], key: Column, missing: int) -> Column:
    if not table:
        return F.lit(missing)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key), F.lit(missing))


def _least_bins(counts: list[tuple[int, int, int]], level: float, bound: Callable[[int], float]) -> dict[int, int]:
    """By class of length, the least bin that Benjamini-Hochberg accepts; ``bound`` is the largest p-value in a bin. ``counts`` has class, bin, number."""
    out = {}
    for kind in {c for c, _, _ in counts}:
        bins = sorted(((b, n) for c, b, n in counts if c == kind), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if total * bound(b) <= level * above:
                out[kind] = b
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rules``, ``_found`` (candidates and their tests) and ``_chars`` (characters by class), in one reading of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.struct(F.char_length(text).alias("all"), *[F.regexp_count(text, F.lit(p)).alias(k) for k, (p, _) in CLASSES.items()])
    return docs.withColumn("rules", _rules(text)).withColumn("_found", _candidates(text)).withColumn("_chars", chars)


def limits(scanned: DataFrame) -> Limits:
    """Both controls over all candidates of ``scan``; two histograms come to the driver, of a few hundred bins for each power of two of lengths."""
    got = scanned.agg(*[F.sum(f"_chars.{k}").alias(k) for k in ("all", *CLASSES)]).first()
    total = (got["all"] or 0) + sum(size for _, size in CLASSES.values()) + 2
    shares = {k: ((got[k] or 0) + size) / total / size for k, (_, size) in CLASSES.items()}
    tokens = scanned.select(F.explode("_found.t").alias("t"))
    kept = tokens.select(
        _length_class(F.col("t")).alias("c"), _p_bin(F.col("t")).alias("p"), F.least(F.greatest(F.floor(_ratio(F.col("t"), shares)), F.lit(0)), F.lit(MAX_L)).cast("int").alias("l")
    )
    counts = [tuple(r) for r in kept.groupBy("c", "p", "l").count().collect()]
    reject = _least_bins([(c, p, n) for c, p, _, n in counts], REJECT, lambda b: 10 ** (-b / 10))
    noise = [(c, l, n) for c, p, l, n in counts if p < reject.get(c, MAX_P + 1)]
    return Limits(shares, _least_bins(noise, LEVEL, lambda b: math.exp(-b)), reject)


def _judged(scanned: DataFrame, limit: Limits) -> DataFrame:
    """``scan`` with ``spans`` and ``confirmed`` in place of its own columns."""

    def random(x: Column) -> Column:
        t = x["t"]
        kind = _length_class(t)
        return (_p_bin(t) < _looked_up(limit.reject, kind, MAX_P + 1)) & (_ratio(t, limit.shares) >= _looked_up(limit.least, kind, 1 << 30))

    meets = lambda a, b: (a["start"] < b["end"]) & (a["end"] > b["start"])
    noise = F.transform(F.filter("_found", random), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    out = scanned.withColumn("_noise", F.when(F.size("_found") > 0, noise).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    fresh = F.filter("_noise", lambda x: ~F.exists("rules", lambda r: meets(r, x)))
    out = out.withColumn("spans", F.when(F.size("_noise") == 0, F.col("rules")).otherwise(F.sort_array(F.concat("rules", fresh))))
    out = out.withColumn("confirmed", F.filter("rules", lambda r: F.exists("_noise", lambda x: meets(r, x))))
    return out.drop("_noise", "_found", "_chars")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rules``, ``spans`` and ``confirmed``: arrays of ``(start, kind, end)`` sorted by start, then kind as listed.

    Starts and ends are code points, end exclusive; kind 0..2 is of ``KINDS`` and 3 is
    ``random``, which never overlaps a rule's span; ``confirmed`` are the rules' spans
    that overlap a random token. A null text is an empty one. An empty table gives
    none. Columns of these names are replaced.
    """
    held = [F.col(c) for c in docs.columns if c not in ("rules", "spans", "confirmed")]
    packed = docs.select(F.struct(*held).alias("row"), "text")
    found = _judged(scan(packed), limits(cut(scan(docs.select("text")).select("_found", "_chars"), "secrets")))
    return found.select("row.*", "rules", "spans", "confirmed")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of the rules' spans, their digest, all spans and the confirmed ones as text.

    A null text is an empty one; a repeated row is reported again; an empty table gives
    none. Other columns are ignored, whatever their names.
    """
    scanned = cut(scan(docs.select("doc_id", "text")).drop("text"), "secrets")
    found = _judged(scanned, limits(scanned))
    of_kind = lambda k: F.size(F.filter("rules", lambda x: x["kind"] == F.lit(k))).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("rules")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), joined(F.col("confirmed")).alias("confirmed"))
