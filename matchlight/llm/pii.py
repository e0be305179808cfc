"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers. The
field then labels all tokens that hold a digit or ``@``, in every document that has
any: token potentials are the log-shares of each label among tokens of that shape,
chain potentials those of neighbouring labels, both counted over the whole corpus with
the rules' spans as labels; tokens in a rule's span are clamped to it. Skip edges tie
each token to the last earlier token of its document with the same key (its lower-case
letters and digits, or its last digits), so that a repeated or similar token shares the
label. The weights of the token, chain and skip potentials are fitted by
pseudo-likelihood on some ``FIT_DOCS`` documents with such tokens; a token outside the rules' spans
that a skip edge ties to one within is not a negative example there. Loopy belief
propagation runs over both kinds of edges. Runs of tokens outside the rules' spans
whose marginal for one kind reaches ``MARGINAL`` become further spans.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]\S*")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Documents with tokens that the weights are fitted on, as the expected size of a random part; all of them where there are fewer.
FIT_DOCS = 20_000
#: Runs of characters from which a token's shape is only the set of their kinds; with it the number of shapes is finite.
MANY_RUNS = 12
#: Least share of a shape's or chain's smoothing, and weights that the fitted ones are drawn to: token, entity, chain, same, similar.
SMOOTHING, PRIOR, RIDGE = 1.0, (1.0, 0.0, 1.0, 2.0, 1.0), 1.0
MARGINAL = 0.9
ROUNDS, DAMPING = 20, 0.5
_PUNCTUATION = ".,;:!?\"'()[]{}<>#*$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by kind, then start; leftmost, not overlapping within a kind, without retries."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def shape(token: str) -> str:
    """Runs of letters as ``a``, of digits as ``9`` with their number up to 20 (without it beside an ``@``), other characters as they are or ``?`` beyond ASCII."""
    runs = _RUN.findall(token)
    mail = "@" in token

    def kind(run: str) -> str:
        if "0" <= run[0] <= "9":
            return "9" if mail else f"9{min(20, len(run))};"
        return "a" if run[0].isalpha() else run if run < "\x7f" else "?"

    if len(runs) > MANY_RUNS:
        return "many:" + "".join(sorted({kind(r)[0] for r in runs}))
    return "".join(map(kind, runs))


def key(token: str) -> tuple[str, bool]:
    """What repeated tokens share, and whether it is the whole token."""
    digits = re.sub(r"\D", "", token)
    if len(digits) >= 7 and "@" not in token:
        return digits[-7:], len(digits) == 7
    return token.strip(_PUNCTUATION).lower(), True


def tokens(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """``(start, end, label)`` of the tokens with a digit or ``@``; label 0 outside the rules' spans, else kind + 1."""
    out, starts = [], sorted((s, e, k) for k, s, e in spans)
    j = 0
    for m in _HINT.finditer(text):
        a, b = m.span()
        while a and not text[a - 1].isspace():
            a -= 1
        while j < len(starts) and starts[j][1] <= a:
            j += 1
        label = next((k + 1 for s, e, k in starts[j : j + 4] if s < b and e > a), 0)
        out.append((a, b, label))
    return out


def skips(text: str, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """``(earlier, later, same)``: each token and the last earlier one with its key; ``same`` if the tokens are equal."""
    out, seen = [], {}
    for i, (a, b, _) in enumerate(nodes):
        word = text[a:b]
        k, whole = key(word)
        if len(k) >= 4:
            if k in seen:
                out.append((seen[k][0], i, whole and seen[k][1] == word))
            seen[k] = (i, word)
    return out


def chains(text: str, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Neighbouring tokens with a single space between them."""
    return [(i - 1, i) for i in range(1, len(nodes)) if text[nodes[i - 1][1] : nodes[i][0]] == " "]


class Field:
    """Potentials of the skip-chain field."""

    def __init__(self, counts: dict[str, list[int]], rest: list[int], chain: np.ndarray, weights: tuple[float, ...] = PRIOR):
        """``counts`` by label of the shapes that rules' spans hold, ``rest`` those of all other shapes together."""
        total = np.array([rest, *counts.values()], float).sum(0)
        share = (total + 1) / (total + 1).sum()
        smooth = lambda c: np.log((np.array(c, float) + SMOOTHING * share) / (sum(c) + SMOOTHING))
        self.rare = smooth(rest)
        self.shapes = {s: smooth(c) for s, c in counts.items()}
        self.chain = np.log((chain + 1) / (chain + 1).sum(1, keepdims=True)) - np.log(share)[None, :]
        self.weights = tuple(weights)

    def unary(self, word: str) -> np.ndarray:
        return self.shapes.get(shape(word), self.rare)

    def examples(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """Label and features (5 labels by 5 weights) of the tokens of a document, given all other tokens' labels."""
        nodes = tokens(text, rule_spans(text))
        if not nodes:
            return
        label = [n[2] for n in nodes]
        f = np.zeros((len(nodes), 5, 5))
        unlike = set()
        for i, (a, b, _) in enumerate(nodes):
            f[i, :, 0] = self.unary(text[a:b])
            f[i, 1:, 1] = 1
        for i, j in chains(text, nodes):
            f[j, :, 2] += self.chain[label[i]]
            f[i, :, 2] += self.chain[:, label[j]]
        for i, j, same in skips(text, nodes):
            f[j, label[i], 3 if same else 4] += 1
            f[i, label[j], 3 if same else 4] += 1
            unlike |= {k for k, other in ((i, j), (j, i)) if not label[k] and label[other]}
        for i in range(len(nodes)):
            if i not in unlike:
                yield label[i], f[i]

    def label(self, text: str, spans: list[Span]) -> list[Span]:
        """Further spans of a document that has the rules' ``spans``."""
        nodes = tokens(text, spans)
        free = [i for i, n in enumerate(nodes) if n[2] == 0]
        if not free:
            return []
        token, entity, chain, same, similar = self.weights
        unary = np.full((len(nodes), 5), -30.0)
        for i, (a, b, label) in enumerate(nodes):
            if label:
                unary[i, label] = 0.0
            else:
                unary[i] = token * self.unary(text[a:b])
                unary[i, 1:] += entity
        edges = [(i, j, same * np.eye(5) if equal else similar * np.eye(5)) for i, j, equal in skips(text, nodes)]
        edges += [(i, j, chain * self.chain) for i, j in chains(text, nodes)]
        marginal = self._propagate(unary, edges)
        found: list[Span] = []
        for i in free:
            kind = int(marginal[i].argmax())
            if kind == 0 or marginal[i, kind] < MARGINAL:
                continue
            a, b, _ = nodes[i]
            if found and found[-1][0] == kind - 1 and found[-1][2] <= a and text[found[-1][2] : a].strip(_PUNCTUATION + " ") == "" and a - found[-1][2] <= 2:
                found[-1] = (kind - 1, found[-1][1], b)
            else:
                found.append((kind - 1, a, b))
        out = []
        for kind, a, b in found:
            while a < b and text[a] in _PUNCTUATION:
                a += 1
            while a < b and text[b - 1] in _PUNCTUATION:
                b -= 1
            if a < b and not any(s < b and e > a for _, s, e in spans):
                out.append((kind, a, b))
        return out

    @staticmethod
    def _propagate(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Marginals by loopy sum-product with damping; messages in logs."""
        left = np.array([e[0] for e in edges], np.int64)
        right = np.array([e[1] for e in edges], np.int64)
        pair = np.array([e[2] for e in edges]).reshape(-1, 5, 5)
        forth, back = np.zeros((len(edges), 5)), np.zeros((len(edges), 5))
        for _ in range(ROUNDS if edges else 0):
            belief = unary.copy()
            np.add.at(belief, right, forth)
            np.add.at(belief, left, back)
            to_right = np.logaddexp.reduce((belief[left] - back)[:, :, None] + pair, axis=1)
            to_left = np.logaddexp.reduce((belief[right] - forth)[:, None, :] + pair, axis=2)
            to_right -= np.logaddexp.reduce(to_right, axis=1, keepdims=True)
            to_left -= np.logaddexp.reduce(to_left, axis=1, keepdims=True)
            moved = max(np.abs(to_right - forth).max(), np.abs(to_left - back).max())
            forth = DAMPING * forth + (1 - DAMPING) * to_right
            back = DAMPING * back + (1 - DAMPING) * to_left
            if moved < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, right, forth)
        np.add.at(belief, left, back)
        belief -= belief.max(1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame) -> Field:
    """Potentials counted over all of ``docs(text)`` and weights fitted on a part; an empty table gives flat potentials and the prior weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        frame = lambda: pd.DataFrame([(s, k, n) for (s, k), n in tally.items()], columns=["shape", "label", "n"])
        for batch in batches:
            for text in batch["text"]:
                nodes = tokens(text, rule_spans(text)) if text else []
                if nodes:
                    tally["d", 0] += 1
                for a, b, label in nodes:
                    tally["s" + shape(text[a:b]), label] += 1
                for i, j in chains(text, nodes) if nodes else ():
                    tally[f"c{nodes[i][2]}", nodes[j][2]] += 1
            if len(tally) > 50_000:
                yield frame()
                tally.clear()
        yield frame()

    counts = docs.select("text").mapInPandas(run, "shape string, label int, n long").groupBy("shape").pivot("label", [0, 1, 2, 3, 4]).agg(F.sum("n"))
    counts = cut(counts.select("shape", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"n{k}") for k in range(5)]), "counts")
    chained, entity = ~F.col("shape").startswith("s"), F.expr("n1 + n2 + n3 + n4 > 0")
    rows = counts.where(chained | entity).collect()  # the shapes of MANY_RUNS runs are finitely many; those without an entity stay behind
    rest = counts.where(~chained & ~entity).agg(F.sum("n0")).first()[0] or 0
    table = {r["shape"]: [r[f"n{k}"] for k in range(5)] for r in rows}
    chain = np.array([table.get(f"c{k}", [0] * 5) for k in range(5)], float)
    field = Field({s[1:]: c for s, c in table.items() if s[0] == "s"}, [rest, 0, 0, 0, 0], chain)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(label, np.round(f, 1).ravel().tolist()) for text in batch["text"] if text for label, f in field.examples(text)]
            yield pd.DataFrame(rows, columns=["label", "f"])

    # a random part of a fixed expected size: no shuffle, and no row limit to meet in one task
    hinted = docs.select("text").sample(min(1.0, FIT_DOCS / max(1, table.get("d", [0])[0])), seed=7)
    got = hinted.mapInPandas(examples, "label int, f array<double>").groupBy("label", "f").count().collect()
    if got:
        field.weights = fit_weights(np.array([r["f"] for r in got]).reshape(-1, 5, 5), np.array([r["label"] for r in got]), np.array([r["count"] for r in got], float))
    return field


def fit_weights(f: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Weights of the greatest pseudo-likelihood with a Gaussian prior around ``PRIOR``, by Newton's steps; potentials are never turned round."""
    w = np.array(PRIOR)
    for _ in range(50):
        z = f @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mean = np.einsum("nl,nlk->nk", p, f)
        gradient = n @ (f[np.arange(len(f)), label] - mean) - RIDGE * (w - PRIOR)
        centred = f - mean[:, None, :]
        hessian = np.einsum("n,nl,nlk,nlm->km", n, p, centred, centred, optimize=True) + RIDGE * np.eye(5)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    w[[0, 2, 3, 4]] = np.maximum(w[[0, 2, 3, 4]], 0.0)
    return tuple(float(x) for x in w)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``rules`` and ``spans``: arrays of ``(kind, start, end)`` in code points, end exclusive.

    ``spans`` holds the rules' spans and the field's. A null text is an empty one and
    has none; rows are taken one by one, so repeated ids do not matter. Columns named
    ``rules`` or ``spans`` are replaced.
    """
    docs, named = apart(docs.drop("rules", "spans"), {"_f"})
    one = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"struct<rules:{one},spans:{one}>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for batch in texts:
            rules, spans = [], []
            for text in batch:
                r = rule_spans(text) if text else []
                rules.append(as_rows(r))
                spans.append(as_rows(r + field.label(text, r)) if text else [])
            yield pd.DataFrame({"rules": rules, "spans": spans})

    return named(docs.withColumn("_f", found("text")).withColumn("rules", F.col("_f.rules")).withColumn("spans", F.col("_f.spans")).drop("_f"))


def report(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of the rules' spans, their digest, and all spans as text.

    A null or empty text has none; repeated and null ids are rows of their own, other columns are ignored.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = rule_spans(text) if text else []
                every = base + field.label(text, base) if text else []
                n = Counter(k for k, _, _ in base)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]`` and ``n_chars``, where there is one, counted anew.

    A null text stays null; of overlapping spans the first is replaced; rows are taken one by one and other columns stay.
    """

    @F.pandas_udf("string")
    def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: _redacted(t, field) if t else t)

    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def _redacted(text: str, field: Field) -> str:
    base = rule_spans(text)
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in base + field.label(text, base)):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
