"""Vector search and similarity over ``(vec_id, embedding, label)`` tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dot
from .blocks import Block, cosine, labelled, nearest, number, others, pair_columns, pair_rows, products, rounded, squared, taken

#: Query rows up to which the query set is broadcast; a larger one is dealt in blocks.
QUERY_ROWS = 20_000
BLOCKS = 16


def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of ``rows`` beside every row of a stated query set.

    A counted small query set is broadcast; a larger one is cut into blocks that meet
    ``rows`` one by one, so that no task holds the whole set.
    """
    if queries.count() <= QUERY_ROWS:
        return rows.crossJoin(F.broadcast(queries))
    blocks = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(BLOCKS)))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")))).join(blocks, "_block").drop("_block")


SQUARED = "aggregate(zip_with(ea, eb, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, v) -> s + v)"


def _pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Each vector beside each query, with embeddings, labels and norms (taken once a row, where they are used)."""
    q = queries.selectExpr("vec_id AS id_a", "embedding AS ea", "label AS label_a", f"sqrt({dot('embedding', 'embedding')}) AS na")
    return against(vectors.selectExpr("vec_id AS id_b", "embedding AS eb", "label AS label_b", f"sqrt({dot('embedding', 'embedding')}) AS nb"), q)


def knn_l2(vectors: DataFrame, query: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """The ``k`` nearest vectors of one query by squared distance, ids breaking ties; 2k are fetched before the threshold."""
    near = _pairs(vectors, query).select("id_b", F.expr(SQUARED).alias("dist")).orderBy("dist", "id_b").limit(2 * k)
    return (near if threshold is None else near.where(F.col("dist") <= threshold)).orderBy("dist", "id_b").limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest other vectors of each query: ``(id_a, id_b, dist, rank, label_a, label_b)``."""
    return nearest(vectors, queries, k).select("id_a", "id_b", "label_a", "label_b", "dist", "rank")


def range_search(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """All other vectors within a squared distance of each query."""
    return _pairs(vectors, queries).where("id_a <> id_b").select("id_a", "id_b", F.expr(SQUARED).alias("dist")).where(F.col("dist") <= threshold)


def _cosine(a: Block, b: Block) -> np.ndarray:
    """Cosines; 0 for a vector of length zero."""
    flat = (a.square == 0)[:, None] | (b.square == 0)[None, :]
    return np.where(flat, 0.0, cosine(a, b))


def _correlation(a: Block, b: Block) -> np.ndarray:
    """Absolute correlations of the dimensions; 0 where a vector does not vary or is missing."""
    u, v = (x.v - x.v.mean(1, keepdims=True) for x in (a, b))
    norm = np.sqrt((u * u).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
    return np.abs(np.divide(u @ v.T, norm, out=np.zeros(norm.shape), where=norm > 0))


def similarity(vectors: DataFrame, queries: DataFrame, method: str = "cosine", temperature: float = 1.0, digits: int = 15) -> DataFrame:
    """``(id_a, id_b, sim)`` of queries against other vectors: cosine, euclidean, correlation or exponential, rounded to ``digits``."""
    measure = {
        "cosine": _cosine, "euclidean": lambda a, b: 1 - np.sqrt(squared(a, b)) / np.sqrt(a.v.shape[1]),
        "correlation": _correlation, "exponential": lambda a, b: np.exp(-np.sqrt(squared(a, b)) / temperature),
    }[method]

    def columns(a: Block, b: Block) -> list[pa.Array]:
        return [*pair_columns(a, b, ("id_a", "id_b")), number(taken(a, b)(rounded(measure(a, b), digits)))]

    return pair_rows(vectors, queries, columns, "id_a long, id_b long, sim double")


def algorithm_report(vectors: DataFrame, queries: DataFrame, match: float = 0.5) -> DataFrame:
    """``(alg, same_mean, same_std, other_mean, other_std, matched)``: scores of pairs of one label and of two by cosine, euclidean and correlation, and the share of scores of at least ``match``.

    Tasks add up what a block of pairs gives; pairs without a score count in nothing, those without a label in the share alone.
    """

    def columns(a: Block, b: Block) -> list[pa.Array]:
        dots, pair, (same, other) = products(a, b), others(a, b), labelled(a, b)
        missing = np.isnan(a.square)[:, None] | np.isnan(b.square)[None, :]
        told = []
        for alg, s in (("cosine", rounded(cosine(a, b, dots), 6)), ("euclidean", 1 - np.sqrt(squared(a, b, dots)) / 8), ("correlation", np.where(missing, np.nan, rounded(_correlation(a, b), 6)))):
            seen = pair & ~np.isnan(s)
            for kind, which in (("same", same & seen), ("other", other & seen), ("any", seen)):
                x = s[which]
                if len(x):
                    told.append((alg, kind, len(x), x.sum(), np.square(x - x.mean()).sum(), np.count_nonzero(x >= match)))
        schema = pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64()
        return [pa.array([row[k] for row in told], kind) for k, kind in enumerate(schema)]

    parts = pair_rows(vectors, queries, columns, "alg string, kind string, n long, total double, gaps double, hits long")
    of = lambda c, kind: F.sum(F.when(F.col("kind") == kind, F.expr(c)))
    sums = parts.groupBy("alg").agg(*[of(c, kind).alias(f"{kind}_{name}") for kind in ("same", "other") for name, c in (("n", "n"), ("total", "total"), ("squares", "gaps + total * total / n"))], of("hits", "any").alias("hits"), of("n", "any").alias("n"))
    mean = lambda kind: F.try_divide(F.col(f"{kind}_total"), F.col(f"{kind}_n"))
    std = lambda kind: F.sqrt(F.greatest(F.try_divide(F.col(f"{kind}_squares"), F.col(f"{kind}_n")) - mean(kind) * mean(kind), F.lit(0.0)))
    some = lambda kind, x: F.when(F.col(f"{kind}_n") > 0, x)
    return sums.select("alg", *[some(kind, f(kind)).alias(f"{kind}_{name}") for kind in ("same", "other") for name, f in (("mean", mean), ("std", std))], (F.col("hits") / F.col("n")).alias("matched"))


def hamming(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(id_a, id_b, bits)``: dimensions in which just one of both vectors is positive."""

    def columns(a: Block, b: Block) -> list[pa.Array]:
        u, v = ((x.v > 0).astype(np.float32) for x in (a, b))
        bits, take = u.sum(1)[:, None] + v.sum(1)[None, :] - 2 * (u @ v.T), taken(a, b)  # small whole numbers: exact
        gone = [np.isnan(x.square) for x in (a, b)]
        missing = take(gone[0][:, None] | gone[1][None, :]) if gone[0].any() or gone[1].any() else None
        return [*pair_columns(a, b, ("id_a", "id_b")), pa.array(take(bits).astype(np.int64), mask=missing)]

    return pair_rows(vectors, queries, columns, "id_a long, id_b long, bits long")


def pair_confidence(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(id_a, id_b, is_match, confidence, quality)``: quality weighs the cosine and the mean of both norms, centred at 10; without a cosine it is 1."""

    def columns(a: Block, b: Block) -> list[pa.Array]:
        take, score, norm = taken(a, b), rounded(cosine(a, b), 6), [np.sqrt(x.square) for x in (a, b)]
        quality = 0.7 * score + 0.3 / (1 + np.exp(10 - (norm[0][:, None] + norm[1][None, :]) / 2))
        score = take(score)
        match = pa.array(score >= 0.5, mask=np.isnan(score) if np.isnan(score).any() else None)
        confidence = np.rint(np.abs(score - 0.5) * 2_000_000) / 1_000_000
        return [*pair_columns(a, b, ("id_a", "id_b")), match, number(confidence), number(take(rounded(np.fmax(0.0, np.fmin(1.0, quality)), 6)))]

    return pair_rows(vectors, queries, columns, "id_a long, id_b long, is_match boolean, confidence double, quality double")


def similarity_matrix(vectors: DataFrame, queries: DataFrame, digits: int = 15) -> DataFrame:
    """The queries' rows of the cosine matrix in long form, mirrored, with the diagonal.

    A pair of two queries comes from both sides already, so only pairs with another row
    are mirrored; ids are taken to be unique.
    """
    asked = queries.select("vec_id", F.lit(1).alias("asked"))
    marked = vectors.join(asked, "vec_id", "left").select("vec_id", "embedding", F.coalesce("asked", F.lit(0)).alias("label"))

    def columns(a: Block, b: Block) -> list[pa.Array]:
        sim, mirrored = rounded(_cosine(a, b), digits), np.flatnonzero(b.labels == 0)
        left, right = np.repeat(a.ids, len(b.ids)), np.tile(b.ids, len(a.ids))
        back, forth = np.repeat(a.ids, len(mirrored)), np.tile(b.ids[mirrored], len(a.ids))
        both = (left, forth), (right, back), (sim.ravel(), sim[:, mirrored].ravel())
        return [pa.array(np.concatenate(both[0])), pa.array(np.concatenate(both[1])), number(np.concatenate(both[2]))]

    return pair_rows(marked, queries.select("vec_id", "embedding", F.lit(1).alias("label")), columns, "id_a long, id_b long, sim double")


def fuse_scores(pairs: DataFrame, a: str, b: str, strategy: str = "weighted", weight: float = 0.5) -> DataFrame:
    made = {"weighted": (1 - weight) * F.col(a) + weight * F.col(b), "max": F.greatest(a, b), "average": (F.col(a) + F.col(b)) / 2}[strategy]
    return pairs.withColumn("fused", made)
