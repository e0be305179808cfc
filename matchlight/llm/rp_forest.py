"""Embedding near-copies with a forest of random-projection trees.

Each tree splits the vectors at the median of a random projection, again and again;
vectors within ``SPILL`` of a split go to both sides. ``SPILL`` is measured in the
standard deviation that the projected difference of two vectors at the link's
threshold has, so a linked pair parts only where it straddles the median by more than
twice that; for closer pairs this is rare at any density, and ``TREES`` independent
trees make a miss improbable. The top levels are fitted on a bounded sample, so that
a node holds about ``NODE`` vectors, and every vector is routed through them in its
own task; below, each ``(tree, node, label)`` group is split further in one task, down
to leaves of ``LEAF`` vectors. A node that splits do not divide, since nearly all of it
lies within the spill, is a group of near copies and one leaf; one above ``BIG``
vectors is dealt to many tasks as pairs of blocks.

Each vector then knows all its leaves. Vectors of a leaf are compared with each other
in double precision, and a linked pair counts in the least leaf that both share, so
that it counts once in the whole forest. Leaves send, for each vector, how many it is
linked with and one edge to the root of its links there: pairs are never written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, components, cut

TREES = 4
SPILL = 0.75
NODE = 2048
BIG = 4 * NODE
#: A split that leaves more than this share on one side divides nothing.
UNDIVIDED = 0.85
LEAF = 96
#: Vectors that the top splits are fitted on, as the expected size of a random part.
FIT_ROWS = 50_000
SEED = 7919


def _directions(tree: int, level: int, dim: int) -> np.ndarray:
    """One direction for all nodes of a level: random, and the same in every task."""
    d = np.random.default_rng((SEED, tree, level, dim)).standard_normal(dim)
    return d / np.linalg.norm(d)


def spill_width(dim: int, least: float) -> float:
    return SPILL * math.sqrt(2 * (1 - least) / dim)


def fit_splits(sample: np.ndarray, depth: int, width: float) -> list[dict[int, float]]:
    """Per tree, the median of the projection at each top node that a split divides; nodes are numbered as in a heap."""
    trees = []
    for tree in range(TREES):
        splits: dict[int, float] = {}
        nodes = {1: sample}
        for level in range(depth):
            direction, after = _directions(tree, level, sample.shape[1]), {}
            for node, rows in nodes.items():
                if not len(rows):
                    continue
                at = rows @ direction
                median = float(np.median(at))
                low, high = rows[at <= median + width], rows[at >= median - width]
                if max(len(low), len(high)) <= UNDIVIDED * len(rows):
                    splits[node] = median
                    after[2 * node], after[2 * node + 1] = low, high
            nodes = after
        trees.append(splits)
    return trees


def _routes(x: np.ndarray, splits: dict[int, float], tree: int, depth: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the last nodes they come to; a row can be in several."""
    row, node = np.arange(len(x)), np.ones(len(x), np.int64)
    for level in range(depth):
        at = (x @ _directions(tree, level, x.shape[1]))[row]
        median = np.array([splits.get(n, np.nan) for n in node.tolist()])
        stay, low, high = np.isnan(median), at <= median + width, at >= median - width
        row, node = np.concatenate((row[stay], row[low], row[high])), np.concatenate((node[stay], 2 * node[low], 2 * node[high] + 1))
    return row, node


def leaves(x: np.ndarray, rng: np.random.Generator, width: float) -> Iterator[np.ndarray]:
    """Row sets of the leaves of one tree below a node; those above ``LEAF`` are undivided."""
    open_nodes = [np.arange(len(x))]
    while open_nodes:
        rows = open_nodes.pop()
        if len(rows) > LEAF:
            d = rng.standard_normal(x.shape[1])
            at = x[rows] @ (d / np.linalg.norm(d))
            median = np.median(at)
            low, high = rows[at <= median + width], rows[at >= median - width]
            if max(len(low), len(high)) <= UNDIVIDED * len(rows):
                open_nodes += [low, high]
                continue
        yield rows


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether each row of ``x`` has a cosine of ``least`` or more with each of ``y``, as dot product over norms."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), 512):
        cosine = (x[k : k + 512] @ y.T) / (nx[k : k + 512, None] * ny[None, :])
        out[k : k + 512] = cosine >= least
        # sums of a product of matrices may differ in their last bits from those of a pair
        for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12), strict=True):
            out[k + i, j] = float((x[k + i] * y[j]).sum()) / (nx[k + i] * ny[j]) >= least
    return out


def _share_less(a: list[np.ndarray], b: list[np.ndarray], code: int) -> np.ndarray:
    """Whether each of ``a`` has a leaf in common with each of ``b`` that is less than ``code``."""
    names = {c: k for k, c in enumerate(np.intersect1d(np.concatenate(a), np.concatenate(b)).tolist()) if c < code}
    if not names:
        return np.zeros((len(a), len(b)), bool)
    sides = []
    for codes in (a, b):
        m = np.zeros((len(codes), len(names)), np.float32)
        for i, own in enumerate(codes):
            m[i, [names[c] for c in own.tolist() if c in names]] = 1
        sides.append(m)
    return sides[0] @ sides[1].T > 0


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix, the first row that its component has."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            new = np.array([i])
            while len(new):
                root[new] = i
                new = np.flatnonzero(adjacent[new].any(0) & (root < 0))
    return root


def compare(x: np.ndarray, left: np.ndarray, right: np.ndarray, codes: list[np.ndarray], weight: np.ndarray, code: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` with links that count in leaf ``code``, the weight of what each is linked with, and each one's root."""
    same = left is right
    links = linked(x[left], x[right], least)
    if same:
        np.fill_diagonal(links, False)
    i, j = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(i):
        return (np.empty(0, np.int64),) * 3
    links = links[np.ix_(i, j)]
    left, right = left[i], right[j]
    links &= ~_share_less([codes[k] for k in left], [codes[k] for k in right], code)
    if same:
        rows, both, degree = left, links, links @ weight[right]
    else:
        rows = np.concatenate((left, right))
        both = np.zeros((len(rows), len(rows)), bool)
        both[: len(left), len(left) :], both[len(left) :, : len(left)] = links, links.T
        degree = np.concatenate((links @ weight[right], links.T @ weight[left]))
    return rows, degree, rows[_roots(both)]


def _node_code(tree: int, node: int, dim: int, label: str) -> int:
    """The least code of a node's leaves; they are numbered from there."""
    name = hashlib.blake2b(f"{tree} {node} {dim} {label}".encode(), digest_size=5).digest()
    return int.from_bytes(name, "little") << 22


def links(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """``(own, degree, root)`` of ``vectors(own, n, label, embedding)``: partial counts of linked vectors and edges of a spanning graph.

    Links have equal labels and a cosine >= ``least``; a linked vector counts ``n``
    times. Vectors must be finite and not zero, ``own`` unique. Vectors of different
    lengths do not link. A vector has as many rows as it has leaves with links.
    """
    schema = "own long, degree long, root long"
    total = vectors.count()
    if total < 2:
        return vectors.select("own", F.lit(0).cast("long").alias("degree"), F.col("own").alias("root")).limit(0)
    kind = vectors.schema["embedding"].dataType.simpleString()  # floats stay floats until they are compared
    depth = max(0, math.ceil(math.log2(total / NODE)))
    dim = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()["dim"]
    splits: list[dict] = [{} for _ in range(TREES)]
    if depth:
        got = vectors.where(F.size("embedding") == dim).sample(min(1.0, FIT_ROWS / total), seed=SEED).select("embedding").toArrow()
        sample = got.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        splits = fit_splits(sample / np.linalg.norm(sample, axis=1, keepdims=True), depth, spill_width(dim, least))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy()
            for size in np.unique(sizes):
                part = batch[sizes == size]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for tree in range(TREES):
                    row, node = _routes(x, splits[tree], tree, depth, spill_width(dim, least)) if size == dim else (np.arange(len(part)), np.zeros(len(part), np.int64))
                    yield part.iloc[row].assign(tree=tree, node=node, dim=int(size))[["tree", "node", "dim", *batch.columns]]

    keys = ["tree", "node", "dim", "label"]
    routed = vectors.select("label", "own", "embedding").mapInPandas(route, f"tree int, node long, dim int, label string, own long, embedding {kind}")
    places = cut(routed.drop("embedding").groupBy(*keys).count().where(F.col("count") > BIG).select(*keys, F.ceil(F.col("count") / NODE).cast("int").alias("blocks")), "big")
    big = bounded_broadcast(places)

    def find_leaves(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("own")
        first = _node_code(*key)
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng((SEED, int(key[0]), int(key[1])))
        found = list(leaves(x, rng, spill_width(x.shape[1], least)))
        code = np.repeat(first + np.arange(len(found)), [len(f) for f in found])
        return pd.DataFrame({"own": rows["own"].to_numpy()[np.concatenate(found)], "code": code})

    def name_big(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"own": batch["own"], "code": [_node_code(*k) for k in zip(*(batch[c] for c in keys), strict=True)]}).astype("int64")

    small = routed.join(big, keys, "left").where("blocks is null").groupBy(*keys).applyInPandas(find_leaves, "own long, code long")
    wide = routed.drop("embedding").join(big, keys).mapInPandas(name_big, "own long, code long")
    codes = cut(small.union(wide).groupBy("own").agg(F.array_sort(F.collect_set("code")).alias("codes")), "leaves")
    known = vectors.join(codes, "own").select("label", "own", "embedding", F.col("n").alias("weight"), "codes")
    again = known.mapInPandas(route, f"tree int, node long, dim int, label string, own long, embedding {kind}, weight long, codes array<long>")
    dealt = (
        again.join(big, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("own", F.lit(3)), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    )

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        own, block, weight = rows["own"].to_numpy(), rows["block"].to_numpy(), rows["weight"].to_numpy()
        codes, first = rows["codes"].tolist(), _node_code(*key[:4])
        if rows["blocks"].iloc[0] > 1:
            left = np.flatnonzero(block == key[4])
            right = left if key[4] == key[5] else np.flatnonzero(block == key[5])
            found = [compare(x, left, right, codes, weight, first, least)] if len(left) and len(right) else []
        else:
            members: dict[int, list[int]] = {}
            for k, own_codes in enumerate(codes):
                for c in own_codes[(own_codes >= first) & (own_codes < first + (1 << 22))].tolist():
                    members.setdefault(c, []).append(k)
            leaf_rows = ((c, np.array(m)) for c, m in members.items() if len(m) > 1)
            found = [compare(x, leaf, leaf, codes, weight, c, least) for c, leaf in leaf_rows]
        if not found:
            return pd.DataFrame({"own": [], "degree": [], "root": []}, dtype="int64")
        k, degree, root = (np.concatenate(part).astype(np.int64) for part in zip(*found, strict=True))
        return pd.DataFrame({"own": own[k], "degree": degree, "root": own[root]})

    return dealt.groupBy(*keys, "bi", "bj").applyInPandas(count, schema)


def near_vectors(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``embeddings(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``least``. A null, empty or zero vector, one with a null or non-finite
    component, and a row without id link with nothing (a row without id has a null
    component and is not kept). Equal vectors of one label are compared once; rows
    that repeat an id are separate vectors of one component. Other columns are ignored.
    """
    value = F.col("embedding")
    finite = ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(finite & F.exists(value, lambda v: v != 0) & (F.size(value) > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    floats = embeddings.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        value.cast("array<float>" if floats else "array<double>").alias("embedding"), good.alias("good"),
    )
    # adding 0.0 makes the two zeros one; two hashes name a vector of a label in 128 bits
    rows = rows.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0).cast("float")))
    key = [F.when(F.col("good"), F.xxhash64("label", "embedding", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("vec_id", "label", "embedding", *key)
    equal = rows.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    numbered = cut(equal.withColumn("own", F.monotonically_increasing_id()), "vectors")
    found = cut(links(numbered.select("own", "n", "label", "embedding"), least), "links")
    degree = found.groupBy("own").agg(F.sum("degree").alias("others"))
    groups = components(found.where("own <> root").select(F.col("own").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "own")
    named = numbered.select("h1", "h2", "own", "rep", "n").join(groups, "own", "left").withColumn("component", F.coalesce("component", "own"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").join(degree, "own", "left")
    named = named.select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
