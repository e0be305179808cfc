"""A training corpus in five stages, each a Spark job over all that its predecessor kept.

toxicity (toxic documents go), quality rules (rejected documents go), n-gram Jaccard
join on five words and a similarity of 0.8 (one document of each group stays), PII
(spans are replaced by their kind), packing (pieces of 2048-token sequences).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchlight.llm import ngram_join, packing, pii, quality, toxicity
from matchlight.llm.common import cut, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages fit models and tokenise, which SQL cannot express; tests/llm compare each stage with plain Python on its own input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
