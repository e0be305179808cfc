"""The registered queries ``opN_<name>`` and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, licenses, ngram_join, packing, phrases, pii, quality, repair, rp_forest, secrets, suffixes, toxicity
from .common import table


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of equal labels at a cosine of 0.93 or more."""
    return rp_forest.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at 100 * intersection >= 90 * union.

    Routed by 40 slices: exact to some 300 shingles, above it with a chance below 1e-8
    of missing a pair (``near_copies`` has the exact way).
    """
    return ngram_join.near_copies(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and the skip-chain field over all documents."""
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal-scoring segments; the fifth of crc32(doc_id) mod 5 = 0 is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and the randomness battery over all documents."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of the word-level BPE file, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids of the byte-level BPE file."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every whole text, joined to known licences."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of lines and paragraphs, joined to known licence notices."""
    return licenses.scan_notices(table(spark, sf_dir, "documents"), licenses.known_notices(spark))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base test and the learned decision list's verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs.select("doc_id", "text"), quality.learn(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 200 bytes that occur twice, removed."""
    return suffixes.report(table(spark, sf_dir, "documents"), stored=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    return repair.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rp_forest": op1_rp_forest,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_pii_skip_chain": op3_pii_skip_chain,
    "op4_toxicity": op4_toxicity,
    "op5_host_suffix_array": op5_host_suffix_array,
    "op6_secret_battery": op6_secret_battery,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_license_digests": op9_license_digests,
    "op9_license_notices": op9_license_notices,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {"op9_license_digests": licenses.oracle_sql(), "op9_license_notices": licenses.notices_sql()}
