"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_preference, common, embed_cross_polytope, line_dedup, mixing, pack_bfd, pack_kk, pii_feistel, quality_rules, simhash_anchor, token_counts, tokens


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    t = common.read(spark, sf_dir, "conversations")
    return chat_preference.preferences(t, F.expr("cast(floor(conv_id / 2) as bigint)"), F.expr("conv_id % 2 = 0"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_cross_polytope.near_vectors(common.read(spark, sf_dir, "embeddings"))


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_rules.verdicts(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return v.select(F.col("__id").alias("doc_id"), *quality_rules.COUNTS, "base_failed", "kept")


def op1_best_fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bfd.pack(common.read(spark, sf_dir, "documents"), tokens.default_path())


def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_deletion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"), count_cols=True)


def op7_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchor.near_duplicates(common.read(spark, sf_dir, "documents"))


def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.probabilities(common.read(spark, sf_dir, "documents"))
    return p.select(F.col("__id").alias("doc_id"), *mixing.TAU, "n_tokens", "p", "sampled")


def op9_differencing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack_kk.pack(common.read(spark, sf_dir, "documents"), tokens.default_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the text in the file that spark.linkloom.pseudonym.keyFile names; a demonstration key where that is unset."""
    path = spark.conf.get("spark.linkloom.pseudonym.keyFile", None)
    return pii_feistel.pseudonymise(common.read(spark, sf_dir, "documents"), spark.read.text(path, wholetext=True) if path else "a demonstration key")


QUERIES = {f.__name__: f for f in (op1_best_fit_matrix, op2_trie_token_counts, op3_preference_pairs, op4_cross_polytope, op5_risk_controlled_rules, op6_deletion_lines, op7_anchor_simhash, op8_raked_mixture, op9_differencing_windows, op10_feistel_pseudonyms)}
ORACLES = {"op3_preference_pairs": chat_preference.ORACLE, "op5_risk_controlled_rules": quality_rules.oracle(), "op6_deletion_lines": line_dedup.ORACLE, "op8_raked_mixture": mixing.oracle()}
