"""From raw documents to packed sequences, in five stages, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the documents that stay, all columns as they were; the last returns
the pieces of the packed sequences. Every stage gives an empty table for an empty one, takes whole texts, however long,
and leaves extra columns as they are, whatever their names; a null or empty text has no words, no lines to lose, no
shingles, and one token, the end id. What each stage does with such rows, ties and repeated rows stands at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import common, line_dedup, mixing, pack_kk, quality_rules, shingle_minhash, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules keep (quality_rules). Null and empty texts fail the base rule; rows that are
    equal fare alike; a score that equals its cutoff passes; without labels the base rule alone rejects."""
    return quality_rules.keep_good(docs, common.read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats (line_dedup); n_chars follows the text. No row goes: a document
    whose lines all go has an empty text, a null text stays null; rows with equal id and text are one document."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class by SimHash (simhash_anchor) or by five-word shingles (shingle_minhash): the smallest id,
    null last; of equal ids the smallest text hash; of equal rows one. Texts without words are one class."""
    return shingle_minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected token shares are the tempered targets, to half a percent (mixing). Rows that share id and
    cell are drawn together; cells without tokens give none."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (pack_kk); repeated rows are packed as often as they occur."""
    p = pack_kk.pack(docs, tokens.default_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", sequences)]

#: SQL has neither SimHash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
