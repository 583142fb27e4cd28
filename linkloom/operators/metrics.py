"""Blocking recall, macro F0.5, threshold grids and the report on cleaned true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assign

PAIR = ["s1_rid", "src", "cand_rid"]


def recall(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_truth, n_hit, recall."""
    t = truth.select(*PAIR).distinct().join(cands.select(*PAIR).distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    return t.agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_hit")).withColumn("recall", F.try_divide("n_hit", "n_truth"))


def f05(matched: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1_rid, n_truth, n_pred, hit, f05) for every record of source 1: 1 if neither has pairs, 0 if only one has."""
    both = truth.select(*PAIR).distinct().withColumn("t", F.lit(1)).join(matched.select(*PAIR).distinct().withColumn("m", F.lit(1)), PAIR, "full")
    n = both.groupBy("s1_rid").agg(F.count("t").alias("n_truth"), F.count("m").alias("n_pred"), F.count_if(F.col("t").isNotNull() & F.col("m").isNotNull()).alias("hit"))
    d = s1.select(F.col("rid").alias("s1_rid")).join(n, "s1_rid", "left").na.fill(0, ["n_truth", "n_pred", "hit"])
    score = F.when((F.col("n_truth") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("hit") == 0, 0.0).otherwise(1.25 * F.col("hit") / (0.25 * F.col("n_truth") + F.col("n_pred")))
    return d.withColumn("f05", score)


def macro_f05(matched: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    return f05(matched, truth, s1).agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n_s1"))


def threshold_grid(scored: DataFrame, truth: DataFrame, s1: DataFrame, thresholds: list[float], by: str = "score") -> DataFrame:
    """(threshold, macro_f05) in one aggregation: owners once, then each owned pair counts at the thresholds it reaches."""
    own = assign.one_owner(scored, by).select(*PAIR, by).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "left")
    per = own.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: x <= F.col(by)))).groupBy("s1_rid", "threshold").agg(F.count(F.lit(1)).alias("n_pred"), F.count("t").alias("hit"))
    n = truth.select(*PAIR).distinct().groupBy("s1_rid").agg(F.count(F.lit(1)).alias("n_truth"))
    every = s1.select(F.col("rid").alias("s1_rid")).join(n, "s1_rid", "left").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    d = every.join(per, ["s1_rid", "threshold"], "left").na.fill(0, ["n_truth", "n_pred", "hit"])
    score = F.when((F.col("n_truth") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("hit") == 0, 0.0).otherwise(1.25 * F.col("hit") / (0.25 * F.col("n_truth") + F.col("n_pred")))
    return d.groupBy("threshold").agg(F.avg(score).alias("macro_f05"))


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select(*PAIR).distinct().withColumn("label", F.lit(1)), PAIR, "left").na.fill(0, ["label"])


def clean_report(truth: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """One row: the shares of true pairs that agree after cleaning."""
    from .features import with_records

    p = with_records(truth.select(*PAIR), s1, s23, ["name_core", "name_compact", "addr_numbers", "addr_clean"])
    share = lambda a, b: F.avg((F.size(F.array_intersect(a, b)) > 0).cast("double"))
    words = lambda c: F.split(c, " ")
    return p.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("name_core_1") == F.col("name_core_2")).cast("double")).alias("name_core_equal"),
        F.avg((F.col("name_compact_1") == F.col("name_compact_2")).cast("double")).alias("name_compact_equal"),
        share(words("name_core_1"), words("name_core_2")).alias("share_name_token"), share(F.col("addr_numbers_1"), F.col("addr_numbers_2")).alias("share_addr_number"),
        share(words("addr_clean_1"), words("addr_clean_2")).alias("share_addr_token"),
    )
