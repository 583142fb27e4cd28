"""From scored pairs to sets: one owner per record, then thresholds or the best expected F0.5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_owner(df: DataFrame, by: str = "score") -> DataFrame:
    """The best record of source 1 for each candidate; ties go to the lower s1_rid."""
    w = Window.partitionBy("src", "cand_rid").orderBy(F.desc(by), "s1_rid")
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def assign_threshold(df: DataFrame, threshold: float, by: str = "score") -> DataFrame:
    """Owners first, then the threshold: what misses it is nobody's."""
    return one_owner(df, by).where(F.col(by) >= threshold)


def assign_expected(df: DataFrame, p: str = "p") -> DataFrame:
    """The set of each record of source 1 with the highest expected F0.5, which may be the empty one.

    The best set of each size holds the most probable pairs, so one walk down a record's sorted pairs (few, as blocking
    bounds them) finds the best size; of equally good sizes the smallest. The empty set's value is the probability that
    the record has no match."""
    best = F.struct(F.col(p).alias("p"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    of = one_owner(df, p).groupBy("s1_rid").agg(F.collect_list(F.struct((-F.col(p)).alias("k"), "src", "cand_rid", best.alias("it"))).alias("of"))
    of = of.select(F.transform(F.array_sort("of"), lambda x: x["it"]).alias("of"))
    sure = lambda x: F.least(F.greatest(x["p"].cast("double"), F.lit(0.0)), F.lit(1 - 1e-9))
    of = of.withColumns({"all": F.aggregate("of", F.lit(0.0), lambda a, x: a + x["p"]), "none": F.exp(F.aggregate("of", F.lit(0.0), lambda a, x: a + F.log(1 - sure(x))))})
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.col("none").alias("value"), F.lit(0).alias("size"))

    def longer(a, x):
        total, n = a["sum"] + x["p"], a["n"] + 1
        value = 1.25 * total / (0.25 * F.col("all") + n)
        return F.struct(total.alias("sum"), n.alias("n"), F.greatest(value, a["value"]).alias("value"), F.when(value > a["value"], n).otherwise(a["size"]).alias("size"))

    size = F.aggregate("of", start, longer)["size"]
    return of.select(F.explode(F.slice("of", F.lit(1), size)).alias("x")).select("x.row.*")


def to_lists(pairs: DataFrame, s1: DataFrame, s23: DataFrame, out: str) -> DataFrame:
    """One row for every record of source 1: its entity id and the sorted, distinct ids of its pairs, joined by commas."""
    ids = pairs.join(s23.select("src", F.col("rid").alias("cand_rid"), F.col("entity_id").alias("_c")), ["src", "cand_rid"])
    lists = ids.groupBy("s1_rid").agg(F.array_join(F.array_sort(F.collect_set("_c")), ",").alias(out))
    return s1.select(F.col("rid").alias("s1_rid"), F.col("entity_id").alias("source1_entity_id")).join(lists, "s1_rid", "left").select("source1_entity_id", F.coalesce(out, F.lit("")).alias(out))
