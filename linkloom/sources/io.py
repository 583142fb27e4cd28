"""Files: tab-separated sources and results, clean records, configuration and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
CLEAN_COLUMNS = ["rid", "entity_id", "src", "country", "business_name", "business_address", "name_clean", "name_core", "name_compact", "name_skel", "legal_form", "is_web", "name_nonlatin", "addr_clean", "addr_numbers", "postcode", "is_landmark", "addr_missing"]


def source_path(root: str, split: str, n: int) -> str:
    return f"{root}/{split}/{split}_source{n}.tsv"


def truth_path(root: str) -> str:
    return f"{root}/train/train_ground_truth.tsv"


def clean_path(work: str, split: str, n: int) -> str:
    return f"{work}/{split}_s{n}.parquet"


def pairs_path(work: str) -> str:
    return f"{work}/train_pairs.parquet"


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All strings, no quoting; raises unless the header is just these columns."""
    head = spark.read.text(path).first()
    if head is None or head[0].rstrip("\r").split("\t") != columns:
        raise ValueError(f"{path}: expected the columns {columns}, found {head and head[0]!r}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_source(spark: SparkSession, path: str, src: int) -> DataFrame:
    """A raw source with src and rid, the row's number from 0 in file order."""
    raw = read_tsv(spark, path, SOURCE_COLUMNS)
    schema = T.StructType([*raw.schema.fields, T.StructField("rid", T.LongType())])
    # No DataFrame function numbers rows in file order without gaps and without sorting everything in one task.
    df = spark.createDataFrame(raw.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    country = F.regexp_replace(F.coalesce("country", F.lit("UNKNOWN")), r"(?U)^\s+|\s+$", "")
    return df.select("rid", "entity_id", F.lit(src).cast("byte").alias("src"), country.alias("country"), F.coalesce("business_name", F.lit("")).alias("business_name"), "business_address")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, cand_id), one row per match."""
    t = read_tsv(spark, path, ["source1_entity_id", "matched_entity_ids"])
    return split_ids(t)


def split_ids(t: DataFrame) -> DataFrame:
    ids = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return t.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("cand_id")).where("cand_id <> ''")


def truth_pairs(truth: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """(s1_rid, src, cand_rid); raises if an id of the truth is unknown or stands for several records."""
    p = truth.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("rid").alias("s1_rid")), "s1_id").join(s23.select(F.col("entity_id").alias("cand_id"), "src", F.col("rid").alias("cand_rid")), "cand_id").select("s1_rid", "src", "cand_rid")
    if (a := truth.count()) != (b := p.count()):
        raise ValueError(f"{a} true pairs, but {b} after looking up their ids")
    return p


def write_clean(df: DataFrame, path: str) -> None:
    df.select(*CLEAN_COLUMNS).write.mode("overwrite").partitionBy("country").parquet(path)


def read_clean(spark: SparkSession, path: str, columns: list[str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """Clean records; only the asked columns and countries are read. Folders have no empty name, so an empty country is
    written as null and becomes empty again; a stated type keeps country 01 from becoming the number 1."""
    schema = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField("country", T.StringType()) if f.name == "country" else f for f in schema])
    df = spark.read.schema(schema).option("basePath", path).parquet(path).withColumn("country", F.coalesce("country", F.lit("")))
    df = df.where(F.col("country").isin(countries)) if countries else df
    return df.select(*columns) if columns else df


def countries(s1: DataFrame) -> DataFrame:
    return s1.select("country").distinct().orderBy("country")


def write_tsv(df: DataFrame, path: str, order: str | None = None, files: int = 1) -> None:
    """Tab-separated without quotes; an empty string is an empty field."""
    out = df.repartitionByRange(files, order).sortWithinPartitions(order) if order else df
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small configuration, as one line of text in a folder that Spark can reach."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()[0])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
