"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a temporary one if the whole application
    is a single process; on several machines a local folder would lose data, so that raises."""
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="linkloom-"))
    return f"{base}/linkloom-{app}"


def keep(df: DataFrame, tag: str = "t", schema: StructType | None = None) -> DataFrame:
    """df, written into the folder and read again: computed once, and its lineage ends there. schema: to read it by, where
    a column is of a type that Spark stores as another."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's folder; DataFrames that still read from it can no longer be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
