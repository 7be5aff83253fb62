"""Tables written between rounds of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share; it is not made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="spark-round-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the folder that all executors share and reads it back, so that plans stay short and lost executors cost little."""
    spark = df.sparkSession
    out = folder(spark, label)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)
