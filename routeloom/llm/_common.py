"""What the operators of this subpackage share: staged tables, sized rows and byte-exact word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and Spark is local, a new temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)  # paths of the innermost stage_alone


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor costs no recomputation of it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (staged := _staged.get()) is not None:
        staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stages what make returns, then deletes the tables that make staged on the way: the result is read from its own."""
    mark = _staged.set([])
    try:
        made = make()
        spent = list(_staged.get())
    finally:
        _staged.reset(mark)
    result = stage(made, label)
    for path in spent:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return result


def sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A staged df, marked for sending to all executors if it has at most so many rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions set for this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
