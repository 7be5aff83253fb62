"""Change feeds: bursts of changes, snapshot differences and the latest status, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def debounce(changes: DataFrame, quiet_seconds: int, watermark: str | None = None) -> DataFrame:
    """(key, start, end, changes, items) for changes (key, ts, item): a burst ends after so many quiet seconds.

    With a watermark the same plan runs on a stream; later rows than it are dropped.
    """
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    out = rows.groupBy("key", F.session_window("ts", f"{quiet_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.collect_set("item").alias("items"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", F.array_join(F.sort_array("items"), ",").alias("items"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, mark): added, changed or removed."""
    a, b = before.select("path", F.col("mark").alias("old")), after.select("path", F.col("mark").alias("new"))
    rows = a.join(b, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return rows.select("path", change.alias("change")).filter("change IS NOT NULL")


def latest(status: DataFrame) -> DataFrame:
    """The newest row of each key of status (key, seq, ...)."""
    rest = [c for c in status.columns if c != "key"]
    return status.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_row")).select("key", "_row.*")


def transitions(events: DataFrame) -> DataFrame:
    """(src, dst, n) of consecutive items of each key by (ts, seq)."""
    following = F.lead("item").over(W.partitionBy("key").orderBy("ts", "seq"))
    return events.select(F.col("item").alias("src"), following.alias("dst")).filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
