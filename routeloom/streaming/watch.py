"""Changes of a project's files, from listings of its folder: each scan is a table of paths with size and time.

Scans are appended to a folder as they are made and read as a stream. State is kept by path: the last scan that had it, and its
size and time then. A path that a later scan lists anew or with another size or time is added or changed at once. One that is
missing sends no row, so its state waits for the event time of its scan to pass the watermark, which the next scan brings, and
then says removed. The first scan is the base and changes nothing. State and offsets are in the stream's checkpoint, so a
restarted stream goes on where it was; no folder is held in one task.

Defined results: scans are numbered from one without gaps, each with its time; a null path is no file; a path listed twice in a
scan counts once, by its greatest size and time; an empty scan removes all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LISTING = "scan long, ts timestamp, path string, size long, modified timestamp"
CHANGES = "path string, scan long, change string, ts timestamp"
# What a project's analysis reads, and the folders that it never enters.
SUFFIXES = {"go": ("go", "html", "tmpl", "gohtml", "sql"), "scala": ("scala", "sbt", "sql")}
NAMES = {"go": ("go.mod", "go.sum", "icb.yaml"), "scala": ("build.properties", "icb.yaml")}
SKIPPED = {"go": ("node_modules", "testdata", "vendor"), "scala": ("node_modules", "testdata", "target")}
SKIPPED_ENDS = {"go": (), "scala": ("src/test", "src/it")}


def relevant(path: Column, lang: str = "go") -> Column:
    """Whether a file, by its path relative to the project, can change the analysis."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(folders, lambda f: f.startswith(".") & (f != "."))
    skipped = F.exists(folders, lambda f: f.isin(*SKIPPED[lang])) | hidden
    for end in SKIPPED_ENDS[lang]:
        skipped = skipped | F.concat(F.lit("/"), path).contains(f"/{end}/")
    suffix = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    return (path == ".git/HEAD") | (~skipped & (suffix.isin(*SUFFIXES[lang]) | name.isin(*NAMES[lang])))


def listed(spark: SparkSession, root: str, lang: str = "go") -> DataFrame:
    """(path, size, modified) of a project's files that matter, listed by Spark without their contents; .git/HEAD tells of checkouts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    try:
        files = files.union(spark.read.format("binaryFile").load(f"{root}/.git/HEAD"))
    except AnalysisException:  # not a checkout
        pass
    base = F.regexp_replace(F.lit(root), r"^file:/+|/+$", "")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), F.concat(F.lit("^/*\\Q"), base, F.lit("\\E/+")), "")
    files = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(relevant(F.col("path"), lang))


def append_scan(files: DataFrame, scans: str, scan: int, ts: str) -> None:
    """Appends a listing (path, size, modified) to the folder of scans."""
    files.select(F.lit(scan).cast("long").alias("scan"), F.lit(ts).cast("timestamp").alias("ts"), "path", F.col("size").cast("long").alias("size"), "modified").write.mode("append").parquet(scans)


def read_scans(spark: SparkSession, scans: str) -> DataFrame:
    """The scans as a stream."""
    return spark.readStream.schema(LISTING).parquet(scans)


def once(listing: DataFrame) -> DataFrame:
    """A listing with one row for each path of a scan."""
    rows = listing.filter("path IS NOT NULL").groupBy("scan", "path").agg(F.max(F.struct("size", "modified")).alias("m"), F.min("ts").alias("ts"))
    return rows.select("scan", "ts", "path", "m.size", "m.modified")


def changes_of_scans(listing: DataFrame) -> DataFrame:
    """(path, scan, change) of all scans (scan, ts, path, size, modified) in a table: one window over each path's scans."""
    last = listing.agg(F.max("scan").alias("_last"))
    by = W.partitionBy("path").orderBy("scan")
    before = lambda c: F.lag(c).over(by)
    rows = once(listing).withColumns({"_seen": before("scan"), "_next": F.lead("scan").over(by), "_differs": ~(F.col("size").eqNullSafe(before("size")) & F.col("modified").eqNullSafe(before("modified")))})
    rows = rows.crossJoin(F.broadcast(last))  # one row
    here = F.when(F.col("_seen") == F.col("scan") - 1, F.when(F.col("_differs"), "changed")).when(F.col("scan") > 1, "added")
    gone = F.when((F.col("scan") < F.col("_last")) & (F.col("_next").isNull() | (F.col("_next") > F.col("scan") + 1)), "removed")
    rows = rows.select("path", F.explode(F.array(F.struct("scan", here.alias("change")), F.struct((F.col("scan") + 1).alias("scan"), gone.alias("change")))).alias("c"))
    return rows.select("path", "c.scan", "c.change").filter("change IS NOT NULL")


def changes(listing: DataFrame) -> DataFrame:
    """(path, scan, change, ts) of a stream of scans; removed files are told once a later scan has moved the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], held[0] + 1, "removed", pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"))], columns=["path", "scan", "change", "ts"])
            return
        rows = pd.concat(list(batches)).sort_values(["scan", "size", "modified"]).drop_duplicates("scan", keep="last")
        for r in rows.itertuples():
            now = (int(r.scan), int(r.size), int(pd.Timestamp(r.modified).value))
            if held is not None and held[0] < now[0] - 1:
                out.append((key[0], held[0] + 1, "removed", r.ts))
                held = None
            if held is None:
                out += [(key[0], now[0], "added", r.ts)] if now[0] > 1 else []
            elif held[1:] != now[1:]:
                out.append((key[0], now[0], "changed", r.ts))
            held, at = now, r.ts
        state.update(held)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(at).value // 1_000_000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["path", "scan", "change", "ts"]).astype({"scan": "int64", "ts": "datetime64[ns]"})

    rows = listing.filter("path IS NOT NULL").withWatermark("ts", "0 seconds")
    return rows.groupBy("path").applyInPandasWithState(step, CHANGES, "scan long, size long, modified long", "append", "EventTimeTimeout")
