"""Migration folders as tables of files (path, text): which files count, their order, and the schema they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The folders that are searched.
DIRS = ("migrations", "db/migrations", "sql/migrations", "internal/migrations", "schema")


def read_files(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """(path, text) of all matching files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def folder(path: Column) -> Column:
    """Folder of a path."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def in_default_dirs(path: Column) -> Column:
    """Whether a file lies in one of the folders searched by default."""
    return folder(path).rlike("(^|/)(" + "|".join(DIRS) + ")$")


def up_files(files: DataFrame) -> DataFrame:
    """Files that build the schema: of a folder with *.up.sql those, else all *.sql but *.down.sql."""
    up = files.filter(F.col("path").endswith(".up.sql"))
    plain = files.filter(F.col("path").endswith(".sql") & ~F.col("path").endswith(".down.sql") & ~F.col("path").endswith(".up.sql"))
    has_up = up.select(folder(F.col("path")).alias("_dir")).distinct()
    return up.unionByName(plain.join(has_up, folder(F.col("path")) == F.col("_dir"), "left_anti"))


def versioned(files: DataFrame) -> DataFrame:
    """Adds version (parts as numbers) to V and R files of folders that hold no other ones, and drops U files; else version is empty.

    Null version: repeatable, to be run last by name. A folder with a file of another form is run by name.
    """
    name = file_name(F.col("path"))
    kind, digits = F.substring(name, 1, 1), F.regexp_extract(name, r"^[VU]([0-9]+(?:[._][0-9]+)*)__", 1)
    fits = name.rlike(r"^([VU][0-9]+([._][0-9]+)*|R)__.*\.sql$")
    stray = files.filter(~fits).select(folder(F.col("path")).alias("_dir"), F.lit(True).alias("_stray")).distinct()
    rows = files.withColumn("_dir", folder(F.col("path"))).join(stray, "_dir", "left")
    version = F.when(F.col("_stray"), F.array().cast("array<bigint>")).when(kind == "V", F.transform(F.split(digits, "[._]"), lambda p: p.cast("long")))
    return rows.filter(F.col("_stray").isNotNull() | (kind != "U")).withColumn("version", version).drop("_dir", "_stray")


# Folders that hold no sources.
SKIPPED = ("target", "node_modules", "build", "out")


def flyway_dirs(files: DataFrame) -> DataFrame:
    """(dir) of files (path): migration folders of modules, or those below them that hold files, of which one for postgres goes alone.

    Hidden and build folders are skipped.
    """
    rows = files.filter(F.col("path").endswith(".sql")).select(folder(F.col("path")).alias("dir")).distinct()
    base = F.regexp_extract("dir", r"^((?:.*/)?src/main/resources/db/migration)(?:/[^/]+)?$", 1)
    skip = F.exists(F.split("dir", "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED))
    rows = rows.withColumn("base", base).filter((F.col("base") != "") & F.col("base").contains("/src/") & ~skip)
    rank = F.when(F.col("dir") == F.col("base"), 0).when(F.lower(file_name(F.col("dir"))).startswith("postgres"), 1).otherwise(2)
    rows = rows.withColumn("rank", rank)
    best = rows.groupBy("base").agg(F.min("rank").alias("best"), F.min(F.when(F.col("rank") == 1, F.col("dir"))).alias("first"))
    return rows.join(best, "base").filter((F.col("rank") == F.col("best")) & ((F.col("best") != 1) | (F.col("dir") == F.col("first")))).select("dir")


def run_order() -> list[Column]:
    """Sort keys of versioned files."""
    return [F.col("version").asc_nulls_last(), file_name(F.col("path")).asc()]


def up_lines(files: DataFrame) -> DataFrame:
    """(path, line, text): lines from 1, blank from a Down mark up to the next Up mark, so that numbers stay true."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x: F.when(x.rlike(r"^\s*--\s*\+goose\s+Down\b"), 0).when(x.rlike(r"^\s*--\s*\+goose\s+Up\b"), 1))
    step = lambda acc, m: F.concat(acc, F.array(F.coalesce(m, F.element_at(acc, -1))))
    state = F.aggregate(marked, F.array(F.lit(1)), step)
    kept = F.transform(lines, lambda x, i: F.when(F.get(state, i + 1) == 1, x).otherwise(""))
    return files.select("path", F.posexplode(kept).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def replay(changes: DataFrame) -> DataFrame:
    """(tbl, column) that exist after all changes (tbl, seq, op, column), op: create, add, drop or drop_table.

    A create has one row for each column, all of one seq; it counts only if the table doesn't exist. Changes of a table
    that doesn't exist have no effect. Aggregates of partial results only, so a table with very many changes costs no sort.
    """
    dropped = changes.filter("op = 'drop_table'").groupBy("tbl").agg(F.max("seq").alias("gone"))
    alive = changes.join(dropped, "tbl", "left").filter("op <> 'drop_table' AND (gone IS NULL OR seq > gone)").drop("gone")
    made = alive.filter("op = 'create'").groupBy("tbl").agg(F.min("seq").alias("made"))
    valid = alive.join(made, "tbl").filter("seq = made OR (seq > made AND op <> 'create')")
    last = valid.groupBy("tbl", "column").agg(F.max_by("op", "seq").alias("op"))
    return last.filter("op <> 'drop'").select("tbl", "column")
