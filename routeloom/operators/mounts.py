"""Full paths of routes under mounted routers: prefixes composed along the mount tree by pointer doubling.

A router has a row for each place it is mounted at (router, parent, framework, pattern); one that is mounted nowhere has a null
parent. Each round joins what a row has collected with what the row it points to has, so chains of any depth take a number of
rounds that grows with its logarithm; the patterns on the way stay lists, which join in any order, and are put together once
at the end by the framework's rule. Routers on a circle of mounts, and those only mounted below one, have no path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged


def joined(framework: Column, prefix: Column, pattern: Column) -> Column:
    """A pattern under a prefix by the rule of its framework; others put them side by side."""
    cut = F.when(prefix.endswith("/"), F.substring(prefix, F.lit(1), F.length(prefix) - 1)).otherwise(prefix)
    bare = F.when(pattern.startswith("/"), F.substring(pattern, F.lit(2), F.length(pattern))).otherwise(pattern)
    chi = F.when((pattern == "/") & (prefix != ""), prefix).otherwise(F.concat(cut, pattern))
    gin = F.when(pattern == "", F.when(prefix == "", "/").otherwise(prefix)).otherwise(F.concat(cut, F.lit("/"), bare))
    return F.when(framework == "chi", chi).when(framework == "gin", gin).otherwise(F.concat(prefix, pattern))


def prefixes(mounts: DataFrame) -> DataFrame:
    """(router, framework, prefix) for every way from a top router to a router of mounts (router, parent, framework, pattern).

    A null pattern is a mount without a path of its own.
    """
    rows = mounts.select("router", "framework", F.col("parent").alias("up"), F.array_compact(F.array("pattern")).alias("patterns"))
    rows = staged(rows, "mounts")
    for _ in range(math.ceil(math.log2(max(2, rows.select("router").distinct().count()))) + 1):
        if rows.filter("up IS NOT NULL").isEmpty():
            break
        above = rows.select(F.col("router").alias("up"), F.col("up").alias("_up"), F.col("patterns").alias("_above"))
        open_ = rows.filter("up IS NOT NULL").join(above, "up").select("router", "framework", F.col("_up").alias("up"), F.concat("_above", "patterns").alias("patterns"))
        rows = staged(rows.filter("up IS NULL").union(open_), "mounts")
    prefix = F.aggregate("patterns", F.lit(""), lambda p, x: joined(F.col("framework"), p, x))
    return rows.filter("up IS NULL").select("router", "framework", prefix.alias("prefix"))


def mounted(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """routes (router, ..., pattern) with path, once for every way to their router."""
    return routes.join(prefixes(mounts), "router").withColumn("path", joined(F.col("framework"), F.col("prefix"), F.col("pattern"))).drop("framework", "prefix")
