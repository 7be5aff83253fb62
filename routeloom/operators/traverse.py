"""Closures, simple paths and backward reach over edge tables, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged


def runs(methods: Column, branches: Column, method: Column) -> Column:
    """Whether a call happens in a flow of an HTTP method: unrestricted, listed, or the rest of a caller's branches."""
    listed = F.split(methods, ",")
    return (methods == "") | method.isin("", "ANY") | F.array_contains(listed, method) | (F.array_contains(listed, "*") & ~F.array_contains(F.split(branches, ","), method))


def closure(seeds: DataFrame, edges: DataFrame, keep: Column | None = None, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): all nodes reached from seeds (root, node, ...) over edges (src, dst, ...), with the least depth.

    Each round joins the last level with the edges and drops pairs that are known. Extra seed columns, such as the flow's
    method, go along and may be used by keep, which decides whether an edge is followed.
    """
    edges = staged(edges, "edges")  # read once for each level, derived once
    extra = [c for c in seeds.columns if c not in ("root", "node")]
    found = level = staged(seeds.distinct().withColumn("depth", F.lit(0)), "level")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.drop("depth").join(edges, F.col("node") == F.col("src"))
        step = (step.filter(keep) if keep is not None else step).select("root", F.col("dst").alias("node"), *extra).distinct()
        level = staged(step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def paths(pairs: DataFrame, edges: DataFrame, depth: int = 10, limit: int = 10) -> DataFrame:
    """(source, target, hops, ids): for each pair the first simple paths by number of edges, then by edge ids as text.

    First a backward search gives each node's distance to the target. The forward walk keeps only steps from which the target
    can still be reached in time, and a pair is done once a level has completed enough paths.
    """
    edges = staged(edges.select("src", "dst", "id"), "edges")
    pairs = staged(pairs.select("source", "target").filter("source <> target").distinct(), "pairs")
    back = closure(pairs.select(F.col("target").alias("root"), F.col("target").alias("node")).distinct(), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth=depth)
    near = staged(back.groupBy("root", "node").agg(F.min("depth").alias("left")), "near")
    walk = pairs.select("source", "target", F.col("source").alias("node"), F.array("source").alias("seen"), F.lit("").alias("ids"))
    done = None
    for hops in range(1, depth + 1):
        step = walk.join(edges.select("src", "dst", "id"), F.col("node") == F.col("src"))
        step = step.filter(~F.array_contains("seen", F.col("dst"))).join(near, (F.col("target") == F.col("root")) & (F.col("dst") == near.node)).filter(F.col("left") + hops <= depth)
        step = step.select("source", "target", F.col("dst").alias("node"), F.array_append("seen", F.col("dst")).alias("seen"), F.concat("ids", F.col("id").cast("string"), F.lit(",")).alias("ids"))
        step = staged(step, "walk")
        ended = step.filter("node = target").select("source", "target", F.lit(hops).alias("hops"), "ids")
        done = ended if done is None else done.union(ended)
        full = done.groupBy("source", "target").count().filter(F.col("count") >= limit).select("source", "target")
        walk = step.filter("node <> target").join(full, ["source", "target"], "left_anti")
        if walk.isEmpty():
            break
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("source", "target").orderBy("hops", "ids"))
    return done.withColumn("_n", rank).filter(F.col("_n") <= limit).drop("_n")


def raise_to_fixpoint(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rank): the highest rank of a node and of all that it calls, from rows (node, rank) and edges (src, dst)."""
    edges = staged(edges.select("src", "dst"), "edges")
    found = staged(rows.groupBy("node").agg(F.max("rank").alias("rank")), "ranks")
    level = found
    while True:
        step = level.join(edges, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.max("rank").alias("rank"))
        known = found.select(F.col("node").alias("_node"), F.col("rank").alias("_rank"))
        level = staged(step.join(known, F.col("node") == F.col("_node"), "left").filter("_rank IS NULL OR rank > _rank").select("node", "rank"), "raised")
        if level.isEmpty():
            return found
        found = staged(found.union(level).groupBy("node").agg(F.max("rank").alias("rank")), "ranks")
