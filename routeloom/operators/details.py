"""Lookups, lists and details over an application graph: rows in source order, full counts beside capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import search
from .store import GraphError

POSITION = ("file", "start_line", "start_col", "id")
ROUTE_ORDER = ("file", "start_line", "id")


class NotFound(GraphError):
    """No node has the id."""


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of an id; raises NotFound."""
    found = nodes.filter(F.col("id") == node_id)
    if found.isEmpty():
        raise NotFound(f"no node {node_id}")
    return found


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with name and kind of their nodes, and whether there is one."""
    return ids.join(nodes.select("id", "kind", "name"), "id", "left").select("id", "kind", "name", F.col("kind").isNotNull().alias("found"))


def edges_by_id(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges of ids (id), each once."""
    return edges.join(ids.select("id").distinct(), "id", "left_semi")


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(node, at, kind, other, name and all of the edge): far ends of every node, numbered in source order."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    own = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    own = own.withColumnRenamed("id", "edge").withColumnRenamed(near, "node").withColumnRenamed(far, "other")
    rank = F.row_number().over(W.partitionBy("node").orderBy("file", "start_line", "start_col", "edge"))
    names = nodes.select(F.col("id").alias("other"), "name", F.col("kind").alias("other_kind"))
    return own.withColumn("at", rank).join(names, "other")


def first_in_order(rows: DataFrame, keys: list[str], value: str, most: int, order: tuple[str, ...] = ("file", "start_line", "start_col", "edge")) -> DataFrame:
    """(keys, n, first): how many rows each key has, and the values of the first so many in order, joined by commas.

    Ranks stop at the limit before the lists are made, so a key with very many rows makes no long list.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    listed = rows.withColumn("_at", rank).filter(F.col("_at") <= most).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]), ",").alias("first"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(listed, keys)


def node_detail(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, dir, kind, n, first): neighbours of every node by direction and kind of edge, in source order."""
    e = edges.withColumnRenamed("id", "edge")
    out = e.select(F.col("src").alias("node"), F.lit("out").alias("dir"), "kind", F.col("dst").alias("other"), "file", "start_line", "start_col", "edge")
    into = e.select(F.col("dst").alias("node"), F.lit("in").alias("dir"), "kind", F.col("src").alias("other"), "file", "start_line", "start_col", "edge")
    return first_in_order(out.union(into), ["node", "dir", "kind"], "other", most)


def page_detail(pages: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """Routes and pages (id, access, middleware) with what they render, request, load and lead to, and what leads to them."""
    e = edges.withColumnRenamed("id", "edge")
    out = e.filter(F.col("kind").isin("renders", "requests", "loads", "navigates_to")).select(F.col("src").alias("node"), "kind", F.col("dst").alias("other"), "file", "start_line", "start_col", "edge")
    into = e.filter("kind = 'navigates_to'").select(F.col("dst").alias("node"), F.lit("reached_from").alias("kind"), F.col("src").alias("other"), "file", "start_line", "start_col", "edge")
    lists = first_in_order(out.union(into), ["node", "kind"], "other", most).groupBy("node").pivot("kind", ["renders", "requests", "loads", "navigates_to", "reached_from"]).agg(F.first("first"))
    return pages.select("id", "access", "middleware").join(lists, F.col("id") == F.col("node"), "left").drop("node").na.fill("", ["renders", "requests", "loads", "navigates_to", "reached_from"])


def table_detail(tables: DataFrame, columns: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """Tables (id, flag) with their columns, what they refer to, what refers to them, what queries them, and whether they are inferred."""
    e = edges.withColumnRenamed("id", "edge")
    fk, own = e.filter("kind = 'fk'"), ("file", "start_line", "start_col", "edge")
    parts = fk.select(F.col("src").alias("id"), F.lit("fk_out").alias("part"), F.col("dst").alias("value"), *own)
    parts = parts.union(fk.select("dst", F.lit("fk_in"), "src", *own))
    parts = parts.union(e.filter("kind = 'queries'").select("dst", F.lit("used_by"), F.concat_ws(" ", "op", "src"), *own))
    parts = parts.union(columns.select("table", F.lit("columns"), F.concat_ws(" ", "name", "type"), "file", "start_line", F.lit(0), F.lit(0).cast("long")))
    names = ["columns", "fk_out", "fk_in", "used_by"]
    lists = first_in_order(parts, ["id", "part"], "value", most).groupBy("id").pivot("part", names).agg(F.first("first"))
    return tables.select("id", (F.col("flag") == "true").alias("inferred")).join(lists, "id", "left").na.fill("", names)


def capped_routes(routes: DataFrame, method: str, name: str, most: int = 200) -> DataFrame:
    """(at, id, total): the first so many routes in order whose method and name fit, with the count of all that do."""
    fit = routes.filter((F.lower("method") == method.lower()) & F.lower("name").contains(name.lower()))
    first = fit.orderBy(*ROUTE_ORDER).limit(most)
    at = F.row_number().over(W.orderBy(*ROUTE_ORDER))  # over the capped rows only
    return first.withColumn("at", at).crossJoin(F.broadcast(fit.agg(F.count(F.lit(1)).alias("total")))).select("at", "id", "total")


def route_projection(routes: DataFrame) -> DataFrame:
    """Routes with their variants and middleware as arrays."""
    parts = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    return routes.select("id", "method", "name", parts(F.col("variants"), r"\s+").alias("variants"), parts(F.col("middleware"), ",").alias("middleware"))


def entry_list(entries: DataFrame) -> DataFrame:
    """Entries in source order: jobs under their parent's name, the detail in brackets."""
    name = F.when(F.col("parent") != "", F.concat_ws(" > ", "parent", "name")).otherwise(F.col("name"))
    name = F.concat(name, F.when(F.col("detail") != "", F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))).otherwise(""))
    return entries.select("id", F.col("method").alias("entry_kind"), name.alias("name"), "file", "start_line").orderBy(*ROUTE_ORDER)


def without_packages(nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Nodes of no package that is one of the prefixes or below it."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | (F.col("package") == p) | F.col("package").startswith(p + "/")
    return nodes.filter(~inside)


def routes_by_table(uses: DataFrame, table: str, op: str | None = None) -> DataFrame:
    """Routes that touch a table, with an op if one is given, from uses (route, tbl, op)."""
    rows = uses.filter(F.col("tbl") == table)
    return (rows.filter(F.col("op") == op) if op else rows).select("route", "op").distinct()


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): counts of nodes and edges by kind, and of packages; the largest first, then by kind."""
    count = lambda rows, part: rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    packages = nodes.filter("package <> ''").agg(F.countDistinct("package").alias("n")).select(F.lit("packages"), F.lit(""), "n")
    return count(nodes, "nodes").union(count(edges, "edges")).union(packages).orderBy("part", F.desc("n"), "kind")


def call_sites(edges: DataFrame) -> DataFrame:
    """(src, dst, calls, place): callees of every caller once, with the number of call sites, numbered by the first of them."""
    own = edges.filter("kind = 'calls'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("calls"), F.min(F.struct("file", "start_line", "start_col", "id")).alias("first"))
    return own.withColumn("place", F.row_number().over(W.partitionBy("src").orderBy("first"))).select("src", "dst", "calls", "place")


def parallel_order(steps: DataFrame) -> DataFrame:
    """steps (parent, seq, parallel, branch) with place: a parallel group stands where its first step does.

    In it branches that are numbers come first, in their order, then the others as text; equal ones stay in sequence.
    """
    group = F.when(F.col("parallel") == "", F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(F.col("parallel"))
    first = F.min("seq").over(W.partitionBy("parent", "_group"))
    number = F.col("branch").try_cast("int")
    order = ["_first", number.asc_nulls_last(), F.when(number.isNull(), F.col("branch")).asc_nulls_first(), "seq"]
    rows = steps.withColumn("_group", group).withColumn("_first", first)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("parent").orderBy(*order))).drop("_group", "_first")


def resolve_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, at, src, dst, kind) of paths (path, ids): the edges of each in the order of its ids."""
    steps = paths.select("path", F.posexplode("ids").alias("at", "id"))
    return steps.join(edges.select("id", "src", "dst", "kind"), "id").select("path", "at", "src", "dst", "kind")


def resolve(nodes: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """(name, status, id, candidates, more) for distinct names (name): a node's id, or that there is none or more than one.

    First the exact id, then the id with a kind in front, in a fixed order. Else the first most + 1 nodes of a search for the
    text: one is it; of several, the only one whose id ends with the text; else the first most are named as candidates, and
    more says that there are others.
    """
    exact = search.resolve(nodes, names).select("name", F.col("id").alias("exact"))
    open_ = names.join(exact, "name", "left_anti").select(F.col("name").alias("query"), F.col("name").alias("text"))
    found = search.search_all(search.build(nodes), open_, most + 1)
    ends = F.col("id").endswith(F.col("query"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "id")))  # most + 1 at the longest
    found = found.groupBy("query").agg(F.transform(listed, lambda x: x["id"]).alias("ids"), F.count_if(ends).alias("ends"), F.min(F.when(ends, F.col("id"))).alias("end"))
    rows = names.join(exact, "name", "left").join(found, F.col("name") == F.col("query"), "left")
    one = F.coalesce("exact", F.when(F.size("ids") == 1, F.col("ids")[0]), F.when(F.col("ends") == 1, F.col("end")))
    status = F.when(one.isNotNull(), "found").when(F.size("ids") > 1, "ambiguous").otherwise("not found")
    unclear = status == "ambiguous"
    return rows.select("name", status.alias("status"), one.alias("id"), F.when(unclear, F.array_join(F.slice("ids", 1, most), ",")).alias("candidates"), F.when(unclear, F.size("ids") > most).alias("more"))


def type_neighborhood(types: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(seed, id, at): types around every seed (seed, id): itself or those a function uses, what these use, and what implements or is implemented.

    In the order found, the first so many of each seed.
    """
    uses, impl = edges.filter("kind = 'uses_type'"), edges.filter("kind = 'implements'")
    level = types.select("seed", "id", F.array(F.lit(0).cast("long")).alias("way"))

    def grow(rows: DataFrame, steps: DataFrame, mark: int) -> DataFrame:
        more = rows.join(steps, "id").select("seed", F.col("to").alias("id"), F.concat(F.array(F.lit(mark).cast("long")), "way", F.array("turn")).alias("way"))
        both = rows.select("seed", "id", F.concat(F.array(F.lit(0).cast("long")), "way").alias("way")).union(more)
        return both.groupBy("seed", "id").agg(F.min("way").alias("way"))

    turn = F.row_number().over(W.partitionBy("id").orderBy("dir", "file", "start_line", "start_col", "edge")).cast("long").alias("turn")
    own = ("file", "start_line", "start_col", F.col("id").alias("edge"))
    out = lambda e: e.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(0).alias("dir"), *own)
    into = impl.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(1).alias("dir"), *own)
    found = grow(level, out(uses).select("id", "to", turn), 1)
    found = grow(found, out(impl).union(into).select("id", "to", turn), 1)
    at = F.row_number().over(W.partitionBy("seed").orderBy("way", "id"))
    return found.withColumn("at", at).filter(F.col("at") <= most).select("seed", "id", "at")
