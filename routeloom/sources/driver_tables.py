"""A code graph derived from order tables by fixed rules, so that another engine can check every query.

route k -> func k (customer), func -> method (order) -> sink.sql (order and supplier) -> sql_table (part); functions call each
other in cycles of five; tables refer to the next part of the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import Graph

ACCESS = {"AUTOMOBILE": "public", "BUILDING": "authenticated", "FURNITURE": "guest", "HOUSEHOLD": "admin"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attrs(**values) -> F.Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _node(df: DataFrame, kind: str, key, name, package, detail, attrs) -> DataFrame:
    zero = F.lit(0)
    return df.select(F.concat(F.lit(kind + ":"), key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), package.alias("package"), detail.alias("detail"), F.lit("").alias("file"), zero.alias("start_line"), zero.alias("start_col"), zero.alias("end_line"), zero.alias("end_col"), attrs.alias("attrs"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes."""
    c, o, li, p = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    k, none = F.col("c_custkey").cast("string"), F.create_map().cast("map<string,string>")
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("ANY")), (F.col("c_custkey") % 3 + 1).cast("int"))
    access = F.lit("public")
    for segment, role in ACCESS.items():
        access = F.when(F.col("c_mktsegment") == segment, role).otherwise(access)
    empty = F.lit("")
    route = _node(c, "route", k, F.concat(method, F.lit(" /customers/"), k), empty, empty, _attrs(method=method, access=access, pattern=F.concat(F.lit("/customers/"), k)))
    func = _node(c, "func", k, F.col("c_name"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")), empty, _attrs(methodBranches=F.lit("GET")))
    order = F.col("o_orderkey").cast("string")
    meth = _node(o, "method", order, F.concat(F.lit("Order"), order), F.lit("orders"), empty, none)
    sink = li.select("l_orderkey", "l_suppkey").distinct()
    sink = _node(sink, "sink.sql", F.concat_ws("_", "l_orderkey", "l_suppkey"), F.concat_ws("_", "l_orderkey", "l_suppkey"), empty, empty, none)
    table = _node(p, "sql_table", F.col("p_partkey").cast("string"), F.col("p_name"), empty, F.col("p_type"), none)
    return route.union(func).union(meth).union(sink).union(table)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges as (src, dst, kind, methods, op); parallel edges of one kind and op are one."""
    c, o, li = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    text = lambda prefix, col: F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))
    empty = F.lit("")
    handled = c.select(text("route", "c_custkey").alias("src"), text("func", "c_custkey").alias("dst"), F.lit("handled_by").alias("kind"), empty.alias("methods"), empty.alias("op"))
    methods = F.when(F.col("o_orderstatus") == "F", "GET").when(F.col("o_orderstatus") == "P", "*").otherwise("")
    calls = o.select(text("func", "o_custkey"), text("method", "o_orderkey"), F.lit("calls"), methods, empty)
    pair = li.withColumn("sink", F.concat_ws("_", "l_orderkey", "l_suppkey"))
    sinks = pair.select(text("method", "l_orderkey"), text("sink.sql", "sink"), F.lit("calls"), empty, empty).distinct()
    op = F.when(F.col("l_returnflag") == "A", "update").when(F.col("l_returnflag") == "R", "delete").otherwise("select")
    queries = pair.select(text("sink.sql", "sink"), text("sql_table", "l_partkey"), F.lit("queries"), empty, op).distinct()
    key = F.col("c_custkey")
    cycle = c.select(key.alias("a"), (key - key % 5 + (key + 1) % 5).alias("b")).join(c.select(key.alias("b")), "b").filter("a <> b")
    cycle = cycle.select(text("func", "a"), text("func", "b"), F.lit("calls"), empty, empty)
    following = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    fk = li.select("l_partkey", following.alias("next")).filter("next IS NOT NULL AND next <> l_partkey").select(text("sql_table", "l_partkey"), text("sql_table", "next"), F.lit("fk"), empty, empty).distinct()
    return handled.union(calls).union(sinks).union(queries).union(cycle).union(fk)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph."""
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


SQL = """
nodes AS (
 SELECT 'route:' || c_custkey AS id, 'route' AS kind, ['GET','POST','ANY'][(c_custkey % 3 + 1)::INT] || ' /customers/' || c_custkey AS name, '' AS package, '' AS detail,
        ['GET','POST','ANY'][(c_custkey % 3 + 1)::INT] AS method, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'public' WHEN 'BUILDING' THEN 'authenticated' WHEN 'FURNITURE' THEN 'guest' WHEN 'HOUSEHOLD' THEN 'admin' ELSE 'public' END AS access, '' AS branches FROM customer
 UNION ALL SELECT 'func:' || c_custkey, 'func', c_name, 'nation' || c_nationkey, '', '', '', 'GET' FROM customer
 UNION ALL SELECT 'method:' || o_orderkey, 'method', 'Order' || o_orderkey, 'orders', '', '', '', '' FROM orders
 UNION ALL SELECT DISTINCT 'sink.sql:' || l_orderkey || '_' || l_suppkey, 'sink.sql', l_orderkey || '_' || l_suppkey, '', '', '', '', '' FROM lineitem
 UNION ALL SELECT 'sql_table:' || p_partkey, 'sql_table', p_name, '', p_type, '', '', '' FROM part),
edges AS (
 SELECT 'route:' || c_custkey AS src, 'func:' || c_custkey AS dst, 'handled_by' AS kind, '' AS methods, '' AS op FROM customer
 UNION ALL SELECT 'func:' || o_custkey, 'method:' || o_orderkey, 'calls', CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'P' THEN '*' ELSE '' END, '' FROM orders
 UNION ALL SELECT DISTINCT 'method:' || l_orderkey, 'sink.sql:' || l_orderkey || '_' || l_suppkey, 'calls', '', '' FROM lineitem
 UNION ALL SELECT DISTINCT 'sink.sql:' || l_orderkey || '_' || l_suppkey, 'sql_table:' || l_partkey, 'queries', '', CASE l_returnflag WHEN 'A' THEN 'update' WHEN 'R' THEN 'delete' ELSE 'select' END FROM lineitem
 UNION ALL SELECT 'func:' || a.c_custkey, 'func:' || b.c_custkey, 'calls', '', '' FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - a.c_custkey % 5 + (a.c_custkey + 1) % 5 WHERE a.c_custkey <> b.c_custkey
 UNION ALL SELECT DISTINCT 'sql_table:' || l_partkey, 'sql_table:' || nxt, 'fk', '', '' FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey)
"""
