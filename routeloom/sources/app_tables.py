"""A second derived graph, of an application: routes, pages, entries, functions, types, templates and tables with positions.

Nodes and edges are one SQL text each, which Spark and any other engine run unchanged on the same order tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .driver_tables import read

NODES = """
SELECT concat('route:', o_orderkey) AS id, 'route' AS kind, concat(CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END, ' /shop/', o_custkey, '/', o_orderkey) AS name, '' AS package, '' AS detail,
  concat('routes', o_custkey % 7, '.src') AS file, CAST(o_orderkey % 40 AS INT) AS start_line, CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS method,
  CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'authenticated' ELSE 'admin' END AS access, CASE WHEN o_orderkey % 5 = 0 THEN concat('/en/', o_orderkey, '  /de/', o_orderkey) ELSE '' END AS variants,
  CASE o_orderkey % 4 WHEN 0 THEN 'auth,log' WHEN 1 THEN 'log' ELSE '' END AS middleware, '' AS parent, CASE WHEN o_orderkey % 6 = 0 THEN 'true' ELSE '' END AS flag FROM {orders}
UNION ALL SELECT concat('page:', c_custkey), 'page', concat('GET /page/', c_custkey), '', '', 'pages.src', CAST(c_custkey % 30 AS INT), 'GET', 'public', '', '', '', '' FROM {customer}
UNION ALL SELECT concat('entry:', s_suppkey), 'entry', concat('task', s_suppkey), '', CASE WHEN s_suppkey % 2 = 0 THEN concat('queue', s_suppkey % 4) ELSE '' END, 'entries.src', CAST(s_suppkey * 7 % 11 AS INT),
  CASE s_suppkey % 3 WHEN 0 THEN 'worker' WHEN 1 THEN 'job' ELSE 'command' END, '', '', '', CASE WHEN s_suppkey % 3 = 1 THEN concat('task', s_suppkey - 1) ELSE '' END, '' FROM {supplier}
UNION ALL SELECT concat('func:', c_custkey), 'func', concat(CASE WHEN c_custkey % 10 = 0 THEN 'lib' ELSE 'app' END, '/nation', c_nationkey, '.F', c_custkey), concat(CASE WHEN c_custkey % 10 = 0 THEN 'lib' ELSE 'app' END, '/nation', c_nationkey), '',
  concat('f', c_nationkey, '.src'), CAST(c_custkey % 90 AS INT), '', '', '', '', '', CASE WHEN c_custkey % 10 = 0 THEN 'true' ELSE '' END FROM {customer}
UNION ALL SELECT concat('type:', p_partkey), 'type', concat('app/', p_name), 'app', CASE p_partkey % 3 WHEN 0 THEN 'struct' WHEN 1 THEN 'interface' ELSE 'object' END, 'types.src', CAST(p_partkey % 70 AS INT), '', '', '', '', '', '' FROM {part}
UNION ALL SELECT concat('interface_call:', s_suppkey), 'interface_call', concat('I', s_suppkey), '', '', '', 0, '', '', '', '', '', 'true' FROM {supplier}
UNION ALL SELECT concat('template:', s_suppkey), 'template', concat('t', s_suppkey, '.html'), '', '', '', 0, '', '', '', '', '', '' FROM {supplier}
UNION ALL SELECT concat('sql_table:s', s_suppkey), 'sql_table', concat('s', s_suppkey), '', concat('id int8, n', s_nationkey, ' text'), 'schema.sql', CAST(s_suppkey % 9 AS INT), '', '', '', '', '', CASE WHEN s_suppkey % 4 = 0 THEN 'true' ELSE '' END FROM {supplier}
UNION ALL SELECT concat('sql_column:s', n_nationkey % 10, '.c', n_nationkey), 'sql_column', concat('c', n_nationkey), '', CASE WHEN n_nationkey % 2 = 0 THEN 'int8' ELSE 'text' END, 'schema.sql', CAST(n_nationkey AS INT), '', '', '', '', concat('sql_table:s', n_nationkey % 10), CASE WHEN n_nationkey < 10 THEN 'true' ELSE '' END FROM {nation}
"""

_NUMBER = "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey)"
EDGES = f"""
SELECT min(seq) AS id, src, dst, kind, file, start_line, start_col, min(op) AS op, min(col) AS col, min(trigger_) AS trigger_, min(parallel) AS parallel, min(branch) AS branch FROM (
 SELECT {_NUMBER} AS seq, CASE what WHEN 0 THEN concat('route:', l_orderkey) WHEN 3 THEN concat('interface_call:', l_suppkey) WHEN 5 THEN concat('route:', l_orderkey) WHEN 6 THEN concat('page:', l_suppkey) WHEN 7 THEN concat('page:', l_suppkey)
   WHEN 9 THEN concat('type:', l_suppkey) WHEN 10 THEN concat('type:', l_suppkey) WHEN 11 THEN concat('sql_table:s', l_suppkey) ELSE concat('func:', l_suppkey) END AS src,
  CASE what WHEN 0 THEN concat('func:', l_suppkey) WHEN 1 THEN concat('func:', l_partkey % 150) WHEN 2 THEN concat('interface_call:', l_partkey % 10) WHEN 3 THEN concat('func:', l_partkey % 150) WHEN 4 THEN concat('sql_table:s', l_partkey % 10)
   WHEN 5 THEN concat('template:', l_suppkey) WHEN 6 THEN concat('route:', l_orderkey) WHEN 7 THEN concat('route:', l_orderkey) WHEN 11 THEN concat('sql_table:s', l_partkey % 10) ELSE concat('type:', l_partkey) END AS dst,
  CASE what WHEN 0 THEN 'handled_by' WHEN 1 THEN 'calls' WHEN 2 THEN 'calls' WHEN 3 THEN 'dispatches_to' WHEN 4 THEN 'queries' WHEN 5 THEN 'renders' WHEN 6 THEN 'navigates_to' WHEN 7 THEN 'requests' WHEN 8 THEN 'uses_type' WHEN 9 THEN 'uses_type' WHEN 10 THEN 'implements' ELSE 'fk' END AS kind,
  concat('f', l_suppkey % 5, '.src') AS file, CAST(l_quantity AS INT) AS start_line, CAST(l_linenumber AS INT) AS start_col,
  CASE l_returnflag WHEN 'A' THEN 'update' WHEN 'R' THEN 'delete' ELSE 'select' END AS op, concat('c', l_partkey % 4) AS col, CASE l_returnflag WHEN 'A' THEN 'form' WHEN 'R' THEN 'redirect' ELSE 'link' END AS trigger_,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('g', l_partkey % 3) END AS parallel, CASE l_returnflag WHEN 'A' THEN '10' WHEN 'R' THEN '9' ELSE 'each' END AS branch
 FROM (SELECT *, (l_orderkey + l_linenumber) % 12 AS what FROM {{lineitem}}) AS x) AS y GROUP BY src, dst, kind, file, start_line, start_col
"""


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("orders", "customer", "supplier", "part", "nation", "lineitem") if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in names})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes."""
    return _run(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges; of one key the first, as the store keeps them."""
    return _run(spark, sf_dir, EDGES)


SQL = "nodes AS (" + NODES.replace("{", "").replace("}", "") + "),\nedges AS (" + EDGES.replace("{", "").replace("}", "") + ")\n"
