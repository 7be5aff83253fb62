"""Registered queries on views, diagrams, migrations and text functions; importing this module adds them to QUERIES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..model import EDGES, NODES, Graph
from ..operators import diagrams, flow, sequence, store, traverse, views
from ..sources import documents, driver_tables as D, migrations as M
from ..sources.driver_tables import read
from .staging import folder
from .queries import _REACH, _tree_edges, QUERIES, SQL, flow_tree, register, table_routes

__all__ = ["QUERIES", "SQL"]


@register(f"""{_REACH}, tr AS (SELECT dst AS id, count(DISTINCT root) AS routes FROM reach JOIN edges ON node = src AND kind = 'queries' GROUP BY dst),
 o AS (SELECT src AS id, count(DISTINCT dst) AS fk_out FROM edges WHERE kind = 'fk' GROUP BY src), i AS (SELECT dst AS id, count(DISTINCT src) AS fk_in FROM edges WHERE kind = 'fk' GROUP BY dst),
 u AS (SELECT dst AS id, count(*) FILTER (op = 'select') AS readers, count(*) FILTER (op <> 'select') AS writers FROM edges WHERE kind = 'queries' GROUP BY dst)
 SELECT n.id, coalesce(fk_out, 0) AS fk_out, coalesce(fk_in, 0) AS fk_in, coalesce(readers, 0) AS readers, coalesce(writers, 0) AS writers, coalesce(routes, 0) AS routes
 FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN u USING (id) LEFT JOIN tr USING (id) WHERE n.kind = 'sql_table'""")
def table_detail(spark, d):
    """References, uses and routes of every table."""
    return views.table_detail(D.nodes(spark, d).filter("kind = 'sql_table'"), D.edges(spark, d), table_routes(spark, d))


@register("""SELECT id, kind, count(*) AS n, string_agg(other, ',' ORDER BY other) FILTER (r <= 40) AS others FROM
 (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY other) AS r FROM (SELECT DISTINCT src AS id, kind, dst AS other FROM edges)) GROUP BY id, kind""")
def page_detail(spark, d):
    """Far ends of every node by kind of edge, 40 by name of each."""
    return views.neighbor_list(D.edges(spark, d))


@register("""SELECT id, list_aggregate(list_sort(list_distinct(flatten(list(ops)))), 'string_agg', ',') AS ops, string_agg(tbl || ':' || op, ',' ORDER BY tbl || ':' || op) AS tables FROM
 (SELECT 'sink:' || l_orderkey AS id, dst AS tbl, coalesce(min(op) FILTER (op <> 'select'), 'select') AS op, list(DISTINCT op) AS ops FROM
 (SELECT l_orderkey, 'part_' || l_partkey % 5 AS dst, CASE l_returnflag WHEN 'A' THEN 'update' WHEN 'R' THEN 'delete' ELSE 'select' END AS op FROM lineitem) GROUP BY ALL) GROUP BY id""", graph=False)
def merged_statements(spark, d):
    """The statements of each order as one: its ops and tables."""
    op = F.when(F.col("l_returnflag") == "A", "update").when(F.col("l_returnflag") == "R", "delete").otherwise("select")
    table = F.concat(F.lit("part_"), (F.col("l_partkey") % 5).cast("string"))
    return views.merge_statements(read(spark, d, "lineitem").select(F.concat(F.lit("sink:"), F.col("l_orderkey").cast("string")).alias("id"), table.alias("tbl"), op.alias("op")))


@register("""SELECT key, min_by(name, seq) AS first, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants FROM
 (SELECT o_custkey AS key, o_orderkey AS seq, 'order' || o_orderkey AS name, o_orderpriority AS variant FROM orders) GROUP BY key""", graph=False)
def merged_routes(spark, d):
    """Registrations of one key: the first name with all variants."""
    key = F.col("o_orderkey")
    return views.merge_duplicates(read(spark, d, "orders").select(F.col("o_custkey").alias("key"), key.alias("seq"), F.concat(F.lit("order"), key.cast("string")).alias("name"), F.col("o_orderpriority").alias("variant")))


@register(""", near AS (SELECT id AS root, id AS node, 0 AS depth FROM nodes WHERE kind = 'func' UNION SELECT r.root, e.dst, r.depth + 1 FROM near r JOIN edges e ON e.src = r.node AND e.kind = 'calls' WHERE r.depth < 5),
 m AS (SELECT DISTINCT src AS node, op AS mark FROM edges WHERE kind = 'queries'), f AS (SELECT root, mark, depth, min(depth) OVER (PARTITION BY root) AS least FROM near JOIN m USING (node))
 SELECT DISTINCT root, mark, depth::INTEGER AS depth FROM f WHERE depth = least""")
def nearest_uses(spark, d):
    """What the nearest statements of each function do, within five calls."""
    e = D.edges(spark, d)
    seeds = D.nodes(spark, d).filter("kind = 'func'").select(F.col("id").alias("root"), F.col("id").alias("node"))
    reached = traverse.closure(seeds, e.filter("kind = 'calls'").select("src", "dst"), max_depth=5)
    return views.nearest(reached, e.filter("kind = 'queries'").select(F.col("src").alias("node"), F.col("op").alias("mark")).distinct())


@register("""SELECT j.user_id AS key, j.event_id AS seq, coalesce(w.event_id, -1) AS owner FROM (SELECT * FROM events WHERE event_type = 'purchase') j
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') w ON j.user_id = w.user_id AND j.event_id > w.event_id""", graph=False)
def job_workers(spark, d):
    """For each purchase the user's latest click before it, as a job belongs to the latest worker of its name."""
    e = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").cast("long").alias("seq"), "event_type")
    pick = lambda kind: e.filter(F.col("event_type") == kind).select("key", "seq")
    return views.latest_before(pick("purchase"), pick("click")).na.fill(-1, ["owner"])


_PATH = "regexp_replace(regexp_replace({}, '^[^:]*://[^/]*', ''), '[?#].*$', '')"


@register(f"""WITH files AS (SELECT DISTINCT regexp_replace({_PATH.format('url')}, '^/[^/]*/', '') AS path FROM pages), u AS (SELECT page_id AS url, list_filter(string_split({_PATH.format('url')}, '/'), lambda p: p <> '') AS parts FROM pages),
 s AS (SELECT url, pos, array_to_string(list_slice(parts, pos, len(parts)), '/') AS path FROM (SELECT url, parts, unnest(range(1, len(parts) + 1)) AS pos FROM u))
 SELECT url, min_by(path, pos) AS path FROM s JOIN files USING (path) GROUP BY url""", graph=False)
def asset_files(spark, d):
    """The file that is the longest end of every page's path."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[^:]*://[^/]*", ""), r"[?#].*$", "")
    pages = read(spark, d, "pages")
    return views.find_files(pages.select(F.col("page_id").alias("url"), path.alias("path")), pages.select(F.regexp_replace(path, "^/[^/]*/", "").alias("path")))


@register("""SELECT doc_id AS id, 2::INTEGER AS start, least(4, len(l))::INTEGER AS "end", len(l)::INTEGER AS total, CASE WHEN len(l) >= 2 THEN array_to_string(l[2:4], chr(10)) END AS part
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""", graph=False)
def source_slice(spark, d):
    """Lines 2 to 4 of every text."""
    return views.slice_lines(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 2, 4)


@register("""SELECT src AS id, string_agg(e, '; ' ORDER BY o, e) AS evidence FROM (SELECT DISTINCT 'func:' || o_custkey AS src, (o_orderstatus <> 'F')::INT AS o,
 CASE WHEN o_orderstatus = 'F' THEN 'admin via ' || o_orderpriority ELSE 'consults ' || o_orderpriority END AS e FROM orders) GROUP BY src""", graph=False)
def access_evidence(spark, d):
    """Why a function has its role."""
    o = read(spark, d, "orders")
    return views.evidence(o.select(F.concat(F.lit("func:"), F.col("o_custkey").cast("string")).alias("id"), F.lit("admin").alias("role"), F.col("o_orderpriority").alias("via"), (F.col("o_orderstatus") != "F").alias("consulted")))


@register("""SELECT id, 0::INTEGER AS part, replace(id, ':', '_') || '["' || name || '"] {}' AS line FROM nodes WHERE kind = 'sql_table'
 UNION ALL SELECT DISTINCT src, 1, replace(src, ':', '_') || ' }o--|| ' || replace(dst, ':', '_') || ' : ""' FROM edges WHERE kind = 'fk'""")
def er_diagram(spark, d):
    """Lines of the diagram of all tables."""
    return diagrams.er_lines(D.nodes(spark, d).filter("kind = 'sql_table'"), D.edges(spark, d).filter("kind = 'fk'"))


@register("""SELECT 0::INTEGER AS part, access, replace(id, ':', '_') || CASE method WHEN 'GET' THEN '(["' || name || '"])' ELSE '[/"' || name || '"/]' END AS line FROM nodes WHERE kind = 'route'
 UNION ALL SELECT DISTINCT 1, '', 'route_' || substr(src, 6) || ' --> route_' || substr(dst, 6) FROM edges WHERE kind = 'calls' AND src LIKE 'func:%' AND dst LIKE 'func:%'""")
def site_map(spark, d):
    """Lines of the site map: routes by access, and moves where one handler calls another."""
    routes = D.nodes(spark, d).filter("kind = 'route'").select("id", "name", F.col("attrs")["method"].alias("method"), F.col("attrs")["access"].alias("access"))
    page = lambda c: F.regexp_replace(c, "^func:", "route:")
    calls = D.edges(spark, d).filter("kind = 'calls'").filter(F.col("src").startswith("func:") & F.col("dst").startswith("func:"))
    return diagrams.site_map_lines(routes, calls.select(page("src").alias("src"), page("dst").alias("dst"), F.lit("link").alias("trigger")))


@register()
def flow_text(spark, d):
    """Flow trees of all routes as drawn lines."""
    return diagrams.tree_lines(flow_tree(spark, d))


@register()
def sequence_diagram(spark, d):
    """Calls of all flow trees as lines of sequence diagrams."""
    return diagrams.sequence_lines(flow_tree(spark, d))


def _site_flows(spark, d):
    """Flow trees of all routes in the order of calls, and the nodes: urgent orders are called through their customer's interface, the rest but low ones in groups."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    e = _tree_edges(spark, d).withColumn("key", F.when((F.col("kind") == "calls") & F.col("dst").startswith("method:"), F.substring_index("dst", ":", -1).cast("long")))
    e = e.join(o, F.col("key") == F.col("o_orderkey"), "left")
    table = D.nodes(spark, d).filter("kind = 'sql_table'").select(F.col("id").alias("t_id"), F.col("name").alias("t_name"))
    e = e.join(table, (F.col("kind") == "queries") & (F.col("dst") == F.col("t_id")), "left")
    port = F.concat(F.lit("interface_call:"), F.col("o_custkey").cast("string"))
    at = F.when(F.col("key").isNotNull(), F.col("key")).when(F.col("dst").startswith("func:"), F.lit(1 << 60)).when(F.col("kind") == "queries", F.substring_index("dst", ":", -1).cast("long")).otherwise(F.substring_index("dst", "_", -1).cast("long"))
    e = e.withColumn("at", at).withColumn("urgent", F.coalesce(F.col("p") == "1", F.lit(False)))
    group = F.when(F.col("p").isin("2", "3", "4"), F.concat(F.lit("g"), "p")).otherwise("")
    branch = F.when(F.col("key") % 3 == 0, "each").when(F.col("key") % 3 == 1, "2").otherwise("10")
    plain = e.filter("NOT urgent").select("root", "src", F.coalesce("t_name", "dst").alias("dst"), "kind", "op", "at", group.alias("parallel"), F.when(group == "", "").otherwise(branch).alias("branch"))
    ports = e.filter("urgent").select("root", "src", port.alias("dst"), "kind", "op", "at", F.lit("").alias("parallel"), F.lit("").alias("branch"))
    behind = e.filter("urgent").select("root", port.alias("src"), "dst", F.lit("dispatches_to").alias("kind"), "op", "at", F.lit("").alias("parallel"), F.lit("").alias("branch"))
    n = D.nodes(spark, d).select("id", "name", "kind", "package", "detail", "file", "start_line", F.lit("").alias("entry_kind"))
    key = F.col("c_custkey").cast("string")
    own = read(spark, d, "customer").select(F.concat(F.lit("interface_call:"), key).alias("id"), F.concat(F.lit("Port"), key).alias("name"), F.lit("interface_call").alias("kind"), *[F.lit("").alias(c) for c in ("package", "detail", "file")], F.lit(0).alias("start_line"), F.lit("").alias("entry_kind"))
    return flow.trees(plain.union(ports).union(behind)), n.union(own)


@register("""WITH RECURSIVE m AS (SELECT c_custkey AS root, ['GET','POST','ANY'][(c_custkey % 3 + 1)::INT] AS method FROM customer),
 chain AS (SELECT root, method, root AS f, 1 AS lvl FROM m UNION ALL SELECT c.root, c.method, n.c_custkey, c.lvl + 1 FROM chain c JOIN customer n ON n.c_custkey = c.f - c.f % 5 + (c.f + 1) % 5 WHERE n.c_custkey <> c.root),
 allowed AS (SELECT c.*, o_orderkey AS o, substr(o_orderpriority, 1, 1) AS p, CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3', '4') THEN 'g' || substr(o_orderpriority, 1, 1) ELSE '' END AS g,
   CASE o_orderkey % 3 WHEN 0 THEN 'each' WHEN 1 THEN '2' ELSE '10' END AS br, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS leads
  FROM chain c JOIN orders ON o_custkey = c.f WHERE CASE o_orderstatus WHEN 'F' THEN method IN ('GET', 'ANY') WHEN 'P' THEN method <> 'GET' ELSE true END),
 top AS (SELECT root, max(lvl) AS deepest FROM allowed WHERE leads GROUP BY root),
 items AS (SELECT root, lvl, o AS item, false AS port, g, CASE WHEN g = '' THEN '' ELSE br END AS br, CASE WHEN g = '' THEN o ELSE min(o) OVER (PARTITION BY root, lvl, g) END AS first FROM allowed WHERE leads AND p <> '1'
  UNION ALL SELECT root, lvl, min(o), true, '', '', min(o) FROM allowed WHERE p = '1' GROUP BY root, lvl HAVING bool_or(leads)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY root, lvl ORDER BY first, TRY_CAST(br AS INTEGER) NULLS LAST, br, item) AS place FROM items),
 turns AS (SELECT *, coalesce(lag(g) OVER w, '') AS g0, coalesce(lead(g) OVER w, '') AS g1, lag(br) OVER w AS br0 FROM placed WINDOW w AS (PARTITION BY root, lvl ORDER BY place)),
 methods AS (SELECT p.root, p.lvl, p.place, p.port, a.o, a.f, count(*) OVER (PARTITION BY p.root, p.lvl, p.place) AS many, row_number() OVER (PARTITION BY p.root, p.lvl, p.place ORDER BY a.o) AS nth
  FROM placed p JOIN allowed a ON a.root = p.root AND a.lvl = p.lvl AND a.leads AND CASE WHEN p.port THEN a.p = '1' ELSE a.o = p.item END),
 sinks AS (SELECT l_orderkey AS o, l_suppkey AS s, string_agg(op || ' ' || p_name, ', ' ORDER BY l_partkey, p_name, op) AS text FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'UPDATE' WHEN 'R' THEN 'DELETE' ELSE 'SELECT' END AS op FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 lane AS (SELECT c_custkey AS f, 'nation' || c_nationkey AS lane, c_name FROM customer),
 msg AS (SELECT c.root, c.lvl, 0 AS place, 0 AS o, -1 AS s, CASE WHEN c.lvl = 1 THEN 'Browser' ELSE b.lane END AS a, l.lane AS z, CASE WHEN c.lvl = 1 THEN c.method || ' /customers/' || c.root || ' → ' ELSE '' END || l.c_name AS text, 'func:' || c.f AS node
   FROM chain c JOIN top t ON t.root = c.root AND c.lvl <= deepest JOIN lane l ON l.f = c.f LEFT JOIN chain y ON y.root = c.root AND y.lvl = c.lvl - 1 LEFT JOIN lane b ON b.f = y.f
  UNION ALL SELECT root, lvl, place, o, -1, lane, 'orders', CASE WHEN port THEN 'Port' || f || ' → ' ELSE '' END || 'Order' || o, 'method:' || o FROM methods JOIN lane USING (f)
  UNION ALL SELECT root, lvl, place, o, s, 'orders', 'Database', text, 'sink.sql:' || o || '_' || s FROM methods JOIN sinks USING (o)),
 told AS (SELECT *, row_number() OVER (PARTITION BY root, z ORDER BY lvl, place, o, s) AS seen FROM msg),
 made AS (SELECT root, lvl, place, o, s, 2 AS sub, '  ' || a || '->>' || z || ': ' || text AS text, node FROM told
  UNION ALL SELECT root, lvl, place, o, s, 1, '  participant ' || z || ' as ' || z, NULL FROM told WHERE seen = 1
  UNION ALL SELECT root, 0, 0, 0, 0, unnest([0, 1, 2]), unnest(['sequenceDiagram', '  actor Browser', '  autonumber']), NULL FROM top
  UNION ALL SELECT root, lvl, place, 0, -2, 0, CASE WHEN g <> g0 THEN '  par ' ELSE '  and ' END || CASE br WHEN 'each' THEN 'each element' ELSE 'branch ' || br END, NULL FROM turns WHERE g <> '' AND (g <> g0 OR br <> br0)
  UNION ALL SELECT root, lvl, place, 1::BIGINT << 60, 0, 3, '  end', NULL FROM turns WHERE g <> '' AND g <> g1
  UNION ALL SELECT root, lvl, place, o, -2, 0, CASE nth WHEN 1 THEN '  alt ' ELSE '  else ' END || 'Order' || o, NULL FROM methods WHERE port AND many > 1
  UNION ALL SELECT root, lvl, place, 1::BIGINT << 60, 0, 3, '  end', NULL FROM methods WHERE port AND many > 1 AND nth = 1)
 SELECT 'route:' || root AS root, row_number() OVER w::INTEGER AS line, text, CASE WHEN node IS NOT NULL THEN count(node) OVER w ELSE 0 END AS number, coalesce(node, '') AS node FROM made WINDOW w AS (PARTITION BY root ORDER BY lvl, place, o, s, sub)""", graph=False)
def flow_sequence(spark, d):
    """Sequence diagrams of all flows, with calls in their order, parallel groups and alternatives."""
    return sequence.lines(*_site_flows(spark, d)).na.fill(0, ["number"]).na.fill("", ["node"])


@register()
def flow_outline(spark, d):
    """The same flows as drawn lines."""
    return sequence.outline(*_site_flows(spark, d))


@register("""SELECT 'node' AS part, id AS a, kind, name AS b FROM nodes UNION ALL SELECT DISTINCT 'edge', src, kind, dst FROM edges""")
def document_graph(spark, d):
    """The derived graph, written as a document in parts and read back by ranges of bytes."""
    e = D.edges(spark, d).select("src", "dst", "kind").distinct()
    none = F.create_map().cast("map<string,string>")
    e = store.ordered_ids(e, ["src", "dst", "kind"]).select("id", "src", "dst", "kind", F.lit("").alias("file"), *[F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")], none.alias("attrs"))
    out = folder(spark, "document")
    documents.write_document(Graph(D.nodes(spark, d).select(NODES.names), e.select(EDGES.names)), out)
    g = documents.read_document(spark, out)
    return g.nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), "kind", F.col("name").alias("b")).union(g.edges.select(F.lit("edge"), "src", "kind", "dst"))


@register("""SELECT l_orderkey AS k, l_linenumber AS line, 'select ''?'' from part_' || l_partkey || ' where a = $1 and b = $2::int' || CASE l_returnflag WHEN 'A' THEN ' or c = $3' ELSE '' END AS sql FROM lineitem""", graph=False)
def positional_parameters(spark, d):
    """Statements made from order lines with numbered parameters."""
    tail = F.when(F.col("l_returnflag") == "A", " or c = ?").otherwise("")
    sql = F.concat(F.lit("select '?' from part_"), F.col("l_partkey").cast("string"), F.lit(" where a = ? and b = :name::int"), tail)
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), X.positional(sql).alias("sql"))


def _files(spark, d):
    """A file for each order: a folder for each customer, names by priority."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    folder = F.concat(F.lit("app"), F.col("o_custkey").cast("string"), F.lit("/migrations/"))
    plain = F.concat(folder, key, F.when(F.col("o_orderstatus") == "F", ".up.sql").when(F.col("o_orderstatus") == "P", ".down.sql").otherwise(".sql"))
    flyway = F.concat(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("V"), (F.col("o_orderkey") % 20).cast("string"), F.lit("_"), key)).when(F.col("o_orderstatus") == "P", F.concat(F.lit("U"), key)).otherwise("R"), F.lit("__"), key, F.lit(".sql"))
    return o.select("o_custkey", "o_orderkey", plain.alias("plain"), F.concat(folder, flyway).alias("flyway"))


@register("""SELECT 'app' || o_custkey || '/migrations/' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN '.up.sql' ELSE '.sql' END AS path FROM orders o
 WHERE o_orderstatus = 'F' OR (o_orderstatus NOT IN ('F', 'P') AND NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = o.o_custkey AND u.o_orderstatus = 'F'))""", graph=False)
def migration_files(spark, d):
    """Files that build each application's schema."""
    return M.up_files(_files(spark, d).select(F.col("plain").alias("path")))


@register("""SELECT o_custkey AS app, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', CASE o_orderstatus WHEN 'F' THEN o_orderkey % 20 END, CASE o_orderstatus WHEN 'F' THEN o_orderkey END, 'R__' || o_orderkey || '.sql')::INTEGER AS place
 FROM orders WHERE o_orderstatus <> 'P'""", graph=False)
def migration_order(spark, d):
    """Place of each versioned or repeatable file in its application's run."""
    from pyspark.sql import Window as W

    rows = M.versioned(_files(spark, d).withColumnRenamed("flyway", "path"))
    return rows.select(F.col("o_custkey").alias("app"), F.col("o_orderkey").alias("k"), F.row_number().over(W.partitionBy("o_custkey").orderBy(*M.run_order())).alias("place"))


@register("""SELECT 'f' || o_orderkey AS path, unnest(range(1, 8))::INTEGER AS line, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['-- +goose Up', 'create table t' || o_custkey, '', '', '', '', ''] WHEN 1 THEN ['', '', '-- +goose Up', 'create table u' || o_custkey, 'x', '', '']
 ELSE ['-- plain', 'create table t' || o_custkey, '', '', '-- +goose Up', 'create table v', 'y'] END) AS text FROM orders""", graph=False)
def migration_up_lines(spark, d):
    """The part of each file that builds, with its line numbers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("-- +goose Up\ncreate table t"), c, F.lit("\n\n-- +goose Down\ndrop table t"), c, F.lit("\n\n")))
    text = text.when(k % 3 == 1, F.concat(F.lit("-- +goose Down\ndrop table u\n-- +goose Up\ncreate table u"), c, F.lit("\nx\n-- +goose Down\nz")))
    text = text.otherwise(F.concat(F.lit("-- plain\ncreate table t"), c, F.lit("\n-- +goose Down\nno\n-- +goose Up\ncreate table v\ny")))
    return M.up_lines(read(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), text.alias("text")))


@register("""WITH c AS (SELECT o_custkey AS tbl, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'drop_table' WHEN o_orderkey % 3 = 0 THEN 'create' WHEN o_orderkey % 4 = 1 THEN 'drop' ELSE 'add' END AS op, 'c' || o_orderkey % 2 || '_' || o_orderpriority AS col FROM orders),
 a AS (SELECT *, coalesce(max(CASE WHEN op = 'drop_table' THEN seq END) OVER (PARTITION BY tbl), -1) AS gone FROM c), b AS (SELECT *, min(CASE WHEN op = 'create' THEN seq END) OVER (PARTITION BY tbl) AS made FROM a WHERE seq > gone),
 v AS (SELECT tbl, seq, op, col FROM b WHERE seq = made OR (seq > made AND op <> 'create'))
 SELECT tbl, col AS "column" FROM v QUALIFY row_number() OVER (PARTITION BY tbl, col ORDER BY seq DESC) = 1 AND op <> 'drop'""", graph=False)
def schema_replay(spark, d):
    """Columns of each table after all its changes."""
    k = F.col("o_orderkey")
    op = F.when(k % 11 == 0, "drop_table").when(k % 3 == 0, "create").when(k % 4 == 1, "drop").otherwise("add")
    return M.replay(read(spark, d, "orders").select(F.col("o_custkey").alias("tbl"), k.alias("seq"), op.alias("op"), F.concat(F.lit("c"), (k % 2).cast("string"), F.lit("_"), F.col("o_orderpriority")).alias("column")))
