"""Registered queries on the application graph and on facts; importing this module adds them to QUERIES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, details, facts, mounts, search, sequence, statements, traverse, values
from ..sources import app_tables as A, migrations, schema, templates
from ..sources.driver_tables import read
from .queries import QUERIES, SQL

NAMES: list[str] = []
_ORDER = "file, start_line, start_col, id"


def register(sql: str | None = None, graph: bool = True):
    """Adds a query by its function's name; graph puts the derivation of the application graph before its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        NAMES.append(f.__name__)
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {A.SQL}{sql}" if graph else sql
        return f

    return add


def _nodes(spark, d, *kinds):
    n = A.nodes(spark, d)
    return n.filter(F.col("kind").isin(*kinds)) if kinds else n


def _edges(spark, d, *kinds):
    e = A.edges(spark, d)
    return e.filter(F.col("kind").isin(*kinds)) if kinds else e


def _listed(keys: str, value: str, rows: str, most: int = 40) -> str:
    """SQL of a capped list in source order with the count of all."""
    return f"SELECT {keys}, count(*) AS n, string_agg({value}, ',' ORDER BY r) FILTER (r <= {most}) AS first FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_ORDER}) AS r FROM ({rows})) GROUP BY {keys}"


@register(", ids AS (SELECT concat('func:', o_orderkey) AS id FROM orders) SELECT id, kind, name, kind IS NOT NULL AS found FROM ids LEFT JOIN nodes USING (id)")
def node_lookup(spark, d):
    """Nodes of the ids of functions, one for each order number: some exist."""
    return details.lookup(_nodes(spark, d), read(spark, d, "orders").select(F.concat(F.lit("func:"), F.col("o_orderkey").cast("string")).alias("id")))


@register(", ids AS (SELECT max(id) AS id FROM edges GROUP BY src, kind) SELECT id, src, dst, kind, file, start_line FROM edges WHERE id IN (SELECT id FROM ids)")
def edges_by_id(spark, d):
    """The last edge of each kind of every node, by its id."""
    e = _edges(spark, d)
    return details.edges_by_id(e, e.groupBy("src", "kind").agg(F.max("id").alias("id"))).select("id", "src", "dst", "kind", "file", "start_line")


@register(f", r AS (SELECT e.src AS node, row_number() OVER (PARTITION BY src ORDER BY {_ORDER.replace('file', 'e.file').replace('start_line', 'e.start_line').replace(' id', ' e.id')}) AS r, e.kind, dst AS other, name FROM edges e JOIN nodes n ON n.id = dst WHERE e.kind IN ('calls', 'dispatches_to', 'queries')) SELECT node, CAST(r AS INTEGER) AS at, kind, other, name FROM r")
def neighbors_in_order(spark, d):
    """What every node calls, dispatches to and queries, numbered in source order."""
    return details.neighbors(_edges(spark, d), _nodes(spark, d), "out", ("calls", "dispatches_to", "queries")).select("node", "at", "kind", "other", "name")


@register(", b AS (SELECT src AS node, 'out' AS dir, kind, dst AS other, file, start_line, start_col, id FROM edges UNION ALL SELECT dst, 'in', kind, src, file, start_line, start_col, id FROM edges) " + _listed("node, dir, kind", "other", "SELECT * FROM b"))
def node_neighbors(spark, d):
    """Neighbours of every node by direction and kind of edge: 40 in source order, and the count of all."""
    return details.node_detail(_edges(spark, d))


@register(f""", b AS (SELECT src AS node, kind, dst AS other, file, start_line, start_col, id FROM edges WHERE kind IN ('renders', 'requests', 'loads', 'navigates_to') UNION ALL SELECT dst, 'reached_from', src, file, start_line, start_col, id FROM edges WHERE kind = 'navigates_to'),
 l AS ({_listed('node, kind', 'other', 'SELECT * FROM b')}), p AS (SELECT node, {', '.join(f"coalesce(max(first) FILTER (kind = '{k}'), '') AS {k}" for k in ('renders', 'requests', 'loads', 'navigates_to', 'reached_from'))} FROM l GROUP BY node)
 SELECT id, access, middleware, {', '.join(f"coalesce({k}, '') AS {k}" for k in ('renders', 'requests', 'loads', 'navigates_to', 'reached_from'))} FROM nodes LEFT JOIN p ON node = id WHERE kind IN ('route', 'page')""")
def route_page_detail(spark, d):
    """Every route and page with what it renders, requests, loads and leads to, and what leads to it."""
    return details.page_detail(_nodes(spark, d, "route", "page"), _edges(spark, d))


@register(f""", b AS (SELECT src AS node, 'fk_out' AS part, dst AS value, file, start_line, start_col, id FROM edges WHERE kind = 'fk' UNION ALL SELECT dst, 'fk_in', src, file, start_line, start_col, id FROM edges WHERE kind = 'fk'
 UNION ALL SELECT dst, 'used_by', op || ' ' || src, file, start_line, start_col, id FROM edges WHERE kind = 'queries' UNION ALL SELECT parent, 'columns', name || ' ' || detail, file, start_line, 0, 0 FROM nodes WHERE kind = 'sql_column'),
 l AS ({_listed('node, part', 'value', 'SELECT * FROM b')}), p AS (SELECT node, {', '.join(f"max(first) FILTER (part = '{k}') AS {k}" for k in ('columns', 'fk_out', 'fk_in', 'used_by'))} FROM l GROUP BY node)
 SELECT id, flag = 'true' AS inferred, {', '.join(f"coalesce({k}, '') AS {k}" for k in ('columns', 'fk_out', 'fk_in', 'used_by'))} FROM nodes LEFT JOIN p ON node = id WHERE kind = 'sql_table'""")
def table_lists(spark, d):
    """Every table with its columns, references both ways and uses."""
    n = A.nodes(spark, d)
    columns = n.filter("kind = 'sql_column'").select(F.col("parent").alias("table"), "name", F.col("detail").alias("type"), "file", "start_line")
    return details.table_detail(n.filter("kind = 'sql_table'"), columns, _edges(spark, d))


def _calls(near: str, far: str, kinds: str) -> str:
    return " " + _listed("node", "other", f"SELECT {near} AS node, {far} AS other, file, start_line, start_col, id FROM edges WHERE kind IN ({kinds})", 200)


@register(_calls("dst", "src", "'calls', 'dispatches_to', 'handled_by'"))
def callers_list(spark, d):
    """Callers of every node in source order, 200 at most, with the count of all."""
    e = _edges(spark, d, "calls", "dispatches_to", "handled_by").withColumnRenamed("id", "edge")
    return details.first_in_order(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "file", "start_line", "start_col", "edge"), ["node"], "other", 200)


@register(_calls("src", "dst", "'calls', 'dispatches_to', 'queries'"))
def callees_list(spark, d):
    """Callees of every node in source order, 200 at most, with the count of all."""
    e = _edges(spark, d, "calls", "dispatches_to", "queries").withColumnRenamed("id", "edge")
    return details.first_in_order(e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "file", "start_line", "start_col", "edge"), ["node"], "other", 200)


@register(", f AS (SELECT id, file, start_line FROM nodes WHERE kind = 'route' AND lower(method) = 'get' AND contains(lower(name), '/shop/1')) SELECT row_number() OVER (ORDER BY file, start_line, id)::INTEGER AS at, id, (SELECT count(*) FROM f) AS total FROM f ORDER BY file, start_line, id LIMIT 200")
def routes_capped(spark, d):
    """The first 200 routes by method and name in order, with the count of all that fit."""
    return details.capped_routes(_nodes(spark, d, "route"), "Get", "/shop/1")


@register(""" SELECT id, method, name, array_to_string(list_filter(string_split_regex(variants, '\\s+'), lambda x: x <> ''), '|') AS variants, len(list_filter(string_split(middleware, ','), lambda x: x <> ''))::INTEGER AS middleware FROM nodes WHERE kind = 'route'""")
def route_variants(spark, d):
    """Routes with their variants as a list and the length of their middleware chain."""
    r = details.route_projection(_nodes(spark, d, "route"))
    return r.select("id", "method", "name", F.array_join("variants", "|").alias("variants"), F.size("middleware").alias("middleware"))


@register(" SELECT id, method AS entry_kind, CASE WHEN parent <> '' THEN parent || ' > ' || name ELSE name END || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END AS name, file, start_line FROM nodes WHERE kind = 'entry'")
def entry_points(spark, d):
    """Entry points in source order."""
    return details.entry_list(_nodes(spark, d, "entry"))


@register(" SELECT id, flag = 'true' AND kind <> 'interface_call' AS external, package = 'app/nation1' OR starts_with(package, 'app/nation1/') AS inside FROM nodes WHERE kind IN ('func', 'interface_call') AND NOT (package = 'lib' OR starts_with(package, 'lib/') OR package = 'app/nation2' OR starts_with(package, 'app/nation2/'))")
def package_filters(spark, d):
    """Functions outside two packages, with whether they are external and of a module."""
    n = details.without_packages(_nodes(spark, d, "func", "interface_call"), ["lib", "app/nation2"])
    return n.select("id", X.external(F.col("kind"), F.col("flag")).alias("external"), X.in_module(F.col("package"), "app/nation1").alias("inside"))


_FLOW = ", w AS (SELECT id AS root, id AS node FROM nodes WHERE kind = 'route' UNION SELECT root, dst FROM w JOIN edges ON src = node AND kind IN ('handled_by', 'calls', 'dispatches_to')), u AS (SELECT DISTINCT root AS route, dst AS tbl, op FROM w JOIN edges ON src = node AND kind = 'queries')"


@register(_FLOW + " SELECT route, op FROM u WHERE tbl = 'sql_table:s3' AND op = 'delete'")
def routes_touching_table(spark, d):
    """Routes that delete from a table."""
    e = _edges(spark, d)
    users = e.filter("kind = 'queries' AND dst = 'sql_table:s3' AND op = 'delete'").select(F.col("dst").alias("root"), F.col("src").alias("node"))
    back = e.filter(F.col("kind").isin("handled_by", "calls", "dispatches_to")).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    routes = traverse.closure(users, back).join(_nodes(spark, d, "route").select(F.col("id").alias("node")).distinct(), "node")
    return details.routes_by_table(routes.select(F.col("node").alias("route"), F.col("root").alias("tbl"), F.lit("delete").alias("op")), "sql_table:s3", "delete")


@register(" SELECT id FROM nodes WHERE kind IN ('type', 'sql_table') ORDER BY id LIMIT 500")
def search_without_text(spark, d):
    """A search without text lists the nodes of its kinds by id, 500 at most."""
    return search.list_or_search(_nodes(spark, d), " ", ["type", "sql_table"], 1000).select("id")


@register(" SELECT id, CASE WHEN access = 'public' AND flag = 'true' THEN 'optional' ELSE access END AS part FROM nodes WHERE kind = 'route' AND method = 'GET' AND contains(name, '/2') AND CASE WHEN access = 'public' AND flag = 'true' THEN 'optional' ELSE access END IN ('optional', 'admin')")
def site_map_filter(spark, d):
    """Routes of a site map by group, method and name."""
    part = facts.access_group(F.col("access"), F.col("flag"))
    return _nodes(spark, d, "route").select("id", "method", "name", part.alias("part")).filter((F.col("method") == "GET") & F.col("name").contains("/2") & F.col("part").isin("optional", "admin")).select("id", "part")


@register(" SELECT 'nodes' AS part, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'packages', '', count(DISTINCT package) FROM nodes WHERE package <> ''")
def graph_summary(spark, d):
    """Counts by kind and of packages, the largest first."""
    return details.summary(_nodes(spark, d), _edges(spark, d))


@register(f" SELECT src, dst, calls, row_number() OVER (PARTITION BY src ORDER BY head)::INTEGER AS place FROM (SELECT src, dst, count(*) AS calls, min(struct_pack(a := file, b := start_line, c := start_col, d := id)) AS head FROM edges WHERE kind = 'calls' GROUP BY src, dst)")
def call_sites(spark, d):
    """Callees of every caller once, with the number of call sites, by the first of them."""
    return details.call_sites(_edges(spark, d))


@register(""", s AS (SELECT src AS parent, id AS seq, CASE WHEN parallel = '' THEN '#' || id ELSE parallel END AS g, parallel, branch FROM edges WHERE kind = 'calls'), f AS (SELECT *, min(seq) OVER (PARTITION BY parent, g) AS head FROM s)
 SELECT parent, seq, parallel, branch, row_number() OVER (PARTITION BY parent ORDER BY head, try_cast(branch AS INTEGER) NULLS LAST, CASE WHEN try_cast(branch AS INTEGER) IS NULL THEN branch END NULLS FIRST, seq)::INTEGER AS place FROM f""")
def parallel_steps(spark, d):
    """Calls of every function with parallel groups together and their branches in order."""
    e = _edges(spark, d, "calls")
    return details.parallel_order(e.select(F.col("src").alias("parent"), F.col("id").alias("seq"), "parallel", "branch"))


@register(", p AS (SELECT src AS path, list(id ORDER BY id DESC)[1:3] AS ids FROM edges WHERE kind = 'uses_type' GROUP BY src), s AS (SELECT path, unnest(ids) AS id, unnest(range(len(ids))) AS r FROM p) SELECT path, CAST(r AS INTEGER) AS at, src, dst, kind FROM s JOIN edges USING (id)")
def path_edges(spark, d):
    """Edges of paths given by ids, in the order of the ids: here the three last uses of each function's and type's."""
    e = _edges(spark, d)
    from pyspark.sql import Window as W

    own = e.filter("kind = 'uses_type'").withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("id")))).filter("r <= 3")
    paths = own.groupBy(F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("ids"))
    return details.resolve_paths(paths, e)


_REFERENCE = "CASE o_orderkey % 5 WHEN 0 THEN {n} WHEN 1 THEN concat('s', o_orderkey % 40, '.c') WHEN 2 THEN concat('app/nation', o_custkey % 30) WHEN 3 THEN concat('nothing', o_orderkey) ELSE concat('t', o_orderkey % 200, '.html') END".replace("{n}", "CAST(o_orderkey AS STRING)")
_RESOLVE = """, names AS (SELECT DISTINCT """ + _REFERENCE.replace("AS STRING", "AS VARCHAR") + """ AS name FROM orders),
 x AS (SELECT names.name, nodes.id, rank FROM names, (SELECT unnest(['', 'route:', 'method:', 'func:', 'interface_call:', 'type:', 'sql_table:']) AS k, unnest(range(7)) AS rank) JOIN nodes ON nodes.id = k || names.name),
 e AS (SELECT names.name, min_by(x.id, x.rank) AS id FROM names JOIN x USING (name) GROUP BY names.name),
 d AS (SELECT id, name, [lower(name), lower(package), lower(file), lower(detail), lower(id)] AS low, greatest(length(name) - 2, 0) + greatest(length(package) - 2, 0) + greatest(length(file) - 2, 0) + greatest(length(detail) - 2, 0) + greatest(length(id) - 2, 0) AS size, lower(concat_ws(' ', name, package, file, detail, id)) AS plain FROM nodes),
 g AS (SELECT count(*) AS total, sum(size) AS tokens FROM d),
 q AS (SELECT name AS lt, length(name) >= 3 AS ranked FROM names WHERE name NOT IN (SELECT name FROM e)),
 m AS (SELECT q.lt, q.ranked, d.* FROM q JOIN d ON contains(plain, lt)),
 h AS (SELECT lt, ranked, id, name, size, CASE WHEN ranked THEN list_sum(list_transform([1, 2, 3, 4, 5], lambda i: [10, 2, 1, 1, 1][i] * len(list_filter(range(1, length(low[i]) - length(lt) + 2), lambda k: substring(low[i], k, length(lt)) = lt)))) ELSE 1 END::DOUBLE AS f FROM m),
 n AS (SELECT lt, greatest(ln((total - count(*) + 0.5)::DOUBLE / (count(*) + 0.5)::DOUBLE), 0.000001) AS idf FROM h, g WHERE f > 0 GROUP BY lt, total),
 r AS (SELECT lt AS name, h.id, row_number() OVER (PARTITION BY lt ORDER BY CASE WHEN ranked THEN round(idf * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / (tokens::DOUBLE / total)))), 9) ELSE 0 END DESC, length(h.name), h.id) AS rank FROM h JOIN n USING (lt), g WHERE f > 0),
 f AS (SELECT name, count(*) AS n, min(id) AS only1, count(*) FILTER (ends_with(id, name)) AS ends, min(id) FILTER (ends_with(id, name)) AS fin, string_agg(id, ',' ORDER BY rank) FILTER (rank <= 10) AS candidates FROM r WHERE rank <= 11 GROUP BY name),
 o AS (SELECT names.name, coalesce(e.id, CASE WHEN n = 1 THEN only1 END, CASE WHEN ends = 1 THEN fin END) AS id, n, candidates FROM names LEFT JOIN e USING (name) LEFT JOIN f USING (name))
 SELECT name, CASE WHEN id IS NOT NULL THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS status, id, CASE WHEN id IS NULL AND n > 1 THEN candidates END AS candidates, CASE WHEN id IS NULL AND n > 1 THEN n > 10 END AS more FROM o"""


@register(_RESOLVE)
def resolve_references(spark, d):
    """References as they are typed, one for every order: an id, an end of one, a text that several nodes hold, or nothing."""
    return details.resolve(_nodes(spark, d), read(spark, d, "orders").select(F.expr(_REFERENCE).alias("name")).distinct())


_TYPES = """, u AS (SELECT src AS id, dst AS to_, row_number() OVER (PARTITION BY src ORDER BY file, start_line, start_col, id) AS turn FROM edges WHERE kind = 'uses_type'),
 i AS (SELECT id, to_, row_number() OVER (PARTITION BY id ORDER BY dir, file, start_line, start_col, edge) AS turn FROM (SELECT src AS id, dst AS to_, 0 AS dir, file, start_line, start_col, id AS edge FROM edges WHERE kind = 'implements' UNION ALL SELECT dst, src, 1, file, start_line, start_col, id FROM edges WHERE kind = 'implements')),
 a AS (SELECT id AS seed, id, [0::BIGINT] AS way FROM nodes WHERE kind = 'type'),
 b AS (SELECT seed, id, min(way) AS way FROM (SELECT seed, id, list_concat([0::BIGINT], way) AS way FROM a UNION ALL SELECT seed, to_, list_concat(list_concat([1::BIGINT], way), [turn]) FROM a JOIN u USING (id)) GROUP BY seed, id),
 c AS (SELECT seed, id, min(way) AS way FROM (SELECT seed, id, list_concat([0::BIGINT], way) AS way FROM b UNION ALL SELECT seed, to_, list_concat(list_concat([1::BIGINT], way), [turn]) FROM b JOIN i USING (id)) GROUP BY seed, id)
 SELECT seed, id, CAST(r AS INTEGER) AS at FROM (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY way, id) AS r FROM c) WHERE r <= 12"""


@register(_TYPES)
def type_neighborhood(spark, d):
    """The first twelve types around every type."""
    return details.type_neighborhood(_nodes(spark, d, "type").select(F.col("id").alias("seed"), "id"), _edges(spark, d))


@register(", g AS (SELECT id AS node FROM nodes WHERE kind = 'func' AND start_line % 30 = 0 UNION SELECT src FROM g JOIN edges ON dst = node AND kind IN ('calls', 'dispatches_to')) SELECT node FROM g")
def redirectors(spark, d):
    """Functions that redirect, or call one that does."""
    own = _nodes(spark, d, "func").filter("start_line % 30 = 0").select(F.lit(0).alias("root"), F.col("id").alias("node"))
    back = _edges(spark, d, "calls", "dispatches_to").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return traverse.closure(own, back).select("node")


@register(", w AS (SELECT id AS root, id AS node, 0 AS depth FROM nodes WHERE kind = 'func' UNION SELECT root, dst, depth + 1 FROM w JOIN edges ON src = node AND kind IN ('calls', 'dispatches_to') WHERE depth < 6), g AS (SELECT root, depth, node FROM w JOIN nodes ON id = node WHERE nodes.kind = 'func' AND start_line % 30 = 7) SELECT root, min(depth)::INTEGER AS depth, min(node) FILTER (depth = least) AS guard FROM (SELECT *, min(depth) OVER (PARTITION BY root) AS least FROM g) GROUP BY root")
def consulted_guards(spark, d):
    """The nearest guard that every function consults within six calls."""
    n = _nodes(spark, d, "func")
    reached = traverse.closure(n.select(F.col("id").alias("root"), F.col("id").alias("node")), _edges(spark, d, "calls", "dispatches_to").select("src", "dst").distinct(), max_depth=6)
    guards = n.filter("start_line % 30 = 7").select(F.col("id").alias("node"))
    return reached.join(guards, "node").groupBy("root").agg(F.min(F.struct("depth", "node")).alias("m")).select("root", "m.depth", F.col("m.node").alias("guard"))


@register(" SELECT id, name || CASE WHEN flag = 'true' THEN ' [not in migrations]' ELSE ' ' || detail END AS line FROM nodes WHERE kind = 'sql_table'")
def table_list(spark, d):
    """All tables by id, marked where no migration makes them."""
    n = _nodes(spark, d, "sql_table")
    return n.select("id", F.concat("name", F.when(F.col("flag") == "true", " [not in migrations]").otherwise(F.concat(F.lit(" "), "detail"))).alias("line")).orderBy("id")


_REQUESTS = """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS method FROM orders), q AS (SELECT *, CASE method WHEN 'ANY' THEN 'PUT' ELSE method END AS wanted FROM r),
 f AS (SELECT q.k, min_by(r.method || ' /{lang}/c' || r.c || '/o' || r.k || '/{id}', r.k) AS route FROM q JOIN r ON r.c = q.c AND r.method IN (q.wanted, 'ANY') GROUP BY q.k)
 SELECT k AS id, CASE k % 7 WHEN 5 THEN NULL WHEN 1 THEN route ELSE method || ' /{lang}/c' || c || '/o' || k || '/{id}' END AS route, CASE k % 7 WHEN 5 THEN NULL WHEN 1 THEN 8 WHEN 2 THEN 1 ELSE 10 END::INTEGER AS score FROM q JOIN f USING (k)"""


@register(_REQUESTS, graph=False)
def matched_requests(spark, d):
    """Requests made from the routes of orders, in seven forms, matched with the routes again."""
    o = read(spark, d, "orders")
    k, t = F.col("o_orderkey"), lambda c: c.cast("string")
    c, n = F.concat(F.lit("c"), t(F.col("o_custkey"))), F.concat(F.lit("o"), t(k))
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("ANY")), (k % 3 + 1).cast("int"))
    pattern = F.concat(F.lit("/{lang}/"), c, F.lit("/"), n, F.lit("/{id}"))
    routes = o.select(F.concat_ws(" ", method, pattern).alias("key"), k.alias("seq"), method.alias("method"), F.array(pattern).alias("patterns"))
    whole = F.concat(F.lit("/en/"), c, F.lit("/"), n, F.lit("/7"))
    url = F.when(k % 7 == 1, F.concat(F.lit("/en/"), c, F.lit("/{?}/7"))).when(k % 7 == 2, F.concat(F.lit("{?}/"), n, F.lit("/9"))).when(k % 7 == 3, F.concat(whole, F.lit("?page=2#top")))
    url = url.when(k % 7 == 4, F.concat(F.lit("/{?}/"), c, F.lit("/"), n, F.lit("/{?}"))).when(k % 7 == 5, F.concat(F.lit("https://x.org"), whole)).otherwise(whole)
    return facts.match_requests(o.select(k.alias("id"), F.when(method == "ANY", "PUT").otherwise(method).alias("method"), F.array(url).alias("values")), routes)


@register("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'GET /u/' || o_orderkey || '/{id}' WHEN o_orderkey % 3 = 1 THEN CASE WHEN (SELECT count(DISTINCT o_orderkey) FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderkey % 3 = 1) = 1 THEN 'GET /c/' || o_custkey || '/{x' || o_orderkey || '}' END END AS route FROM orders o", graph=False)
def request_shapes(spark, d):
    """Requests by route key: an exact one, one of a shape that only one route has, or neither."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    t = lambda c: c.cast("string")
    shared = F.concat(F.lit("GET /c/"), t(F.col("o_custkey")), F.lit("/{x"), t(k), F.lit("}"))
    routes = o.filter(k % 3 < 2).select(F.when(k % 3 == 0, F.concat(F.lit("GET /u/"), t(k), F.lit("/{id}"))).otherwise(shared).alias("key"))
    wanted = F.when(k % 3 == 0, F.concat(F.lit("GET /u/"), t(k), F.lit("/{id}"))).when(k % 3 == 1, F.concat(F.lit("GET /c/"), t(F.col("o_custkey")), F.lit("/{y}"))).otherwise(F.concat(F.lit("GET /none/"), t(k)))
    return facts.resolve_shapes(o.select(k.alias("id"), wanted.alias("key")), routes)


_IMPL = "t AS (SELECT DISTINCT l_suppkey * 10 + l_linenumber AS type, l_partkey % 40 AS method FROM lineitem), i AS (SELECT DISTINCT o_custkey AS face, o_orderkey % 40 AS method FROM orders), m AS (SELECT type, face FROM t JOIN i USING (method) GROUP BY type, face HAVING count(*) = (SELECT count(*) FROM i q WHERE q.face = i.face))"


@register(f"WITH {_IMPL} SELECT type, face AS interface FROM m", graph=False)
def implementations(spark, d):
    """Types that have all the methods of an interface."""
    return facts.implements(*_methods(spark, d))


def _methods(spark, d):
    types = read(spark, d, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("type"), (F.col("l_partkey") % 40).alias("method"))
    return types, read(spark, d, "orders").select(F.col("o_custkey").alias("interface"), (F.col("o_orderkey") % 40).alias("method"))


@register(f"WITH {_IMPL}, c AS (SELECT o_orderkey AS call, o_custkey AS face, o_orderkey % 40 AS method FROM orders) SELECT DISTINCT call, 'T' || m.type || '.' || c.method AS method FROM c JOIN m USING (face) JOIN t ON t.type = m.type AND t.method = c.method WHERE face % 2 = 0 OR m.type % 4 = 0", graph=False)
def interface_dispatch(spark, d):
    """Calls through interfaces to the methods of the types that implement them; foreign interfaces reach own types only."""
    types, faces = _methods(spark, d)
    calls = read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("interface"), (F.col("o_orderkey") % 40).alias("name"))
    methods = types.distinct().select("type", F.col("method").alias("name"), F.concat(F.lit("T"), F.col("type").cast("string"), F.lit("."), F.col("method").cast("string")).alias("method"))
    own = faces.select(F.col("interface").alias("name")).filter("name % 2 = 0")
    # types and interfaces have names of their own here
    named = lambda df, c, sign: df.withColumn(c, F.concat(F.lit(sign), F.col(c).cast("string")))
    module = named(own, "name", "I").union(named(types.select(F.col("type").alias("name")).filter("name % 4 = 0"), "name", "T"))
    return facts.dispatch(named(calls, "interface", "I"), facts.implements(named(types, "type", "T"), named(faces, "interface", "I")), named(methods, "type", "T"), module)


@register("SELECT l_suppkey AS child, l_partkey AS parent FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)", graph=False)
def reference_ends(spark, d):
    """Foreign keys whose parent table exists."""
    tables = read(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("table"))
    return facts.kept_references(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("child"), F.col("l_partkey").alias("parent")), tables).select("child", "parent")


@register("""SELECT l_orderkey AS call, CASE l_returnflag WHEN 'A' THEN 'sink.sql' ELSE 'sink.http' END AS kind, CASE l_returnflag WHEN 'A' THEN 'DB.Query' ELSE 'Client.Get' END AS callee,
 CASE l_returnflag WHEN 'A' THEN 'select * from t' || l_partkey || ' where a = $1' ELSE 'http://h' || l_suppkey || '/?q' END AS detail FROM lineitem WHERE l_returnflag <> 'N'""", graph=False)
def sink_calls(spark, d):
    """Calls of functions that rules name as sinks."""
    li = read(spark, d, "lineitem")
    callee = F.when(F.col("l_returnflag") == "A", "DB.Query").when(F.col("l_returnflag") == "R", "Client.Get").otherwise("fmt.Print")
    args = F.array(F.lit("ctx"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("select * from t"), F.col("l_partkey").cast("string"), F.lit(" where a = :id"))).otherwise(F.concat(F.lit("http://h"), F.col("l_suppkey").cast("string"), F.lit("/?q"))))
    rules = spark.createDataFrame([("DB.Query", "sink.sql", 1, True), ("Client.Get", "sink.http", 1, False)], "callee string, kind string, arg int, rebind boolean")
    return facts.sinks(li.select(F.col("l_orderkey").alias("call"), callee.alias("callee"), args.alias("args")), rules)


@register("SELECT o_orderkey AS call, 'Get' || o_custkey AS name, 'select ' || o_orderkey AS sql FROM orders WHERE o_orderstatus = 'F'", graph=False)
def named_statements(spark, d):
    """Statements that a generator has named in their first line."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("-- name: Get"), c, F.lit(" :one\nselect "), k)).otherwise(F.concat(F.lit("select "), k))
    return facts.named_statements(read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), text.alias("text")))


@register("""SELECT o_orderkey AS call, CASE WHEN o_orderkey % 4 = 0 THEN 'named' || o_custkey ELSE 'order_people' END AS "table", unnest(CASE o_orderstatus WHEN 'F' THEN ['insert', 'update'] WHEN 'O' THEN ['select'] END) AS op FROM orders WHERE o_orderstatus <> 'P'""", graph=False)
def orm_chains(spark, d):
    """Tables and ops of ORM chains: a named table, or the model's."""
    method = F.when(F.col("o_orderstatus") == "F", "Save").when(F.col("o_orderstatus") == "O", "First").otherwise("Raw")
    table = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("named"), F.col("o_custkey").cast("string")))
    return facts.chain_uses(read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), method.alias("method"), F.lit("OrderPerson").alias("model"), table.alias("table")))


def _statements(spark, d):
    """A statement for each order line, in ten forms."""
    li = read(spark, d, "lineitem")
    form, p, s = (F.col("l_orderkey") + F.col("l_linenumber")) % 10, F.concat(F.lit("part_"), (F.col("l_partkey") % 50).cast("string")), F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string"))
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = [
        c("SELECT p.id, s.name FROM ", p, " p JOIN ", s, " AS s ON s.id = p.supp WHERE p.size > $1 -- from none"),
        c("WITH old AS (DELETE FROM ", p, " WHERE size < 5 RETURNING id) INSERT INTO ", s, " (id, at) SELECT id, now() FROM old"),
        c("BEGIN; UPDATE ", p, " SET size = size + 1, note = 'a;b' WHERE id = ${?}; COMMIT"),
        c('SELECT * FROM "Log" WHERE ', p, " IN ({?})"),
        c("DELETE FROM ", p, " WHERE"),
        c("CREATE TABLE IF NOT EXISTS ", p, " (id int8)"),
        c("SELECT extract(year FROM p.made) y FROM ", p, " p WHERE p.a IS DISTINCT FROM p.b"),
        c("SELECT q.n FROM (SELECT x.size AS n FROM ", p, " x WHERE EXISTS (SELECT 1 FROM ", s, " x WHERE x.id = 1)) q"),
        c('UPDATE "Big ', p, '" SET note = $$from z; x$$, size = (SELECT max(id) FROM ', s, ")"),
        c("INSERT INTO ", s, " (id) VALUES (1) ON CONFLICT (id) DO UPDATE SET id = excluded.id RETURNING at"),
    ]
    return li.select((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"), F.element_at(F.array(*forms), (form + 1).cast("int")).alias("sql")).dropDuplicates(["id"])


_FORMS = """l AS (SELECT DISTINCT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, (l_orderkey + l_linenumber) % 10 AS form, 'part_' || l_partkey % 50 AS p, 'supp_' || l_suppkey AS s FROM lineitem),
 f AS (SELECT *, CASE form WHEN 0 THEN [[p, 'select', 'id supp size'], [s, 'select', 'name id']] WHEN 1 THEN [[p, 'delete', ''], [s, 'insert', 'id at']] WHEN 2 THEN [[p, 'update', 'size note id']] WHEN 3 THEN [['Log', 'select', '* ' || p]] WHEN 4 THEN [[p, 'delete', '']]
  WHEN 5 THEN [[p, 'ddl', '']] WHEN 6 THEN [[p, 'select', 'made a b']] WHEN 7 THEN [[p, 'select', 'size'], [s, 'select', 'id']] WHEN 8 THEN [['Big ' || p, 'update', 'note size'], [s, 'select', '']] ELSE [[s, 'insert', 'id at']] END AS uses FROM l),
 u AS (SELECT id, k, uses[k][1] AS t, uses[k][2] AS op, uses[k][3] AS cols FROM (SELECT id, uses, unnest(range(1, len(uses) + 1)) AS k FROM f))"""


@register(f"""WITH {_FORMS}, t AS (SELECT id, string_agg(t || ':' || op || '[' || cols || ']', ' ' ORDER BY k) AS tables FROM u GROUP BY id)
 SELECT id, CASE form WHEN 1 THEN 'insert' WHEN 2 THEN 'other update other' WHEN 4 THEN 'delete' WHEN 5 THEN 'ddl' WHEN 8 THEN 'update' WHEN 9 THEN 'insert' ELSE 'select' END AS ops, tables, form IN (2, 3, 4) AS partial, form = 4 AS broken FROM f JOIN t USING (id)""", graph=False)
def sql_query_analysis(spark, d):
    """Ops, tables and columns of statements made from order lines."""
    return statements.analyse(_statements(spark, d))


@register(f"WITH {_FORMS} SELECT DISTINCT 'sql_table:' || t AS id, NOT (starts_with(t, 'part_') AND t NOT IN ('part_7', 'part_8')) AS inferred FROM u", graph=False)
def linked_tables(spark, d):
    """Tables that linked statements add, with whether the schema has them."""
    tables = read(spark, d, "part").select(F.concat(F.lit("part_"), (F.col("p_partkey") % 50).cast("string")).alias("table")).filter("table NOT IN ('part_7', 'part_8')")
    return facts.linked(_statements(spark, d), tables)[0]


@register(f"WITH {_FORMS} SELECT id AS src, 'sql_table:' || t AS dst, op, replace(cols, ' ', ',') AS columns FROM u", graph=False)
def linked_edges(spark, d):
    """Edges from linked statements to the tables they use."""
    return facts.linked(_statements(spark, d), read(spark, d, "part").select(F.lit("x").alias("table")))[1]


def _linked(spark, d):
    """Statements of order lines, every third by a call that takes question marks, linked with a schema of parts 0 to 29 and their references."""
    k = F.col("id")
    marks = (k % 3 == 0) & ~F.col("sql").contains("{?}")
    sinks = _statements(spark, d).select("id", F.when(marks, F.replace("sql", F.lit("$1"), F.lit("?"))).otherwise(F.col("sql")).alias("sql"), F.when(marks, "java.sql.Connection.prepare").otherwise("db.query").alias("callee"), (k % 7 == 0).alias("partial"))
    p = read(spark, d, "part").select((F.col("p_partkey") % 30).alias("k")).distinct()
    name = lambda c: F.concat(F.lit("part_"), c.cast("string"))
    columns = p.select(name(F.col("k")).alias("table"), F.posexplode(F.array(F.lit("id"), F.lit("size"))).alias("at", "column"))
    columns = columns.select("table", "at", "column", F.when(F.col("at") == 0, "int8").otherwise("text").alias("type"), (F.col("at") == 0).alias("primary"))
    references = p.filter("k > 0").select(name(F.col("k")).alias("table"), F.lit(0).alias("at"), F.array(F.lit("size")).alias("columns"), name(F.col("k") - 1).alias("parent"))
    return facts.linked_graph(sinks, columns, references)


_SCHEMA = "s AS (SELECT DISTINCT p_partkey % 30 AS k FROM part)"


@register(f"""WITH {_FORMS}, {_SCHEMA}, o AS (SELECT id, form, id % 7 = 0 OR form IN (2, 3, 4) AS partial FROM l)
 SELECT 'sql_table:part_' || k AS id, 'sql_table' AS kind, 'id int8, size text' AS detail, false AS inferred, '' AS op, false AS partial, false AS broken FROM s
 UNION ALL SELECT 'sql_column:part_' || k || '.' || c, 'sql_column', CASE c WHEN 'id' THEN 'int8' ELSE 'text' END, false, '', false, false FROM s, (SELECT unnest(['id', 'size']) AS c)
 UNION ALL SELECT DISTINCT 'sql_table:' || t, 'sql_table', '', true, '', false, false FROM u WHERE t NOT IN (SELECT 'part_' || k FROM s)
 UNION ALL SELECT 'sink.sql:' || id, 'sink.sql', '', false, CASE form WHEN 1 THEN 'insert' WHEN 2 THEN 'other,update,other' WHEN 4 THEN 'delete' WHEN 5 THEN 'ddl' WHEN 8 THEN 'update' WHEN 9 THEN 'insert' ELSE 'select' END, partial, form = 4 FROM o""", graph=False)
def linked_graph_nodes(spark, d):
    """Nodes of a graph that statements were linked into: tables and columns of the schema, inferred tables, and the statements' marks."""
    return _linked(spark, d)[0]


@register(f"""WITH {_FORMS}, {_SCHEMA} SELECT 'sql_table:part_' || k AS src, 'sql_column:part_' || k || '.' || c AS dst, 'has_column' AS kind, '' AS op, '' AS columns FROM s, (SELECT unnest(['id', 'size']) AS c)
 UNION ALL SELECT 'sql_table:part_' || k, 'sql_table:part_' || (k - 1), 'fk', '', '' FROM s WHERE k > 0 AND k - 1 IN (SELECT k FROM s)
 UNION ALL SELECT 'sink.sql:' || id, 'sql_table:' || t, 'queries', op, replace(cols, ' ', ',') FROM u""", graph=False)
def linked_graph_edges(spark, d):
    """Edges of that graph: columns and references of the schema, and what each statement queries."""
    return _linked(spark, d)[1]


def _columns(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table"), F.col("o_orderkey").alias("at"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("column"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("type"), (F.col("o_orderkey") % 3 == 0).alias("primary"))


def _references(spark, d):
    o = read(spark, d, "orders").filter("o_orderstatus = 'P' OR o_orderkey % 5 = 0")
    return o.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("column"), F.concat(F.lit("t"), (F.col("o_custkey") + 1).cast("string")).alias("parent"))


_COLUMNS = "c AS (SELECT 't' || o_custkey AS tbl, o_orderkey AS at_, 'c' || o_orderkey AS col, lower(substr(o_orderpriority, 3, 20)) AS typ, o_orderkey % 3 = 0 AS prim FROM orders), f AS (SELECT 't' || o_custkey AS tbl, 'c' || o_orderkey AS col, 't' || (o_custkey + 1) AS parent FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 5 = 0)"


@register(f"WITH {_COLUMNS} SELECT 'sql_table:' || tbl AS id, 'sql_table' AS kind, string_agg(col || ' ' || typ, ', ' ORDER BY at_) AS detail FROM c GROUP BY tbl UNION ALL SELECT 'sql_column:' || tbl || '.' || col, 'sql_column', typ FROM c", graph=False)
def schema_nodes(spark, d):
    """Nodes of a schema's tables and columns."""
    return facts.schema_graph(_columns(spark, d), _references(spark, d))[0]


@register(f"WITH {_COLUMNS} SELECT 'sql_table:' || tbl AS src, 'sql_column:' || tbl || '.' || col AS dst, 'has_column' AS kind FROM c UNION ALL SELECT 'sql_table:' || tbl, 'sql_table:' || parent, 'fk' FROM f WHERE parent IN (SELECT tbl FROM c)", graph=False)
def schema_edges(spark, d):
    """Edges of a schema: tables to columns, and references whose parent exists."""
    return facts.schema_graph(_columns(spark, d), _references(spark, d))[1]


@register(f"WITH {_COLUMNS} SELECT tbl AS table_, at_ AS at, regexp_replace(typ, '[^A-Za-z0-9_]', '_', 'g') || ' ' || col || CASE WHEN prim AND col IN (SELECT col FROM f) THEN ' PK, FK' WHEN prim THEN ' PK' WHEN col IN (SELECT col FROM f) THEN ' FK' ELSE '' END AS line FROM c", graph=False)
def er_columns(spark, d):
    """Columns of tables as lines of an ER diagram, with their marks."""
    return facts.column_flags(_columns(spark, d), _references(spark, d)).withColumnRenamed("table", "table_")


@register("""WITH u AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'P' THEN 'update' ELSE 'select' END AS op, 't' || o_orderkey % 3 AS tbl, ['a' || o_orderkey % 4, 'b' || o_orderkey % 5] AS columns, o_orderkey % 7 = 0 AS partial, CASE WHEN o_orderkey % 11 = 0 THEN 'e' || o_orderkey ELSE '' END AS error FROM orders),
 o AS (SELECT id, string_agg(op, ',' ORDER BY seq) AS ops FROM (SELECT id, op, min(seq) AS seq FROM u GROUP BY id, op) GROUP BY id), p AS (SELECT id, bool_or(partial) AS partial, coalesce(min_by(error, seq) FILTER (error <> ''), '') AS error FROM u GROUP BY id),
 c AS (SELECT id, tbl, string_agg(c, ' ' ORDER BY seq, i) AS cols FROM (SELECT id, tbl, c, min(seq) AS seq, min_by(i, seq) AS i FROM (SELECT id, tbl, seq, unnest(columns) AS c, unnest([1, 2]) AS i FROM u) GROUP BY id, tbl, c) GROUP BY id, tbl),
 t AS (SELECT id, tbl, min(seq) AS seq, coalesce(min_by(op, seq) FILTER (op <> 'select'), 'select') AS op FROM u GROUP BY id, tbl), x AS (SELECT id, string_agg(tbl || ':' || op || '[' || cols || ']', ' ' ORDER BY seq) AS tables FROM t JOIN c USING (id, tbl) GROUP BY id)
 SELECT id, ops, tables, partial, error FROM o JOIN p USING (id) JOIN x USING (id)""", graph=False)
def merged_values(spark, d):
    """Readings of a statement's possible values as one."""
    k = F.col("o_orderkey")
    t = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    op = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "P", "update").otherwise("select")
    return facts.merge_values(read(spark, d, "orders").select(F.col("o_custkey").alias("id"), k.alias("seq"), op.alias("op"), t("t", k % 3).alias("tbl"), F.array(t("a", k % 4), t("b", k % 5)).alias("columns"), (k % 7 == 0).alias("partial"), F.when(k % 11 == 0, t("e", k)).otherwise("").alias("error")))


@register("""WITH r AS (SELECT o_custkey AS call, CASE o_orderkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, min(o_orderkey) AS seq, CASE o_orderkey % 3 WHEN 0 THEN '/en' WHEN 1 THEN '/de-AT' ELSE '/shop' END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/p' || o_orderkey % 4 END AS path FROM orders GROUP BY ALL),
 g AS (SELECT *, CASE WHEN starts_with(path, '/shop') THEN path ELSE '/{lang}' || regexp_replace(path, '^/[^/]*', '') END AS shape FROM r)
 SELECT call, method, CASE WHEN count(*) > 1 THEN shape ELSE min(path) END AS pattern, CASE WHEN count(*) > 1 THEN string_agg(path, ' ' ORDER BY seq) ELSE '' END AS variants FROM g GROUP BY call, method, shape""", graph=False)
def language_registrations(spark, d):
    """Registrations of a call and a method that differ in the language alone as one, with its variants."""
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 3 == 0, "/en").when(k % 3 == 1, "/de-AT").otherwise("/shop"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("/p"), (k % 4).cast("string"))))
    return facts.language_groups(read(spark, d, "orders").select(F.col("o_custkey").alias("call"), k.alias("seq"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path")))


@register("""WITH s AS (SELECT DISTINCT o_custkey AS module, o_orderkey % 6 AS dir FROM orders), z AS (SELECT module, count(*) AS size FROM s GROUP BY module), p AS (SELECT a.module, b.module AS other, count(*) AS n FROM s a JOIN s b ON a.dir = b.dir AND a.module <> b.module GROUP BY ALL)
 SELECT module, size FROM z WHERE module NOT IN (SELECT p.module FROM p JOIN z ON z.module = p.module JOIN z y ON y.module = p.other WHERE n = z.size AND (y.size > z.size OR p.other < p.module))""", graph=False)
def covered_modules(spark, d):
    """Modules whose folders are not all another's."""
    return facts.covered(read(spark, d, "orders").select(F.col("o_custkey").alias("module"), (F.col("o_orderkey") % 6).alias("dir")))


@register("""SELECT l_orderkey AS k, l_linenumber AS line, 'sink.sql:f' || l_suppkey || '.src:' || l_partkey || ':' || l_linenumber AS id, l_returnflag = 'A' AS resolved, 'sql_table:s' || l_suppkey AS tbl, 'sql_column:s' || l_suppkey || '.c' AS col,
 CASE l_returnflag WHEN 'A' THEN 'cascade' WHEN 'R' THEN 'restrict' ELSE '' END AS action, 'f' || l_suppkey || '.src:' || l_partkey AS place FROM lineitem""", graph=False)
def identities(spark, d):
    """Ids of sinks, tables and columns, whether values are known, and names of actions and places."""
    li, t = read(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    file, table = F.concat(F.lit("f"), t("l_suppkey"), F.lit(".src")), F.concat(F.lit("s"), t("l_suppkey"))
    values = F.when(F.col("l_returnflag") == "A", F.array(F.lit("x"))).when(F.col("l_returnflag") == "R", F.array(F.lit("x"), F.lit("a{?}"))).otherwise(F.array().cast("array<string>"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), X.sink_id(F.lit("sink.sql"), file, F.col("l_partkey"), F.col("l_linenumber")).alias("id"), X.resolved(values).alias("resolved"), X.table_id(table).alias("tbl"), X.column_id(table, F.lit("c")).alias("col"), X.fk_action(F.when(F.col("l_returnflag") == "A", "c").when(F.col("l_returnflag") == "R", "r").otherwise("a")).alias("action"), X.position(file, F.col("l_partkey")).alias("place"))


@register("""WITH p AS (SELECT c_custkey AS k, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS v, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
 SELECT k, CASE WHEN len(v) * len(s) > 8 THEN '{?}' ELSE array_to_string(flatten(list_transform(v, lambda a: list_transform(s, lambda b: a || b))), '|') END AS joined, array_to_string(list_filter(list_concat(v, s), lambda x: true), '|') AS united FROM p""", graph=False)
def alternatives(spark, d):
    """All joins of two lists of alternatives, unknown beyond a number of them; and both lists in order without an empty one."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("v"), F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return o.select("k", F.array_join(X.concat_alternatives(F.col("v"), F.col("s"), 8), "|").alias("joined"), F.array_join(X.drop_empty_alternative(F.array_union(F.concat(F.col("v"), F.array(F.lit(""))), F.col("s"))), "|").alias("united"))


@register("""SELECT k, CASE WHEN o_orderstatus = 'F' THEN p || o_custkey || '/' || o_orderpriority || e || '|' || p || o_custkey || '/x' || e ELSE p || o_custkey || '/{?}' || e END AS urls, 'select a' || k || ' from t limit $1' AS sql
 FROM (SELECT *, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '/u/' WHEN 1 THEN '/v%/' WHEN 2 THEN '/w/' ELSE '' END AS p, CASE o_orderkey % 4 WHEN 1 THEN '/{?}' WHEN 2 THEN '%' ELSE '' END AS e FROM orders)""", graph=False)
def folded_formats(spark, d):
    """URLs made by formats of known or unknown parts, with widths and percent signs, and holes behind a dollar sign."""
    o = read(spark, d, "orders")
    known = F.when(F.col("o_orderstatus") == "F", F.array(F.array(F.col("o_custkey").cast("string")), F.array(F.col("o_orderpriority"), F.lit("x")))).otherwise(F.array(F.array(F.col("o_custkey").cast("string"))))
    known = F.when(F.col("o_orderkey") % 4 == 1, F.slice(known, 1, 2)).otherwise(known)
    form = F.element_at(F.array(*map(F.lit, ("/u/%d/%s", "/v%%/%05d/%-8.2f/%T", "/w/%+d/%q%%", "%v/%s"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("select a"), F.col("o_orderkey").cast("string"), F.lit(" from t limit ${?}{?}"))
    return o.select(F.col("o_orderkey").alias("k"), F.array_join(X.fold_format(form, known), "|").alias("urls"), X.hole_parameters(text).alias("sql"))


_DDL = """WITH o AS (SELECT o_custkey AS db, o_orderkey AS k, 't' || o_orderkey AS t, 'u' || o_custkey AS u, o_orderkey % 4 AS f FROM orders), a AS (SELECT *, CASE f WHEN 0 THEN 'r' || k ELSE t END AS tbl FROM o WHERE f <> 2)
 SELECT db, tbl AS "table", 'column' AS part, unnest(range(3))::INTEGER AS at, unnest(['id', 'owner', CASE f WHEN 1 THEN 'extra' WHEN 3 THEN 'memo' ELSE 'note' END]) AS name, '' AS columns, unnest(['bigserial', 'int8', CASE f WHEN 1 THEN 'text[]' ELSE 'varchar' END]) AS type, unnest(['not null', 'not null', '']) AS detail FROM a
 UNION ALL SELECT db, tbl, 'primary', 0, '', 'id', '', '' FROM a
 UNION ALL SELECT db, tbl, 'reference', 0, '', 'owner', u, 'id cascade' FROM a
 UNION ALL SELECT db, tbl, 'index', 0, 'un' || k, 'owner,note', '', 'unique' FROM a
 UNION ALL SELECT db, tbl, 'index', 1, 'ix' || k, 'memo', '', 'unique' FROM a WHERE f = 3"""


@register(_DDL, graph=False)
def ddl_replay(spark, d):
    """Schemas after the migrations of every customer's database: a table for each order, some renamed, changed or dropped."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey").cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    t = c("t", k)
    sql = c("-- one table\nCREATE TABLE IF NOT EXISTS ", t, " (\n id bigserial PRIMARY KEY, owner bigint NOT NULL REFERENCES u", F.col("o_custkey").cast("string"), " (id) ON DELETE CASCADE,\n note varchar(20) DEFAULT 'a;b', CONSTRAINT un", k, " UNIQUE (owner, note));\n")
    form = F.col("o_orderkey") % 4
    more = F.when(form == 0, c("ALTER TABLE ", t, " RENAME TO r", k)).when(form == 1, c("ALTER TABLE ", t, " DROP COLUMN note, ADD COLUMN extra text[]")).when(form == 2, c("DROP TABLE IF EXISTS ", t, "; SELECT 1")).otherwise(c("ALTER TABLE ", t, " RENAME COLUMN note TO memo; CREATE UNIQUE INDEX ix", k, " ON ", t, " (memo)"))
    return schema.replay(o.select(F.col("o_custkey").alias("db"), F.col("o_orderkey").alias("seq"), F.concat(sql, more).alias("sql")))


@register("""WITH f AS (SELECT DISTINCT CASE o_orderkey % 6 WHEN 0 THEN 'm' || o_custkey || '/src/main/resources/db/migration' WHEN 1 THEN 'm' || o_custkey || '/src/main/resources/db/migration/mysql' WHEN 2 THEN 'm' || o_custkey || '/src/main/resources/db/migration/postgresql'
  WHEN 3 THEN 'target/m' || o_custkey || '/src/main/resources/db/migration' WHEN 4 THEN 'n' || o_custkey || '/src/main/resources/db/migration/h2' ELSE 'x' || o_custkey || '/sql' END AS dir, o_orderkey % 6 AS f, o_custkey AS c FROM orders)
 SELECT dir FROM f WHERE f IN (0, 4) OR (f = 2 AND c NOT IN (SELECT c FROM f WHERE f = 0)) OR (f = 1 AND c NOT IN (SELECT c FROM f WHERE f IN (0, 2)))""", graph=False)
def flyway_folders(spark, d):
    """Migration folders of modules, of several databases' the one for postgres."""
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    base = "/src/main/resources/db/migration"
    dirs = F.when(k % 6 == 0, F.concat(F.lit("m"), c, F.lit(base))).when(k % 6 == 1, F.concat(F.lit("m"), c, F.lit(base + "/mysql"))).when(k % 6 == 2, F.concat(F.lit("m"), c, F.lit(base + "/postgresql")))
    dirs = dirs.when(k % 6 == 3, F.concat(F.lit("target/m"), c, F.lit(base))).when(k % 6 == 4, F.concat(F.lit("n"), c, F.lit(base + "/h2"))).otherwise(F.concat(F.lit("x"), c, F.lit("/sql")))
    return migrations.flyway_dirs(o.select(F.concat(dirs, F.lit("/V"), k.cast("string"), F.lit("__a.sql")).alias("path")))


@register("""WITH f AS (SELECT DISTINCT 'web/n' || o_custkey % 7 || '/' || CASE o_orderkey % 2 WHEN 0 THEN 'p' ELSE 'q' END || o_orderkey % 50 || '.html' AS path, o_custkey % 7 AS dir, o_orderkey % 2 AS q, o_orderkey % 50 AS n FROM orders), s AS (SELECT DISTINCT o_custkey % 7 AS dir FROM orders)
 SELECT 's' || s.dir AS source, path FROM s JOIN f USING (dir) WHERE (q = 0 AND n < 10) OR n = 33""", graph=False)
def template_files(spark, d):
    """Files that template patterns name."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    folder = (F.col("o_custkey") % 7).cast("string")
    files = o.select(F.concat(F.lit("web/n"), folder, F.lit("/"), F.when(k % 2 == 0, "p").otherwise("q"), (k % 50).cast("string"), F.lit(".html")).alias("path")).distinct()
    patterns = o.select(folder.alias("f")).distinct().select(F.concat(F.lit("s"), "f").alias("source"), F.explode(F.array(F.concat(F.lit("web/n"), "f", F.lit("/p?.html")), F.concat(F.lit("web/n"), "f", F.lit("/q33*.html")))).alias("glob"))
    return templates.matching_files(files, patterns)


def _templates(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    next_ = F.concat(F.lit("t"), (k - k % 6 + (k + 1) % 6).cast("string"))
    text = F.concat(F.lit("{{/* note */}}<p>{{if .Ok}}"), k.cast("string"), F.lit("{{else}}none{{end}}</p>{{.Title}}"), F.when(k % 6 < 4, F.concat(F.lit('{{template "'), next_, F.lit('" .}}'))).otherwise(""))
    return o.select(F.concat(F.lit("t"), k.cast("string")).alias("name"), text.alias("text"))


@register("SELECT 't' || o_orderkey AS name, '<p>' || o_orderkey || 'none</p>{?}' AS text, CASE WHEN o_orderkey % 6 < 4 THEN 't' || (o_orderkey - o_orderkey % 6 + (o_orderkey + 1) % 6) ELSE '' END AS uses FROM orders", graph=False)
def flat_templates(spark, d):
    """Templates without their actions, and what they include."""
    return templates.flattened(_templates(spark, d)).select("name", "text", F.array_join("uses", ",").alias("uses"))


@register("""WITH RECURSIVE e AS (SELECT 't' || o_orderkey AS src, 't' || (o_orderkey - o_orderkey % 6 + (o_orderkey + 1) % 6) AS dst FROM orders WHERE o_orderkey % 6 < 4), n AS (SELECT 't' || o_orderkey AS name FROM orders),
 w AS (SELECT name AS root, name AS node, 0 AS depth FROM n UNION ALL SELECT root, dst, depth + 1 FROM w JOIN e ON src = node JOIN n ON name = dst) SELECT root, node, depth::INTEGER AS depth FROM w""", graph=False)
def template_includes(spark, d):
    """Every template with all that it includes."""
    return templates.includes(templates.flattened(_templates(spark, d)))


@register("SELECT 't' || o_orderkey AS name, 'Title' AS field, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_custkey ELSE (SELECT string_agg(DISTINCT 'p' || p_size, ',' ORDER BY 'p' || p_size) FROM part) END AS values FROM orders", graph=False)
def template_values(spark, d):
    """What fields of templates may hold: stored for the template, else anywhere."""
    values = read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("scope"), F.lit("Title").alias("field"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("value"))
    anywhere = read(spark, d, "part").select(F.lit("main").alias("scope"), F.lit("Title").alias("field"), F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("value"))
    return templates.resolved_values(_templates(spark, d), values, anywhere).select("name", "field", F.array_join("values", ",").alias("values"))


@register("""WITH l AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '<(?:a|form|img|script|link|div|button)\\b[^>]*>')) AS tag FROM pages), x AS (SELECT id, regexp_extract(tag, '^<([a-z]+)', 1) AS element, regexp_extract(tag, '\\s(href|src|action)\\s*=\\s*"([^"]*)"', 1) AS attribute, regexp_extract(tag, '\\s(?:href|src|action)\\s*=\\s*"([^"]*)"', 1) AS url, tag FROM l)
 SELECT id, element, attribute, url, CASE element WHEN 'a' THEN 'GET' WHEN 'form' THEN 'GET' ELSE '' END AS method, CASE element WHEN 'a' THEN CASE attribute WHEN 'href' THEN 'link' ELSE '' END WHEN 'form' THEN CASE attribute WHEN 'action' THEN 'request' ELSE '' END WHEN 'div' THEN '' WHEN 'button' THEN '' ELSE 'asset' END AS kind, count(*) AS n FROM x WHERE attribute <> '' AND url <> '' AND NOT starts_with(url, '#') AND NOT starts_with(url, 'javascript:') AND (element <> 'link' OR contains(tag, 'stylesheet') OR contains(tag, 'icon')) GROUP BY ALL""", graph=False)
def page_references(spark, d):
    """URLs in the markup of every page with their methods and kinds."""
    rows = templates.references(read(spark, d, "pages").select(F.col("page_id").alias("id"), "html"))
    return rows.groupBy("id", "element", "attribute", "url", "method", "kind").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT o_orderkey AS id, CASE o_orderkey % 6
 WHEN 0 THEN 'GET /en/' || o_custkey || ' GET /de/' || o_custkey WHEN 1 THEN 'a{?} a' WHEN 2 THEN '/api//x /api/' || o_custkey || '/x' WHEN 3 THEN '{?}' WHEN 4 THEN 'n' || o_custkey ELSE '{?}' END AS texts FROM orders""", graph=False)
def folded_values(spark, d):
    """Texts of a value for every order: a loop over languages, a circle, joined paths, an unknown, a result without its empty text, too many."""
    o = read(spark, d, "orders")
    k, c, form = F.col("o_orderkey") * 64, F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    value = lambda i, op, text="": F.struct((k + i).alias("id"), F.lit(op).alias("op"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    use = lambda i, at, arg: F.struct((k + i).alias("id"), F.lit(at).alias("at"), (k + arg).alias("arg"))
    made = F.when(form == 0, F.array(value(0, "concat"), value(1, "concat"), value(2, "any"), value(3, "const", "GET "), value(4, "const", "/en/"), value(5, "const", "/de/"), value(6, "same"), value(7, "const", c)))
    made = made.when(form == 1, F.array(value(0, "any"), value(1, "concat"), value(2, "const", "a"), value(3, "same")))
    made = made.when(form == 2, F.array(value(0, "path"), value(1, "const", "/api"), value(2, "any"), value(3, "const", ""), value(4, "const", c), value(5, "const", "x")))
    made = made.when(form == 3, F.array(value(0, "any"), value(1, "call")))
    made = made.when(form == 4, F.array(value(0, "result"), value(1, "const", ""), value(2, "const", F.concat(F.lit("n"), c))))
    made = made.otherwise(F.array(value(0, "any"), *[value(i, "const", str(i)) for i in range(1, 34)]))
    used = F.when(form == 0, F.array(use(0, 0, 1), use(0, 1, 6), use(1, 0, 3), use(1, 1, 2), use(2, 0, 4), use(2, 1, 5), use(6, 0, 7)))
    used = used.when(form == 1, F.array(use(0, 0, 1), use(0, 1, 2), use(1, 0, 2), use(1, 1, 3), use(3, 0, 0)))
    used = used.when(form == 2, F.array(use(0, 0, 1), use(0, 1, 2), use(0, 2, 5), use(2, 0, 3), use(2, 1, 4)))
    used = used.when(form == 3, F.array(use(0, 0, 1))).when(form == 4, F.array(use(0, 0, 1), use(0, 1, 2))).otherwise(F.array(*[use(0, i, i) for i in range(1, 34)]))
    found = values.fold(o.select(F.inline(made)), o.select(F.inline(used)), o.select(k.alias("id")))
    return found.select((F.col("id") / 64).cast("long").alias("id"), F.array_join("texts", " ").alias("texts"))


_MOUNTS = """m AS (SELECT c_custkey AS router, CASE WHEN c_custkey % 40 > 0 THEN c_custkey - CASE WHEN c_custkey % 3 = 0 AND c_custkey % 40 > 1 THEN 2 ELSE 1 END END AS parent, floor(c_custkey / 40)::BIGINT % 4 AS f,
  CASE c_custkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/a' || c_custkey WHEN 2 THEN '/b/' WHEN 3 THEN 'c' ELSE '' END AS pattern FROM customer)"""
_JOINED = "CASE f WHEN 0 THEN CASE WHEN {x} = '/' AND {p} <> '' THEN {p} ELSE regexp_replace({p}, '/$', '') || {x} END WHEN 1 THEN CASE WHEN {x} = '' THEN CASE WHEN {p} = '' THEN '/' ELSE {p} END ELSE regexp_replace({p}, '/$', '') || '/' || regexp_replace({x}, '^/', '') END ELSE {p} || {x} END"


@register(f"""WITH RECURSIVE {_MOUNTS}, w AS (SELECT router, f, '' AS prefix FROM m WHERE parent IS NULL UNION ALL SELECT m.router, m.f, {_JOINED.replace('{x}', 'm.pattern').replace('{p}', 'w.prefix').replace('CASE f', 'CASE m.f')} FROM w JOIN m ON m.parent = w.router),
 r AS (SELECT o_orderkey AS id, o_custkey AS router, CASE o_orderkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '' ELSE '/x' || o_orderkey END AS pattern FROM orders)
 SELECT id, {_JOINED.replace('{x}', 'pattern').replace('{p}', 'prefix')} AS path FROM r JOIN w USING (router)""", graph=False)
def mounted_routes(spark, d):
    """Paths of a route for every order, on routers that are mounted below one another in chains of up to forty, by four rules."""
    k = F.col("c_custkey")
    above = F.when(k % 40 > 0, k - F.when((k % 3 == 0) & (k % 40 > 1), 2).otherwise(1))
    framework = F.element_at(F.array(*map(F.lit, ("chi", "gin", "echo", "gorilla"))), (F.floor(k / 40) % 4 + 1).cast("int"))
    pattern = F.when(k % 5 == 0, "/").when(k % 5 == 1, F.concat(F.lit("/a"), k.cast("string"))).when(k % 5 == 2, "/b/").when(k % 5 == 3, "c").otherwise("")
    tree = read(spark, d, "customer").select(k.alias("router"), above.alias("parent"), framework.alias("framework"), F.when(above.isNotNull(), pattern).alias("pattern"))
    o = F.col("o_orderkey")
    routes = read(spark, d, "orders").select(o.alias("id"), F.col("o_custkey").alias("router"), F.when(o % 3 == 0, "/").when(o % 3 == 1, "").otherwise(F.concat(F.lit("/x"), o.cast("string"))).alias("pattern"))
    return mounts.mounted(routes, tree).select("id", "path")


_BLOCKS = """b AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS block, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey, l_suppkey, l_returnflag FROM lineitem),
 e AS (SELECT fn, block AS src, 0 AS at, block + 1 AS dst FROM b WHERE block + 1 < n UNION ALL SELECT fn, block, 1, (l_partkey + l_suppkey) % n FROM b WHERE l_returnflag <> 'N' AND block + 1 < n),
 t AS (SELECT fn, block, CASE l_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, l_suppkey % 2 = 0 AS equal FROM b WHERE l_returnflag = 'A' AND block + 1 < n)"""


def _blocks(spark, d):
    """Edges and method tests of a function for every order, with a block for every line: each leads to the next, some also elsewhere."""
    from pyspark.sql import Window as W

    own = W.partitionBy("l_orderkey")
    b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), (F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).cast("long").alias("block"), F.count(F.lit(1)).over(own).alias("n"), "l_partkey", "l_suppkey", "l_returnflag").filter("block + 1 < n")
    edges = b.select("fn", F.col("block").alias("src"), F.lit(0).alias("at"), (F.col("block") + 1).alias("dst"))
    edges = edges.union(b.filter("l_returnflag <> 'N'").select("fn", "block", F.lit(1), (F.col("l_partkey") + F.col("l_suppkey")) % F.col("n")))
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    return edges, b.filter("l_returnflag = 'A'").select("fn", "block", method.alias("method"), (F.col("l_suppkey") % 2 == 0).alias("equal"))


@register(f"""WITH RECURSIVE {_BLOCKS}, v AS (SELECT fn, 0::BIGINT AS block FROM e UNION SELECT v.fn, e.dst FROM v JOIN e ON e.fn = v.fn AND e.src = v.block),
 w AS (SELECT fn, block AS out_, 0::BIGINT AS block FROM v WHERE block > 0 UNION SELECT w.fn, w.out_, e.dst FROM w JOIN e ON e.fn = w.fn AND e.src = w.block AND e.dst <> w.out_)
 SELECT v.fn, v.block, o.block AS by FROM v JOIN v o ON o.fn = v.fn WHERE o.block = 0 OR NOT EXISTS (SELECT 1 FROM w WHERE w.fn = v.fn AND w.out_ = o.block AND w.block = v.block)""", graph=False)
def block_dominators(spark, d):
    """Which blocks every way to a block goes through; the other side leaves each block out in turn."""
    return blocks.dominates(blocks.dominators(_blocks(spark, d)[0]))


@register(f"""WITH RECURSIVE {_BLOCKS}, m AS (SELECT fn, method, min(block) AS first FROM t GROUP BY fn, method UNION ALL SELECT DISTINCT fn, '*', 1000000 FROM t),
 v AS (SELECT fn, method, first, 0::BIGINT AS block FROM m UNION SELECT v.fn, v.method, v.first, e.dst FROM v JOIN e ON e.fn = v.fn AND e.src = v.block LEFT JOIN t ON t.fn = v.fn AND t.block = v.block WHERE t.method IS NULL OR e.at = CASE WHEN (t.method = v.method) = t.equal THEN 0 ELSE 1 END)
 SELECT fn, block, string_agg(method, ',' ORDER BY first, method) AS methods FROM v GROUP BY fn, block""", graph=False)
def method_scopes(spark, d):
    """Methods that each block of a function runs under, where the function tests the method."""
    return blocks.method_scopes(*_blocks(spark, d))


@register("""SELECT id, 0::INTEGER AS part, 0::INTEGER AS at, '  ' || name || ' {' AS line FROM nodes WHERE kind = 'sql_table' UNION ALL SELECT id, 2, 0, '  }' FROM nodes WHERE kind = 'sql_table'
 UNION ALL SELECT c.parent, 1, c.start_line, '    ' || c.detail || ' ' || c.name || ' ' || concat_ws(',', CASE c.flag WHEN 'true' THEN 'PK' END, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'fk' AND e.src = c.parent AND e.col = c.name) THEN 'FK' END)
  FROM nodes c WHERE c.kind = 'sql_column' AND c.parent IN (SELECT id FROM nodes WHERE kind = 'sql_table')
 UNION ALL SELECT e.src, 3, 0, '  ' || s.name || ' }o--|| ' || t.name || ' : "' || e.col || CASE e.op WHEN 'delete' THEN ' on delete cascade' ELSE '' END || '"' FROM edges e JOIN nodes s ON s.id = e.src AND s.kind = 'sql_table' JOIN nodes t ON t.id = e.dst AND t.kind = 'sql_table' WHERE e.kind = 'fk'""")
def er_bodies(spark, d):
    """Tables with their columns, keys and references as lines of a diagram."""
    n = _nodes(spark, d, "sql_table", "sql_column")
    columns = n.filter("kind = 'sql_column'").select(F.col("parent").alias("table"), "name", F.col("detail").alias("type"), (F.col("flag") == "true").alias("primary"), F.col("start_line").alias("at"))
    fk = A.edges(spark, d).filter("kind = 'fk'").select("src", "dst", F.col("col").alias("columns"), F.when(F.col("op") == "delete", "cascade").otherwise("").alias("on_delete"))
    return sequence.er_bodies(n.filter("kind = 'sql_table'").select("id", "name"), columns, fk)
