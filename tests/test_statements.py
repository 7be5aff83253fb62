"""Statement analysis on written-out cases: scopes, aliases, written columns, and texts that can't be read."""

from pyspark.sql import functions as F

from routeloom.operators import facts, statements

CASES = [  # sql, ops, tables, partial, broken
    ("SELECT city, code FROM stations WHERE line_id = $1", "select", "stations:select[city code line_id]", False, False),
    ("select * from stations st where st.line_id = 3", "select", "stations:select[* line_id]", False, False),
    ("SELECT l.name, o.title FROM lines l JOIN operators o ON o.id = l.operator_id WHERE l.code = $1", "select", "lines:select[name operator_id code] operators:select[title id]", False, False),
    ("INSERT INTO trips (line_id, day) SELECT $1, d FROM days WHERE open", "insert", "trips:insert[line_id day] days:select[]", False, False),
    ("UPDATE trips SET delay = $1, seen = seen + 1 WHERE id = $2", "update", "trips:update[delay seen id]", False, False),
    ("DELETE FROM trips WHERE day < $1", "delete", "trips:delete[day]", False, False),
    ("WITH old AS (DELETE FROM trips WHERE day < $1 RETURNING id) SELECT count(*) FROM old", "select", "trips:delete[day id]", False, False),
    ("SELECT max(delay) FROM trips WHERE {?}", "select", "trips:select[delay]", True, False),
    ("SELECT id FROM trips ORDER BY {?} LIMIT ${?}", "select", "trips:select[id]", True, False),
    ("CREATE TABLE IF NOT EXISTS marks (n int, at date)", "ddl", "marks:ddl[]", False, False),
    ("ALTER TABLE trips ADD COLUMN x int; TRUNCATE a, b", "ddl ddl", "trips:ddl[] a:ddl[] b:ddl[]", False, False),
    ("SELECT now()", "select", "", False, False),
    ("BEGIN; UPDATE a SET x = 1; INSERT INTO b (y) VALUES (2); COMMIT", "other update insert other", "a:update[x] b:insert[y]", False, False),
    ("UPDATE trips SET", "update", "trips:update[]", True, True),
    ("INSERT INTO trips (a, b", "insert", "trips:insert[]", True, True),
    ("SELECT a.x, b.y FROM t1 a, t2 AS b WHERE a.id = b.id FOR UPDATE", "select", "t1:select[x id] t2:select[y id]", False, False),
    ("INSERT INTO k (id, n) VALUES ($1, $2) ON CONFLICT (id) DO UPDATE SET n = excluded.n", "insert", "k:insert[id n]", False, False),
    ("SELECT 'from nowhere' AS x -- from comment\nFROM \"Big Trips\" WHERE Name = 'a;b'", "select", "Big Trips:select[name]", False, False),
    ("", "", "", False, False),
    # from that leads to no table
    ("SELECT extract(year FROM created) FROM trips", "select", "trips:select[created]", False, False),
    ("SELECT trim(both from code), substring(name from 2 for 3) FROM lines", "select", "lines:select[code name]", False, False),
    ("SELECT id FROM lines WHERE a IS DISTINCT FROM b AND c IS NOT DISTINCT FROM d", "select", "lines:select[id a b c d]", False, False),
    ("SELECT $$from z$$, $q$ join y $q$, E'\\'from x' FROM lines", "select", "lines:select[]", False, False),
    # aliases are no columns
    ("SELECT q.n FROM (SELECT y AS n FROM t) q", "select", "t:select[y]", False, False),
    ("SELECT count(*) total, a b FROM t", "select", "t:select[a]", False, False),
    ("SELECT CASE WHEN a THEN b END kind, c::text, CAST(d AS double precision), interval '1 day' FROM t", "select", "t:select[a b c d]", False, False),
    # nested scopes
    ("SELECT x.a FROM t1 x WHERE EXISTS (SELECT 1 FROM t2 x WHERE x.b = 1 AND x.c IN (SELECT x.d FROM t3 x)) AND x.e = 2", "select", "t1:select[a e] t2:select[b c] t3:select[d]", False, False),
    ("SELECT o.id FROM (a JOIN (b JOIN c ON b.x = c.x) ON a.y = b.y) JOIN o USING (z)", "select", "a:select[y] b:select[x y] c:select[x] o:select[id]", False, False),
    ("WITH RECURSIVE up (id, boss) AS (SELECT id, boss FROM staff UNION ALL SELECT s.id, s.boss FROM staff s JOIN up ON up.boss = s.id), one AS MATERIALIZED (SELECT 1) SELECT * FROM up, one", "select", "staff:select[id boss *]", False, False),
    ("((((((((((((SELECT a FROM deep WHERE ((((((((((((b))))))))))))))))))))))))", "select", "deep:select[a b]", False, False),
    # writing
    ("UPDATE ONLY trips AS t SET (a, b) = (SELECT c, d FROM src s WHERE s.id = t.id), e[1] = 2 FROM lines l WHERE l.id = t.line_id", "update", "trips:update[a b e id line_id] src:select[id] lines:select[id]", False, False),
    ("DELETE FROM trips t USING lines l WHERE t.line_id = l.id RETURNING t.*", "delete", "trips:delete[line_id *] lines:select[id]", False, False),
    ("MERGE INTO stock s USING moves m ON s.id = m.id WHEN NOT MATCHED THEN INSERT (id, n) VALUES (m.id, m.n)", "merge", "stock:merge[id] moves:select[id n]", False, False),
    ("MERGE INTO stock s USING moves m ON s.id = m.id WHEN MATCHED THEN UPDATE SET n = m.n", "merge", "stock:merge[id] moves:select[id n]", False, False),
    ("INSERT INTO app.log AS l (at) VALUES (now()) RETURNING l.id", "insert", "app.log:insert[at id]", False, False),
    # functions and lists in from
    ("SELECT g.n, t.a FROM generate_series(1, 3) AS g(n), t, unnest($1) u WHERE t.b = u", "select", "t:select[a b u]", False, False),
    ("SELECT sum(a) FILTER (WHERE b) OVER (PARTITION BY c ORDER BY d), rank() OVER w FROM t WINDOW w AS (ORDER BY e)", "select", "t:select[a b c d e]", False, False),
    ("SELECT s.t.a, created AT TIME ZONE 'UTC' FROM s.t", "select", "s.t:select[a created]", False, False),
    ("SELECT a FROM t WHERE b = 'it''s' AND \"C\" = \"d\"\"e\"", "select", "t:select[a b C d\"e]", False, False),
]


def test_written_out_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, sql string")
    got = {r.id: (CASES[r.id][0], r.ops, r.tables, r.partial, r.broken) for r in statements.analyse(df).collect()}
    wrong = [(got[i], c[1:]) for i, c in enumerate(CASES) if got[i] != c]
    assert not wrong, "\n".join(map(str, wrong))


def test_depth_has_no_limit(spark):
    """A table forty brackets deep, and two texts that know nothing of each other."""
    sql = "SELECT a FROM t WHERE b IN " + "".join(f"(SELECT c{i} FROM t{i} WHERE d IN " for i in range(40)) + "(1)" + ")" * 40
    got = statements.analyse(spark.createDataFrame([(1, sql), (2, "SELECT 1"), (3, None)], "id int, sql string")).orderBy("id").collect()
    assert len(got[0].tables.split()) == 41 and not got[0].broken and got[1].tables == "" and got[2].ops == ""
    toks = statements.tokens(spark.createDataFrame([(1, "f(a, (b), g(c))")], "id int, sql string"))
    assert {r.tok: r.depth for r in toks.filter(F.col("kind") == "name").collect()} == {"f": 0, "a": 1, "b": 2, "g": 1, "c": 2}
    scopes = {r.tok: r.scope for r in toks.filter(F.col("kind") == "name").collect()}
    assert scopes["a"] == scopes["g"] and len({scopes["a"], scopes["b"], scopes["c"], scopes["f"]}) == 4


def test_linked_graph(spark):
    """Names with spaces, marks that stay, question marks, tables that only a statement names, columns and references of the schema."""
    sinks = [("a", 'SELECT x FROM "My Table" WHERE y = ?', "java.sql.Connection.prepareStatement", False), ("b", "DELETE FROM known WHERE id = 1", "db.Exec", True), ("c", "SELECT {?} FROM known", "db.Query", False), ("d", "", "db.Query", False), ("e", None, None, True), ("f", "SELECT b FROM other WHERE", "x", False)]
    columns = spark.createDataFrame([("known", 0, "id", "int8", True), ("known", 1, "up", "int8", False), ("kin", 0, "id", "int8", True)], "table string, at int, column string, type string, primary boolean")
    references = spark.createDataFrame([("known", 0, ["up"], "kin"), ("known", 1, ["up"], "gone")], "table string, at int, columns array<string>, parent string")
    nodes, edges = facts.linked_graph(spark.createDataFrame(sinks, "id string, sql string, callee string, partial boolean"), columns, references)
    got = {r.id: (r.kind, r.inferred, r.op, r.partial, r.broken) for r in nodes.collect()}
    assert {k: got[k] for k in got if k.startswith("sink")} == {"sink.sql:a": ("sink.sql", False, "select", False, False), "sink.sql:b": ("sink.sql", False, "delete", True, False), "sink.sql:c": ("sink.sql", False, "select", True, False), "sink.sql:d": ("sink.sql", False, "", False, False), "sink.sql:e": ("sink.sql", False, "", True, False), "sink.sql:f": ("sink.sql", False, "select", True, True)}
    assert {k: v[1] for k, v in got.items() if v[0] == "sql_table"} == {"sql_table:known": False, "sql_table:kin": False, "sql_table:My Table": True, "sql_table:other": True}
    assert {k for k, v in got.items() if v[0] == "sql_column"} == {"sql_column:known.id", "sql_column:known.up", "sql_column:kin.id"}
    got = {(r.src, r.dst, r.kind, r.op, r["columns"]) for r in edges.collect() if r.kind != "has_column"}
    assert got == {("sql_table:known", "sql_table:kin", "fk", "", ""), ("sink.sql:a", "sql_table:My Table", "queries", "select", "x,y"), ("sink.sql:b", "sql_table:known", "queries", "delete", "id"), ("sink.sql:c", "sql_table:known", "queries", "select", ""), ("sink.sql:f", "sql_table:other", "queries", "select", "")}
