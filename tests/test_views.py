"""Views, diagrams, migrations and generations on small fixtures, and their SQL at the smallest size."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.model import EDGES, NODES, Graph
from routeloom.operators import diagrams, store, views
from routeloom.plans import queries, view_queries as V
from routeloom.sources import migrations as M

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in V.SQL if V.QUERIES[n].__module__ == V.__name__)


def rows_of(pdf):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    got = rows_of(V.QUERIES[name](spark, DATA).toPandas())
    assert got and got == rows_of(con.sql(V.SQL[name]).df())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert value(spark, X.positional(F.lit("a = ? and b = ':x' and c = :x::int and d = ?"))) == "a = $1 and b = ':x' and c = $2::int and d = $3"
    assert value(spark, X.positional(F.lit(""))) == ""
    assert value(spark, X.resolved(F.array(F.lit("a"), F.lit("b{?}")))) is False
    assert value(spark, X.resolved(F.array(F.lit("a")))) is True
    assert value(spark, X.request_shape(F.lit("/a/{id}/b/{x...}"))) == "/a/{}/b/{}"


def test_versions_are_numbers_and_repeatable_files_come_last(spark):
    names = ["V10__b.sql", "V2__a.sql", "V2.1__c.sql", "R__z.sql", "R__a.sql", "U2__a.sql"]
    files = spark.createDataFrame([(f"db/{n}",) for n in names], "path string")
    got = [r.path[3:] for r in M.versioned(files).orderBy(*M.run_order()).collect()]
    assert got == ["V2__a.sql", "V2.1__c.sql", "V10__b.sql", "R__a.sql", "R__z.sql"]
    stray = spark.createDataFrame([(f"db/{n}",) for n in ("V10__b.sql", "V2__a.sql", "notes.sql")], "path string")  # run by name
    assert [r.path[3:] for r in M.versioned(stray).orderBy(*M.run_order()).collect()] == ["V10__b.sql", "V2__a.sql", "notes.sql"]


def test_up_files_and_up_lines(spark, tmp_path):
    files = spark.createDataFrame([("a/1.up.sql", ""), ("a/1.down.sql", ""), ("a/2.sql", ""), ("b/1.sql", ""), ("b/1.down.sql", "")], "path string, text string")
    assert sorted(r.path for r in M.up_files(files).collect()) == ["a/1.up.sql", "b/1.sql"]
    one = spark.createDataFrame([("f", "x\n-- +goose Down\ny\n-- +goose Up\nz")], "path string, text string")
    assert [r.text for r in M.up_lines(one).orderBy("line").collect()] == ["x", "", "", "-- +goose Up", "z"]
    (tmp_path / "migrations").mkdir()
    (tmp_path / "migrations" / "1.sql").write_text("create table t")
    read = M.read_files(spark, str(tmp_path)).filter(M.in_default_dirs(F.col("path"))).collect()
    assert [r.text for r in read] == ["create table t"]


def test_replay_ignores_a_second_create_and_forgets_dropped_tables(spark):
    rows = [("t", 1, "create", "a"), ("t", 2, "create", "b"), ("t", 3, "add", "c"), ("t", 4, "drop", "a"), ("u", 1, "create", "x"), ("u", 2, "drop_table", None), ("v", 1, "add", "q"), ("w", 1, "create", "x"), ("w", 2, "drop_table", None), ("w", 3, "create", "y")]
    got = M.replay(spark.createDataFrame(rows, "tbl string, seq long, op string, column string"))
    assert {tuple(r) for r in got.collect()} == {("t", "c"), ("w", "y")}


def test_drawn_trees(spark):
    rows = [("r", 0, -1, 1, "h", "", 1), ("r", 1, 0, 2, "a", "", 2), ("r", 2, 1, 3, "sink.sql:q", "sink", 1), ("r", 3, 0, 2, "h", "cycle", 1)]
    trees = spark.createDataFrame(rows, "root string, step int, parent int, depth int, node string, mark string, calls int")
    assert [r.line for r in diagrams.tree_lines(trees).orderBy("step").collect()] == ["└── h", "    ├── a ×2", "    │   └── sink.sql:q", "    └── h (recursive)"]
    assert [r.line for r in diagrams.sequence_lines(trees).orderBy("step").collect()][2] == "a->>sink_sql: sink.sql:q"


def test_site_map_leaves_out_moves_to_itself_and_to_unknown_pages(spark):
    routes = spark.createDataFrame([("route:a", 'A "x"', "GET", "public"), ("route:b", "B", "POST", "admin")], "id string, name string, method string, access string")
    moves = spark.createDataFrame([("route:a", "route:b", "form"), ("route:a", "route:a", "link"), ("route:a", "route:z", "link")], "src string, dst string, trigger string")
    assert {r.line for r in diagrams.site_map_lines(routes, moves).collect()} == {'route_a(["A #quot;x#quot;"])', 'route_b[/"B"/]', "route_a ==> route_b"}


def test_slices_and_owners(spark):
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, "a"), (3, None)], "id int, text string")
    got = {r.id: r.part for r in views.slice_lines(texts, 2, 9).collect()}
    assert got == {1: "b\nc", 2: None, 3: None}
    items, owners = (spark.createDataFrame(x, "key string, seq long") for x in ([("k", 1), ("k", 5), ("m", 9)], [("k", 2), ("k", 4), ("k", 7)]))
    assert {(r.key, r.seq, r.owner) for r in views.latest_before(items, owners).collect()} == {("k", 1, None), ("k", 5, 4), ("m", 9, None)}


def test_generations_follow_each_other(spark, tmp_path):
    graph = Graph(spark.createDataFrame([("func:a", "func", "a", "", "", "", 0, 0, 0, 0, {})], NODES), spark.createDataFrame([], EDGES))
    path = str(tmp_path / "g")
    assert store.published(spark, path) is None
    assert [store.publish(graph, path), store.publish(graph, path)] == [1, 2]
    number, folder = store.published(spark, path)
    assert number == 2 and store.read_tables(spark, folder).nodes.first().id == "func:a"


def test_all_are_registered():
    assert V.QUERIES is queries.QUERIES and {"flow_text", "sequence_diagram", *NAMES} <= set(V.QUERIES)
