"""Store, traversal, flow trees, functions and change feeds on small fixtures, and all SQL at the smallest size."""

import datetime
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.operators import flow, search, store, traverse
from routeloom.plans import queries as Q
from routeloom.streaming import changes

DATA = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(pairs)], "src string, dst string, id long")


def test_closure_is_breadth_first_and_ends_on_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")])
    got = traverse.closure(spark.createDataFrame([("a", "a")], "root string, node string"), e)
    assert sorted((r.node, r.depth) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 1)]


def test_paths_are_simple_and_ordered_by_length_then_text(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("a", "b")])
    pairs = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "zz")], "source string, target string")
    got = sorted((r.hops, r.ids) for r in traverse.paths(pairs, e, depth=5, limit=10).collect())
    assert got == [(1, "3,"), (2, "1,2,"), (2, "5,2,")]


def test_last_and_first_wins_and_dense_ids(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("m", 2, "y")], "k string, seq long, v string")
    assert {(r.k, r.v) for r in store.last_wins(rows, ["k"], "seq").collect()} == {("k", "z"), ("m", "y")}
    assert {(r.k, r.v) for r in store.first_wins(rows, ["k"], "seq").collect()} == {("k", "x"), ("m", "y")}
    many = spark.range(0, 500).select((F.col("id") * 7).alias("seq"))
    assert [r.id for r in store.dense_ids(many, "seq", width=50).orderBy("seq").collect()] == list(range(1, 501))


def document(**more):
    nodes = [{"id": "func:a", "kind": "func", "name": "a"}, {"id": "func:b", "kind": "func", "name": "b", "pos": {"file": "x.go", "startLine": 3}, "attrs": {"external": "true"}}]
    return {"version": 1, "nodes": nodes, "edges": [{"from": "func:a", "to": "func:b", "kind": "calls"}, {"from": "func:a", "to": "func:b", "kind": "calls"}]} | more


def test_import_and_export_are_inverse(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(document()))
    g = store.import_json(spark, str(tmp_path / "g.json"))
    assert (g.nodes.count(), g.edges.count()) == (2, 1)
    (tmp_path / "h.json").write_text(store.export_json(g))
    h = store.import_json(spark, str(tmp_path / "h.json"))
    assert sorted(map(str, g.nodes.collect())) == sorted(map(str, h.nodes.collect()))
    assert g.edges.collect() == h.edges.collect()


@pytest.mark.parametrize("more", [{"version": 7}, {"extra": 1}, {"edges": [{"from": "func:a", "to": "func:zz", "kind": "calls"}]}, {"nodes": [{"id": "x", "kind": "nope", "name": "x"}], "edges": []}, {"nodes": [{"id": "func:a", "kind": "func", "name": "a", "color": 1}], "edges": []}])
def test_bad_documents_are_refused(spark, tmp_path, more):
    (tmp_path / "g.json").write_text(json.dumps(document(**more)))
    with pytest.raises(store.GraphError):
        store.import_json(spark, str(tmp_path / "g.json"))


def test_flow_tree_marks():
    calls = {"route:r": ["func:a"], "func:a": ["func:b", "func:b", "func:c"], "func:b": ["func:a", "sink.sql:1"], "func:c": ["func:b", "func:idle"]}
    rows = flow.tree("route:r", calls, {"sink.sql:1": ["select sql_table:t"]})
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in rows] == [(1, "func:a", "", 1, ""), (2, "func:b", "", 2, ""), (3, "sink.sql:1", "sink", 1, "select sql_table:t"), (2, "func:c", "", 1, ""), (3, "func:b", "ref", 1, "")]
    assert [r[1] for r in rows] == [-1, 0, 1, 0, 3]
    full = flow.tree("route:r", calls, {}, prune=False)
    assert [(r[3], r[4]) for r in full][2] == ("func:a", "cycle")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_functions(spark):
    lit = F.lit
    assert value(spark, X.split_method(lit("GET /x"))) == "GET" and value(spark, X.split_method(lit("/x"))) == "ANY"
    assert value(spark, X.collapse_language(lit("/en/a"))) == "/{lang}/a" and value(spark, X.collapse_language(lit("/end/a"))) == "/end/a"
    assert value(spark, X.url_path(lit("/a?x={?}#y"))) == "/a" and value(spark, X.url_path(lit("https://e.org/a"))) == ""
    assert value(spark, X.url_path(lit("{?}/a"))) == "/{?}/a"
    assert value(spark, X.plural(lit("city"))) == "cities" and value(spark, X.plural(lit("box"))) == "boxes"
    assert value(spark, X.snake_case(lit("UserID"))) == "user_id"
    assert value(spark, X.match_score(lit("/notes/{id}"), lit("/notes/7"))) == 5
    assert value(spark, X.match_score(lit("/{a}/{b}"), lit("/x/y"))) == 0
    assert value(spark, X.match_score(lit("/files/{rest...}"), lit("/files/a/b"))) == 4
    assert value(spark, X.concat_alternatives(F.array(lit("a"), lit("b")), F.array(lit("1")))) == ["a1", "b1"]
    assert [tuple(u) for u in value(spark, X.fallback_tables(lit("DELETE FROM a WHERE x IN (SELECT y FROM b)")))] == [("delete", "a"), ("delete", "b")]


def test_search_and_resolve(spark):
    nodes = spark.createDataFrame([("sql_table:users", "sql_table", "users"), ("func:listUsers", "func", "listUsers"), ("func:users", "func", "users")], "id string, kind string, name string")
    assert [r.id for r in search.search(nodes, "USERS").collect()][0] == "func:users"
    assert search.search(nodes, "  ").count() == 0
    assert {r.id for r in search.search(nodes, "users list").collect()} == {"func:listUsers"}
    got = search.resolve(nodes, spark.createDataFrame([("users",), ("sql_table:users",), ("none",)], "name string"))
    assert {r.name: r.id for r in got.collect()} == {"users": "func:users", "sql_table:users": "sql_table:users"}


def test_changes(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", t, "a"), ("k", t + datetime.timedelta(seconds=1), "b"), ("k", t + datetime.timedelta(seconds=60), "a")], "key string, ts timestamp, item string")
    assert sorted((r.changes, r["items"]) for r in changes.debounce(rows, 10).collect()) == [(1, "a"), (2, "a,b")]
    shot = lambda x: spark.createDataFrame(x, "path string, mark long")
    assert {tuple(r) for r in changes.snapshot_diff(shot([("a", 1), ("b", 1)]), shot([("b", 2), ("c", 1)])).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}


def rows_of(pdf):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    assert rows_of(Q.QUERIES[name](spark, DATA).toPandas()) == rows_of(con.sql(Q.SQL[name]).df())
