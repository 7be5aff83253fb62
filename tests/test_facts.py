"""Facts, schemas and chains on written-out cases, and the queries on the application graph against their SQL."""

import duckdb
import pytest

from routeloom.operators import facts
from routeloom.plans import app_queries, queries
from routeloom.sources import schema

SMALL = "/root/testdata/sf0.001"
#: Queries whose operators have tests of their own with brute force; they take long to start.
ELSEWHERE = {"sql_query_analysis", "linked_tables", "linked_edges", "linked_graph_nodes", "linked_graph_edges", "resolve_references", "folded_values", "block_dominators", "method_scopes", "mounted_routes"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in app_queries.NAMES if n in queries.SQL and n not in ELSEWHERE])
def test_query_equals_its_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    other = tables.sql(queries.SQL[name])
    assert sorted(other.columns) == columns
    text = lambda v: str(round(v, 6) if isinstance(v, float) else v)
    got = sorted(tuple(text(r[c]) for c in columns) for r in found.collect())
    at = [other.columns.index(c) for c in columns]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in other.fetchall())


def test_chains(spark):
    rows = [("a", "FindInBatches", "TripPlan", "", ""), ("b", "Save", "", "", "*[]Trip"), ("c", "Count", "", "", "Trip"), ("d", "Delete", "Trip", "old_trips", ""), ("e", "Raw", "Trip", "", ""), ("f", "Create", None, None, "&models.CityBus")]
    got = facts.chain_uses(spark.createDataFrame(rows, "call string, method string, model string, table string, argument string")).collect()
    assert {(r.call, r.table, r.op) for r in got} == {("a", "trip_plans", "select"), ("b", "trips", "insert"), ("b", "trips", "update"), ("d", "old_trips", "delete"), ("f", "city_buses", "insert")}


def test_schema_replay(spark):
    sql = """CREATE TABLE a (id bigint PRIMARY KEY, name text NOT NULL, up int REFERENCES a (id) ON DELETE SET NULL);
    CREATE TABLE b (LIKE a INCLUDING ALL, x int);
    CREATE INDEX ix ON a (lower(name)); CREATE UNIQUE INDEX iy ON a (name, (id + 1), "Up" DESC); CREATE INDEX iz ON a USING gin (to_tsvector('x', name), up);
    SELECT $$CREATE TABLE c (x int);$$;
    ALTER TABLE a DROP COLUMN up; ALTER TABLE a RENAME TO z;"""
    rows = schema.replay(spark.createDataFrame([("d", 1, sql)], "db string, seq int, sql string")).collect()
    got = {(r.table, r.part, r["at"], r.name): (r["columns"], r.type, r.detail) for r in rows}
    assert {k[3] for k in got if k[:2] == ("b", "column")} == {"x"} and not any(k[0] == "c" for k in got)
    assert {k[3] for k in got if k[:2] == ("z", "column")} == {"id", "name"} and not any(k[1] == "reference" for k in got)
    assert {k[3]: v[0] for k, v in got.items() if k[1] == "index"} == {"ix": "", "iy": "name,Up", "iz": "up"} and got["z", "index", 1, "iy"][2] == "unique"
