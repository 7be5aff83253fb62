"""Operators on inputs whose pairs are too many to be formed one by one: a job that takes too long is cancelled, which fails its test."""

import random
import threading

from pyspark.sql import functions as F

from routeloom.operators import diagrams, facts, flow, search, statements, traverse
from routeloom.plans import app_queries, queries
from routeloom.sources import schema


def within(spark, seconds, run):
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


def test_covered_equals_brute_force(spark):
    rng = random.Random(1)
    rows = {(m, rng.choice("abcdef") if rng.random() < 0.95 else None) for m in range(60) for _ in range(rng.randint(1, 4))}
    own = {m: {d for n, d in rows if n == m} for m, _ in rows}
    inside = lambda m, o: None not in own[m] and m != o and own[m] <= own[o] and (len(own[o]) > len(own[m]) or o < m)
    kept = {(m, len(own[m])) for m in own if not any(inside(m, o) for o in own)}
    got = facts.covered(spark.createDataFrame([*rows, *rows], "module int, dir string")).collect()
    assert {tuple(r) for r in got} == kept and len(got) == len(kept)


def test_covered_of_many_alike(spark):
    rows = spark.range(40000).select(F.col("id").alias("module"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("dir"))
    assert [tuple(r) for r in within(spark, 60, lambda: facts.covered(rows).collect())] == [(0, 6)]


def test_implements_and_dispatch_equal_brute_force(spark):
    rng = random.Random(2)
    types = {(t, rng.choice("abcdef")) for t in range(50) for _ in range(rng.randint(1, 6))} | {(0, None), (None, "a")}
    faces = {(i, rng.choice("abcdef")) for i in range(40) for _ in range(rng.randint(1, 3))} | {(1, None), (2, "unheard")}
    has = lambda rows, k: {m for n, m in rows if n == k}
    related = {(t, i) for t in {t for t, _ in types} for i in {i for i, _ in faces} if None not in has(faces, i) and has(faces, i) <= has(types, t)}
    t = spark.createDataFrame([*types, *types], "type int, method string")
    i = spark.createDataFrame([*faces, *faces], "interface int, method string")
    got = facts.implements(t, i).collect()
    assert {tuple(r) for r in got} == related and len(got) == len(related)
    # some calls stand twice, and some methods serve several types or names
    calls = [(c, rng.randrange(40), rng.choice("abcdef")) for c in range(60)] + [(c, rng.randrange(40), "a") for c in range(20)]
    methods = [(k, m, rng.choice([f"{k}.{m}", m, "same"])) for k, m in types if k is not None and m]
    own = [(n,) for n in range(0, 50, 3)]
    relation = spark.createDataFrame([r for r in related if r[0] is not None], "type int, interface int")
    for these, those in ((calls, methods), (calls[:60], [(k, m, f"{k}.{m}") for k, m, _ in methods])):
        found = facts.dispatch(spark.createDataFrame(these, "call int, interface int, name string"), relation, spark.createDataFrame(those, "type int, name string, method string"), spark.createDataFrame(own, "name int")).collect()
        want = {(c, x) for c, f, n in these for k, m, x in those if m == n and (k, f) in related and (f % 3 == 0 or k % 3 == 0)}
        assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_implements_of_many_alike(spark):
    many = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("method"))
    assert within(spark, 90, lambda: facts.implements(many(15000, "type"), many(15000, "interface")).count()) == 15000 * 15000


def test_a_text_is_read_once(spark, monkeypatch):
    seen, tokens = [], statements.tokens
    monkeypatch.setattr(statements, "tokens", lambda df: (seen.append(df.count()), tokens(df))[1])
    texts = ["select a from t", "delete from u where", None]
    got = statements.analyse(spark.createDataFrame([(i, texts[i % 3]) for i in range(30)], "id int, sql string")).collect()
    assert seen == [3]
    assert {(r.id, r.ops, r.tables, r.broken) for r in got} == {(i, *[("select", "t:select[a]", False), ("delete", "u:delete[]", True), ("", "", False)][i % 3]) for i in range(30)} and len(got) == 30


def test_trees_need_no_group_in_pandas(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", None, raising=False)
    rows = [(r, s, d, k, o) for r in ("r1", "r2") for s, d, k, o in ((r, "f", "calls", ""), ("f", "g", "calls", ""), ("f", "sink.sql:1", "calls", ""), ("g", "f", "calls", ""), ("sink.sql:1", "t", "queries", "select"), ("g", "sink.sql:1", "calls", ""))]
    trees = flow.trees(spark.createDataFrame(rows, "root string, src string, dst string, kind string, op string"))
    steps = [(0, -1, 1, "f", "", 1, ""), (1, 0, 2, "g", "", 1, ""), (2, 1, 3, "sink.sql:1", "sink", 1, "select t"), (3, 0, 2, "sink.sql:1", "sink", 1, "select t")]
    assert {tuple(r) for r in trees.collect()} == {(r, *s) for r in ("r1", "r2") for s in steps}
    drawn = {(r.step, r.line) for r in diagrams.tree_lines(trees).filter("root = 'r1'").collect()}
    assert drawn == {(0, "└── f"), (1, "    ├── g"), (2, "    │   └── sink.sql:1"), (3, "    └── sink.sql:1")}
    assert [r.line for r in diagrams.sequence_lines(trees).filter("root = 'r2'").orderBy("step").collect()] == ["r2->>f: f", "f->>g: g", "g->>sink_sql: sink.sql:1", "f->>sink_sql: sink.sql:1"]


def test_uses_of_trees_draw_no_tree(spark, monkeypatch):
    monkeypatch.delattr(flow, "trees")
    assert queries.QUERIES["flow_tree_tables"](spark, "/root/testdata/sf0.001").count() > 0


def test_routes_of_a_table_are_found_backward(spark, monkeypatch):
    roots, closure = [], traverse.closure
    monkeypatch.setattr(traverse, "closure", lambda seeds, *a, **k: (roots.append({r.root for r in seeds.select("root").collect()}), closure(seeds, *a, **k))[1])
    assert app_queries.QUERIES["routes_touching_table"](spark, "/root/testdata/sf0.001").count() > 0
    assert roots == [{"sql_table:s3"}]


def test_rare_term_beside_a_common_one(spark):
    nodes = spark.range(40000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("func").alias("kind"), F.format_string("common %06d", "id").alias("name"))
    asked = spark.range(2500).select(F.col("id").alias("query"), F.format_string("common %06d", F.col("id") * 7).alias("text"))
    got = within(spark, 100, lambda: search.search_all(search.build(nodes), asked).collect())
    assert len(got) == 2500 and all(r.id == f"n{r.query * 7}" and r.rank == 1 and r.score > 0 for r in got)


def test_replay_needs_no_group_in_pandas(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", None, raising=False)
    files = [(2, 1, "CREATE TABLE a (id int PRIMARY KEY, up int REFERENCES b (id), UNIQUE (id, up))"), (1, 1, "CREATE TABLE a (x int)"), (1, 2, "ALTER TABLE a RENAME COLUMN x TO y")]
    got = {(r.db, r.part, r["at"], r.name, r["columns"], r.type, r.detail) for r in schema.replay(spark.createDataFrame(files, "db long, seq int, sql string")).collect()}
    assert got == {(1, "column", 0, "y", "", "int4", ""), (2, "column", 0, "id", "", "int4", "not null"), (2, "column", 1, "up", "", "int4", ""), (2, "primary", 0, "", "id", "", ""), (2, "reference", 0, "", "up", "b", "id"), (2, "index", 0, "", "id,up", "", "unique")}
