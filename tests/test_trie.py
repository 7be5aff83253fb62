"""Requests matched by the trie against scoring of all pairs."""

import random

from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.operators import facts, trie


def test_no_fit_is_left_out(spark):
    r = random.Random(7)
    parts = ["api", "pets", "{id}", "{name}", "owners", "{rest...}", ""]
    patterns = {"/", "/{$}", "/pets/", "/{rest...}"} | {"/" + "/".join(p for p in r.choices(parts[:6], k=r.randint(1, 4))) for _ in range(60)}
    patterns = {p for p in patterns if "...}" not in p.rsplit("/", 1)[0]}
    values = ["api", "pets", "7", "{?}", "x{?}", "owners", ""]
    paths = {"/", "/{?}", "{?}", "/pets//", "{?}/pets"} | {("" if r.random() < 0.2 else "/") + "/".join(r.choices(values, k=r.randint(1, 5))) for _ in range(150)}
    a, b = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    fits = a.crossJoin(b).filter(X.match_score(F.col("pattern"), F.col("path")) > 0)
    want = {tuple(x) for x in fits.collect()}
    found = [tuple(x) for x in trie.candidates(a, b).collect()]
    assert want <= set(found) and len(found) == len(set(found)) and len(want) > 100
    assert trie.candidates(a, b.limit(0)).count() == trie.candidates(a.limit(0), b).count() == 0


def test_a_shared_prefix_is_no_product(spark):
    """A thousand routes below one prefix: each request meets those that may fit it alone."""
    routes = spark.range(1000).select(F.concat(F.lit("/api/v1/r"), F.col("id").cast("string"), F.lit("/{id}")).alias("pattern"))
    asked = spark.range(1000).select(F.concat(F.lit("/api/v1/r"), F.col("id").cast("string"), F.lit("/7")).alias("path"))
    assert trie.candidates(asked, routes).count() == 1000


def test_best_match(spark):
    routes = spark.createDataFrame([("GET /pets/{id}", 1, "GET", ["/pets/{id}"]), ("GET /pets/new", 2, "GET", ["/pets/new"]), ("ANY /pets/{id}", 3, "ANY", ["/pets/{id}", "/tiere/{id}"]), ("POST /pets", 4, "POST", ["/pets"])], "key string, seq long, method string, patterns array<string>")
    requests = spark.createDataFrame([(1, "GET", ["/pets/new"]), (2, "GET", ["/pets/7?x=1"]), (3, "PUT", ["/tiere/7"]), (4, "", ["/pets/{?}"]), (5, "POST", ["/pets"]), (6, "GET", ["https://x.org/pets/1", "/none"]), (7, "GET", None)], "id int, method string, values array<string>")
    got = {x.id: (x.route, x.score) for x in facts.match_requests(requests, routes).collect()}
    assert got == {1: ("GET /pets/new", 6), 2: ("GET /pets/{id}", 5), 3: ("ANY /pets/{id}", 5), 4: ("GET /pets/{id}", 5), 5: ("POST /pets", 3), 6: (None, None), 7: (None, None)}
