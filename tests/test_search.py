"""Search and resolve over the gram index, by written-out cases and by brute force."""

import math
import random

import duckdb
import pytest

from routeloom.operators import details, search
from routeloom.plans import queries as Q

SCHEMA = "id string, kind string, name string, package string, file string, detail string"
NODES = [
    ("route:GET /pets", "route", "GET /pets", "", "main.x", ""),
    ("func:shop.ListPets", "func", "ListPets", "shop", "pets.x", ""),
    ("method:(*shop.Store).Pets", "method", "Pets", "shop/store", "store.x", "SELECT name FROM pets"),
    ("sql_table:pets", "sql_table", "pets", "", "schema.sql", ""),
    ("sql_table:owners", "sql_table", "owners", "", "schema.sql", "of pets"),
    ("type:shop.Quo\"te", "type", "Quo\"te", "shop", "", ""),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, SCHEMA)


def ids(df):
    return [r.id.split(":")[1] for r in df.collect()]


CASES = [  # text, kinds, what is found, in order
    ("LISTP", None, ["shop.ListPets"]),  # any case, inside a name
    ("name from PETS", None, ["(*shop.Store).Pets"]),  # text of a statement, three terms
    ("pets", ["sql_table"], ["pets", "owners"]),  # a name counts more than a detail
    ("x", ["route", "sql_table"], ["GET /pets"]),  # a short term, by the length of the name
    ("op", ["func", "method"], ["(*shop.Store).Pets", "shop.ListPets"]),
    ("zq", None, []),
    ("  ", None, []),
    ("pets zzz", None, []),
    ('"pets', None, []),  # signs are literal
    ("%", None, []),
    ("_", None, ["pets", "owners"]),
    ('o"t', None, ['shop.Quo"te']),
    ("shop.(*Store).Pets", None, []),
    ("shop.Store).Pets", None, ["(*shop.Store).Pets"]),
    ("main.x GET", None, ["GET /pets"]),
    (".x GET /", None, ["GET /pets"]),
]


def test_written_out_cases(spark, nodes):
    asked = spark.createDataFrame([(i, text, kinds) for i, (text, kinds, _) in enumerate(CASES)], "query int, text string, kinds array<string>")
    found = {}
    for r in search.search_all(search.build(nodes), asked).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r.id.split(":")[1])
    assert [(text, found.get(i, [])) for i, (text, _, _) in enumerate(CASES)] == [(text, ids) for text, _, ids in CASES]
    assert ids(search.search(nodes, "pets", ["sql_table"], 1)) == ["pets"]


def test_lists_without_text(nodes):
    assert ids(search.list_or_search(nodes, " ", ["sql_table", "type"])) == ["owners", "pets", 'shop.Quo"te']
    assert ids(search.list_or_search(nodes, "", ["sql_table"], 1)) == ["owners"]
    assert ids(search.list_or_search(nodes, "listp", None)) == ["shop.ListPets"]
    with pytest.raises(ValueError):
        search.list_or_search(nodes, "  ")


def rank(nodes, text, kinds, limit):
    terms = [t.lower() for t in text.split()]
    plain = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    rows = [([x.lower() for x in (n[2], n[3], n[4], n[5], n[0])], n) for n in nodes]
    size = [sum(max(0, len(x) - 2) for x in low) for low, _ in rows]
    count = lambda x, t: sum(x.startswith(t, i) for i in range(len(x)))
    if all(len(t) >= 3 for t in terms):
        f = [[sum(w * count(x, t) for w, x in zip((10, 2, 1, 1, 1), low)) for t in terms] for low, _ in rows]
    else:
        f = [[int(plain(t) in plain(" ".join((n[2], n[3], n[4], n[5], n[0])))) for t in text.split()] for _, n in rows]
    n = [sum(x[i] > 0 for x in f) for i in range(len(terms))]
    idf = [max(math.log((len(rows) - k + 0.5) / (k + 0.5)), 0) or 1e-6 for k in n]
    mean = sum(size) / len(size)
    out = []
    for (_, node), own, s in zip(rows, f, size):
        if terms and all(own) and (not kinds or node[1] in kinds):
            score = sum(i * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * s / mean)) for i, x in zip(idf, own)) if all(len(t) >= 3 for t in terms) else 0
            out.append((-round(score, 9), len(node[2]), node[0]))
    return [x[2] for x in sorted(out)[:limit]]


def test_order_equals_brute_force(spark):
    r = random.Random(4)
    parts = ["list", "get", "Pet", "owner", "aaaa", "id", "_", "ÄÖ", "\\E"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    nodes = [(f"{k}:{i}{word()}", k, word(), word(), word(), " ".join(word() for _ in range(r.randint(0, 6)))) for i, k in enumerate(r.choices(["func", "type"], k=200))]
    asked = [(0, "pet", None), (1, "list get", ["func"]), (2, "aaa", None), (3, "äö", None), (4, "pet pet", None), (5, "id owner", ["type"]), (6, "petlist", None), (7, "\\Ea", None), (8, "", None), (9, "\\Eid pet", None)]
    got = search.search_all(search.build(spark.createDataFrame(nodes, SCHEMA)), spark.createDataFrame(asked, "query int, text string, kinds array<string>"), 20).collect()
    for query, text, kinds in asked:
        own = sorted((x.rank, x.id) for x in got if x["query"] == query)
        assert [i for _, i in own] == rank(nodes, text, kinds, 20), text
        assert [k for k, _ in own] == list(range(1, len(own) + 1))


def test_no_query_meets_all_nodes(spark, nodes):
    names = spark.createDataFrame([("pets",), ("GET /pets",), ("Pets",), ("Store).Pets",), ("ListP",), ("nothing at all",), (" ",)], "name string")
    found = details.resolve(nodes, names)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {x.name: (x.status, x.id) for x in found.collect()}
    assert got == {"pets": ("found", "sql_table:pets"), "GET /pets": ("found", "route:GET /pets"), "Pets": ("found", "method:(*shop.Store).Pets") if sum(n[0].endswith("Pets") for n in NODES) == 1 else ("ambiguous", None), "Store).Pets": ("found", "method:(*shop.Store).Pets"), "ListP": ("found", "func:shop.ListPets"), "nothing at all": ("not found", None), " ": ("not found", None)}


def test_ambiguous_names_list_ten(spark):
    nodes = spark.createDataFrame([(f"func:a.Load{i:02}", "func", f"Load{i:02}", "a", "", "") for i in range(12)] + [("func:b.Save1", "func", "Save1", "b", "", ""), ("func:c.Save1", "func", "Save1", "c", "", "")], SCHEMA)
    got = {x.name: x for x in details.resolve(nodes, spark.createDataFrame([("Load",), ("Save1",), ("b.Save",)], "name string")).collect()}
    assert got["Load"].candidates == ",".join(f"func:a.Load{i:02}" for i in range(10)) and got["Load"].more
    assert (got["Save1"].status, got["Save1"].candidates, got["Save1"].more) == ("ambiguous", "func:b.Save1,func:c.Save1", False)
    assert got["b.Save"].id == "func:b.Save1"
    assert details.resolve(nodes.limit(0), spark.createDataFrame([("x",)], "name string")).first().status == "not found"


def test_weights_of_columns_rank_short_terms(nodes):
    got = lambda *a: [(r.id.split(":")[1], r.score) for r in search.weighted(nodes, *a).collect()]
    assert got("PE", ["func", "method", "sql_table"]) == [("(*shop.Store).Pets", 12), ("shop.ListPets", 12), ("pets", 11), ("owners", 1)]
    assert got("s op") == [("(*shop.Store).Pets", 18), ("shop.ListPets", 17), ('shop.Quo"te', 6)]
    assert got("s op", ["type", "func"], 1) == [("shop.ListPets", 17)]
    assert got("  ") == got("pets zq") == []


PARTS = [(1, "pan", "e"), (2, "a long canoe", "x"), (3, "tin", "ANE"), (4, None, "ane"), (5, "wane", None), (6, "dane", "ANE"), (7, "zzz", "e"), (8, "mane", "ANE")]


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """Tables of a few nodes, some without a name or a detail, and a connection that sees them."""
    con, folder = duckdb.connect(), str(tmp_path_factory.mktemp("few"))
    rows = ", ".join(f"({k}, {'NULL' if n is None else repr(n)}, {'NULL' if t is None else repr(t)})" for k, n, t in PARTS)
    con.execute(f"create table part as select k::BIGINT AS p_partkey, n AS p_name, t AS p_type from (values {rows}) v(k, n, t)")
    con.execute("create table customer as select k::BIGINT AS c_custkey, n AS c_name, k::BIGINT AS c_nationkey, 'BUILDING' AS c_mktsegment from (values (1, 'Jane'), (2, 'Customer'), (3, 'An')) v(k, n)")
    con.execute("create table orders as select 1::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus")
    con.execute("create table lineitem as select 1::BIGINT AS l_orderkey, 1::BIGINT AS l_linenumber, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 'A' AS l_returnflag")
    for t in ("part", "customer", "orders", "lineitem"):
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return con, folder


def test_search_ranked_scores_every_node(spark, few):
    con, folder = few
    got = [(r.id, r.score) for r in Q.QUERIES["search_ranked"](spark, folder).collect()]
    assert got == [("sql_table:6", 23), ("sql_table:8", 23), ("sql_table:2", 21), ("func:1", 20), ("sql_table:1", 12), ("sql_table:3", 3), ("sql_table:5", None), ("sql_table:4", None)]


@pytest.mark.parametrize("name", ["search_ranked", "search_short"])
def test_searches_stand_in_the_order_of_sql(spark, few, name):
    con, folder = few
    got = [tuple(r) for r in Q.QUERIES[name](spark, folder).select("id", "kind", "name", "score").collect()]
    assert got and got == con.sql(Q.SQL[name]).fetchall()
