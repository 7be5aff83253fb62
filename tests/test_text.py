"""Scalar functions and statement analysis on written-out cases."""

import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as X

def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_placeholders(spark):
    cases = {
        "VALUES (:line, :stop, :line)": "VALUES ($1, $2, $3)",
        "x = :x AND y::int > 0 AND z = ':no' AND w = :w.v_1": "x = $1 AND y::int > 0 AND z = ':no' AND w = $2",
        "a = ? OR b IN (?, ?) OR c = '?'": "a = $1 OR b IN ($2, $3) OR c = '?'",
        '"odd?name" = ? -- and \'left open ?': '"odd?name" = $1 -- and \'left open ?',
        "": "",
        ": :1 ::": ": :1 ::",
    }
    assert column(spark, X.positional, cases) == list(cases.values())


def test_names(spark):
    cases = {"Trip": "trips", "TimeTable": "time_tables", "StopID": "stop_ids", "JSONFile": "json_files", "City": "cities", "Bus": "buses", "Branch": "branches", "Key": "keys", "StationPerson": "station_people"}
    assert column(spark, lambda v: X.plural(X.snake_case(v)), cases) == list(cases.values())
    patterns = ["GET /x", "/a b", "POST  /y z", "/q"]
    assert column(spark, X.split_method, patterns) == ["GET", "ANY", "POST", "ANY"] and column(spark, X.split_path, patterns) == ["/x", "/a b", "/y z", "/q"]
    assert column(spark, X.url_path, ["/a?b", "https://x/y", "//x", "{?}/z", "x", "/a{?}#b", "/to?u=http://x"]) == ["/a", "", "", "/{?}/z", "", "/a{?}", "/to"]
    assert column(spark, lambda v: X.one_line(v, 5), [" a \n b ", "ééé", "abcdef"]) == ["a b", "éé…", "abcde…"]
    assert column(spark, X.fk_action, ["c", "n", "d", "r", "a"]) == ["cascade", "set null", "set default", "restrict", ""]
    assert column(spark, lambda v: F.array_join(X.fold_format(v, F.array(F.array(F.lit("a"), F.lit("b")))), " "), ["x", "/%s/", "%s-%d", "%05d%%", "%-3.2f|%%", "100%", "%T%T"]) == ["x", "/a/ /b/", "a-{?} b-{?}", "a% b%", "a|% b|%", "100%", "a{?} b{?}"]
    assert column(spark, lambda v: X.line_at(v, F.lit(4)), ["ab\ncd\n", "é\n\nx"]) == [2, 3]


@pytest.mark.parametrize("pattern,path,score", [("/files/{rest...}", "/files", 0), ("/files/{rest...}", "/files/a/b", 4), ("/notes/{id}", "/notes/7/", 5), ("/a/b", "/a/x{?}", 4), ("/{l}/notes/{id}/share", "/{?}/share", 1), ("/", "/", 3), ("/{$}", "/x", 0), ("/{a}/{b}", "/x/y", 0), ("/a", "/b", 0)])
def test_match_score(spark, pattern, path, score):
    assert spark.range(1).select(X.match_score(F.lit(pattern), F.lit(path))).first()[0] == score


def test_fallback(spark):
    cases = {"DELETE FROM a WHERE x IN (SELECT y FROM b)": "a:delete b:delete", 'INSERT INTO "Users" SELECT * FROM "Users"': "Users:insert", "select 1 from T join u": "T:select u:select", "update x set y = 1": "x:update", "create table z": "z:ddl"}
    assert column(spark, lambda v: F.array_join(F.transform(X.fallback_tables(v), lambda u: F.concat_ws(":", u["table"], u["op"])), " "), cases) == list(cases.values())


def test_reference_kinds(spark):
    cases = {("form", "action"): "request", ("button", "hx-post"): "request", ("img", "src"): "asset", ("source", "src"): "asset", ("link", "href"): "asset", ("a", "href"): "link", ("iframe", "src"): "", ("video", "src"): "", ("a", "src"): "", ("input", "formaction"): ""}
    df = spark.createDataFrame([(*k,) for k in cases], "e string, a string")
    assert {(r.e, r.a): r.k for r in df.select("e", "a", X.reference_kind(F.col("e"), F.col("a")).alias("k")).collect()} == cases
