"""File changes as a stream that restarts, bursts and latest rows from it, and the memo of routes against full closures."""

import os
import random

from pyspark.sql import functions as F

from routeloom.operators import memo, traverse
from routeloom.streaming import changes, watch


def test_what_matters(spark):
    paths = ["main.go", "a/b.tmpl", "vendor/x.go", "a/testdata/x.go", ".idea/x.go", ".git/HEAD", ".git/config", "go.mod", "icb.yaml", "x.txt", "node_modules/a.sql", "build.sbt", "src/test/A.scala", "src/main/A.scala", "target/A.scala", "project/build.properties", "Makefile"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {lang: [r.path for r in df.filter(watch.relevant(F.col("path"), lang)).collect()] for lang in ("go", "scala")}
    assert got["go"] == ["main.go", "a/b.tmpl", ".git/HEAD", "go.mod", "icb.yaml"]
    assert got["scala"] == [".git/HEAD", "icb.yaml", "build.sbt", "src/main/A.scala", "project/build.properties"]


def scan(spark, folder, n, files):
    rows = [(p, size, f"2024-01-01 00:00:{mod:02}") for p, size, mod in files]
    df = spark.createDataFrame(rows, "path string, size long, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    watch.append_scan(df, folder, n, f"2024-01-01 00:{n:02}:00")


def test_stream_of_scans_restarts_and_feeds_bursts_and_latest(spark, tmp_path):
    scans, log, mark, bursts = (str(tmp_path / n) for n in ("scans", "log", "mark", "bursts"))
    r = random.Random(6)
    states = [{}]
    for _ in range(7):
        files = dict(states[-1])
        for p in r.sample("abcdefgh", 4):
            files[p] = (r.randint(1, 2), r.randint(0, 1))
        for p in r.sample("abcdefgh", 3):
            files.pop(p, None)
        states.append(files)
    states[5] = {}
    shots = states[1:]
    want = set()
    for k in range(1, len(shots)):
        a, b = shots[k - 1], shots[k]
        want |= {(p, k + 1, "added") for p in b.keys() - a.keys()} | {(p, k + 1, "removed") for p in a.keys() - b.keys()} | {(p, k + 1, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}

    def run():
        q = watch.changes(watch.read_scans(spark, scans)).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(log)
        q.awaitTermination()

    for n, files in enumerate(shots, 1):
        scan(spark, scans, n, [(p, *v) for p, v in files.items()])
        if n in (2, 3, 7):  # stopped and started from its checkpoint between
            run()
    scan(spark, scans, 8, [("zz", 1, 1)])
    scan(spark, scans, 9, [("zz", 1, 1)])
    run()
    got = [(r.path, r.scan, r.change) for r in spark.read.parquet(log).collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[1] <= 7} == want
    assert {x for x in got if x[1] > 7} == {("zz", 8, "added")} | {(p, 8, "removed") for p in shots[-1]}
    batch = watch.changes_of_scans(spark.read.schema(watch.LISTING).parquet(scans)).collect()
    assert {(r.path, r.scan, r.change) for r in batch} == set(got) and len(batch) == len(got)

    feed = spark.readStream.schema(watch.CHANGES).parquet(log).select(F.lit("project").alias("key"), "ts", F.col("path").alias("item"))
    changes.debounce(feed, 90, "0 seconds").writeStream.format("parquet").option("checkpointLocation", mark + "2").trigger(availableNow=True).start(bursts).awaitTermination()
    whole = {(r.start, r.items) for r in changes.debounce(spark.read.parquet(log).select(F.lit("project").alias("key"), "ts", F.col("path").alias("item")), 90).collect()}
    assert {(r.start, r.items) for r in spark.read.parquet(bursts).collect()} <= whole

    newest = changes.latest(spark.readStream.schema(watch.CHANGES).parquet(log).select(F.col("path").alias("key"), F.struct("scan", F.col("change") == "added").alias("seq"), "change"))
    newest.writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for p, k, c in sorted(got, key=lambda x: (x[1], x[2] == "added")):
        last[p] = c
    assert {r.key: r.change for r in spark.table("newest").collect()} == last


def test_listing_of_a_folder(spark, tmp_path):
    root = tmp_path / "project"
    for p, text in {"main.go": "x", "web/page.html": "abc", "vendor/v.go": "x", ".git/HEAD": "ref", "notes.txt": "x"}.items():
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text(text)
    assert {(r.path, r["size"]) for r in watch.listed(spark, str(root)).collect()} == {("main.go", 1), ("web/page.html", 3), (".git/HEAD", 3)}


def test_memo_equals_the_full_closure_after_random_edits(spark):
    r = random.Random(2)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(22)}
    frame = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    roots = spark.createDataFrame([(i,) for i in (0, 1, 2, 99)], "root long")
    state = memo.start(roots, frame(edges))
    for generation in range(1, 4):
        gone = set(r.sample(sorted(edges), 6)) | {(50, 51)}
        new = {(r.randrange(14), r.randrange(14)) for _ in range(5)} | set(r.sample(sorted(gone), 1))
        state = memo.advance(state, frame(gone), frame(new))
        edges = (edges - gone) | new
        full = traverse.closure(roots.withColumn("node", F.col("root")), frame(edges)).select("root", "node")
        assert state.generation == generation and {(x.src, x.dst) for x in state.edges.collect()} == edges
        assert sorted(map(tuple, state.reached.collect())) == sorted(map(tuple, full.collect()))
    uses = spark.createDataFrame([(99, "t", "select"), (99, "t", "select"), (1, "u", "delete")], "node long, tbl string, op string")
    assert {(99, "t", "select"), (1, "u", "delete")} <= set(map(tuple, memo.table_routes(state, uses).collect()))
