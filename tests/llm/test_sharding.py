"""Jump consistent hashing against the published loop, slots against plain counting."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from routeloom.llm import sharding


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop_and_moves_only_to_new_shards(spark):
    ids = spark.range(-300, 300).withColumn("digits", F.array(*sharding.key_digits(F.col("id"))))
    digits = [F.col("digits")[i] for i in range(3)]
    counts = [1, 2, 7, 8, 9, 1000]
    got = ids.select("id", *[sharding.jump(digits, n, 3 if n == 9 else 48).alias(f"s{n}") for n in counts]).collect()
    for r in got:
        assert [r[f"s{n}"] for n in counts] == [jump(key_of(r.id), n) for n in counts]
        assert r.s9 in (r.s8, 8)
    assert sum(r.s9 == 8 for r in got) < 600 / 9 * 1.6
    assert jump(0, 1) == 0 and jump(10863919174838991, 11) == 6 and jump(2016238256797177309, 11) == 3  # known values of the published function


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long, size long")


def test_slots_of_awkward_rows(spark):
    """Nulls, empty and long texts, one id with a third of the rows, repeated rows and columns with clashing names."""
    rows = [(i, f"text {i} ä", "x", 1, 1) for i in range(120)] + [(7, "same", None, None, None)] * 60 + [(None, None, None, None, None), (None, "", "y", 0, 0), (3, "wört " * 200_000, "z", 0, 0)]
    docs = table(spark, rows).repartition(5)
    got = sharding.deal(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (jump(key_of(r.doc_id), 8), jump(key_of(r.doc_id), 9), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.deal(table(spark, rows[::-1]).coalesce(1), 8).collect()))
    empty = sharding.deal(docs.limit(0), 8)
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_plan_has_no_python(spark, tmp_path):
    table(spark, [(1, "a", None, None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    df = sharding.op12_shard(spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and [r.slot for r in df.collect()] == [0]
