"""Dual-tree search against scoring of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from routeloom.llm import dualtree

SCHEMA = "id long, text string, score string, item long, terms string"


def words(text):
    out, now = [], ""
    for c in text or "":
        if ord(c) > 127 or c.isalnum():
            now += c.lower() if c.isascii() else c
        else:
            out.append(now)
            now = ""
    return [w for w in [*out, now] if w]


def brute(docs, items, k):
    counted = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for (d, c), size in zip(counted, sizes):
            m = 10 + 90 * size * n // total if total else 0
            s = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if w in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def key(rows):
    return sorted(rows, key=str)


def corpus(n, seed=1, shared=4):
    r = random.Random(seed)
    topics = [[f"t{j}w{i}" for i in range(60)] for j in range(6)]
    common = ["the", "Of", "ñandú", "a1"]
    return [(i, " ".join(r.choices(topics[r.randrange(6)] + common * shared, k=r.randint(1, 60)))) for i in range(n)]


def test_results_equal_scoring_of_all_pairs(spark):
    docs = corpus(400) + [(1000, None), (1001, ""), (1002, "-- \n"), (1003, "The t1w1, t1w1;T1W1!" * 3000), (None, "t2w2 t2w3 the"), (1004, "t2w2 t2w3 the"), (1005, "ÑANDÚ ñandú")] + [(3, "t2w2 t2w3 the")] * 20
    items = [(i, t) for i, t in corpus(40, 2)] + [(100, None), (101, "... "), (102, "t2w2 T2W3 the the"), (102, "t2w2 T2W3 the the"), (103, "unknown words"), (None, "ñandú"), (104, "t1w1 " * 20_000)]
    asked = [(d, t, "x", 7, "y") for d, t in docs], [(d, t, "x", 7, "y") for d, t in items]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in asked)
    for sizes in ({}, {"range_docs": 30, "chunk_items": 16, "first_of": 4}, {"range_docs": 5, "chunk_items": 1000}):
        got = dualtree.rank_documents(a.repartition(3), b, 10, **sizes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert key(map(tuple, got.collect())) == key(brute(docs, items, 10))


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b", "x", 1, "y")], SCHEMA), spark.createDataFrame([], SCHEMA)
    for docs, items in ((some, none), (none, some), (none, none), (spark.createDataFrame([(1, None)], "id long, text string"), some)):
        assert dualtree.rank_documents(docs, items).collect() == []
    assert [tuple(r) for r in dualtree.rank_documents(some, some).collect()] == brute([(1, "a b")], [(1, "a b")], 10)


def tables(docs, items, floor):
    counted = [(d, Counter(words(t))) for d, t in docs]
    vocabulary = sorted({w for _, t in items for w in words(t)})
    weight = {w: 1 + len(vocabulary) - i for i, w in enumerate(vocabulary)}
    own = [sorted(set(words(t))) for _, t in items]
    a = pa.table({"key": pa.array([i for i, _ in items], pa.int64()), "item": pa.array([i for i, _ in items], pa.int64()), "terms": pa.array([[w.encode() for w in x] for x in own], pa.list_(pa.binary())), "weights": pa.array([[weight[w] for w in x] for x in own], pa.list_(pa.int64())), "floor": pa.array([floor.get(i, 0) for i, _ in items], pa.int64())})
    b = pa.table({"id": pa.array([d for d, _ in docs], pa.int64()), "m": pa.array([100] * len(docs), pa.int64()), "terms": pa.array([[w.encode() for w in c] for _, c in counted], pa.list_(pa.binary())), "tfs": pa.array([list(c.values()) for _, c in counted], pa.list_(pa.int64()))})
    return a, b


def test_pairs_of_nodes_are_pruned():
    """Documents of other topics are left out in whole batches, more so with floors from other ranges; the result is the same."""
    docs, items = corpus(3000, 3, 0), corpus(24, 4, 0)
    found, plain = dualtree.search_range(*tables(docs, items, {}), 5)
    assert plain.scored < 0.5 * len(docs) * len(items)
    least = {}
    for row in found.to_pylist():
        least[row["key"]] = min(row["score"], least.get(row["key"], 1 << 60))
    again, floored = dualtree.search_range(*tables(docs, items, least), 5)
    assert key(map(str, again.to_pylist())) == key(map(str, found.to_pylist())) and floored.scored < plain.scored
    nothing, search = dualtree.search_range(*tables(docs, items, {i: 1 << 50 for i, _ in items}), 5)
    assert nothing.num_rows == 0 and search.scored == 0 and search.pairs == 1  # the roots' bound alone


def test_bounds_hold():
    """No document scores above the bound of a node it lies in, for any item below the other node."""
    docs, items = corpus(200, 5), corpus(20, 6)
    _, search = dualtree.search_range(*tables(docs, items, {}), 5)
    for lo, hi in ((0, 20), (0, 8), (8, 16)):
        group = search.order[lo:hi]
        exact = search.docs.sums(np.arange(len(search.docs.size)), search.flags(group)).max(1)
        union = search.flags(group).any(1, keepdims=True)
        for level, rows in enumerate(search.levels):
            bound = rows.sums(np.arange(len(rows.size)), union)[:, 0]
            assert (exact <= bound[np.arange(len(exact)) // (search.leaf * search.fan**level)]).all()
