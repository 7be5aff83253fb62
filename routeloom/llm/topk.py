"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are turned into integer term weights (one term for each dimension). Rows are dealt into ranges, and each range into
small blocks of neighbours, by halving it along the term that spreads most. A block keeps the largest and the smallest weight
of each term; their products with a query, summed over the terms, bound every score in the block. Each query visits the blocks
of a range in falling order of that bound and scores a block through its forward index (a dense row of weights for each
document) until the bound is below its k-th best score, so no result is lost. Where there are many ranges a share of them goes
first, and the k-th best scores found there are floors for all others, which skip blocks below them and return only what
reaches them. A last window over the ranges' lists gives the k best of all.

Queries are dealt into chunks and meet every range once; that is the stated query set against all rows, in blocks.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; an empty vector has score
0 with all others; vectors of different lengths are filled with zeros; rows with the query's own id are never its
candidates; of repeated ids each row counts as a candidate, and a repeated query id is asked once (its greatest vector).
Null ids take no part. Weights and scores beyond 64 bits are held at the largest or smallest such number; sums on the way are
exact. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import sized, stage, table


@F.pandas_udf(T.ArrayType(T.LongType()))
def quantise(v: pd.Series) -> pd.Series:
    """floor(64 * x) of each component, computed as double; null if the vector takes no part."""

    def one(x):
        if x is None:
            return None
        a = np.array([np.nan if c is None else c for c in x] if x.dtype == object else x, dtype=np.float64)
        a = np.floor(64.0 * a)
        # the largest double below 2**63, so that the cast holds
        return np.clip(a, -(2.0**63), 2.0**63 - 1024).astype(np.int64) if np.isfinite(a).all() else None

    return v.map(one)


def _dense(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point or 64 bits where every sum is exact there, else in whole numbers of any size, held at 64 bits."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(d.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**52:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ d.T
    ends = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ d.T.astype(object), ends.min + 1, ends.max).astype(np.int64)


def neighbours(docs: np.ndarray, block: int) -> np.ndarray:
    """An order of rows in which each run of block rows is close: halves along the term that spreads most, at whole blocks."""
    parts, done = [np.arange(len(docs))], []
    while parts:
        part = parts.pop()
        if len(part) <= block:
            done.append(part)
            continue
        own = docs[part].astype(np.float64)
        part = part[np.argsort(own[:, own.var(0).argmax()], kind="stable")] if own.shape[1] else part
        half = -(-len(part) // block) // 2 * block
        parts += [part[half:], part[:half]]
    return np.concatenate(done)


def search_range(q: pd.DataFrame, d: pd.DataFrame, k: int, block: int) -> tuple[pd.DataFrame, int, int]:
    """Top k of one range for each query (id, v, floor) of a chunk, none below its floor, by bounds of its blocks; and how many blocks were scored for a query, of how many."""
    d = d.sort_values("id", kind="stable")
    width = max([len(x) for x in q["v"]] + [len(x) for x in d["v"]] + [1])
    queries, docs = _dense(q["v"], width), _dense(d["v"], width)
    ids, own = d["id"].to_numpy(np.int64), q["id"].to_numpy(np.int64)
    place = neighbours(docs, block)  # of blocks' rows in ids
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(docs[place], starts, 0), np.minimum.reduceat(docs[place], starts, 0)
    positive = np.maximum(queries, 0)
    bound = _exact(np.concatenate([positive, queries - positive], 1), np.concatenate([high, low], 1))
    order = np.argsort(-np.maximum(bound, np.iinfo(np.int64).min + 1), 1, kind="stable")
    least = np.iinfo(np.int64).min
    floor = q["floor"].to_numpy(np.int64) if "floor" in q else np.full(len(own), least)
    best = np.full((len(own), k), least)  # scores, falling
    where = np.full((len(own), k), len(ids))  # positions in ids; equal scores in rising position
    alive = np.arange(len(own))
    scored, step, width_ = 0, 0, 1
    while step < len(starts) and len(alive):
        # the next blocks of every query at once, twice as many each time: each block meets all queries that want it
        turn = order[alive, step : step + width_]
        want = bound[alive[:, None], turn] >= np.maximum(best[alive, k - 1], floor[alive])[:, None]
        alive, turn, want = alive[want[:, 0]], turn[want[:, 0]], want[want[:, 0]]
        scored += int(want.sum())
        asks = np.zeros((len(alive), len(starts)), bool)
        asks[np.nonzero(want)[0], turn[want]] = True
        for b in np.flatnonzero(asks.any(0)):
            who, at = alive[asks[:, b]], place[starts[b] : starts[b] + block]
            score = _exact(queries[who], docs[at])
            score[own[who][:, None] == ids[at][None, :]] = least
            better = (score >= best[who, k - 1][:, None]).any(1)
            who, score = who[better], score[better]
            s = np.concatenate([best[who], score], 1)
            p = np.concatenate([where[who], np.broadcast_to(at, score.shape)], 1)
            first = np.lexsort((p, -np.maximum(s, least + 1)), axis=1)[:, :k]
            best[who], where[who] = np.take_along_axis(s, first, 1), np.take_along_axis(p, first, 1)
        step, width_ = step + width_, min(2 * width_, 32)
    found = (best > least) & (best >= floor[:, None])
    return pd.DataFrame({"query_id": np.repeat(own, found.sum(1)), "vec_id": ids[where[found]], "score": best[found]}), scored, len(own) * len(starts)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 32, range_rows: int = 8192, chunk_rows: int = 1024, first_of: int = 4, first_most: int = 64) -> DataFrame:
    """k best rows of vectors (id, v) for each row of queries (id, v) as (query_id, rank, vec_id, score); ties to the smaller id.

    The number of ranges and chunks follows the row counts, so that a task holds range_rows and chunk_rows rows on average. One
    range of first_of, and no more than first_most, goes first and gives the floors.
    """
    n, m = vectors.count(), queries.count()
    ranges, chunks = max(1, -(-n // range_rows)), max(1, -(-m // chunk_rows))
    d = vectors.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)))
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    q = queries.select(F.col("id").alias("id"), F.col("v").alias("v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        return search_range(a, b, k, block)[0]

    def wave(asked: DataFrame, lo: int, hi: int) -> DataFrame:
        asked = asked.withColumn("range", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
        some = d.filter((F.col("range") >= lo) & (F.col("range") < hi))
        return asked.groupBy("chunk", "range").cogroup(some.groupBy("chunk", "range")).applyInPandas(search, "query_id long, vec_id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= k)
    least = F.lit(np.iinfo(np.int64).min)
    early = min(ranges // first_of, first_most)
    if not early:
        return best(wave(q.withColumn("floor", least), 0, ranges)).select("query_id", "rank", "vec_id", "score")
    first = stage(best(wave(q.withColumn("floor", least), 0, early)), "topk-first")
    floors = stage(first.filter(F.col("rank") == k).select(F.col("query_id").alias("_asked"), F.col("score").alias("_floor")), "topk-floors")
    floored = q.join(sized(floors), F.col("id") == F.col("_asked"), "left").select("id", "v", "chunk", F.coalesce("_floor", least).alias("floor"))
    later = wave(floored, early, ranges)
    return best(first.drop("rank").union(later)).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every embedding whose vec_id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), quantise("embedding").alias("v")).filter("v IS NOT NULL")
    q = e.filter("id % 20 = 0").groupBy("id").agg(F.max("v").alias("v"))
    return top_k(e, q, 20)


OP3_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
