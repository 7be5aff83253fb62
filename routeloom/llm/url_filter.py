"""URL rules judged by Bloom filter cascades: exact membership over a known universe of keys, without a join per URL.

A rule is a host and a path prefix, written as one key such as ``example.net/en/``. The keys of a URL are its host
suffixes joined with those path prefixes whose lengths occur among the rules. A cascade holds one list over all keys
that occur in the corpus: level 0 encodes the listed keys, level 1 the other keys that level 0 wrongly accepts, level 2
the listed keys that level 1 wrongly accepts, and so on until no error is left. The answer is then exact for every key of
that universe, and only the bit maps (a fixed number of bits for each encoded key) travel to the executors.

Defined results: a URL that is null or has no ``://`` has an empty host and path and no rule; repeated rows are judged one
by one; an empty table gives an empty result; other columns are ignored by ``judge`` but kept. Of two fitting rules of the
same length the greater key wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, stage, table

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(h: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """One row of bit positions for each 64-bit key hash."""
    with np.errstate(over="ignore"):
        a = _mix(h + _GOLD * np.uint64(2 * level + 1))
        b = _mix(h + _GOLD * np.uint64(2 * level + 2)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


@dataclass
class Level:
    """One Bloom filter: a bit map, its number of bits and of hash functions."""

    words: np.ndarray
    bits: int
    hashes: int


class BloomCascade:
    """Exact membership of one list over a universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Whether each key hash of the universe is listed. The first level that rejects a key decides."""
        answer = np.full(len(h), len(self.levels) % 2 == 1)
        undecided = np.arange(len(h))
        for i, level in enumerate(self.levels):
            p = _positions(h[undecided], i, level.bits, level.hashes)
            hit = ((level.words[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).all(1)
            answer[undecided[~hit]] = i % 2 == 1
            undecided = undecided[hit]
        return answer

    @staticmethod
    def fit(universe: DataFrame, bits_per_key: int = 10, hashes: int = 5, max_bits: int = 1 << 31, max_levels: int = 40) -> BloomCascade:
        """universe: distinct keys as (h long, listed boolean). max_bits bounds what each level broadcasts (256 MB); beyond it, fit raises."""
        spark, levels, encoded, other = universe.sparkSession, [], universe.filter("listed"), universe.filter("not listed")
        while n := encoded.count():
            bits = max(64, n * bits_per_key)
            if bits > max_bits:
                raise ValueError(f"{n} keys need {bits} bits; split the list or raise max_bits")
            if len(levels) == max_levels:
                raise ValueError("two keys of the universe share a 64-bit hash")
            level = _encode(encoded, len(levels), bits, hashes)
            levels.append(level)
            wrong = other.filter(_accepts(spark, level, len(levels) - 1)(F.col("h")))
            encoded, other = wrong, encoded
        return BloomCascade(levels)


def _encode(keys: DataFrame, i: int, bits: int, hashes: int) -> Level:
    def masks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = np.unique(_positions(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), i, bits, hashes))
            word, at = np.unique(p >> np.uint64(5), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(31)), at) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.astype(np.int64))], ["word", "mask"])

    words = np.zeros(bits // 32 + 1, np.uint32)
    for r in keys.select("h").mapInArrow(masks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        words[r.word] = r.mask
    return Level(words, bits, hashes)


def _accepts(spark: SparkSession, level: Level, i: int):
    shared = spark.sparkContext.broadcast(level.words)

    @F.pandas_udf(T.BooleanType())
    def test(h: pd.Series) -> pd.Series:
        p = _positions(h.to_numpy().astype(np.int64).view(np.uint64), i, level.bits, level.hashes)
        return pd.Series(((shared.value[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).all(1))

    return test


def url_host(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def _rest(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL: what follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix joined with every path prefix of one of the lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row. A URL that no cascade lists gets the default verdict and a null rule."""
    spark, rules = pages.sparkSession, RULES if rules is None else rules
    lengths = sorted({len(k) - k.index("/") for k, _ in rules})
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    parts = parts.withColumn("_keys", F.array_distinct(url_keys(F.col("host"), F.col("path"), lengths)))
    listed = spark.createDataFrame(rules, "key string, verdict string")
    universe = parts.select(F.explode("_keys").alias("key")).distinct().join(listed, "key", "left")
    universe = stage(universe.select(F.xxhash64("key").alias("h"), "verdict"), "url-keys")
    kinds = sorted({v for _, v in rules})
    cascades = {v: BloomCascade.fit(universe.select("h", F.coalesce(F.col("verdict") == v, F.lit(False)).alias("listed"))) for v in kinds}
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def kind_of(hashes: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in hashes], dtype=np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes]).view(np.uint64) if sizes.sum() else np.zeros(0, np.uint64)
        kind = np.full(len(flat), -1, np.int32)
        for i, v in enumerate(kinds):
            kind[shared.value[v].contains(flat)] = i
        return pd.Series(np.split(kind, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)

    hit = F.zip_with("_keys", "_kinds", lambda k, v: F.struct(F.length(k).alias("n"), k.alias("rule"), v.alias("kind")))
    out = parts.withColumn("_kinds", kind_of(F.transform("_keys", lambda k: F.xxhash64(k))))
    out = out.withColumn("_hit", F.array_max(F.filter(hit, lambda x: x["kind"] >= 0)))
    verdict = F.element_at(F.array(*map(F.lit, kinds)), F.col("_hit.kind") + 1)
    return out.withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce(F.when(F.col("_hit").isNotNull(), verdict), F.lit(default))}).drop("_keys", "_kinds", "_hit")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every URL of pages."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.page_id, max({'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS b
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.b.rule AS rule, coalesce(m.b.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
