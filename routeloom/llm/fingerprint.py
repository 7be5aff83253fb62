"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes ends a chunk where it is -1 modulo the block size, so that boundaries depend on nearby text
alone and an edit changes only the chunks around it. Each chunk gives one of 64 signs. The block size is the smallest of
3 * 2**k at which the whole text has at most SIGNS chunks; a fingerprint holds the signatures at that size and at twice it,
``size:signature:signature``. Two fingerprints are compared where they have a block size in common, by the edit distance
(insertions and deletions) of the two signatures: likeness is 1 - distance / (sum of their lengths), and 0 when no common
size exists or they share no run of RUN signs (fewer if a signature is shorter). The best common size counts.

Each document is also compared with the next one by id, and with its own edited text. Rows are range-partitioned by id and
sorted, so that the next row is at hand; only the first and last row of each partition meet in a second, small step.

Defined results: null text counts as empty; an empty text has the fingerprint ``3::`` and likeness 1 with another empty
text, 0 with any other; rows with equal ids follow each other by a hash of the text, then by text; null ids come first; the last row's next is the
first; a single row is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import stage, table

WINDOW, SIGNS, RUN = 7, 64, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CODE = np.zeros(256, np.uint8)
CODE[ALPHABET] = np.arange(64)
_PRIME = 0x01000193


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last seven bytes at each position (fewer at the start)."""
    b = data.astype(np.uint32) + np.uint32(1)
    h = b.copy()
    weight = 1
    for back in range(1, WINDOW):
        weight = weight * _PRIME & 0xFFFFFFFF
        h[back:] += b[:-back] * np.uint32(weight)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _signature(h: np.ndarray, cuts: np.ndarray) -> str:
    """One sign for each chunk; the rest after the last cut is a chunk too."""
    starts = np.concatenate([[0], cuts + 1])
    starts = starts[starts < len(h)]
    s = np.add.reduceat(h * np.uint32(0x85EBCA6B) ^ (h >> np.uint32(7)), starts, dtype=np.uint32)
    s = (s ^ (s >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return ALPHABET[s >> np.uint32(26)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """Fingerprint of the bytes of a whole text."""
    if not text:
        return "3::"
    h = _rolling(np.frombuffer(text, np.uint8))
    cuts, size = np.flatnonzero(h % np.uint32(3) == np.uint32(2)), 3
    chunks = lambda c: len(c) + (not len(c) or c[-1] != len(h) - 1)
    while chunks(cuts) > SIGNS:
        size *= 2
        cuts = cuts[h[cuts] % np.uint32(size) == np.uint32(size - 1)]
    wide = cuts[h[cuts] % np.uint32(2 * size) == np.uint32(2 * size - 1)]
    return f"{size}:{_signature(h, cuts)}:{_signature(h, wide)}"


def _common_run(a: str, b: str) -> bool:
    n = min(RUN, len(a), len(b))
    seen = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in seen for i in range(len(b) - n + 1))


def _subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of signatures (at most 64 signs), bit-parallel over all pairs."""
    n = len(a)
    places = np.zeros((n, 64), np.uint64)
    for i, s in enumerate(a):
        np.bitwise_or.at(places[i], CODE[np.frombuffer(s.encode(), np.uint8)], np.uint64(1) << np.arange(len(s), dtype=np.uint64))
    v = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    lengths = np.array([len(s) for s in b])
    other = np.zeros((n, int(lengths.max(initial=0))), np.uint8)
    for i, s in enumerate(b):
        other[i, : len(s)] = CODE[np.frombuffer(s.encode(), np.uint8)]
    for j in range(other.shape[1]):
        m = np.where(j < lengths, places[np.arange(n), other[:, j]], np.uint64(0))
        u = v & m
        v = (v + u) | (v - u)
    inside = np.array([(1 << len(s)) - 1 for s in a], np.uint64)
    return np.bitwise_count(~v & inside).astype(np.int64)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness of each pair of fingerprints, from 0 to 1."""
    out = np.zeros(len(pairs))
    tried: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (n, a, aa), (m, b, bb) = x.split(":"), y.split(":")
        n, m = int(n), int(m)
        same = [(a, b), (aa, bb)] if n == m else [(aa, b)] if 2 * n == m else [(a, bb)] if n == 2 * m else []
        tried += [(i, p, q) for p, q in same if p and q and _common_run(p, q)]
    if tried:
        common = _subsequence([t[1] for t in tried], [t[2] for t in tried])
        for (i, p, q), c in zip(tried, common):
            out[i] = max(out[i], 2.0 * c / (len(p) + len(q)))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_FIELDS = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]


def _judge(ids: list, texts: list[str], own: list[str], following: list[tuple[str, str]]) -> list[list]:
    """Result columns for rows with their fingerprints and the next rows' text and fingerprint."""
    changed = [edited(t, f[0]).encode() for t, f in zip(texts, following)]
    prints = [fingerprint(c) for c in changed]
    near = likeness([*zip(own, prints), *((a, f[1]) for a, f in zip(own, following))])
    return [ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], own, prints, near[: len(ids)].tolist(), near[len(ids) :].tolist()]


def compare_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for docs (key, text)."""
    docs = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
    kind = pa.int64() if isinstance(docs.schema[key].dataType, T.LongType) else None
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *_FIELDS, T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])
    columns = [f.name for f in schema.fields]

    def arrays(rows: list[list], part: int, first: list, last: list) -> pa.RecordBatch:
        n = len(rows[0])
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([*(pa.array(r, t) for r, t in zip(rows, types)), pa.array([part] * n, pa.int32()), pa.array(first, pa.string()), pa.array(last, pa.string())], columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # held: the row whose next is not seen yet
        for b in it:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                own = [fingerprint(t.encode()) for t in texts]
                if held is None and ids:
                    yield arrays([[None], [0], [""], [own[0]], [""], [0.0], [0.0]], part, [texts[0]], [None])
                else:
                    ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
                if ids:
                    held = ids.pop(), texts.pop(), own.pop()
                    nexts = [*zip(texts, own), held[1:]][1:]
                    if ids:
                        yield arrays(_judge(ids, texts, own, nexts), part, [None] * len(ids), [None] * len(ids))
        if held is not None:
            yield arrays([[held[0]], [0], [""], [held[2]], [""], [0.0], [0.0]], part, [None], [held[1]])

    # rows of one id are ordered by a hash first: the ranges are found from samples of the keys, which shouldn't hold texts
    order = [F.col(key).asc_nulls_first(), F.xxhash64("text")]
    rows = stage(docs.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, schema), "fingerprints")
    # two rows for each partition, with their texts
    firsts = rows.filter("first IS NOT NULL").select(F.col("part").alias("next_part"), F.col("first").alias("next_text"), F.col("fingerprint").alias("next_print"))
    by_part = W.partitionBy(F.lit(0)).orderBy("part")
    parts = rows.filter("first IS NOT NULL").select("part")
    parts = parts.withColumn("next_part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)))
    ends = rows.filter("last IS NOT NULL").select(key, F.col("last"), "fingerprint", "part").join(parts, "part").join(firsts, "next_part")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c = [x.to_pylist() for x in b.columns]
            if c[0]:
                yield arrays(_judge(c[0], c[1], c[2], list(zip(c[3], c[4]))), 0, [None] * len(c[0]), [None] * len(c[0])).select(columns[:-3])

    done = ends.select(key, "last", "fingerprint", "next_text", "next_print").mapInArrow(finish, T.StructType(schema.fields[:-3]))
    return rows.filter("first IS NULL AND last IS NULL").select(columns[:-3]).union(done)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_next(table(spark, sf_dir, "documents"))
