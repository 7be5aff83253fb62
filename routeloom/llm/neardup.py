"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds the hashes of its distinct word shingles. Its signature has VALUES symbols of 16 bits, each from the
minimum of one hash over the set. The signature distance of two documents is the number of symbols that differ. Signatures
are split into chunks of CHUNK symbols; by the pigeonhole principle two signatures at a distance of at most
2 * VALUES / CHUNK - 1 agree in some chunk up to one symbol. Each chunk is therefore indexed with no symbol or any one symbol
left out (the allowed error), so all such pairs share a key: a distance of 15 of 32 is covered, where sets at 0.85 differ in
5 on average. Candidates are confirmed on the full sets.

No group is expanded into all pairs. Documents with equal sets are one class with one representative. Representatives that
share a key are first compared with three pivots of the key, of which one is the most central; the confirmed links give components. Only pairs that share a
key and lie in different components after that can still matter. In a group that is alike but not linked those would be all
pairs, so they are found by what is rare in them: each set is put in one order, rarest shingle first, and a link at the
threshold must share a shingle among the first few of both (as many as may be missing, plus one). The join is on that shingle
and a band of the union's size, groups of one component are left out, and the place of the shingle bounds what can still be
common. This limit is exact: it follows from the sizes alone, whatever the order is.

Defined results: null or empty text, or text without words, has an empty set, is linked with nothing and stays; a text with
fewer words than a shingle has its whole word sequence as its one shingle; repeated rows have the same component; null ids
are linked with nothing and stay; ids are taken to be unique but for repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stage, stage_alone, table
from ._graph import components

VALUES, CHUNK = 32, 4
_RNG = np.random.default_rng(20240)
_XOR = _RNG.integers(0, 1 << 64, VALUES, np.uint64)
_MUL = _RNG.integers(0, 1 << 64, VALUES, np.uint64) | np.uint64(1)
_ODD = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_CACHE = 400_000
BUCKETS = 1 << 20  # shingles are counted by bucket for the order; the counts are the only thing that is broadcast
BANDS = 24  # bands to a doubling of the size


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the k-word shingles of a text: A-Z lower-cased, words split at ASCII white space."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        s = np.full(len(h) - k + 1, _ODD[63 - k])
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * _ODD[i]
        return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES symbols of 16 bits."""
    low = np.full(VALUES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[i : i + 2048, None] ^ _XOR) * _MUL).min(0))
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, k: int, key: str) -> DataFrame:
    """(key, n, digest, signature) of each row; digest and signature are null for an empty set."""
    schema = T.StructType([docs.schema[key], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(k)
        for b in it:
            sets = (make.of(t.as_py()) for t in b.column(1))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (0, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema.names)

    return docs.select(F.col(key), F.col("text").cast("binary")).mapInArrow(run, schema)


def index_keys(reps: DataFrame) -> DataFrame:
    """(key, rep, n): for each chunk of a signature and each symbol left out, one key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sig = np.frombuffer(b"".join(x.as_py() for x in b.column(2)), "<u2").reshape(-1, VALUES // CHUNK, CHUNK).astype(np.int64)
            keys = []
            for out in range(CHUNK):
                code = np.arange(VALUES // CHUNK, dtype=np.int64) * CHUNK + out
                code = np.broadcast_to(code, sig.shape[:2])
                for at in range(CHUNK):
                    if at != out:
                        code = (code << 16) | sig[:, :, at]
                keys.append(code)
            keys = np.concatenate(keys, 1)
            per = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), per)), pa.array(np.repeat(b.column(1).to_numpy(zero_copy_only=False), per))], ["key", "rep", "n"])

    return reps.select("rep", "n", "signature").mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), reps.schema["rep"], T.StructField("n", T.LongType())]))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, n) of each pair: sizes of the intersection and the union of their full sets.

    Ids are dealt into blocks of about 256. A set travels once to each pair of blocks that needs it, not once to each pair.
    """
    blocks = max(8, sets.count() // 256)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(blocks))
    dealt = pairs.select("a", "b", block("a").alias("x"), block("b").alias("y"))
    needed = dealt.select("x", "y", F.col("a").alias("id")).union(dealt.select("x", "y", F.col("b").alias("id"))).distinct().join(sets, "id")
    rows = needed.select("x", "y", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), "shingles")
    rows = rows.union(dealt.select("x", "y", F.lit(1), "a", "b", F.lit(None).cast("binary")))
    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y", "kind")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("common", T.LongType()), T.StructField("n", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in it:
            out: list[tuple] = []
            for x, y, kind, a, b, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) != here:
                    here, held = (x, y), {}
                if kind == 0:
                    held[a] = np.frombuffer(shingles, np.uint64)
                elif a in held and b in held:
                    common = len(np.intersect1d(held[a], held[b], True))
                    out.append((a, b, common, len(held[a]) + len(held[b]) - common))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, [batch.column(3).type, batch.column(4).type, pa.int64(), pa.int64()])], schema.names)

    return rows.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int, key: str) -> DataFrame:
    """(id, shingles) of the documents in ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(k)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make.of(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["id", "shingles"])

    rows = docs.select(F.col(key).alias("id"), F.col("text").cast("binary").alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("shingles", T.BinaryType())])).groupBy("id").agg(F.min("shingles").alias("shingles"))


def linked(docs: DataFrame, reps: DataFrame, k: int, percent: int, key: str) -> DataFrame:
    """(node, label) of the representatives (rep, n, signature) that have links."""
    keys = index_keys(reps)
    first = lambda salt: F.min(F.struct(F.xxhash64("rep", F.lit(salt)), "rep"))["rep"]
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    grouped = stage(keys.join(sizes, "key"), "shared-keys")
    sets = stage(shingle_sets(docs, grouped.select(F.col("rep").alias("id")).distinct(), k, key), "sets")
    middle = F.max_by("rep", F.struct("central", F.xxhash64("rep")))
    pivots = grouped.join(centrality(sets), F.col("rep") == F.col("id")).groupBy("key").agg(F.array(middle, first(1), first(2)).alias("pivots"))
    members = stage(grouped.drop("members").join(pivots, "key"), "members")

    arms = members.select("rep", F.explode(F.array_distinct("pivots")).alias("pivot")).filter("rep <> pivot")
    pairs = arms.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    tested = stage(confirmed(pairs, sets), "tested")
    close = (100 * F.col("common") >= percent * F.col("n"))
    links = tested.filter(close).select("a", "b")
    labels = components(links)

    more = open_pairs(members, labels, sets, percent)
    more = stage(more.join(tested, ["a", "b"], "left_anti"), "open-pairs")
    if not more.isEmpty():
        links = links.union(stage(confirmed(more, sets).filter(close).select("a", "b"), "more-links"))
        labels = components(links)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) for docs (key, text): links where 100 * |intersection| >= percent * |union|."""
    rows = stage(sketches(docs, k, key), "sketches")
    some = rows.filter(F.col("digest").isNotNull() & F.col(key).isNotNull())
    reps = stage(some.groupBy("digest").agg(F.min(key).alias("rep"), F.min("n").alias("n"), F.min("signature").alias("signature")), "classes")
    labels = stage_alone(docs.sparkSession, lambda: linked(docs, reps, k, percent, key), "labels")
    found = reps.join(labels, reps.rep == labels.node, "left").select(F.col("digest").alias("_digest"), F.coalesce("label", "rep").alias("component_id"))
    linked_rows = some.join(found, some.digest == found._digest).select(key, F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter(F.col("digest").isNull() | F.col(key).isNull()).select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets (id, shingles) fall into each of BUCKETS: BUCKETS numbers, however many sets there are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in it:
            for x in b.column(0):
                np.add.at(counts, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    found = sets.select("shingles").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def centrality(sets: DataFrame) -> DataFrame:
    """(id, central) of sets (id, shingles): the mean logarithm of how often a set's shingles occur, by bucket: high in the middle of a large group."""
    counts = sets.sparkSession.sparkContext.broadcast(np.log(np.maximum(bucket_counts(sets), 1)).astype(np.float32))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [float(counts.value[(np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(BUCKETS)).astype(np.int64)].mean(dtype=np.float64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.float64())], ["id", "central"])

    return sets.select("id", "shingles").mapInArrow(run, T.StructType([sets.schema["id"], T.StructField("central", T.DoubleType())]))


def least_common(n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Least size of the intersection of linked sets of these sizes: 100 * i >= percent * (n + other - i)."""
    return -(-percent * (n + other) // (100 + percent))


def open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives of mixed keys that lie in different components and may still be links."""
    rows = members.join(labels, members.rep == labels.node, "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    reps = rows.join(mixed, "key", "left_semi").select(F.col("rep").alias("id"), "label").distinct()
    own = stage(sets.join(reps, "id").select("id", "label", "shingles"), "mixed-sets")
    counts = own.sparkSession.sparkContext.broadcast(bucket_counts(own).astype(np.int32))
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("small", T.BooleanType()), own.schema["id"], own.schema["label"], T.StructField("n", T.LongType()), T.StructField("at", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, 100) for batch in it for i in range(0, batch.num_rows, 100)):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for at, x in enumerate(b.column(2)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(s)
                # Band of a pair: that of the smaller set. The set is the smaller one in its own band, the larger one in all that may link with it.
                band = lambda m: np.floor(np.log2(m) * BANDS).astype(np.int64)
                sizes = np.arange(-(-percent * n // 100), n + 1)
                bands, first = np.unique(band(sizes), return_index=True)
                prefix = np.append(n - least_common(n, sizes[first], percent) + 1, n - least_common(n, np.int64(n), percent) + 1)
                order = np.lexsort((s, counts.value[(s % np.uint64(BUCKETS)).astype(np.int64)]))[: prefix.max()]
                for of, length, small in zip(np.append(bands, band(n)), prefix, [False] * len(bands) + [True]):
                    k = int(length)
                    for c, v in zip(columns, (s[order[:k]].view(np.int64), np.full(k, of), np.full(k, small), np.full(k, at), np.full(k, n), np.arange(k))):
                        c.append(v)
            c = [np.concatenate(x) for x in columns]
            at = pa.array(c[3])
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1].astype(np.int32)), pa.array(c[2].astype(bool)), b.column(0).take(at), b.column(1).take(at), pa.array(c[4]), pa.array(c[5])], schema.names)

    first = own.mapInArrow(run, schema)  # made twice rather than written: it is larger than the sets
    of_both = first.groupBy("shingle", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("small").alias("some"), F.bool_or(~F.col("small")).alias("more")).filter("lo <> hi AND some AND more")
    first = first.join(of_both.select("shingle", "band"), ["shingle", "band"], "left_semi")
    x, y = first.filter("small").alias("x"), first.filter("NOT small").alias("y")
    close = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label"))
    close &= (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))  # each pair one way
    close &= 100 * F.col("x.n") >= percent * F.col("y.n")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    # what comes before the first shingle in common is common to neither; the first one passes
    close &= 100 * rest >= percent * (F.col("x.n") + F.col("y.n") - rest)
    a, b = F.col("x.id"), F.col("y.id")
    return x.join(y, close).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on three-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)
