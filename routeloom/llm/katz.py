"""Language-model scoring by a Katz backoff bigram model.

Counts are discounted by Good-Turing: an n-gram seen r times keeps the part d(r) of its count, for r up to TOP; higher counts
are kept whole. A word after a history has probability d(c) * c / c(h) if the pair was seen, else alpha(h) * P1(word), with
alpha(h) = (1 - seen mass) / (1 - P1 of the seen words): the probabilities after each history sum to exactly one over the known
words and one unknown word. A history all of whose pairs have higher counts would keep nothing to back off with; it counts
once more than it was seen (c(h) + 1), so that the left-over mass is 1 / (c(h) + 1). P1 is the discounted unigram model, by the
same rule, whose left-over mass is the unknown word's. A history that was never seen backs off with weight one.

How it runs. Texts are cut into batches of BATCH_TOKENS, each with its own word list (a written table); a longer text goes on in
the next batch. From each batch its distinct unigrams and bigrams go, with their training counts, to a partition by hash; a
partition sums them and writes the totals back for each batch in the same order. Each batch then knows the counts of all its
n-grams and scores what was seen. For each history it sends what alpha needs, summed over its training occurrences: how many
there are of each low count, and P1 / c, so that every distinct bigram counts once. The partition of a history sums these and
answers the batches that met an unseen pair after it. A frequent n-gram or history thus sends one entry from a batch, and
partitions are as many as the tokens need: a group holds about GROUP_TOKENS of them at any input size. Sorted keys travel as
differences, by bytes of equal weight, compressed.

Defined results: null text counts as empty and has the end token alone; repeated rows are counted and scored each; without
training documents every token is unknown (probability one); a null id hashes as empty text; an empty table gives an empty
result; other columns are ignored. A text of any length is split a block of CHUNK bytes at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, parallelism, stage, table

TOP = 5
BATCH_TOKENS = 1_000_000
GROUP_TOKENS = 1_000_000
CACHE = 200_000
CHUNK = 1 << 22
END, BEGIN = np.uint64(1), np.uint64(2)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def bigram_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of word hashes."""
    x = h * _A + (w ^ (w >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each key: ranges of the mixed key, so that sorted keys stay sorted by partition."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole or floating numbers, compressed by bytes of equal weight; rising ones as differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    """What pack made."""
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a block of about CHUNK bytes at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.end() if space else len(text)
        yield text[at:end].lower().split()
        at = end


BATCH = "batch long, tokens long, ids array<{id}>, uids binary, lengths binary, train binary, heads binary, words binary, places binary"


def batches(docs: DataFrame, key: str) -> DataFrame:
    """Rows of about BATCH_TOKENS tokens: texts or parts of texts (id, number, length, whether to learn, word before), sorted words, and the words' places."""
    schema = T.StructType.fromDDL(BATCH.format(id=docs.schema[key].dataType.simpleString()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        task = TaskContext.get().partitionId()
        made = number = 0
        ids, uids, lengths, train, heads, hashes, size = [], [], [], [], [], [], 0

        def row(id_type: pa.DataType) -> pa.RecordBatch:
            tokens = np.concatenate(hashes)
            words = np.unique(np.concatenate([tokens, np.array([END, *(h for h in heads if h != BEGIN)], np.uint64)]))  # all histories but the begin
            places = np.searchsorted(words, tokens)
            binary = [pack(np.array(uids, np.int64), True), pack(np.array(lengths, np.int64)), pack(np.array(train, np.uint8)), pack(np.array(heads, np.uint64)), pack(words, True), pack(places.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + made]), pa.array([size]), pa.array([ids], pa.list_(id_type)), *(pa.array([c], pa.binary()) for c in binary)], schema.names)

        for b in (batch.slice(i, 100) for batch in it for i in range(0, batch.num_rows, 100)):
            id_type = b.column(0).type
            for doc, text, learn in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py() or b""
                number += 1
                head, left = BEGIN, True
                blocks = pieces(text)
                while left:
                    words = next(blocks, None)
                    left = words is not None
                    words = words or []
                    if len(known) > CACHE:
                        known.clear()
                    for w in set(words).difference(known):
                        known[w] = max(3, xxhash.xxh3_64_intdigest(w))
                    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    h = h if left else np.array([END])
                    while len(h):
                        part, h = h[: BATCH_TOKENS - size], h[BATCH_TOKENS - size :]
                        if head != BEGIN and uids and uids[-1] == (task << 36) + number:
                            lengths[-1] += len(part)
                        else:
                            ids.append(doc)
                            uids.append((task << 36) + number)
                            lengths.append(len(part))
                            train.append(bool(learn))
                            heads.append(head)
                        hashes.append(part)
                        size += len(part)
                        head = part[-1]
                        if size >= BATCH_TOKENS:
                            yield row(id_type)
                            ids, uids, lengths, train, heads, hashes, size = [], [], [], [], [], [], 0
                            made += 1
        if ids:
            yield row(id_type)

    return docs.select(F.col(key), F.col("text").cast("binary"), "train").mapInArrow(run, schema)


def one_by_one(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Rows as dicts and as batches of one, since each is large."""
    for b in it:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0], b.slice(i, 1)


class Batch:
    """The arrays of one batch row."""

    def __init__(self, row: dict):
        self.batch, self.ids, self.uids = row["batch"], row["ids"], unpack(row["uids"], np.int64, True)
        self.lengths, self.train = unpack(row["lengths"], np.int64), unpack(row["train"], np.uint8).astype(bool)
        self.words, self.tokens = unpack(row["words"], np.uint64, True), unpack(row["places"], np.uint32)
        self.learn = np.repeat(self.train, self.lengths)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        heads = unpack(row["heads"], np.uint64)
        w = self.words[self.tokens]
        history = np.concatenate([heads[:1], w[:-1]])
        history[self.starts] = heads
        self.pairs, self.pair = np.unique(bigram_keys(history, w), return_inverse=True)
        self.histories, self.history = np.unique(history, return_inverse=True)

    def grams(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(order, distinct keys, training counts)."""
        return [(1, self.words, np.bincount(self.tokens, self.learn, len(self.words))), (2, self.pairs, np.bincount(self.pair, self.learn, len(self.pairs)))]


def split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Partitions that have any of the sorted keys, and where these are."""
    ends = np.searchsorted(partition_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), slice(ends[p], ends[p + 1])


def counted(rows: DataFrame, parts: int) -> DataFrame:
    """(batch, part, order, counts, totals): training counts over all batches of each batch's n-grams, by partition of their keys.

    A row with a null batch holds a partition's totals: n-grams seen r times for r = 1 to TOP + 1, n-grams seen, and their sum.
    """
    names = ["part", "batch", "order", "keys", "n"]

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in one_by_one(it):
            x = Batch(row)
            for order, keys, n in x.grams():
                n = n.astype(np.uint32)
                out = [(p, x.batch, order, pack(keys[s], True), pack(n[s])) for p, s in split(keys, parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for order, own in pdf.groupby("order"):
            keys = [unpack(k, np.uint64, True) for k in own["keys"]]
            ends = np.cumsum([len(k) for k in keys])[:-1]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(at, np.concatenate([unpack(n, np.uint32) for n in own["n"]]), len(distinct)).astype(np.int64)
            out += [(b, p, order, pack(c.astype(np.uint32)), None) for b, p, c in zip(own["batch"], own["part"], np.split(counts[at], ends))]
            seen = [int((counts == r).sum()) for r in range(1, TOP + 2)]
            out.append((None, int(own["part"].iloc[0]), order, None, [*seen, int((counts > 0).sum()), int(counts.sum())]))
        return pd.DataFrame(out, columns=["batch", "part", "order", "counts", "totals"]).astype({"batch": "Int64"})

    sent = rows.mapInArrow(send, "part long, batch long, order int, keys binary, n binary")
    return sent.groupBy("part").applyInPandas(total, "batch long, part long, order int, counts binary, totals array<long>")


@dataclass
class Model:
    """What is the same for all tokens: discounts by count, and totals."""

    keep: list[np.ndarray]  # by order: part of a count that is kept, for counts 0 to TOP
    n: int
    v: int
    whole: int  # what unigram counts are divided by
    unknown: float

    @staticmethod
    def of(unigrams: list[int], bigrams: list[int]) -> Model:
        keep = [discounts(unigrams), discounts(bigrams)]
        n, v = unigrams[TOP + 2], unigrams[TOP + 1]
        lost = sum((1 - keep[0][r]) * r * unigrams[r - 1] for r in range(1, TOP + 1))
        return Model(keep, n, v, n, lost / n) if lost else Model(keep, n, v, n + 1, 1 / (n + 1))

    def discounted(self, order: int, count: np.ndarray) -> np.ndarray:
        """Counts times the part that is kept."""
        return np.where(count <= TOP, count * self.keep[order - 1][np.minimum(count, TOP)], count)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P1 by count; the unknown word's for 0."""
        return np.where(count > 0, self.discounted(1, count) / self.whole, self.unknown)

    def backoff(self, n: np.ndarray, low: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the weight, and of what the probability of seen pairs is multiplied by.

        By history: occurrences n, those of pairs of count r in low[r - 1], and P1 of the seen words. Both are 0 for a history never seen.
        """
        lost = sum((1 - self.keep[1][r]) * low[r - 1] for r in range(1, TOP + 1))
        whole = np.where(lost > 0, n, n + 1)
        lost = np.where(lost > 0, lost, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, np.log10(lost / whole / (1 - lower)), 0.0), np.where(n > 0, np.log10(n / whole), 0.0)


def discounts(seen: list[int]) -> np.ndarray:
    """Good-Turing parts of counts 1 to TOP from the numbers of n-grams seen 1 to TOP + 1 times; (r - 0.5) / r where these give none between 0 and 1."""
    out = np.ones(TOP + 1)
    cut = (TOP + 1) * seen[TOP] / seen[0] if seen[0] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * seen[r] / (r * seen[r - 1]) - cut) / (1 - cut) if seen[r - 1] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def score(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) for docs (key, text, train)."""
    rows = stage(batches(docs, key), "token-batches")
    parts = max(parallelism(docs.sparkSession), -(-(rows.agg(F.sum("tokens")).first()[0] or 0) // GROUP_TOKENS))
    counts = stage(counted(rows, parts), "counts")
    totals = {1: [0] * (TOP + 3), 2: [0] * (TOP + 3)}
    sums = counts.filter("batch IS NULL").groupBy("order").agg(*[F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(TOP + 3)])
    for r in sums.collect():
        totals[r["order"]] = [int(r[f"t{i}"]) for i in range(TOP + 3)]
    model = Model.of(totals[1], totals[2])

    found = counts.filter("batch IS NOT NULL").groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct("part", "order", "counts")).alias("found"))
    judged = stage(seen_pairs(rows.join(found, rows.batch == found._batch).drop("_batch"), model, parts), "judged-batches")
    weights = backoff_weights(judged.select("batch", "histories", "asked", "n", "low", "lower"), model, parts)
    weights = weights.groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct("part", "alpha", "scale")).alias("weights"))
    judged = judged.drop("n", "low", "lower").join(weights, judged.batch == weights._batch, "left").drop("_batch")
    texts = finished(judged, parts).groupBy("uid").agg(F.first("id").alias(key), F.first("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return texts.select(key, "train", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def seen_pairs(rows: DataFrame, model: Model, parts: int) -> DataFrame:
    """Batches (found: the counts of their n-grams) as texts with the sums of what was seen, histories with their sums, and what waits for a history."""
    ids = rows.schema["ids"].dataType.simpleString()
    names = ["uids", "train", "n_tokens", "n_known", "base", "part", "histories", "asked", "n", "low", "lower", "wait_text", "wait_history", "wait_open", "wait_seen"]
    schema = T.StructType.fromDDL(f"batch long, ids {ids}, " + ", ".join(f"{c} binary" for c in names))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in one_by_one(it):
            x = Batch(row)
            replies = {(f["order"], f["part"]): f["counts"] for f in row["found"]}
            of = []
            for order, keys in ((1, x.words), (2, x.pairs)):
                own = np.zeros(len(keys), np.int64)
                for p, s in split(keys, parts):
                    own[s] = unpack(replies[order, p], np.uint32)
                of.append(own)
            word, pair = of[0][x.tokens], of[1][x.pair]
            # a history has been seen as often as its word, the begin of a text as often as the end
            before = of[0][np.searchsorted(x.words, np.where(x.histories == BEGIN, END, x.histories))][x.history]
            p1, seen = model.unigram(word), pair > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.log10(np.where(seen, model.discounted(2, pair) / np.maximum(before, 1), p1))
            base = np.log10((word + 0.1) / (model.n + 0.1 * (model.v + 1)))
            add = lambda v: np.add.reduceat(v, x.starts)
            texts = [pack(x.uids, True), pack(x.train.astype(np.uint8)), pack(x.lengths), pack(add((word > 0).astype(np.int64))), pack(add(base)), pack(add(p))]

            size, learned = len(x.histories), x.history[x.learn]
            n = np.bincount(learned, minlength=size)
            low = [np.bincount(x.history[x.learn & (pair == r)], minlength=size) for r in range(1, TOP + 1)]
            lower = np.bincount(learned, (p1 / np.maximum(pair, 1))[x.learn], size)
            # a pair of low count shows that its history is discounted; else a seen pair waits for the answer too
            shown = np.bincount(x.history[seen & (pair <= TOP)], minlength=size) > 0
            wait = ~seen | ~shown[x.history]
            asked = np.bincount(x.history[wait], minlength=size) > 0
            sent = asked | (n > 0)
            place = np.cumsum(asked) - 1
            text = np.repeat(np.arange(len(x.lengths)), x.lengths)[wait]
            both, at = np.unique(text * size + x.history[wait], return_inverse=True)
            opened = np.bincount(at, ~seen[wait], len(both)).astype(np.uint32)
            histories = [pack(x.histories[sent], True), pack(asked[sent].astype(np.uint8)), pack(n[sent].astype(np.uint32)), pack(np.concatenate([c[sent] for c in low]).astype(np.uint32)), pack(lower[sent])]
            waits = [pack((both // size).astype(np.uint32), True), pack(place[both % size].astype(np.uint32)), pack(opened), pack((np.bincount(at, minlength=len(both)) - opened).astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([x.batch]), b.column("ids"), *(pa.array([c], pa.binary()) for c in (*texts, *histories, *waits))], schema.names)

    return rows.mapInArrow(run, schema)


def backoff_weights(judged: DataFrame, model: Model, parts: int) -> DataFrame:
    """(batch, part, alpha, scale): logarithms for the histories that a batch asks for, in their order."""
    names = ["part", "batch", "keys", "asked", "n", "low", "lower"]

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in one_by_one(it):
            keys, asked, n, lower = unpack(row["histories"], np.uint64, True), unpack(row["asked"], np.uint8), unpack(row["n"], np.uint32), unpack(row["lower"], np.float64)
            low = unpack(row["low"], np.uint32).reshape(TOP, len(keys))
            out = [(p, row["batch"], pack(keys[s], True), pack(asked[s]), pack(n[s]), pack(low[:, s].ravel()), pack(lower[s])) for p, s in split(keys, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.binary()] * 5))], names)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k, np.uint64, True) for k in pdf["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        add = lambda v: np.bincount(at, v, len(distinct))
        low = np.concatenate([unpack(v, np.uint32).reshape(TOP, len(k)) for v, k in zip(pdf["low"], keys)], 1)
        alpha, scale = model.backoff(add(np.concatenate([unpack(v, np.uint32) for v in pdf["n"]])), [add(c) for c in low], add(np.concatenate([unpack(v, np.float64) for v in pdf["lower"]])))
        out = []
        for batch, part, asked, own in zip(pdf["batch"], pdf["part"], pdf["asked"], np.split(at, np.cumsum([len(k) for k in keys])[:-1])):
            own = own[unpack(asked, np.uint8) > 0]
            if len(own):
                out.append((batch, part, pack(alpha[own]), pack(scale[own])))
        return pd.DataFrame(out, columns=["batch", "part", "alpha", "scale"])

    sent = judged.mapInArrow(send, "part long, batch long, keys binary, asked binary, n binary, low binary, lower binary")
    return sent.groupBy("part").applyInPandas(answer, "batch long, part long, alpha binary, scale binary")


def finished(judged: DataFrame, parts: int) -> DataFrame:
    """(uid, id, train, n_tokens, n_known, base_score, score) of the texts, or parts of texts, of judged batches and their weights."""
    kind = judged.schema["ids"].dataType.elementType.simpleString()
    schema = T.StructType.fromDDL(f"uid long, id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in one_by_one(it):
            keys = unpack(row["histories"], np.uint64, True)
            keys = keys[unpack(row["asked"], np.uint8) > 0]
            alpha, scale = np.zeros(len(keys)), np.zeros(len(keys))
            replies = {w["part"]: w for w in row["weights"] or []}
            for p, s in split(keys, parts):
                alpha[s], scale[s] = unpack(replies[p]["alpha"], np.float64), unpack(replies[p]["scale"], np.float64)
            text, at = unpack(row["wait_text"], np.uint32, True), unpack(row["wait_history"], np.uint32)
            part = unpack(row["part"], np.float64)
            part = part + np.bincount(text, unpack(row["wait_open"], np.uint32) * alpha[at] + unpack(row["wait_seen"], np.uint32) * scale[at], len(part))
            columns = [unpack(row["uids"], np.int64, True), b.column("ids").flatten(), unpack(row["train"], np.uint8).astype(bool), unpack(row["n_tokens"], np.int64), unpack(row["n_known"], np.int64), unpack(row["base"], np.float64), part]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names)

    return judged.mapInArrow(run, schema)


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from those outside the tenth fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) != 0).alias("train"))
    return score(docs).withColumn("held_out", ~F.col("train")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
