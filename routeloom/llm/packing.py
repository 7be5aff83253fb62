"""Mixture-controlled packing of tokenised documents by deficit round-robin over source queues.

The documents of a source form a queue of tokens. In each round every source's deficit grows by its share of a window, and
the source sends grains of ``grain`` tokens while its deficit covers them; what is left is carried to the next round. A
round thus fills one window of ``window`` tokens to the target proportions, up to a grain for each source. The number of
grains that a source has sent after r rounds is known in closed form, floor(r * share * window / grain), so rounds can be
dealt to independent parts of ``rounds_per_part`` rounds: a part starts with the deficits that the rounds before it leave.
A part concatenates its rounds into sequences of exactly ``window`` tokens; only the last sequence of a part is padded.

Shares are the sources' parts of all tokens, so that all queues end in the last round and every document is packed whole:
each token lies in exactly one piece.

Documents are tokenised once, in place; token ids are kept as bytes. A source's queue is ordered by the task that tokenised
a document and the position there, so a hot source needs no group of its own. The longest group is a part: a fixed number
of tokens.

Defined results: null text counts as empty (its one token is the end id); a null source is a source of its own; repeated
rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import stage, table

END = 1


class Tokens:
    """Token ids of texts as little-endian 16-bit bytes, from a byte-level BPE file of the tokenizers library.

    The file's vocabulary is run by tiktoken, which gives the same ids several times faster; texts that hold a special
    token's string go to the tokenizers library itself, whose model stays in memory only from then on.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.load, self.model = lambda: Tokenizer.from_file(path), None
        model = self.load()
        if model.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of at most 65,536 ids is needed")
        self.special = [t.content for t in model.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves, others from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model.get_vocab().items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """Ids of a text, without special ones added."""
        if not any(s in text for s in self.special):
            return np.array(self.fast(text), "<u2").tobytes()
        self.model = self.model or self.load()
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def sent(rounds: int, source_tokens: int, all_tokens: int, window: int, grain: int) -> int:
    """Tokens that a source has sent after so many rounds."""
    share = rounds * window * source_tokens
    return source_tokens if share >= all_tokens * source_tokens else share // (all_tokens * grain) * grain


def tokenised(docs: DataFrame, path: str, key: str) -> DataFrame:
    """(key, source, task, at, n, ids): at counts the tokens of the source before the document in its task."""
    schema = T.StructType([docs.schema[key], T.StructField("source", T.StringType()), T.StructField("task", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([END], "<u2").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, position = Tokens(path), TaskContext.get().partitionId(), defaultdict(int)
        for b in it:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                at, n, ids = [], [], []
                for source, text in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                    ids.append(tokens.encode(text or "") + end)
                    n.append(len(ids[-1]) // 2)
                    at.append(position[source])
                    position[source] += n[-1]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([task] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return docs.select(F.col(key), "source", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, grain: int = 128, rounds_per_part: int = 1024, key: str = "doc_id") -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source) of docs (key, source, text)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = stage(tokenised(docs, tokenizer, key), "tokens")
    cells = rows.groupBy("source", "task").agg(F.sum("n").alias("cell"))
    ahead = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"ahead": F.coalesce(F.sum("cell").over(ahead), F.lit(0)), "source_tokens": F.sum("cell").over(W.partitionBy("source"))})
    totals = rows.groupBy("source").agg(F.sum("n").alias("source_tokens"))
    whole = totals.agg(F.sum("source_tokens")).first()[0] or 1
    cells = stage(cells.select(F.col("source").alias("_source"), F.col("task").alias("_task"), "ahead", "source_tokens"), "queues")
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("task") == F.col("_task")))
    rows = rows.select(key, "source", "source_tokens", (F.col("ahead") + F.col("at")).alias("position"), "n", "ids")
    schema = T.StructType([T.StructField("part", T.LongType()), docs.schema[key], T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("source_tokens", "position", "start", "n")), T.StructField("ids", T.BinaryType())])

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts documents where their queue passes from one part to the next."""
        for b in it:
            out: list[tuple] = []
            for doc, source, total, position, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                done = 0
                while done < n:
                    part = part_of(position + done, total, whole, window, grain, rounds_per_part)
                    stop = min(n, sent((part + 1) * rounds_per_part, total, whole, window, grain) - position)
                    out.append((part, doc, source, total, position + done, done, n, ids[2 * done : 2 * stop]))
                    done = stop
            yield pa.RecordBatch.from_arrays([pa.array(list(c), T_ARROW.get(f.dataType.typeName())) for c, f in zip(zip(*out) if out else [[]] * 8, schema.fields)], schema.names)

    made = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("source", T.StringType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_part(pdf, key, whole, window, grain, rounds_per_part)

    return rows.mapInArrow(deal, schema).groupBy("part").applyInPandas(fill, made)


T_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "integer": pa.int32()}


def part_of(position: int, source_tokens: int, all_tokens: int, window: int, grain: int, rounds_per_part: int) -> int:
    """The part whose rounds send the token at a position of a queue."""
    per_part = rounds_per_part * window
    p = position * all_tokens // (source_tokens * per_part)
    while sent(p * rounds_per_part, source_tokens, all_tokens, window, grain) > position:
        p -= 1
    while sent((p + 1) * rounds_per_part, source_tokens, all_tokens, window, grain) <= position:
        p += 1
    return p


def pack_part(pdf: pd.DataFrame, key: str, all_tokens: int, window: int, grain: int, rounds_per_part: int) -> pd.DataFrame:
    """Runs the rounds of one part. pdf holds slices of documents; each source's slices are gapless by position."""
    part = int(pdf["part"].iloc[0])
    queues = []
    blank = pdf["source"].isna()
    for _, own in sorted(pdf.groupby([blank, pdf["source"].fillna("")], sort=False), key=lambda x: x[0]):
        own = own.sort_values("position")
        queues.append([int(own["source_tokens"].iloc[0]), list(zip(own[key], own["start"], own["n"], own["ids"], own["source"])), 0, 0])
    out: list[tuple] = []
    sequence, offset, base = 0, 0, part << 32
    for r in range(part * rounds_per_part, (part + 1) * rounds_per_part):
        for queue in queues:
            total, slices, index, used = queue
            # the deficit covers so many tokens now; the rest is carried on
            send = sent(r + 1, total, all_tokens, window, grain) - sent(r, total, all_tokens, window, grain)
            while send:
                doc, start, n, ids, source = slices[index]
                take = min(send, len(ids) // 2 - used, window - offset)
                piece = np.frombuffer(ids, "<u2", take, 2 * used).astype("<u4").tobytes()
                last = out[-1] if out else None
                if last and last[9] is queue and last[8] == index and last[5] == base + sequence:  # goes on in the same sequence
                    out[-1] = (*last[:2], last[2] + take, zlib.crc32(piece, last[3]), *last[4:])
                else:
                    out.append((doc, start + used, take, zlib.crc32(piece), n, base + sequence, offset, source, index, queue))
                offset, used, send = offset + take, used + take, send - take
                if offset == window:
                    sequence, offset = sequence + 1, 0
                if 2 * used == len(ids):
                    index, used = index + 1, 0
            queue[2:] = index, used
    return pd.DataFrame([x[:8] for x in out], columns=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents."""
    return pack(table(spark, sf_dir, "documents"))
