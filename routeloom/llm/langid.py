"""Language identification by segmentation-marginalised unigram models over a fixed public piece vocabulary.

Each language has a probability for each piece. The probability of a word is the sum, over all ways to cut it into pieces,
of the product of their probabilities; a forward pass over the word's positions gives that sum. Expectation maximisation
over the words of a bounded sample of labelled texts (``docs_per_language``) fits the pieces. A text's score for a language
is the sum over its words of the log probability for each word; every word of the whole text counts. A word is a letter
(Unicode category L) with the letters and combining marks (M) that follow, lower-cased, with the vocabulary's word-start sign in
front. A character outside the vocabulary has a small fixed probability in all languages. All pieces of the vocabulary count
that can occur in such words, whatever their length.

Defined results: ``und`` with score 0 for null text, text without a letter, or when nothing was learned; ties go to the
smaller language; repeated rows get the same answer; rows without text or language teach nothing; an empty table gives an
empty result. Rows are scored SLICE at a time and new words WORDS at a time, so memory does not follow the size of a batch;
the words of one very long text are scored in such blocks too.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, table

START = "▁"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
FLOOR = 1e-7  # probability of a letter, or of a piece never seen in a language
CACHE = 150_000  # words remembered, or fewer where languages are many
SLICE, WORDS = 100, 8_192  # rows and new words scored at a time
LONG = 48  # words of more letters are scored one by one
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces that can occur in a lower-cased word with the word-start sign in front."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == p.lower() and regex.fullmatch(START + r"?[\p{L}\p{M}]*", p) and p)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


def forward(word: str, probability: dict[str, float], longest: int) -> list[float]:
    """Sums over all segmentations of each prefix of the word."""
    a = [1.0]
    for end in range(1, len(word) + 1):
        a.append(sum(a[s] * p for s in range(max(0, end - longest), end) if (p := probability.get(word[s:end]) or (FLOOR if end - s == 1 else 0.0))))
    return a


def expected_counts(words: dict[str, float], probability: dict[str, float]) -> dict[str, float]:
    """Expected number of times that each piece is used (the E step). A word too long for its probability to be a float is left out."""
    longest = max(map(len, probability), default=1)
    out: dict[str, float] = defaultdict(float)
    for w, count in words.items():
        a, n = forward(w, probability, longest), len(w)
        b = [0.0] * n + [1.0]
        for s in range(n - 1, -1, -1):
            b[s] = sum(b[e] * p for e in range(s + 1, min(n, s + longest) + 1) if (p := probability.get(w[s:e]) or (FLOOR if e - s == 1 else 0.0)))
        if a[n] <= 0:
            continue
        for e in range(1, n + 1):
            for s in range(max(0, e - longest), e):
                if p := probability.get(w[s:e]):
                    out[w[s:e]] += count * a[s] * p * b[e] / a[n]
    return out


def fit_language(words: dict[str, float], pieces: set[str], rounds: int = 2) -> dict[str, float]:
    """Piece probabilities of one language from its words (with the word-start sign) and their counts."""
    longest = max(map(len, pieces), default=1)
    counts: dict[str, float] = defaultdict(float)
    for w, c in words.items():
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - longest), e):
                if w[s:e] in pieces:
                    counts[w[s:e]] += c
    for i in range(rounds + 1):
        total = sum(counts.values()) or 1.0
        probability = {p: c / total for p, c in counts.items() if c / total > FLOOR}
        if i < rounds:
            counts = expected_counts(words, probability)
    return probability


def fit(docs: DataFrame, docs_per_language: int = 150, vocabulary_path: str | None = None) -> dict[str, dict[str, float]]:
    """Models by language from (text, lang, order): of each language about docs_per_language rows, those first by order (hex digits).

    Languages are assumed to be few (their counts are collected).
    Words are counted on the executors, and each language is fitted in a task of its own from that bounded sample.
    """
    spark = docs.sparkSession
    counts = docs.filter("text IS NOT NULL AND lang IS NOT NULL").groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_language / r["count"]))]), F.col("lang"))
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    sample = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(place < share)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, SLICE) for batch in it for i in range(0, batch.num_rows, SLICE)):
            found = Counter((lang, START + w) for lang, text in zip(*(c.to_pylist() for c in b.columns)) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = spark.sparkContext.broadcast(set(vocabulary(vocabulary_path)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        model = fit_language(dict(sorted(zip(pdf["word"], pdf["n"]))), pieces.value)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "piece": list(model), "p": list(model.values())})

    models: dict[str, dict[str, float]] = {}
    for r in words.groupBy("lang").applyInPandas(learn, "lang string, piece string, p double").toLocalIterator():
        models.setdefault(r.lang, {})[r.piece] = r.p
    return dict(sorted(models.items()))


class Scorer:
    """Scores words for all languages at once and remembers some of them."""

    def __init__(self, models: dict[str, dict[str, float]]):
        self.languages = list(models)
        k = max(1, len(models))
        table: dict[str, list[float]] = {}
        for i, m in enumerate(models.values()):
            for piece, p in m.items():
                table.setdefault(piece, [FLOOR * FLOOR] * k)[i] = p
        for piece in [p for p in table if len(p) == 1]:
            table[piece] = [max(p, FLOOR) for p in table[piece]]
        self.table, self.longest = table, max(map(len, table), default=1)
        self.most = min(CACHE, 32_000_000 // (8 * k))
        self.known: dict[str, int] = {}
        self.rows = np.zeros((self.most, k))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sorted hashes, probabilities
        for n in {1, *map(len, table)}:
            pieces = sorted((p for p in table if len(p) == n), key=self._hash)
            hashes = np.array([*map(self._hash, pieces), (1 << 64) - 1], np.uint64)
            self.by_length[n] = hashes, np.array([*(table[p] for p in pieces), [FLOOR if n == 1 else 0.0] * k])

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of some words: at most WORDS of at most LONG letters at a time."""
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for lo in range(0, len(short), WORDS):
            some = short[lo : lo + WORDS]
            out[some] = self._block([words[i] for i in some])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.word(w)
        return out

    def _block(self, words: list[str]) -> np.ndarray:
        """The forward pass over all words of a block at once."""
        words = [START + w for w in words]
        n, k = len(words), len(self.languages)
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        lengths, most = lengths[order], int(lengths.max())
        codes = np.zeros((most, n), np.uint64)  # a row for each position, words by falling length
        for i, j in enumerate(order):
            codes[: lengths[i], i] = np.frombuffer(words[j].encode("utf-32-le"), np.uint32)
        prefix = np.zeros((most + 1, n), np.uint64)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for i in range(most):
                prefix[i + 1] = prefix[i] * _BASE + codes[i]
                power.append(power[-1] * _BASE)
        sums: dict[int, np.ndarray] = {0: np.ones((n, k))}
        logs, out = np.zeros(n), np.zeros((n, k))
        for end in range(1, most + 1):
            m = int(np.searchsorted(-lengths, -end, "right"))  # words that reach this position
            total = np.zeros((m, k))
            for size, (hashes, probabilities) in self.by_length.items():
                start = end - size
                if start < 0:
                    continue
                with np.errstate(over="ignore"):
                    h = prefix[end, :m] - prefix[start, :m] * power[size]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                if size == 1:
                    total += sums[start][:m] * probabilities[np.where(hit, at, len(hashes) - 1)]
                else:
                    hit = np.flatnonzero(hit)
                    total[hit] += sums[start][hit] * probabilities[at[hit]]
            sums[end] = total
            sums.pop(end - self.longest, None)
            low = np.flatnonzero(total.max(1) < 1e-100)
            if len(low):
                top = total[low].max(1)
                logs[low] += np.log(top)
                for v in sums.values():
                    v[low] /= top[:, None]
            done = slice(int(np.searchsorted(-lengths, -end, "left")), m)
            out[order[done]] = logs[done, None] + np.log(np.maximum(total[done], 1e-300))
        return out

    def word(self, w: str) -> list[float]:
        """Log probabilities of a word in each language, scaled on the way so that long words don't vanish."""
        w = START + w
        k, get = len(self.languages), self.table.get
        floor, zero = [FLOOR] * k, [0.0] * k
        sums, logs = [[1.0] * k], 0.0
        for end in range(1, len(w) + 1):
            total = zero
            for s in range(max(0, end - self.longest), end):
                p = get(w[s:end]) or (floor if end - s == 1 else None)
                if p:
                    total = [t + a * b for t, a, b in zip(total, sums[s - end], p)]
            sums.append(total)
            if len(sums) > self.longest:
                del sums[0]
            top = max(total)
            if top < 1e-100:
                sums = [[x / top for x in row] for row in sums]
                logs += math.log(top)
        return [logs + math.log(max(x, 1e-300)) for x in sums[-1]]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language and its posterior probability among the learned ones."""
        out = []
        for lo in range(0, len(texts), SLICE):
            split = [words_of(t) if t and self.languages else [] for t in texts[lo : lo + SLICE]]
            distinct = set().union(*split)
            new = distinct.difference(self.known)
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = distinct
            if len(new) > self.most:  # more different words than are remembered
                out += [self._result(self._sum(words) if words else None) for words in split]
                continue
            if new:
                at = len(self.known)
                self.rows[at : at + len(new)] = self.words(list(new))
                self.known.update(zip(new, range(at, at + len(new))))
            out += [self._result(self.rows[[self.known[w] for w in words]].sum(0) if words else None) for words in split]
        return out

    def _sum(self, words: list[str]) -> np.ndarray:
        """Sum over words in blocks, nothing remembered."""
        counts = Counter(words)
        distinct, total = list(counts), np.zeros(len(self.languages))
        for lo in range(0, len(distinct), WORDS):
            some = distinct[lo : lo + WORDS]
            total += np.array([counts[w] for w in some]) @ self.words(some)
        return total

    def _result(self, total: np.ndarray | None) -> tuple[str, float]:
        if total is None:
            return "und", 0.0
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def identify(docs: DataFrame, models: dict[str, dict[str, float]], text: str = "text") -> DataFrame:
    """docs with lang_pred and score added; all columns stay (a column of either name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    docs = docs.drop("lang_pred", "score")

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in (batch.slice(i, SLICE) for batch in it for i in range(0, max(1, batch.num_rows), SLICE)):
            found = scorer.texts(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def sample_order(doc_id: Column) -> Column:
    """A fixed random order of documents."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document; learns from documents outside the fourth fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    models = fit(docs.filter(~held).withColumn("order", sample_order(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text", held.alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", "score")
