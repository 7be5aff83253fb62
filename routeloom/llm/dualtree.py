"""Ranked lexical search by dual trees: hierarchies over items and over documents, pruned in pairs of nodes.

A document is a vector of what each of its terms adds to a score, an item the set of its terms. Both are arranged in trees of
neighbours. A node of documents holds for each term the most that one of its documents adds, a node of items the union of its
items' terms, so the sum of the first over the second is at least every score of a pair below them. A pair of nodes whose bound
is below the weakest k-th best score of its items is left out with all documents and items below it, without losing a result;
pairs of leaves are scored in falling order of their bounds.

On Spark, documents are tokenised once into staged vectors, held to terms that items may have (a bitmap of 2**20 checksums of
item terms goes to all tasks; its false positives only cost room). Vectors are dealt into ranges by a row key, items into
chunks, and each chunk meets each range in one group of a bounded number of rows. One range in sixteen goes first: the k-th best
scores found there are floors for all other ranges, so these prune from the start and return little. A window over what the
ranges return gives the k best.

Defined results: null and empty texts have no term; a document without terms is never found and not counted in N; an item
without terms has no result; a null document id ranks after all others of its score, repeated rows of documents rank each,
repeated items are answered each; very long texts are read whole, in the memory of one text; empty tables give an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import sized, stage, table

SLOTS = 1 << 20
PIVOTS = 32
TERM_BYTES = bytes(c + 32 if chr(c).isupper() and c < 128 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, A-Z lower-cased. Separators are all ASCII, so bytes of UTF-8 split as code points do."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def vectors(docs: DataFrame, slots: np.ndarray | None = None) -> DataFrame:
    """(id, n, terms, tfs) of docs (id, text): n counts all terms, terms and tfs hold those whose slot is set."""
    shared = docs.sparkSession.sparkContext.broadcast(None if slots is None else np.packbits(slots))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared.value is None else np.unpackbits(shared.value)
        wanted: dict[bytes, bool] = {}
        for b in it:
            n, sizes, terms, tfs = [], [0], [], []
            for text in b.column(1):
                words = terms_of(text.as_py())
                n.append(len(words))
                if len(wanted) > 1_000_000:
                    wanted.clear()
                for term, tf in Counter(words).items():
                    use = wanted.get(term)
                    if use is None:
                        use = wanted[term] = bits is None or bool(bits[zlib.crc32(term) % SLOTS])
                    if use:
                        terms.append(term)
                        tfs.append(tf)
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), x) for x in (pa.array(terms, pa.binary()), pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "id long, n long, terms array<binary>, tfs array<long>")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Rows:
    """Sparse rows (term, value), none empty: of documents, or of tree nodes with the largest values."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, width: int):
        key = row.astype(np.int64) * width + term
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.row, self.term = key[first] // width, key[first] % width
        self.value = np.maximum.reduceat(value, first) if len(first) else value
        self.width = width
        self.start = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.size = np.diff(self.start, append=len(self.row))

    def parents(self, fan: int) -> Rows:
        return Rows(self.row // fan, self.term, self.value, self.width)

    def sums(self, rows: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Sum of the values of each row over each set of terms (a column of flags)."""
        at = spans(self.start[rows], self.size[rows])
        sizes = self.size[rows]
        return np.add.reduceat(self.value[at, None] * sets[self.term[at]], np.cumsum(sizes) - sizes, 0)


def features(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, width: int) -> np.ndarray:
    """What each row has in common with each of a few rows, to find neighbours. Rows are sorted."""
    start = np.searchsorted(row, np.arange(n + 1))
    out = np.zeros((n, min(n, PIVOTS)))
    for i, pivot in enumerate(np.unique(np.linspace(0, n - 1, min(n, PIVOTS)).astype(np.int64))):
        own = np.zeros(width)
        own[term[start[pivot] : start[pivot + 1]]] = 1.0
        out[:, i] = np.bincount(row, value * own[term], n)
    return out


def neighbours(points: np.ndarray, block: int) -> np.ndarray:
    """An order in which each run of block rows is close: cut at the mean of the feature that spreads most, at whole blocks, no part below an eighth."""
    parts, done = [np.arange(len(points))], []
    while parts:
        part = parts.pop()
        if len(part) <= block:
            done.append(part)
            continue
        own = points[part]
        own = own[:, own.var(0).argmax()]
        part, blocks = part[np.argsort(own, kind="stable")], -(-len(part) // block)
        low = round(np.count_nonzero(own <= own.mean()) / block)
        low = min(max(low, 1, blocks // 8), blocks - max(1, blocks // 8)) * block
        parts += [part[low:], part[:low]]
    return np.concatenate(done)


class Search:
    """The k best documents of one range for each item of a chunk."""

    def __init__(self, item_terms: list[np.ndarray], floors: np.ndarray, docs: tuple[np.ndarray, np.ndarray, np.ndarray], ties: np.ndarray, weight: np.ndarray, k: int, leaf: int = 16, item_leaf: int = 4, fan: int = 4):
        row, term, value = docs  # rows are numbered in tie order
        width = len(weight)
        self.k, self.fan, self.width, self.items = k, fan, width, item_terms
        n, m = len(ties), len(item_terms)
        place = neighbours(features(row, term, value, n, width), leaf)
        at = np.empty(n, np.int64)
        at[place] = np.arange(n)
        self.place = place
        self.docs = Rows(at[row], term, value, width)
        self.leaf = leaf
        self.levels = [Rows(self.docs.row // leaf, self.docs.term, self.docs.value, width)]
        while len(self.levels[-1].size) > 1:
            self.levels.append(self.levels[-1].parents(fan))
        flat = np.repeat(np.arange(m), [len(t) for t in item_terms]), np.concatenate([*item_terms, np.zeros(0, np.int64)])
        self.order = neighbours(features(*flat, weight[flat[1]].astype(np.float64), m, width), item_leaf)
        self.item_leaf = item_leaf
        self.best = np.zeros((m, k), np.int64)
        self.where = np.full((m, k), n)
        self.floors = np.maximum(floors, 1)
        self.scored = self.pairs = 0

    def flags(self, items: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, len(items)), bool)
        for i, item in enumerate(items):
            out[self.items[item], i] = True
        return out

    def weakest(self, items: np.ndarray) -> int:
        return int(np.maximum(self.best[items, -1], self.floors[items]).min())

    def run(self) -> None:
        m, top = len(self.order), len(self.levels) - 1
        todo = [(0, m, top, np.arange(len(self.levels[top].size)))] if m and len(self.docs.size) else []
        while todo:
            lo, hi, level, nodes = todo.pop()
            items = self.order[lo:hi]
            union = np.zeros((self.width, 1), bool)
            for item in items:
                union[self.items[item]] = True
            bounds = self.levels[level].sums(nodes, union)[:, 0]
            self.pairs += len(nodes)
            live = bounds >= self.weakest(items)
            nodes, bounds = nodes[live], bounds[live]
            if not len(nodes):
                continue
            split = hi - lo > self.item_leaf
            if level == 0 and not split:
                self.score(items, nodes[np.argsort(-bounds, kind="stable")], np.sort(bounds)[::-1])
                continue
            if level:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1].size)]
                level -= 1
            half = lo + (-(-(hi - lo) // self.item_leaf) + 1) // 2 * self.item_leaf
            todo += [(half, hi, level, nodes), (lo, half, level, nodes)] if split else [(lo, hi, level, nodes)]

    def score(self, items: np.ndarray, leaves: np.ndarray, bounds: np.ndarray, batch: int = 8) -> None:
        """Scores the documents of leaves, in falling order of the leaves' bounds, until these are below the weakest k-th score."""
        flags = self.flags(items)
        for at in range(0, len(leaves), batch):
            if bounds[at] < self.weakest(items):
                return
            some = leaves[at : at + batch]
            rows = (some[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            rows = rows[rows < len(self.docs.size)]
            found = self.docs.sums(rows, flags)
            self.scored += len(rows) * len(items)
            for i, item in enumerate(items):
                own = np.flatnonzero(found[:, i] >= max(self.best[item, -1], self.floors[item]))
                if len(own):
                    s = np.concatenate([self.best[item], found[own, i]])
                    p = np.concatenate([self.where[item], self.place[rows[own]]])
                    first = np.lexsort((p, -s))[: self.k]
                    self.best[item], self.where[item] = s[first], p[first]


def search_range(items: pa.Table, docs: pa.Table, k: int) -> tuple[pa.Table, Search | None]:
    """Top k of docs (id, m, terms, tfs) for items (key, item, terms, weights, floor), as (key, item, doc, score)."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("key", "item", "doc", "score")})
    if not items.num_rows or not docs.num_rows:
        return empty, None
    terms = items["terms"].combine_chunks()
    encoded = terms.flatten().dictionary_encode()
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    term = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(encoded.dictionary)
    weight = np.zeros(width, np.int64)
    weight[term] = items["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    item_terms = np.split(term, np.cumsum(sizes)[:-1])

    docs = docs.take(pc.sort_indices(docs, [("id", "ascending")], null_placement="at_end"))
    lists = docs["terms"].combine_chunks()
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=encoded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = docs["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    m = docs["m"].to_numpy()[row]
    value = weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
    use = (at >= 0) & (value > 0)
    row, at, value = row[use], at[use], value[use]
    ties, row = np.unique(row, return_inverse=True)
    if not len(ties):
        return empty, None
    search = Search(item_terms, items["floor"].to_numpy(), (row, at, value), ties, weight, k)
    search.run()
    found = search.best >= search.floors[:, None]
    which = pa.array(np.repeat(np.arange(items.num_rows), found.sum(1)))
    ids = docs["id"].take(pa.array(ties[search.where[found]]))
    return pa.table({"key": items["key"].take(which), "item": items["item"].take(which), "doc": ids, "score": pa.array(search.best[found])}), search


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, range_docs: int = 4096, chunk_items: int = 1024, first_of: int = 16) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs (id, text) for each row of items (id, text)."""
    asked = stage(vectors(items).withColumn("key", F.monotonically_increasing_id()), "search-items")
    named = asked.select("key", F.explode("terms").alias("term"))
    slots = np.zeros(SLOTS, bool)
    for (slot,) in named.select((F.crc32("term") % SLOTS).alias("slot")).distinct().collect():  # SLOTS at most
        slots[slot] = True
    found = stage(vectors(docs, slots).withColumn("row", F.monotonically_increasing_id()), "search-documents")
    n, total = found.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2.0 * n + 2.0) / (2 * F.col("df") + 1).cast("double")
    weights = stage(named.select("term").distinct().join(df, "term").select("term", F.floor(1000.0 * F.log(ratio)).cast("long").alias("w")), "search-weights")
    terms = named.join(sized(weights), "term").groupBy("key").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    terms = terms.select("key", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    asked = stage(asked.select("key", F.col("id").alias("item")).join(terms, "key"), "search-asked")

    ranges, chunks = max(1, -(-n // range_docs)), max(1, -(-asked.count() // chunk_items))
    docs = found.filter(F.size("terms") > 0).select("id", F.expr(f"10L + (90L * n * {n}L) div {max(total, 1)}L").alias("m"), "terms", "tfs", F.pmod(F.xxhash64("row"), F.lit(ranges)).alias("range"))
    docs = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))

    def wave(floors: DataFrame | None, lo: int, hi: int) -> DataFrame:
        own = asked.withColumn("floor", F.lit(0).cast("long")) if floors is None else asked.join(sized(floors), "key", "left").fillna(0, ["floor"])
        own = own.select("key", "item", "terms", "weights", "floor", "chunk", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))).alias("range"))
        some = docs.filter((F.col("range") >= lo) & (F.col("range") < hi))
        search = lambda a, b: search_range(a, b, k)[0]
        return own.groupBy("chunk", "range").cogroup(some.groupBy("chunk", "range")).applyInArrow(search, "key long, item long, doc long, score long")

    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    early = ranges // first_of
    if early:
        first = stage(best(wave(None, 0, early)), "search-first")
        floors = stage(first.filter(F.col("rank") == k).select("key", F.col("score").alias("floor")), "search-floors")
        result = best(first.drop("rank").union(wave(floors, early, ranges)))
    else:
        result = best(wave(None, 0, ranges))
    return result.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs, items = (table(spark, sf_dir, name).select(F.col(key).alias("id"), "text") for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    return rank_documents(docs, items, 10)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
           FROM documents),
k AS (SELECT doc_id, r, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM k),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM k) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, nn),
i AS (SELECT item_id, row_number() OVER () AS q,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
      FROM benchmark),
u AS (SELECT DISTINCT item_id, q, term FROM (SELECT item_id, q, unnest(t) AS term FROM i)),
s AS (SELECT u.q, u.item_id, k.r, k.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * k.n * g.nn) // g.ll))))::BIGINT AS score
      FROM u JOIN w ON u.term = w.term JOIN p ON p.term = u.term JOIN k ON k.r = p.r, g GROUP BY u.q, u.item_id, k.r, k.doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
