"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions only.

The documents of a source, in a seeded order, form one stream of words that is cut into blocks of ``block`` words. Targets
share all words by weight; no target exceeds ``most`` times its source, and the excess is shared again by weight among the
others. Blocks are then allocated to sources by the highest quotients weight / (2 i - 1), which gives each source a whole
number of block copies. Within a source the same rule gives each shard (``shards`` runs of neighbouring blocks) its integer
quota, and a seeded selection inside the shard takes every block floor(quota / blocks) or one more time: copy i of the quota
falls on the block where (position + seeded start) * quota / blocks passes a whole number. A document's share of the mix is
the number of its words in taken blocks, with repeats, which has a closed form: nothing is exploded to blocks or words.

Positions in a source's stream come from two levels of running sums: inside hashed buckets, and over the buckets of a
source. A hot source is thus split over all its buckets, and the number of buckets follows the number of documents.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, ordered last; a source
without words has target 0; repeated rows count each; an empty table gives an empty result; other columns are ignored.
Null ids hash as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import stage, table, word_count

SEED = "mix-1"
WORD_AND_SPACE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def seeded(*parts: Column | str) -> Column:
    """A whole number from 0 to 2**32 - 1 that depends on the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(items: DataFrame, group: list[str], seats: str, weight: str, capacity: str, order: list[Column]) -> DataFrame:
    """Adds ``quota``: of each group's seats, those that an item wins by the highest quotients; at most its capacity.

    Seats that an item wins in any case are counted, not listed: with n items, W their weight and S the seats, the final
    divisor lies between W / (S + n / 2) and W / (S - n / 2), so only the quotients in between (a few for each item) are
    ranked. The margin above is wider for seats that a full item passes on.
    """
    all_of = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    rows = items.withColumns({"_w": F.sum(weight).over(all_of), "_n": F.count(F.lit(1)).over(all_of)})
    at = lambda margin: F.when(F.col("_w") > 0, F.floor(F.col(weight) * (F.col(seats) + margin) / F.col("_w") + 0.5)).otherwise(0).cast("long")
    sure = F.least(F.greatest(at(-0.5 * F.col("_n")) - 1, F.lit(0)), F.col(capacity))
    last = F.least(F.greatest(at(2.0 * F.col("_n")) + 2, F.col("_sure")), F.col(capacity))
    rows = rows.withColumn("_sure", sure).withColumn("_last", last)
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(all_of))
    tried = rows.withColumn("_i", F.explode_outer(F.when(F.col("_last") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_last")))))
    quotient = F.when(F.col("_i").isNotNull() & (F.col(weight) > 0), F.col(weight) / (2 * F.col("_i") - 1))
    by = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(F.desc_nulls_last(quotient), *order, F.col("_i"))
    won = (F.col("_i").isNotNull() & (F.row_number().over(by) <= F.col("_open"))).cast("long")
    keep = [c for c in items.columns]
    return tried.withColumn("_won", won).groupBy(*keep, "_sure").agg(F.sum("_won").alias("_won")).withColumn("quota", F.col("_sure") + F.col("_won")).drop("_sure", "_won")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) with weight and target: all words by weight, none above most times its source.

    Sources fill in order of most * size / weight; the first that is not full at the level which the rest would get sets
    the level. One row for each source, in one window: it orders all sources by name as the weights need it.
    """
    one = W.partitionBy(F.lit(0))
    named = one.orderBy(F.col("source").isNull(), "source")
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumns({"_cap": F.col("source_size") * most, "_ratio": F.col("source_size") * F.lit(float(most)) / F.col("weight"), "_total": F.sum("source_size").over(one)})
    filling = one.orderBy("_ratio", F.col("source").isNull(), "source")
    before, rest = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("_level", level)
    final = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(one)["_level"]
    target = F.least(F.col("_cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("_cap").cast("double")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 32, shards: int = 64, docs_per_bucket: int = 1_000_000, buckets: int = 64, key: str = "doc_id", row: str | None = None) -> DataFrame:
    """(key, size, source_size, target, taken, source) for every row of docs (key, text, source).

    With ``row``, the name of a column that tells rows apart, also that column and the selection itself: ``first``, the words
    of the row's first block that belong to rows before it, and ``copies``, how often each block that the row touches is
    taken (null without words). Rows of one id and size are then ordered by their text.
    """
    spread = buckets + docs.count() // docs_per_bucket
    own = [] if row is None else [F.col(row), F.xxhash64("text").alias("text_hash")]
    sized = docs.select(F.col(key), "source", word_count(F.col("text")).alias("size"), *own)
    sized = sized.withColumns({"order": seeded(F.col(key)), "key_text": F.coalesce(F.col(key).cast("string"), F.lit("~"))})
    sized = stage(sized.withColumn("bucket", F.pmod("order", F.lit(spread))), "mix-sizes")
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))

    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumns({"blocks": F.ceil(F.col("source_size") / block).cast("long"), "_all": F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long")})
    sources = apportion(sources.withColumn("_most", F.col("blocks") * most), [], "_all", "target", "_most", [F.col("source").isNull(), F.col("source")])
    sources = sources.withColumnRenamed("quota", "copies").withColumn("shard_blocks", F.greatest(F.ceil(F.col("blocks") / shards), F.lit(1)).cast("long"))

    runs = sources.filter("blocks > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / F.col("shard_blocks")))))
    runs = runs.withColumn("run_blocks", F.least(F.col("shard_blocks"), F.col("blocks") - F.col("shard") * F.col("shard_blocks")))
    runs = runs.select("source", "shard", "run_blocks", "copies", (F.col("run_blocks") * most).alias("_most"))
    runs = apportion(runs, ["source"], "copies", "run_blocks", "_most", [F.col("shard")])
    runs = runs.withColumn("start", F.pmod(seeded(F.col("source"), F.col("shard")), F.col("run_blocks")))
    earlier = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("copies_before", F.coalesce(F.sum("quota").over(earlier), F.lit(0)))
    plans = runs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "run_blocks", "quota", "start", "copies_before"))).alias("plan"))
    plans = plans.withColumnRenamed("source", "_planned")
    plans = sources.join(plans, F.col("source").eqNullSafe(F.col("_planned")), "left").select(F.col("source").alias("_planned"), "source_size", "target", "shard_blocks", "plan")

    cells = cells.join(plans, F.col("source").eqNullSafe(F.col("_planned")))
    cells = cells.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "cell_start", "source_size", "target", "shard_blocks", "plan")
    inside = W.partitionBy("source", "bucket").orderBy("order", "key_text", "size", *([] if row is None else ["text_hash", row])).rowsBetween(W.unboundedPreceding, 0)
    rows = sized.withColumn("_end", F.sum("size").over(inside))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    end = F.col("cell_start") + F.col("_end")

    def taken_before(position: Column) -> Column:
        """Words that the mix takes of the first so many words of the source."""
        at = F.floor(position / block)
        return _copies_before(at) * block + (position - at * block) * (_copies_before(at + 1) - _copies_before(at))

    def _copies_before(b: Column) -> Column:
        """Copies that fall on the first b blocks of the source."""
        shard = F.least(F.floor(b / F.col("shard_blocks")), F.size("plan") - 1)
        run, i = F.element_at("plan", (shard + 1).cast("int")), b - shard * F.col("shard_blocks")
        n, q, s = run["run_blocks"], run["quota"], run["start"]
        each, more = F.floor(q / n), F.pmod(q, n)
        return run["copies_before"] + i * each + F.floor((i + s) * more / n) - F.floor(s * more / n)

    bounds = F.transform(F.array(end - F.col("size"), end), taken_before)  # the same expression for both, so the generated code stays small
    taken = F.when(F.col("size") > 0, bounds[1] - bounds[0]).otherwise(0).cast("long")
    found = [key, "size", "source_size", "target", taken.alias("taken"), "source"]
    if row is not None:
        touched = F.sequence(F.floor((end - F.col("size")) / block), F.floor((end - 1) / block))
        copies = F.transform(touched, lambda b: (_copies_before(b + 1) - _copies_before(b)).cast("int"))
        found += [row, F.pmod(end - F.col("size"), F.lit(block)).cast("int").alias("first"), F.when(F.col("size") > 0, copies).alias("copies")]
    return rows.select(*found)


def taken_words(text: Column, first: Column, copies: Column, copy: Column, block: int = 32) -> Column:
    """The words of the blocks that are taken at least ``copy`` times, in order; the text as it is if these are all."""
    words = F.regexp_extract_all(text, F.lit(WORD_AND_SPACE), F.lit(0))
    words = F.filter(words, lambda w, i: F.get(copies, F.floor((i + first) / block).cast("int")) >= copy)
    part = F.regexp_replace(F.array_join(words, ""), r"^[\x20\x09-\x0D]+", "")
    return F.when(F.array_min(copies) >= copy, text).otherwise(part)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")
