"""Sharding by jump consistent hashing, in DataFrame functions only.

A document's key is the first 64 bits of the md5 of its id as text, so that any engine gets the same one. From the key a
linear congruential generator draws the shard counts at which the document would move; the last one below the number of
shards is its shard. No ring table is kept, and when one shard is appended a document either stays or goes to the new one.
That is the law ``key``: the id and the number of shards decide alone, so documents of equal text but different ids stand
where their ids put them.

64-bit products wrap in the generator. Checked arithmetic has no such product, so its state is held in digits of 24, 24 and
16 bits. A document draws at most one count for each shard; draws beyond the first 48 are made only for rows that need them.

Slots number the rows of a shard without gaps, by a hash of the id, then id, size, checksum and text hash: a sort by ranges of
all rows, whose last key tells rows apart, so a run of equal rows (or of one id that holds a third of the table) is cut into
ranges like any other. Each range counts its rows of each shard, and running sums over these few counts place the rows.

Defined results: a null text has size 1 and checksum 0, like an empty one; a null id is a key of its own (the hash of empty
text), and its rows share a shard; repeated rows count each and get slots of their own; rows that are equal in all returned
columns may change slots between them, so reruns agree; very long texts are measured whole; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import sized, stage, table

LCG = 2862933555777941757  # fixed value: the multiplier of the published generator
DIGITS = (24, 24, 16)
_A = (LCG & 0xFFFFFF, LCG >> 24 & 0xFFFFFF, LCG >> 48)
FIRST_DRAWS = 48


def key_digits(key: Column) -> list[Column]:
    """The 64-bit key of an id, lowest digit first."""
    hexadecimal = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    part = lambda start, n: F.conv(F.substring(hexadecimal, start, n), 16, 10).cast("long")
    return [part(11, 6), part(5, 6), part(1, 4)]


def _drawn(state: Column) -> Column:
    """The next draw: ``shard`` is the count drawn last, ``next`` the one drawn now."""
    x = [state["x0"], state["x1"], state["x2"]]
    low = x[0] * _A[0] + 1
    middle = x[0] * _A[1] + x[1] * _A[0] + F.shiftright(low, 24)
    high = x[0] * _A[2] + x[1] * _A[1] + x[2] * _A[0] + F.shiftright(middle, 24)
    x1, x2 = middle.bitwiseAND(F.lit(0xFFFFFF)), high.bitwiseAND(F.lit(0xFFFF))
    top = x2 * F.lit(1 << 15) + F.shiftright(x1, 9)  # bits 33 to 63
    after = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + 1).cast("double")))
    return F.struct(state["next"].alias("shard"), after.cast("long").alias("next"), low.bitwiseAND(F.lit(0xFFFFFF)).alias("x0"), x1.alias("x1"), x2.alias("x2"))


def jump(digits: list[Column], shards: int, first_draws: int = FIRST_DRAWS) -> Column:
    """Shard from 0 to shards - 1 of a key."""

    def after(draws: int) -> Column:
        start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), *[d.alias(f"x{i}") for i, d in enumerate(digits)])
        return F.aggregate(F.sequence(F.lit(1), F.lit(draws)), start, lambda s, _: F.when(s["next"] < shards, _drawn(s)).otherwise(s))

    found = after(min(shards, first_draws))
    shard = F.when(found["next"] >= shards, found["shard"])
    return (F.coalesce(shard, after(shards)["shard"]) if shards > first_draws else found["shard"]).cast("int")


def deal(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of docs; grown_shard with one shard more."""
    if shards < 1:
        raise ValueError("there must be a shard")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    digits = key_digits(F.col(key))
    rows = rows.withColumns({f"_x{i}": d for i, d in enumerate(digits)})
    digits = [F.col(f"_x{i}") for i in range(3)]
    rows = rows.withColumns({"shard": jump(digits, shards), "grown_shard": jump(digits, shards + 1), "_order": reduce(lambda a, d: a * 256 + F.shiftright(d, 8), digits[:2], F.lit(0))})
    rows = stage(rows.drop("_x0", "_x1", "_x2"), "shard-rows")

    placed = rows.orderBy("shard", "_order", F.asc_nulls_last(key), "size", "text_crc32", "_text", "_row")
    placed = placed.drop("_order", "_text", "_row").withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_range", F.shiftright("_at", 33)), "shard-order")
    cells = placed.groupBy("shard", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    cells = stage(cells.select("shard", "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")), "shard-cells")
    rows = placed.join(sized(cells), ["shard", "_range"])
    return rows.select(F.col(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_shift")).alias("slot"), "grown_shard")


def op12_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts all documents into eight shards."""
    return deal(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
