"""A corpus pipeline of five stages: language, near-duplicates, personal data, mixing, packing. Counted with subpackage llm.

Each stage is (name, function of spark, docs, sf_dir); its result is written as Parquet and read as the next one's docs. All
but the last return the columns of documents. Stages work on all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import langid, mixing, neardup, packing, pii
from routeloom.llm._common import stage, stage_alone, table

MIN_LANGUAGE_SCORE = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    """Adds _row, a number that tells rows apart; written, so that all readers see the same numbers."""
    return stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or no language above MIN_LANGUAGE_SCORE.

    Null texts go. Where no document has a language nothing is learned, and all documents stay: none can be rejected.
    """
    models = langid.fit(docs.select("text", "lang", langid.sample_order(F.col("doc_id")).alias("order")))
    if not models:
        return docs
    found = langid.identify(docs, models)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by five-word shingles at 0.8: by the smallest id, then by a hash of the text.

    Rows are linked by a key of their own, so repeated rows are one group and null ids, which come last, are linked too.
    """
    rows = keyed(docs)

    def doomed() -> DataFrame:
        found = stage(neardup.near_duplicates(rows.select("_row", "text"), 5, 80, "_row").select("_row", "component_id"), "groups")
        grouped = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        found = found.join(grouped, "component_id", "left_semi")
        ranked = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("_rank")).join(found, "_row")
        kept = ranked.groupBy("component_id").agg(F.min("_rank")["_row"].alias("_kept"))
        return found.join(kept, "component_id").filter("_row <> _kept").select("_row")

    dropped = stage_alone(spark, doomed, "dropped")
    return rows.join(dropped, "_row", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows. Null texts stay null, repeated rows are masked alike, other columns stay as they are."""
    found = pii.redact(docs, pii.fit(docs))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the blocks of words that the mix takes: a row of docs gives at most three.

    They differ in text only: the n-th has the words of the row's blocks that are taken n times or more. Rows with a null or
    a repeated id have shares of their own. Null texts and texts without words give no row; an empty table gives none. Columns
    of docs may have any name but _row, _copy, _first and _copies.
    """
    rows = keyed(docs)
    shares = lambda: mixing.mix(rows.select("doc_id", "text", "source", "_row"), row="_row").filter("taken > 0").select("_row", F.col("first").alias("_first"), F.col("copies").alias("_copies"))
    rows = rows.join(stage_alone(spark, shares, "shares"), "_row")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max("_copies"))))
    rows = rows.withColumn("text", mixing.taken_words(F.col("text"), F.col("_first"), F.col("_copies"), F.col("_copy")))
    return (rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences. A null text counts as empty, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None  # the language and personal-data stages are models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, with a written table between them; what a stage wrote on its way is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        made = lambda step=step, docs=docs: step(spark, docs, sf_dir)
        docs = stage_alone(spark, made, f"pipeline-{name}") if i + 1 < len(STAGES) else made()
    return docs
