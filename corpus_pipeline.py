"""A corpus pipeline of five stages over `documents`: language, near duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import jaccard_join, language_id, mixing, packing, pii
from tideline.llm.common import drop_stored, hashed, numbered, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a known language, and name it in `lang`; those without letters (null and empty texts too), or in none, go.

    The model learns from rows outside the held-out bucket; a row with a null doc_id isn't in that bucket. Rows that repeat
    are judged alike. Columns beyond those of documents go. An empty table stays empty.
    """
    held = F.coalesce(language_id.bucket(F.col("doc_id")) == 2, F.lit(False))
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs.where(~held)))
    found = found.where((F.col("lang_pred") != "und") & (F.col("lang_bits") <= language_id.MOST_BITS))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar ones: that of least doc_id, nulls last, of rows that agree in it any one.

    Rows are compared, not ids: rows with a null or a repeated doc_id are documents of their own, so of rows that repeat
    one stays, and of two texts with one id both do unless they are similar. Rows without words (null and empty texts too)
    are similar to none and stay. Columns beyond those of documents go. An empty table stays empty.
    """
    rows, row = numbered(docs.select(*COLUMNS))
    found = stored(jaccard_join.jaccard_join(rows.select(F.col(row).alias("doc_id"), "text")), "found").withColumnsRenamed({"doc_id": row, "component_id": "group_"})
    found = found.join(rows.select(row, "doc_id"), row)
    kept = found.groupBy("group_").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("kept_"), F.count("*").alias("rows_")).where("rows_ > 1")
    gone = stored(found.join(kept, "group_").where(F.col(row) != F.col(f"kept_.{row}")).select(row), "gone")
    return rows.join(hashed(gone), row, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kinds; n_chars follows.

    Every row stays, repeated ones and null ids too; a null text stays null and has null n_chars, an empty one stays
    empty. Columns beyond those of documents go. An empty table stays empty.
    """
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some twice, so that sources come to their target weights.

    Rows are taken, not ids, so rows that repeat and null ids are documents of their own; a null source is a source. Of a source
    without words nothing is taken; where a source is taken whole, its rows without words are too. Columns beyond
    those of documents go. An empty table stays empty.
    """
    return mixing.mix(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and gives its end id alone. Rows that repeat, and null ids, give their pieces again. An empty table
    gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: Language prediction, the field's spans and the tokenizer can't be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
