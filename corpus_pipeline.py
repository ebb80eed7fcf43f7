"""A corpus pipeline of five stages over ``documents``: toxicity, repeated lines, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``, with ``n_chars`` following the text. Repeated rows, nulls in any column, empty tables and
further columns of any name go through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import jaccard, lines, packing, pii, toxicity
from kindred.llm.frames import in_large, plan_bytes, stored


def counted(docs: DataFrame) -> DataFrame:
    """Let ``n_chars`` follow the text, where there is such a column; a null text has none."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def written_large(docs: DataFrame, out: DataFrame) -> DataFrame:
    """Stages are written: no more files than cores, or than files of some megabytes."""
    return in_large(out, plan_bytes(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier doesn't predict toxic; null and empty texts are scored as texts without words. Labels outside the held-out fold teach it."""
    return written_large(docs, toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a row with a smaller ``doc_id`` holds as well; rows without an id keep their lines, a null text stays null."""
    return written_large(docs, counted(lines.drop_repeats(docs, keep_columns=True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest ``doc_id`` of each group of near copies; rows without words or id stay, and so do all rows that share the smallest id."""
    return written_large(docs, jaccard.keep_first(docs))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data generalised to its kind and disclosing terms removed; a null text stays null."""
    return written_large(docs, counted(pii.sanitise(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in sequences of at most 2048 tokens; a null or empty text is the end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the spans' statistics or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared checkpoint folder.

    A stage's table is dropped when its successor is written; the last one stays, as the result reads it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        made = stored(stage(spark, docs, sf_dir))
        if last:
            last.drop()
        docs, last = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
