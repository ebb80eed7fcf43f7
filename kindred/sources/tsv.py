"""Tab-separated sources and sinks; every field is a string and no literal means null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """A file with a header; "NA" and "NULL" are text, and an empty field is ''. A missing file raises."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    read = spark.read.csv(path, schema=schema, sep="\t", header=True, nullValue="\0", emptyValue="", escape='"', multiLine=True)
    return read.na.fill("")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def split_tolerant(lines: DataFrame, columns: tuple[str, ...] = RECORD, at_least: int | None = None) -> DataFrame:
    """Fields of each line of ``value``; lines with fewer than ``at_least`` fields go, further fields are ignored."""
    parts = F.split(F.col("value"), "\t", -1)
    chosen = lines.where(F.size(parts) >= (at_least or len(columns)))
    kept = [c for c in lines.columns if c != "value"]
    return chosen.select(*kept, *[F.coalesce(F.get(parts, i), F.lit("")).alias(c) for i, c in enumerate(columns)])


def count_malformed(lines: DataFrame, at_least: int = 4) -> DataFrame:
    return lines.agg(F.count_if(F.size(F.split("value", "\t", -1)) < at_least).alias("skipped"), F.count("*").alias("lines"))


def split_pair_lines(lines: DataFrame) -> DataFrame:
    """``(s1_id, target_ids)`` of a two-column file: what follows the first tab is one field, blank lines go."""
    parts = F.split(F.col("value"), "\t", 2)
    return lines.where(F.trim("value") != "").select(F.trim(F.get(parts, 0)).alias("s1_id"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("target_ids"))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """``(s1_id, target_ids)`` of a submission's file or folder of files, without their headers."""
    read = spark.read.csv(path, schema="s1_id string, target_ids string", sep="\t", header=True, quote="", nullValue="\0", emptyValue="")
    return read.select(F.trim(F.coalesce("s1_id", F.lit(""))).alias("s1_id"), F.trim(F.coalesce("target_ids", F.lit(""))).alias("target_ids"))


def id_list(ids: Column) -> Column:
    """A comma list as an array of trimmed, non-empty ids."""
    return F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def joined_ids(ids: Column) -> Column:
    """An array of ids as the text of a submission: trimmed, without empty ones, each once in its first place."""
    return F.array_join(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "")), ",")


def parse_truth(table: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """``(s1_id, target_ids array)``; missing columns raise."""
    if missing := {key, ids} - set(table.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return table.select(F.trim(key).alias("s1_id"), id_list(F.col(ids)).alias("target_ids"))


def write_submission(lists: DataFrame, path: str, ids_name: str = "matched_entity_ids") -> None:
    """``(s1_id, target_ids array)`` as a folder of tab-separated files with a header."""
    out = lists.select(F.col("s1_id").alias("source1_entity_id"), joined_ids(F.col("target_ids")).alias(ids_name))
    out.write.csv(path, sep="\t", header=True, emptyValue="", mode="overwrite")


def assemble(s1: DataFrame, lists: DataFrame, order: str = "pos") -> DataFrame:
    """One row per S1 record in its order, with '' where nothing was matched."""
    return s1.join(lists, "s1_id", "left").select(order, "s1_id", F.coalesce(joined_ids(F.col("target_ids")), F.lit("")).alias("target_ids"))
