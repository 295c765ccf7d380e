"""Reading batch tables and application files from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators.applications import NA
from proofmark.operators.batch import missing_columns, normalise_columns


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """A batch CSV: every column text (no type guessing, so `007` stays), words for missing values
    null, column names normalised. Missing required columns are refused by name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = normalise_columns(df)
    lacking = missing_columns(df)
    if lacking:
        raise ValueError("missing required columns: " + ", ".join(lacking))
    return df.select([F.when(~F.col(c).isin(*NA), F.col(c)).alias(c) for c in df.columns])


def read_application_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_name, content) of the files in a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_name"), F.decode(F.col("content"), "UTF-8").alias("content"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(source_name, content) with the bytes as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_name"), "content")


