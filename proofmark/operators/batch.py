"""Batches: joining expected rows with recognised texts, one result row per label, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions import text
from proofmark.operators import checks as ck

REQUIRED = ["file_name", "brand_name", "class_type", "alcohol_content", "net_contents"]
OPTIONAL = ["name_address", "country_of_origin", "warning_required"]
RESULT = ["file_name", "overall_result", "passed_checks", "manual_review_checks", "failed_checks", "brand_name", "class_type", "alcohol_content", "net_contents", "name_address", "country_of_origin", "issues", "ocr_text_preview"]
# The issues of rows that can't be checked.
NO_NAME, NO_IMAGE = "CSV row is missing a file_name value.", "Matching image file was not uploaded."
#: Seconds within which a label should be read.
TARGET_SECONDS = 5.0
LARGE_BATCH = 25


def normalised_names(names: list[str]) -> list[str]:
    import re

    return [re.sub("[^a-z0-9]+", "_", n.strip().lower()).strip("_") for n in names]


def normalise_columns(df: DataFrame) -> DataFrame:
    """Columns renamed to lower case with underscores; names that then clash are refused."""
    names = normalised_names(df.columns)
    if len(set(names)) < len(names):
        raise ValueError(f"columns clash once normalised: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def ensure_checkable(rows: DataFrame, texts: DataFrame) -> None:
    """Refuse a batch that can't be checked: required columns missing, no rows, or no texts."""
    lacking = missing_columns(rows)
    if lacking:
        raise ValueError("missing required columns: " + ", ".join(lacking))
    if rows.isEmpty():
        raise ValueError("the batch has no rows")
    if texts.isEmpty():
        raise ValueError("there are no texts to check against")


def last_texts(texts: DataFrame, order: str, key: str) -> DataFrame:
    """(file_name, key): which row holds the last text of each file name, by `order` (null first), on
    equal places the greatest key. Only names, places and keys are shuffled, pre-aggregated, so a
    name that many rows carry is no hot group. Rows without a name or a key count for nothing."""
    named = texts.where(F.col("file_name").isNotNull() & F.col(key).isNotNull())
    return named.groupBy("file_name").agg(F.max(F.struct(order, key)).alias("_last")).select("file_name", F.col(f"_last.{key}").alias(key))


def with_texts(rows: DataFrame, texts: DataFrame, order: str, key: str) -> DataFrame:
    """Rows with the last text of their trimmed file name (texts: file_name, detected_text,
    processing_time_s, a unique key and an order) and `outcome`: missing_name, missing_image, matched.

    Rows are led to the key of their text first; the texts themselves then take part in one join, on
    that unique key. Nothing is hinted: adaptive execution broadcasts a side by its measured bytes
    and splits a text that very many rows share."""
    last = last_texts(texts, order, key).select(F.col("file_name").alias("_name"), F.col(key).alias("_text"))
    df = rows.withColumn("_key", text.clean_cell(F.col("file_name"))).join(last, F.col("_key") == F.col("_name"), "left")
    side = texts.select(F.col(key).alias("_text"), "detected_text", "processing_time_s")
    df = df.join(side, "_text", "left")
    outcome = F.when(F.col("_key") == "", "missing_name").when(F.col("_text").isNull(), "missing_image").otherwise("matched")
    return df.select(*rows.columns, "detected_text", "processing_time_s", outcome.alias("outcome"))


def results(joined: DataFrame, keys: list[str]) -> DataFrame:
    """One result row per expected row. Rows without a name or a text fail with the reason and
    are never checked; nothing is dropped."""
    done = ck.with_checks(joined)
    ok = F.col("outcome") == "matched"
    cell = lambda n: text.clean_cell(F.col(n).cast("string")) if n in joined.columns else F.lit("")
    count = lambda r, failed: F.when(ok, ck.count_of(F.col("checks"), r)).otherwise(F.lit(failed))
    return done.select(
        *keys,
        cell("file_name").alias("file_name"),
        F.when(ok, ck.overall(F.col("checks"))).otherwise(ck.FAIL).alias("overall_result"),
        count(ck.PASS, 0).alias("passed_checks"),
        count(ck.REVIEW, 0).alias("manual_review_checks"),
        count(ck.FAIL, 1).alias("failed_checks"),
        *[cell(n).alias(n) for n in RESULT[5:11]],
        F.when(ok, ck.issues(F.col("checks"))).when(F.col("outcome") == "missing_name", NO_NAME).otherwise(NO_IMAGE).alias("issues"),
        F.when(ok, text.preview(F.col("detected_text"))).otherwise("").alias("ocr_text_preview"),
        F.bround("processing_time_s", 2).alias("processing_time_s"),
    )


def summary(rows: DataFrame) -> DataFrame:
    is_ = lambda r: F.count_if(F.col("overall_result") == r)
    return rows.agg(F.count("*").alias("total"), is_("PASS").alias("passed"), is_("MANUAL REVIEW RECOMMENDED").alias("review"), is_("FAIL").alias("failed"))


def timing(rows: DataFrame) -> DataFrame:
    """Mean of the times there are, whether it meets the target, and their sum."""
    t = F.bround("processing_time_s", 2)
    return rows.agg(F.count(t).alias("timed"), F.avg(t).alias("mean_seconds"), (F.avg(t) <= TARGET_SECONDS).alias("within_target"), F.sum(t).alias("total_seconds"))


def duplicate_names(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("file_name").isNotNull()).groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1")


def blank_names(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if(text.clean_cell(F.col("file_name")) == "").alias("blank_names"), (F.count("*") > LARGE_BATCH).alias("large_batch"))


def status(result: Column) -> Column:
    """Display status of a result; an unknown one stays."""
    icons = {"PASS": "✅ PASS", "REVIEW": "⚠️ REVIEW", "FAIL": "❌ FAIL", "Not implemented": "⏳ Not implemented"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in icons.items() for x in kv])[result], result)


def overlay(rows: DataFrame, edits: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Reviewer edits over rows: a non-blank edit replaces a value, a blank one keeps it. Of several
    edits of a key the last by `order` that isn't blank counts, field by field; on equal places the
    greatest value. Edits without a key or a place count for nothing."""
    told = lambda f: F.nullif(text.clean_cell(F.col(f)), F.lit(""))
    last = lambda f: F.max(F.when(told(f).isNotNull(), F.struct(F.col(order).alias("at"), told(f).alias("v"))))["v"]
    known = edits.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    e = known.groupBy(F.col(key).alias("_k")).agg(*[last(f).alias(f"_e_{f}") for f in fields])
    df = rows.join(e, F.col(key) == F.col("_k"), "left")
    return df.select(*[F.coalesce(F.col(f"_e_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
