"""Writing results: CSV files and display projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.operators.batch import status

# Column titles of written results.
CHECK_TITLES = {"check": "Check", "expected": "Expected", "detected": "Detected", "result": "Result", "notes": "Notes"}
BATCH_TITLES = {
    "file_name": "File Name", "overall_result": "Overall Result", "passed_checks": "Passed Checks", "manual_review_checks": "Manual Review Checks", "failed_checks": "Failed Checks",
    "brand_name": "Brand Name", "class_type": "Class/Type", "alcohol_content": "Alcohol Content", "net_contents": "Net Contents", "name_address": "Name/Address", "country_of_origin": "Country of Origin",
    "issues": "Issues", "ocr_text_preview": "OCR Text Preview", "processing_time_s": "Processing Time (s)",
}


def titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    return df.select([F.col(c).alias(t) for c, t in titles.items() if c in df.columns])


def with_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", status(F.col("result")))


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header, quotes doubled; one part per task unless a number of files is asked for."""
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', encoding="UTF-8", emptyValue="", nullValue="")


def write_check_results(rows: DataFrame, path: str, files: int | None = None) -> None:
    write_csv(titled(rows, CHECK_TITLES), path, files)


def write_batch_results(rows: DataFrame, path: str, files: int | None = None) -> None:
    write_csv(titled(rows, BATCH_TITLES), path, files)
