"""The similarity functions under names for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from proofmark.functions import fuzzy
from proofmark.runtime import ship

NAMES = {"indel_ratio": fuzzy.indel, "match_score": fuzzy.match_score, "sequence_ratio": fuzzy.sequence_ratio}


def register(spark: SparkSession) -> None:
    """indel_ratio(a, b) and sequence_ratio(a, b) of any texts, match_score(expected, line) of
    normalised ones."""
    ship(spark)
    for name, function in NAMES.items():
        spark.udf.register(name, function)
