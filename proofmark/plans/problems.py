"""Queries of the general data problems: loading, units, drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators import drift, records, units
from proofmark.runtime import load

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_records(load(spark, d, "raw_application"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejects(_parsed(spark, d)).where("reason <> 'no_header'").select("record_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return records.load_valid(_parsed(spark, d))


def p3_rejects(spark: SparkSession, d: str) -> DataFrame:
    return records.rejects(_parsed(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.amounts_in_other_units(load(spark, d, "sample_application"), load(spark, d, "application_source"))


def p5_amounts(spark: SparkSession, d: str) -> DataFrame:
    return units.standard_amounts(load(spark, d, "sample_application"), load(spark, d, "application_source"))


def _migrations(spark: SparkSession, d: str) -> drift.Migrations:
    return drift.migrations(load(spark, d, "imports_application"))


def _routed(m: drift.Migrations) -> DataFrame:
    fields = m.versions.select(F.explode("fields").alias("f")).select("f.key", "f.name")
    return drift.routed_fields(m.versions, *drift.routes(drift.renames(m), fields))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drifted(_migrations(spark, d))


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_migrations(spark, d))


def p6_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(drift.file_versions(drift.read_files(load(spark, d, "imports_application"))))


def p6_steps(spark: SparkSession, d: str) -> DataFrame:
    """The migration steps between fingerprints."""
    return _migrations(spark, d).steps


def p6_applied(spark: SparkSession, d: str) -> DataFrame:
    """The renames, casts and defaults that each file goes through."""
    return drift.applied_steps(_routed(_migrations(spark, d)))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    table = drift.consistent_table(load(spark, d, "imports_application"), _routed(_migrations(spark, d)))
    return table.withColumn("other_fields", F.to_json("other_fields"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p3_found, p3_loaded, p3_rejects, p5_found, p5_amounts, p6_found, p6_changes, p6_fingerprints, p6_steps, p6_applied, p6_table)}
