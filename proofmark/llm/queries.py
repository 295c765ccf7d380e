"""Queries of the operators for training text: each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.llm import addresses, canonical, confusables, leak, mix, quality, scan_noise
from proofmark.runtime import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_premises(load(spark, d, "sample_application"))


def p1_premises(spark: SparkSession, d: str) -> DataFrame:
    return addresses.premises(load(spark, d, "sample_application"))


def p1_rewrites(spark: SparkSession, d: str) -> DataFrame:
    return addresses.normalised_parts(load(spark, d, "sample_application"))[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.noisy_lines(load(spark, d, "batch"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(load(spark, d, "batch"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    one = lambda table, text: confusables.inconsistent_rows(load(spark, d, table), text).select(F.lit(table).alias("table_name"), "row_id")
    return one("sample_application", "brand_name").unionByName(one("batch", "detected_text"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Brand names, and the lines of the recognised texts, grouped by what they look like."""
    brands = confusables.look_alike_groups(load(spark, d, "sample_application"), "brand_name")
    lines = confusables.look_alike_groups(confusables.lines_of_texts(load(spark, d, "batch"), "detected_text"), "detected_text")
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), "*")
    return named(brands, "sample_application").unionByName(named(lines, "batch"))


def p7_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sample_application")
    countries = canonical.free_entries(rows, "country_of_origin", load(spark, d, "country_list"), "country_id", "country_name", other_names=canonical.COUNTRY_NAMES)
    classes = canonical.free_entries(rows, "class_type", load(spark, d, "class_list"), "class_id", "class_name", turned=True)
    return countries.unionByName(classes)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_entries(spark, d).select("row_id", "field", "ref_id")


def p7_misses(spark: SparkSession, d: str) -> DataFrame:
    """The values without an entry and how many rows have them."""
    return p7_entries(spark, d).where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked(load(spark, d, "documents"), load(spark, d, "eval_item"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(load(spark, d, "documents"), load(spark, d, "eval_item"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(load(spark, d, "documents"), load(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(load(spark, d, "documents"), load(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(load(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(load(spark, d, "documents"))


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts alone: built-in expressions only."""
    return load(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in quality.plain_counts(F.col("text")).items()])


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_premises, p1_rewrites, p2_found, p2_repaired, p4_found, p4_groups, p7_found, p7_entries, p7_misses, p8_found, p8_report, p9_mix, p9_shares, p10_found, p10_statistics, p10_counts)}


# White space as Unicode has it.
WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    gone = lambda p: f"len(regexp_replace(text, '{p}', '', 'g'))"
    share = lambda a, b: f"case when {b} > 0 then ({a})::double / {b} else 0.0::double end"
    ending = """[.!?][''")\\]»”’]*\\s*$""".replace("\\\\", "\\")
    return {
        "p10_counts": f"""
        with c as (select doc_id, text, len(regexp_extract_all(text, '\\p{{L}}+')) as w, {gone("[^\\p{L}]+")} as letters, {gone(WS + "+")} as solid,
          len(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as alnum, {gone("[^\\p{N}]+")} as digits, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents)
        select doc_id, cast(w as integer) as n_words, {share("letters", "w")} as mean_word_length, {share("solid - alnum", "solid")} as symbol_ratio, {share("digits", "solid")} as digit_ratio, cast(len(l) as integer) as n_lines,
          {share(f"len(list_filter(l, lambda x: regexp_matches(x, '{ending}')))", "len(l)")} as punctuated_line_share from c""".replace("\\\\p", "\\p"),
    }
