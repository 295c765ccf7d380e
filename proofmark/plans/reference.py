"""Queries of the verification operators over the whole of their tables.

Label texts are batch.detected_text, expected values sample_application; application files are
those of imports_application.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions import fuzzy, numbers, text
from proofmark.operators import applications, batch, checks, filenames, ocr_text
from proofmark.runtime import checkpointed, exploded, load, spread
from proofmark.sources import images

Query = Callable[[SparkSession, str], DataFrame]


def S(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_application")


def B(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "batch")


def column_query(table: str, **made: Callable[[], Column]) -> Query:
    """One row per row of a table: row_id and made columns."""
    key = "doc_id" if table == "documents" else "row_id"
    return lambda spark, d: load(spark, d, table).select(key, *[c().alias(n) for n, c in made.items()])


def joined_values(values: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(values), numbers.shown), ",")


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(B(spark, d).select("row_id", "detected_text")).select("row_id", F.posexplode(F.split("detected_text", "\n")).alias("line_no", "line"))


def line_keys(spark: SparkSession, d: str) -> DataFrame:
    return label_lines(spark, d).select("row_id", "line_no", text.letters_key(F.col("line")).alias("line_key"))


def line_repairs(spark: SparkSession, d: str) -> DataFrame:
    return label_lines(spark, d).select("row_id", "line_no", ocr_text.repaired_line(F.col("line")).alias("repaired"))


def line_garbage(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents, which hold the junk: which would be dropped from a label's text."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s = text.strip(F.col("line"))
    return lines.select("doc_id", "line_no", (F.coalesce(s, F.lit("")) == "").alias("blank"), ocr_text.garbage(s).alias("garbage"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(B(spark, d).select("row_id", "detected_text")).select("row_id", ocr_text.clean_text(F.col("detected_text")).alias("clean_text"))


def field_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = numbers.field_candidates(F.col("detected_text"), F.lit("primary"))
    return exploded(B(spark, d).select("row_id", "detected_text"), c, ["c"]).select("row_id", "c.field", "c.display", "c.value")


def joined(spark: SparkSession, d: str) -> DataFrame:
    """Expected rows with the last text of their file name and the outcome of the join."""
    texts = B(spark, d).select("row_id", "file_name", "detected_text", "processing_time_s", "processed_at")
    return batch.with_texts(spread(S(spark, d)), texts.withColumnRenamed("row_id", "text_id"), "processed_at", "text_id")


def join_outcome(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).select("row_id", "outcome", F.length("detected_text").alias("text_length"))


def batch_results(spark: SparkSession, d: str) -> DataFrame:
    return batch.results(joined(spark, d), ["row_id"])


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.summary(B(spark, d))


def own_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.summary(batch_results(spark, d))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return checks.with_checks(spread(B(spark, d)))


def core_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.check_rows(_checked(spark, d), ["row_id"])


def attention(spark: SparkSession, d: str) -> DataFrame:
    return checks.attention_items(core_checks(spark, d))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("checks")
    return _checked(spark, d).select("row_id", checks.overall(c).alias("overall_result"), *[checks.count_of(c, r).alias(r.lower()) for r in ("PASS", "REVIEW", "FAIL")], checks.issues(c).alias("issues"))


def _one_check(name: str) -> Query:
    return lambda spark, d: core_checks(spark, d).where(F.col("check") == name).drop("check_no", "check")


def _unnested(c: Column) -> list[Column]:
    return [c[f].alias(f) for f in ("expected", "detected", "result", "notes")]


def alcohol_checks(spark: SparkSession, d: str) -> DataFrame:
    e, t = text.clean_cell(F.col("alcohol_content")), text.empty_if_null(F.col("detected_text"))
    df = B(spark, d).select("row_id", e.alias("e"), t.alias("t"), numbers.percent_values(e).alias("wp"), numbers.proof_values(e).alias("wq"), numbers.percent_values(t).alias("gp"), numbers.proof_values(t).alias("gq"))
    df = df.select("row_id", "e", checks.alcohol_rule(*map(F.col, ("wp", "wq", "gp", "gq"))).alias("rule"), checks.listed(F.col("gp"), F.col("gq")).alias("seen"), checks.has_marker(F.col("t")).alias("marked"))
    return df.select("row_id", checks.alcohol_check(*map(F.col, ("e", "rule", "seen", "marked"))).alias("c")).select("row_id", *_unnested(F.col("c")))


def warning_checks(spark: SparkSession, d: str) -> DataFrame:
    """batch has no word on whether the warning is required, so it is told by the number of failed checks
    here, not where it is two: for the branches that core_checks, which always requires it, never takes."""
    df = B(spark, d).select("row_id", (F.col("failed_checks") != 2).alias("required"), text.collapse(text.empty_if_null(F.col("detected_text"))).alias("t"))
    df = df.select("row_id", "required", (F.col("t") == "").alias("blank"), checks.heading_case(F.col("t")).alias("heading"), checks.phrases_found(F.col("t")).alias("found"))
    return df.select("row_id", checks.warning_check(*map(F.col, ("blank", "heading", "found", "required"))).alias("c")).select("row_id", *_unnested(F.col("c")))


def similarity(spark: SparkSession, d: str) -> DataFrame:
    """Brand and class of every application row against those of each checked label of its file name."""
    a = S(spark, d).where("file_name is not null").select("file_name", F.col("brand_name").alias("a_brand"), F.col("class_type").alias("a_class"))
    df = B(spark, d).join(a, "file_name")
    x, y = text.norm_text(F.col("a_brand")), text.norm_text(F.col("brand_name"))
    df = df.select("row_id", "a_class", "class_type", x.alias("x"), y.alias("y"))
    return df.select("row_id", fuzzy.indel("x", "y").alias("indel"), fuzzy.indel(fuzzy.token_sorted(F.col("x")), fuzzy.token_sorted(F.col("y"))).alias("token_sort"), fuzzy.match_score("x", "y").alias("score"), fuzzy.sequence_ratio("a_class", "class_type").alias("sequence"))


def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.timing(B(spark, d))


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return batch.duplicate_names(B(spark, d))


def blank_names(spark: SparkSession, d: str) -> DataFrame:
    return batch.blank_names(B(spark, d))


def reviewer_edits(spark: SparkSession, d: str) -> DataFrame:
    fields = ["brand_name", "class_type", "net_contents"]
    edits = B(spark, d).where("file_name is not null").select("file_name", *fields, "processed_at")
    return batch.overlay(S(spark, d).select("row_id", "file_name", *fields, "alcohol_content"), edits, "file_name", fields, "processed_at")


def key_value_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", applications.key_values(F.col("text")).alias("e"))
    return exploded(docs, F.col("e"), ["x"]).select("doc_id", "x.key", "x.value")


def application_files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "imports_application").select(F.concat_ws(".", F.col("file_id").cast("string"), F.col("file_format")).alias("source_name"), "content")


def json_entries(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "imports_application").where("file_format = 'json'")
    return exploded(f.select("file_id", "content"), applications.read_entries("content", F.lit("json"))["entries"], ["place", "e"]).select("file_id", "place", "e.key", "e.value")


def parsed_applications(spark: SparkSession, d: str) -> DataFrame:
    p = applications.parse_files(application_files(spark, d))
    return p.withColumn("messages", F.array_join("messages", " "))


def text_applications(spark: SparkSession, d: str) -> DataFrame:
    """Applications as key/value text files, written from the expected rows and read again."""
    line = lambda k, c, sep=": ": F.when(F.col(c).isNotNull(), F.concat(F.lit(k + sep), F.regexp_replace(F.col(c), "[\r\n]+", " ")))
    content = F.concat_ws("\n", line("Brand Name", "brand_name"), line("Class/Type", "class_type"), line("Alcohol Content", "alcohol_content", " - "), line("Bottle Size", "net_contents", " = "), line("Name & Address", "name_address"), line("Country", "country_of_origin"), line("Government Warning Required", "warning_required"))
    files = S(spark, d).select(F.concat(F.col("row_id").cast("string"), F.lit(".txt")).alias("source_name"), content.alias("content"))
    return applications.parse_files(files).withColumn("messages", F.array_join("messages", " "))


def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    return applications.metadata_rows(applications.parse_files(application_files(spark, d)))


def imported_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the first expected row of each file name, overridden by what its text file says."""
    files = text_applications(spark, d).withColumn("row_id", F.regexp_extract("source_name", "^[0-9]+", 0).cast("bigint"))
    current = S(spark, d).select("row_id", F.upper("brand_name").alias("brand_name"), "class_type", F.lit("75 cl").alias("net_contents"), F.lit(True).alias("warning_required"))
    return applications.merged(current, files, "row_id")


def file_matches(spark: SparkSession, d: str) -> DataFrame:
    """Application names (of the expected rows' files) against the names of the checked images."""
    apps = S(spark, d).where("file_name is not null").select(F.concat(F.regexp_replace("file_name", r"_?\d*\.[A-Za-z]+$", ""), F.lit("_application.csv")).alias("file_name"))
    return filenames.best_images(apps, B(spark, d).where("file_name is not null"))


def generated_batch(spark: SparkSession, d: str) -> DataFrame:
    files = application_files(spark, d)
    found = filenames.best_images(files.select(F.col("source_name").alias("file_name")), B(spark, d).where("file_name is not null"))
    return applications.generated_batch(applications.parse_files(files), found)


def batch_messages(spark: SparkSession, d: str) -> DataFrame:
    """The files are parsed once: what was made of them is written and read twice."""
    files = application_files(spark, d)
    found = filenames.best_images(files.select(F.col("source_name").alias("file_name")), B(spark, d).where("file_name is not null"))
    parsed = checkpointed(applications.parse_files(files))
    return applications.batch_messages(parsed, applications.generated_batch(parsed, found))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Label texts as they come from overlapping regions: whole, upper and lower part, and a
    candidate region of the lines with figures."""
    t = spread(B(spark, d).where("detected_text is not null").select("row_id", "detected_text")).select(F.col("row_id").cast("string").alias("file_name"), F.split("detected_text", "\n").alias("l"))
    n = F.size("l")
    part = lambda a: F.array_join(a, "\n")
    def region(ord_: int, kind: str, title: str, source: str, raw: Column) -> Column:
        return F.struct(F.lit(ord_).alias("region_ord"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), F.lit(source).alias("source"), raw.alias("raw_text"))

    upto = lambda x: F.slice("l", F.lit(1), F.greatest(F.lit(1), x.cast("int")))
    rows = F.array(
        region(0, "visible", images.FRONT, "region", part(upto(n * 2 / 3))),
        region(1, "visible", images.FRONT, "region", part(upto(n / 3))),
        region(2, "visible", images.BACK, "region", part(F.slice("l", F.greatest(F.lit(1), (n / 2).cast("int")), n))),
        region(3, "candidate", "", "candidate", part(F.filter("l", lambda x: x.rlike("[0-9]")))),
    )
    return exploded(t, rows, ["x"]).select("file_name", "x.*")


def combined_regions(spark: SparkSession, d: str) -> DataFrame:
    return ocr_text.combine_regions(regions(spark, d).where("kind = 'visible'"), "file_name")


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ocr_text.best_candidates(regions(spark, d), "file_name")


def label_texts(spark: SparkSession, d: str) -> DataFrame:
    return images.label_texts(regions(spark, d))


def region_table(spark: SparkSession, d: str) -> DataFrame:
    return images.region_table(spark)


def queries() -> dict[str, Query]:
    c = F.col
    simple = {
        "text_normalized": column_query("sample_application", brand=lambda: text.norm_text(c("brand_name")), address=lambda: text.norm_text(c("name_address"))),
        "text_tokens": column_query("sample_application", tokens=lambda: F.array_join(text.norm_tokens(c("name_address")), " ")),
        "text_phrases": column_query("batch", phrase=lambda: text.norm_phrase(c("detected_text")), spaces=lambda: text.collapse(text.empty_if_null(c("detected_text")))),
        "phrase_containment": column_query("batch", brand_found=lambda: text.contains_phrase(c("brand_name"), c("detected_text")), class_found=lambda: text.contains_phrase(c("class_type"), c("detected_text"))),
        "token_coverage": column_query("batch", coverage=lambda: text.token_coverage(text.norm_tokens(c("name_address")), text.norm_tokens(c("detected_text")))),
        "cells_and_keys": column_query("sample_application", cell=lambda: text.clean_cell(c("country_of_origin")), key=lambda: text.norm_key(c("class_type")), column_name=lambda: text.column_name(c("class_type")), value=lambda: text.norm_value(c("name_address"))),
        "file_names": column_query("sample_application", stem=lambda: text.file_stem(c("file_name")), words=lambda: F.array_join(F.array_sort(text.file_tokens(c("file_name"))), " "), extension=lambda: text.file_extension(text.empty_if_null(c("file_name")))),
        "text_previews": column_query("batch", preview=lambda: text.preview(c("detected_text"))),
        "elapsed_times": column_query("batch", elapsed=lambda: text.elapsed(c("processing_time_s"))),
        "alcohol_values": column_query("batch", percent=lambda: joined_values(numbers.percent_values(c("detected_text"))), proof=lambda: joined_values(numbers.proof_values(c("detected_text"))), stated=lambda: numbers.states_alcohol(c("detected_text"))),
        "recognised_numbers": column_query("sample_application", strength=lambda: numbers.number(c("alcohol_content")), size=lambda: numbers.usual_ml(numbers.number(c("net_contents")))),
        "net_contents_normalized": column_query("sample_application", net=lambda: numbers.norm_net_contents(c("net_contents"))),
        "candidate_presence": column_query("batch", net_present=lambda: text.already_present(c("net_contents"), c("detected_text")), alcohol_present=lambda: text.already_present(c("alcohol_content"), c("detected_text"))),
        "warning_phrases": column_query("batch", n_found=lambda: F.size(checks.phrases_found(c("detected_text"))), missing=lambda: F.array_join(checks.phrases_missing(checks.phrases_found(c("detected_text"))), "; ")),
        "booleans": column_query("sample_application", batch_required=lambda: checks.batch_warning_required(c("warning_required")), application_required=lambda: applications.boolean(c("warning_required"))),
        "status_labels": column_query("batch", status=lambda: batch.status(c("overall_result"))),
    }
    own = [line_keys, line_repairs, line_garbage, clean_texts, field_candidates, join_outcome, batch_results, batch_summary, own_summary, core_checks, attention, label_counts, alcohol_checks, warning_checks, similarity, timing_summary, duplicate_names, blank_names, reviewer_edits, key_value_lines, json_entries, parsed_applications, text_applications, metadata_rows, imported_fields, file_matches, generated_batch, batch_messages, combined_regions, best_candidates, label_texts, region_table]
    named = {"brand_checks": "Brand Name", "class_checks": "Class/Type", "net_contents_checks": "Net Contents", "name_address_checks": "Name/Address", "country_checks": "Country of Origin"}
    return simple | {f.__name__: f for f in own} | {n: _one_check(k) for n, k in named.items()}
