"""Application files of any layout read into the expected fields of a label.

A file becomes an ordered array of (key, value) entries, whatever its format; free-form keys are
led to fields by aliases. Reading errors stay in the row as a message: no file is lost and none
stops the others.
"""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from proofmark.functions import text

# Names under which a field may come, in order of preference (normalised).
ALIASES = {
    "brand_name": ["brand name", "brand", "item 6", "item 6 brand name", "6 brand name"],
    "class_type": ["class type", "class and type", "class type designation", "class designation", "type designation", "class", "type", "product designation"],
    "alcohol_content": ["alcohol content", "alcohol by volume", "alc vol", "abv", "proof", "percent alcohol"],
    "net_contents": ["net contents", "net content", "bottle size", "container size", "volume", "contents"],
    "warning_required": ["warning required", "government warning required", "health warning required", "government health warning required", "requires warning"],
    "product_type": ["type of product", "product type", "item 5", "item 5 type of product", "5 type of product"],
    "fanciful_name": ["fanciful name", "item 7", "item 7 fanciful name", "7 fanciful name"],
    "name_address": ["name address", "name and address", "name and address of applicant", "applicant name and address", "applicant address", "bottler address", "producer address", "importer address", "item 8", "item 8 name and address", "8 name and address"],
    "country_of_origin": ["country of origin", "origin country", "import country", "country"],
}
# Labels, words and messages, on which the results depend.
LABELS = {"brand_name": "Brand Name", "class_type": "Class/Type", "alcohol_content": "Alcohol Content", "net_contents": "Net Contents", "product_type": "Product Type", "fanciful_name": "Fanciful Name", "name_address": "Name / Address", "country_of_origin": "Country of Origin"}
METADATA = ["product_type", "fanciful_name", "name_address", "country_of_origin"]
TRUE, FALSE = ["true", "t", "yes", "y", "1", "required", "checked"], ["false", "f", "no", "n", "0", "not required", "unchecked"]
NA = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
UNSUPPORTED = "Unsupported application upload type. Supported formats are CSV, JSON, TXT, and PDF."
NO_ROWS = "The uploaded CSV did not contain any rows."
MORE_ROWS = "The CSV contains multiple rows. Single-label review imported the first row only. Use Batch Applications for multi-row review."
MORE_RECORDS = "The JSON contains multiple records. Single-label review imported the first record only."
NO_FIELDS = "No supported expected-field values were found. You can still enter the fields manually."
NO_MATCH = "Could not confidently match this application to a label image filename. Review and fill in file_name before processing."
PDF_NOTE = "PDF import is best-effort. It works best with filled PDF form fields or exported application summaries."
PDF_FORM = "Detected text consistent with TTB F 5100.31, Application for and Certification/Exemption of Label/Bottle Approval."
PDF_FORM_2 = "TTB F 5100.31 includes Brand Name and applicant/product metadata, but class/type, alcohol content, and net contents may not be available as dedicated paper-form fields."
PDF_EMPTY = "No filled PDF form-field values were found. If this is a blank official form, enter expected fields manually or upload CSV/JSON/TXT data."

ENTRIES = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())]))
READ = StructType([StructField("entries", ENTRIES), StructField("records", IntegerType()), StructField("error", StringType())])


def shown(v: object) -> str | None:
    """A JSON scalar or list of scalars as text; items of a list joined by comma and blank."""
    if isinstance(v, list):
        return ", ".join(s for s in (str(x).strip() for x in v if x is not None) if s)
    return None if v is None else str(v)


def flat(data: object) -> list[tuple[str, str | None]]:
    """Entries of nested JSON: keys of nested objects joined by a blank; of a list of objects the
    first; of a root list the first item; a root that is no object has none. A key met again keeps
    its first place and takes the later value."""
    out: dict[str, str | None] = {}

    def walk(x: dict, prefix: str) -> None:
        for k, v in x.items():
            key = f"{prefix} {k}".strip()
            if isinstance(v, dict):
                walk(v, key)
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                walk(v[0], key)
            else:
                out[key] = shown(v)

    while isinstance(data, list):
        data = data[0] if data else None
    if isinstance(data, dict):
        walk(data, "")
    return list(out.items())


def read_one(content: str | None, kind: str) -> tuple[list[tuple[str, str | None]], int, str | None]:
    body = (content or "").removeprefix("﻿")
    try:
        if kind == "json":
            data = json.loads(body)
            return flat(data), len(data) if isinstance(data, list) else 1, None
        rows = [r for r in csv.reader(io.StringIO(body)) if r]
        if len(rows) < 2:
            return [], 0, None
        return [(k, None if i >= len(rows[1]) or rows[1][i] in NA else rows[1][i]) for i, k in enumerate(rows[0])], len(rows) - 1, None
    except (ValueError, csv.Error) as e:
        return [], 0, str(e)


@F.pandas_udf(READ)
def read_entries(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Entries of JSON and CSV files, the number of records and the reading error, if any."""
    rows = []
    for c, k in zip(content, kind):
        entries, n, error = read_one(c if isinstance(c, str) else None, k)
        rows.append(([{"key": a, "value": b} for a, b in entries], n, error))
    return pd.DataFrame(rows, columns=["entries", "records", "error"]).astype({"records": "int32"})


def key_values(c: Column) -> Column:
    """Entries of `key: value`, `key = value` or `key - value` lines; the first separator after two
    to eighty characters parts them. A key met again keeps its first place with the last value."""
    pattern = r"^(.{2,80}?)(?:\s*[:=]\s*|\s+-\s+)(.+)$"
    hit = F.filter(text.lines_of(F.regexp_replace(text.empty_if_null(c), "^﻿", "")), lambda x: x.rlike(pattern))
    pairs = F.transform(hit, lambda x: F.struct(text.strip(F.regexp_extract(x, pattern, 1)).alias("key"), text.strip(F.regexp_extract(x, pattern, 2)).alias("value")))
    pairs = F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))
    return last_wins(pairs)


def last_wins(entries: Column) -> Column:
    keys = F.transform(entries, lambda e: e["key"])
    firsts = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.transform(firsts, lambda e: F.struct(e["key"].alias("key"), F.element_at(F.filter(entries, lambda x: x["key"] == e["key"]), -1)["value"].alias("value")))


def normalised(entries: Column) -> Column:
    return last_wins(F.transform(entries, lambda e: F.struct(text.norm_key(e["key"]).alias("key"), text.norm_value(e["value"]).alias("value"))))


def by_alias(entries: Column, field: str) -> Column:
    """Value of a field from normalised entries: the first alias with a value, else the first entry
    whose key has all words of some alias; empty where there is none."""

    def exact_value(alias: str) -> Column:
        return F.get(F.filter(entries, lambda e: (e["key"] == alias) & (e["value"] != "")), F.lit(0))["value"]

    exact = [exact_value(a) for a in ALIASES[field]]

    def loose(e: Column) -> Column:
        words, hit = F.split(e["key"], " "), F.lit(False)
        for a in ALIASES[field]:
            hit = hit | (F.size(F.array_except(F.array(*map(F.lit, a.split())), words)) == 0)
        return hit & (e["value"] != "")

    return F.coalesce(*exact, F.get(F.filter(entries, loose), F.lit(0))["value"], F.lit(""))


def boolean(c: Column, default: bool = True) -> Column:
    s = F.lower(text.norm_value(c))
    return F.when(s.isin(TRUE), True).when(s.isin(FALSE), False).otherwise(F.lit(default))


def from_entries(df: DataFrame, entries: str, messages: Column) -> DataFrame:
    """Fields and messages of parsed applications; df has source_name and source_format."""
    keep = [c for c in df.columns if c != entries]
    df = df.select(*keep, normalised(F.col(entries)).alias("_e"), messages.alias("_m"))
    df = df.select(*keep, "_m", *[by_alias(F.col("_e"), f).alias(f"_{f}" if f == "warning_required" else f) for f in ALIASES])
    names = F.filter(F.array(*[F.when(F.col(f) != "", F.lit(label)) for f, label in LABELS.items()]), lambda x: x.isNotNull())
    told = F.when(F.size(names) > 0, F.concat(F.lit("Imported fields: "), F.array_join(names, ", "), F.lit("."))).otherwise(NO_FIELDS)
    fields = [f for f in ALIASES if f != "warning_required"]
    return df.select(*keep, *fields, boolean(F.col("_warning_required")).alias("warning_required"), F.concat("_m", F.array(told)).alias("messages"))


def parse_files(files: DataFrame) -> DataFrame:
    """files(source_name, content string[, source_format]) -> one row per file: source_name,
    source_format, nine fields, messages and error. The extension decides the format. A file
    that can't be read or has no supported format keeps empty fields, warning_required true and
    a message. PDF files go through proofmark.sources.pdf, which needs a reader."""
    ext = text.file_extension(text.empty_if_null(F.col("source_name")))
    df = files.select("source_name", "content", ext.alias("_x"))
    got = df.withColumn("_r", read_entries(F.when(F.col("_x").isin("csv", "json"), F.col("content")), F.col("_x")))
    entries = F.when(F.col("_x") == "txt", key_values(F.col("content"))).when(F.col("_x").isin("csv", "json"), F.col("_r.entries"))
    none = F.array().cast("array<string>")
    msgs = F.when((F.col("_x") == "csv") & (F.col("_r.records") > 1), F.array(F.lit(MORE_ROWS))).when((F.col("_x") == "json") & (F.col("_r.records") > 1), F.array(F.lit(MORE_RECORDS))).otherwise(none)
    got = got.select("source_name", F.when(F.col("_x") == "", "UNKNOWN").otherwise(F.upper("_x")).alias("source_format"), "_x", F.col("_r.records").alias("_n"), F.col("_r.error").alias("error"), F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")).alias("_entries"), msgs.alias("_msgs"))
    out = from_entries(got, "_entries", F.col("_msgs"))
    failed = F.concat(F.lit("Application parsing failed: "), F.col("error"))
    final = (
        F.when(F.col("error").isNotNull(), F.array(failed))
        .when(~F.col("_x").isin("csv", "json", "txt"), F.array(F.lit(UNSUPPORTED)))
        .when((F.col("_x") == "csv") & (F.col("_n") == 0), F.array(F.lit(NO_ROWS)))
        .otherwise(F.col("messages"))
    )
    return out.withColumn("messages", final).drop("_x", "_n", "_msgs")


def generated_batch(parsed: DataFrame, matches: DataFrame) -> DataFrame:
    """Batch table of parsed applications: file_name is the matched image or blank."""
    m = matches.select(F.col("app_name").alias("source_name"), F.col("image_name").alias("file_name"))
    fields = ["brand_name", "class_type", "alcohol_content", "net_contents", "name_address", "country_of_origin", "warning_required"]
    return parsed.join(m, "source_name", "left").select(F.coalesce("file_name", F.lit("")).alias("file_name"), F.col("source_name").alias("application_file"), *fields)


def batch_messages(parsed: DataFrame, batch: DataFrame) -> DataFrame:
    """(application_file, message) of all files, with a word on those without an image."""
    own = parsed.select(F.col("source_name").alias("application_file"), F.explode_outer("messages").alias("m"))
    lacking = batch.where("file_name = ''").select("application_file", F.lit(NO_MATCH).alias("m"))
    return own.unionByName(lacking).select("application_file", F.concat("application_file", F.lit(": "), "m").alias("message"))


def metadata_rows(parsed: DataFrame) -> DataFrame:
    """(source_name, field, imported_value) of the metadata fields that have a value."""
    return parsed.unpivot(["source_name"], METADATA, "field", "imported_value").where("imported_value <> ''")


def merged(current: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Imported non-empty values over current ones; warning_required always taken over."""
    fields = [f for f in ALIASES if f in current.columns and f != "warning_required"]
    i = imported.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_i_{f}") for f in [*fields, "warning_required"]])
    df = current.join(i, F.col(key) == F.col("_k"), "left")
    return df.select(
        *[F.coalesce(F.nullif(F.col(f"_i_{c}"), F.lit("")), F.col(c)).alias(c) if c in fields else F.coalesce(F.col("_i_warning_required"), F.col(c)).alias(c) if c == "warning_required" else F.col(c) for c in current.columns]
    )
