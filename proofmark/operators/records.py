"""Loading delimited records of many files, the unsound ones set apart with a reason.

Every record is read permissively: nothing is dropped, the raw text stays beside the
parsed fields, and three checks in a fixed order decide (`quoting`, `column_count`,
`invalid_value`). A record is cut at its quote signs: pieces at even places are outside
quotes, at odd places inside. That one cut answers quoting, field count and field values
with array functions, in time linear in the record, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.runtime import broadcast_if_small, strip

# What the loader accepts.
FILE_NAME = r"(?is)^.+\.(png|jpg|jpeg)$"
WARNING_WORDS = ["", "true", "false", "yes", "no", "y", "n", "1", "0", "required", "not required", "checked", "unchecked"]
FIELDS = ["file_name", "brand_name", "class_type", "alcohol_content", "net_contents", "name_address", "country_of_origin", "warning_required"]
#: Stands for a delimiter outside quotes; an ESCAPE that a record holds itself is followed by KEPT.
ESCAPE, CUT, KEPT = "\x01", "\x02", "\x03"


def delimiter_of(header: Column) -> Column:
    """Comma or semicolon, whichever the header has more of; comma on a tie."""
    count = lambda d: F.length(header) - F.length(F.replace(header, F.lit(d), F.lit("")))
    return F.when(count(";") > count(","), F.lit(";")).otherwise(F.lit(","))


def column_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def quotes_sound(pieces: Column, d: Column) -> Column:
    """Pieces of a record cut at '"': every quoted field opens after a delimiter or at the start,
    closes before one or at the end, and holds quotes only doubled."""
    n = F.size(pieces)

    def sound(p: Column, i: Column) -> Column:
        only = n == 1
        first, last = (i == 0) & (F.endswith(p, d) | (p == "")), (i == n - 1) & (F.startswith(p, d) | (p == ""))
        middle = (i > 0) & (i < n - 1) & ((p == "") | (F.startswith(p, d) & F.endswith(p, d)))
        return only | (i % 2 == 1) | first | last | middle

    return (n % 2 == 1) & F.forall(F.transform(pieces, sound), lambda x: x)


def parse_records(raw: DataFrame) -> DataFrame:
    """raw(record_id, source_file, record_no, raw_record, ...) -> one row per record_no > 0 with
    `fields` map(header name -> value), `reason` (null: sound) and the raw text.

    Null raw_record counts as an empty record. A file without a header (record_no 0) gives
    reason `no_header`. Of a header name held twice the first column counts. Repeated record
    ids stay repeated. Columns beyond the four are left out.
    """
    raw = raw.select("record_id", "source_file", "record_no", "raw_record")
    header = (
        raw.where(F.col("record_no") == 0)
        .groupBy("source_file")
        .agg(F.min("raw_record").alias("_header"))
        .select(
            F.col("source_file").alias("_file"),
            delimiter_of(F.col("_header")).alias("_delim"),
            F.transform(F.split(F.col("_header"), F.concat(F.lit("\\Q"), delimiter_of(F.col("_header")), F.lit("\\E")), -1), column_name).alias("_names"),
        )
    )
    body = raw.where(F.col("record_no") > 0).withColumn("_text", F.coalesce("raw_record", F.lit("")))
    df = body.join(broadcast_if_small(header), F.col("source_file") == F.col("_file"), "left")
    df = df.withColumn("_pieces", F.split("_text", '"', -1))
    df = df.withColumn("_quoted_well", quotes_sound(F.col("_pieces"), F.col("_delim")))
    escaped = F.transform("_pieces", lambda p: F.replace(p, F.lit(ESCAPE), F.lit(ESCAPE + KEPT)))
    marked = F.array_join(F.transform(escaped, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.col("_delim"), F.lit(ESCAPE + CUT))).otherwise(p)), '"')
    own = lambda v: F.replace(v, F.lit(ESCAPE + KEPT), F.lit(ESCAPE))
    plain = lambda v: F.when(F.startswith(v, F.lit('"')) & (F.length(v) >= 2), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)
    df = df.withColumn("_values", F.transform(F.split(marked, ESCAPE + CUT, -1), lambda v: plain(own(v))))
    at = lambda name: F.get(F.col("_values"), F.array_position("_names", F.lit(name)).cast("int") - 1)
    has = lambda name: F.array_contains("_names", F.lit(name))
    bad_name = has("file_name") & ~F.coalesce(strip(at("file_name")), F.lit("")).rlike(FILE_NAME)
    bad_word = has("warning_required") & ~F.lower(F.coalesce(strip(at("warning_required")), F.lit(""))).isin(WARNING_WORDS)
    reason = (
        F.when(F.col("_names").isNull(), "no_header")
        .when(~F.col("_quoted_well"), "quoting")
        .when(F.size("_values") != F.size("_names"), "column_count")
        .when(bad_name | bad_word, "invalid_value")
    )
    return df.select(*raw.columns, "_names", "_values", reason.alias("reason"))


def load_valid(parsed: DataFrame) -> DataFrame:
    """The sound records as typed rows: strings trimmed, blanks null, warning_required boolean."""
    at = lambda name: strip(F.get(F.col("_values"), F.array_position("_names", F.lit(name)).cast("int") - 1))
    text = lambda name: F.nullif(at(name), F.lit("")).alias(name)
    word = F.lower(at("warning_required"))
    return parsed.where(F.col("reason").isNull()).select(
        "record_id",
        "source_file",
        "record_no",
        *[text(f) for f in FIELDS[:-1]],
        F.when(word.isin("false", "no", "n", "0", "not required", "unchecked"), False).otherwise(True).alias("warning_required"),
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """The unsound records: id, reason and the corrupt raw text."""
    return parsed.where(F.col("reason").isNotNull()).select("record_id", "source_file", "record_no", "reason", F.col("raw_record").alias("corrupt_text"))
