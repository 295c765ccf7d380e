"""Text functions as column expressions: everything stays in the JVM.

White space means Unicode white space throughout. Null texts count as empty where a function
says so and stay null otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmark.runtime import strip

# Punctuation that normalising deletes (all ASCII punctuation but %).
DELETED = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Words of file names that tell nothing about the label.
FILE_WORDS = ["application", "applications", "app", "label", "labels", "ttb", "cola", "f510031", "form", "test", "sample", "official", "filled", "pdf", "csv", "json", "txt", "distillery", "imports", "import", "importer", "company", "inc", "llc"]


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_cell(c: Column) -> Column:
    """Null to empty, trimmed."""
    return strip(empty_if_null(c))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def norm_text(c: Column) -> Column:
    """Upper case, quotes straight, & as AND, punctuation but % deleted, blanks collapsed."""
    up = F.replace(straight_quotes(F.upper(empty_if_null(c))), F.lit("&"), F.lit(" AND "))
    return collapse(F.translate(up, DELETED, ""))


def norm_tokens(c: Column) -> Column:
    return F.regexp_extract_all(norm_text(c), F.lit("[A-Z0-9%]+"), F.lit(0))


def has_phrase(norm_expected: Column, norm_seen: Column) -> Column:
    """Whether the normalised phrase stands in the normalised text, not inside a longer word.
    The plain substring test goes first and decides nearly all rows."""
    bounded = F.regexp_like(norm_seen, F.concat(F.lit(r"(?<![A-Z0-9])\Q"), norm_expected, F.lit(r"\E(?![A-Z0-9])")))
    return (norm_expected != "") & (norm_seen != "") & F.contains(norm_seen, norm_expected) & bounded


def contains_phrase(expected: Column, text: Column) -> Column:
    return has_phrase(norm_text(expected), norm_text(text))


def token_coverage(expected: Column, seen: Column) -> Column:
    """Share of the expected tokens (as a set) that the other token array has; 0 for none expected."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(e, seen)) / F.size(e))


def norm_phrase(c: Column) -> Column:
    """Lower case, quotes straight, blanks collapsed, punctuation kept."""
    return collapse(straight_quotes(F.lower(empty_if_null(c))))


def norm_key(c: Column) -> Column:
    """Field names for comparison: lower case, & as and, all else a blank."""
    return F.trim(F.regexp_replace(F.replace(F.lower(empty_if_null(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def norm_value(c: Column) -> Column:
    """Imported values: one leading slash dropped, \\r as \\n, blanks collapsed, at most one empty line."""
    s = F.regexp_replace(strip(empty_if_null(c)), "^/", "")
    s = F.regexp_replace(F.replace(s, F.lit("\r"), F.lit("\n")), "[ \t]+", " ")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def norm_list(c: Column) -> Column:
    """A list value: its non-empty items, normalised, joined by comma and blank."""
    return F.array_join(F.filter(F.transform(c, norm_value), lambda x: x != ""), ", ")


def column_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_cell(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def lines_of(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(empty_if_null(c), LINE_BREAK), strip), lambda x: x != "")


def letters_key(c: Column) -> Column:
    """Upper case, only A-Z and 0-9."""
    return F.regexp_replace(F.upper(empty_if_null(c)), "[^A-Z0-9]+", "")


def already_present(candidate: Column, text: Column) -> Column:
    k = letters_key(candidate)
    return (k != "") & F.contains(letters_key(text), k)


def file_extension(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.lower(strip(F.element_at(F.split(c, r"\."), -1)))).otherwise(F.lit(""))


def file_stem(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(empty_if_null(c), r"(?s)\.[^.]*$", "")), "[^a-z0-9]+", " "))


def file_tokens(c: Column) -> Column:
    """Distinct telling words of a file name."""
    return F.filter(F.array_except(F.split(file_stem(c), " "), F.array(*map(F.lit, FILE_WORDS))), lambda x: x != "")


def preview(c: Column) -> Column:
    """Trimmed, first 250 characters, line breaks as blanks (in this order)."""
    return F.translate(F.substring(clean_cell(c), 1, 250), "\n", " ")


def elapsed(seconds: Column) -> Column:
    """Two decimals below a second, else one; rounded half to even on the exact binary value."""
    shown = lambda pattern: F.concat(F.call_function("format_number", seconds, F.lit(pattern)), F.lit(" seconds"))
    return F.when(seconds < 1, shown("0.00")).otherwise(shown("0.0"))
