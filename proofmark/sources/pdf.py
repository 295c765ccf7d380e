"""PDF forms through a reader: pypdf where it is installed, or any function.

The reader takes the bytes of a file and returns (form fields, page text); field values may be
dictionaries as form libraries give them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.operators import applications as ap

Reader = Callable[[bytes], tuple[dict, str]]


def pypdf_reader(content: bytes) -> tuple[dict, str]:
    """Form fields, also under their other names, and the text of the pages; a page that fails has none."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF library is installed: give a reader, or import CSV, JSON or TXT data") from e
    document = PdfReader(io.BytesIO(content))
    fields: dict[str, object] = {}
    for name, field in (document.get_fields() or {}).items():
        for label in (name, field.get("/TU"), field.get("/TM")):
            if label:
                fields.setdefault(str(label), dict(field))
    pages = []
    for page in document.pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001 - as documented
            continue
    return fields, "\n".join(pages)


def field_value(v: object) -> str:
    """Of a dictionary the first of value and default value, else the value itself."""
    if isinstance(v, dict):
        v = next((v[k] for k in ("/V", "/DV", "V", "DV") if k in v), "")
    return "" if v is None else str(v).strip()


def parse_pdf_files(files: DataFrame, reader: Reader = pypdf_reader) -> DataFrame:
    """files(source_name, content binary) parsed like other applications. Form fields come before
    what the page text tells; a reader that fails leaves a message in the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["source_name"], b["content"]):
                try:
                    fields, page = reader(bytes(content))
                    rows.append((name, [{"key": str(k), "value": field_value(v)} for k, v in fields.items() if field_value(v)], page or "", None))
                except Exception as e:  # noqa: BLE001 - any reader error belongs to its row
                    rows.append((name, [], "", str(e)))
            yield pd.DataFrame(rows, columns=["source_name", "form", "page", "error"])

    got = files.select("source_name", "content").mapInPandas(run, "source_name string, form array<struct<key:string,value:string>>, page string, error string")
    text_only = F.filter(ap.key_values(F.col("page")), lambda e: ~F.exists("form", lambda f: f["key"] == e["key"]))
    entries = F.concat(F.col("form"), text_only)
    low = F.lower("page")
    form = F.contains(low, F.lit("ttb f 5100.31")) | F.contains(low, F.lit("label/bottle approval"))
    none = F.array().cast("array<string>")
    msgs = F.concat(F.array(F.lit(ap.PDF_NOTE)), F.when(form, F.array(F.lit(ap.PDF_FORM), F.lit(ap.PDF_FORM_2))).otherwise(none), F.when(F.size("_entries") == 0, F.array(F.lit(ap.PDF_EMPTY))).otherwise(none))
    df = got.withColumn("_entries", entries).withColumn("_msgs", msgs).select("source_name", F.lit("PDF").alias("source_format"), "error", "_entries", "_msgs")
    out = ap.from_entries(df, "_entries", F.col("_msgs"))
    return out.withColumn("messages", F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("Application parsing failed: "), F.col("error")))).otherwise(F.col("messages"))).drop("_msgs")
