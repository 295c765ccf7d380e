"""Label images through a recogniser: the Tesseract program where it is installed, or any function.

Which parts of an image are read, and how, is a table of regions; the recogniser takes the prepared
pixels of a region and returns text. Everything after the raw text is column expressions.
`ready()` tells whether the program is there; without it text sources work all the same.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators import ocr_text
from proofmark.sources import pixels


@dataclass(frozen=True)
class Region:
    strategy: str
    kind: str  # visible or candidate
    title: str
    box: tuple[float, float, float, float]
    psm: int
    threshold: bool = False
    numeric: bool = False


FRONT, BACK, LABEL = "Front / Brand Label OCR", "Back Label OCR", "Label OCR"
# The regions, as fractions of the image (left, top, right, bottom).
REGIONS = [
    Region("side_by_side", "visible", FRONT, (0.03, 0.04, 0.49, 0.27), 6),
    Region("side_by_side", "visible", FRONT, (0.06, 0.22, 0.48, 0.51), 6),
    Region("side_by_side", "visible", FRONT, (0.03, 0.58, 0.50, 0.90), 6),
    Region("side_by_side", "visible", BACK, (0.55, 0.04, 0.98, 0.31), 6),
    Region("side_by_side", "visible", BACK, (0.55, 0.22, 0.98, 0.44), 6),
    Region("side_by_side", "visible", BACK, (0.55, 0.34, 0.98, 0.86), 6, True),
    Region("side_by_side", "candidate", "", (0.02, 0.58, 0.50, 0.90), 6),
    Region("side_by_side", "candidate", "", (0.08, 0.66, 0.48, 0.91), 11, True, True),
    Region("general", "visible", LABEL, (0.0, 0.0, 1.0, 1.0), 4),
    Region("general", "visible", LABEL, (0.0, 0.0, 1.0, 1.0), 11),
    Region("general", "visible", LABEL, (0.0, 0.0, 1.0, 0.28), 6),
    Region("general", "visible", LABEL, (0.0, 0.12, 1.0, 0.45), 6),
    Region("general", "visible", LABEL, (0.0, 0.30, 1.0, 0.96), 6),
    Region("general", "candidate", "", (0.0, 0.50, 1.0, 1.0), 6, True),
    Region("general", "candidate", "", (0.0, 0.50, 1.0, 1.0), 11, True, True),
]

Recogniser = Callable[[np.ndarray, Region], str]

# Where the program is looked for beside the path, and the characters of numeric regions.
PLACES = [r"C:\Program Files\Tesseract-OCR\tesseract.exe", r"C:\Program Files (x86)\Tesseract-OCR\tesseract.exe"]
CHARACTERS = "0123456789.%ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/"


def program() -> str | None:
    """The Tesseract program of this machine."""
    return shutil.which("tesseract") or next((p for p in PLACES if os.path.exists(p)), None)


def ready() -> tuple[bool, str]:
    """Whether the program can be found on this machine."""
    at = program()
    return (True, f"Recogniser found at {at}.") if at else (False, "No recogniser found; supply detected text or a recogniser function.")


def tesseract(region_pixels: np.ndarray, region: Region) -> str:
    """Text of gray pixels by the program, which reads them from its input as a plain bitmap."""
    at = program()
    if at is None:
        raise RuntimeError(ready()[1])
    height, width = region_pixels.shape
    options = ["-c", f"tessedit_char_whitelist={CHARACTERS}"] if region.numeric else []
    done = subprocess.run([at, "stdin", "stdout", "--oem", "3", "--psm", str(region.psm), *options], input=b"P5 %d %d 255\n" % (width, height) + region_pixels.tobytes(), capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r.strategy, r.kind, r.title, *r.box, r.psm, r.threshold, r.numeric) for i, r in enumerate(REGIONS)], "region_ord int, strategy string, kind string, title string, l double, t double, r double, b double, psm int, threshold boolean, numeric boolean")


def recognise(files: DataFrame, recogniser: Recogniser = tesseract, partitions: int | None = None) -> DataFrame:
    """files(source_name, content) -> (file_name, region_ord, kind, title, source, raw_text, error), one
    row per region read: of side by side labels their own regions, else the general ones. Images
    are spread first: reading them is the cost. A region that fails reads as empty text; an image
    that can't be read is one row without a region, with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["source_name"], b["content"]):
                try:
                    image = pixels.read_image(bytes(content))
                except Exception as e:  # noqa: BLE001 - any reading error belongs to its row
                    rows.append((name, None, None, None, None, "", f"{type(e).__name__}: {e}"))
                    continue
                strategy = "side_by_side" if pixels.side_by_side(image) else "general"
                for i, r in enumerate(REGIONS):
                    if r.strategy != strategy:
                        continue
                    try:
                        raw = recogniser(pixels.prepared(pixels.crop(image, r.box), pixels.THRESHOLD if r.threshold else None), r)
                    except Exception:  # noqa: BLE001 - as documented
                        raw = ""
                    source = "candidate" if r.kind == "candidate" else "region" if strategy == "side_by_side" else "primary"
                    rows.append((name, i, r.kind, r.title, source, raw, None))
            yield pd.DataFrame(rows, columns=["file_name", "region_ord", "kind", "title", "source", "raw_text", "error"]).astype({"region_ord": "Int32"})

    spread = files.select("source_name", "content")
    spread = spread.repartition(partitions) if partitions else spread
    return spread.mapInPandas(run, "file_name string, region_ord int, kind string, title string, source string, raw_text string, error string")


def label_texts(regions: DataFrame) -> DataFrame:
    """(file_name, detected_text) from read regions: visible ones folded, values recovered from all."""
    visible = ocr_text.combine_regions(regions.where("kind = 'visible'"), "file_name")
    best = ocr_text.best_candidates(regions, "file_name").groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("field_no", "field", "display"))).alias("c"))
    df = visible.join(best, "file_name", "left")
    none = F.array().cast("array<struct<field_no:int,field:string,display:string>>")
    df = df.select("file_name", "visible_text", F.coalesce("c", none).alias("c"))
    return ocr_text.with_recovered(df, "visible_text", "c", "detected_text").select("file_name", "detected_text")
