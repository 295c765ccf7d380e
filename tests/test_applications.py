import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.operators import applications as ap
from proofmark.operators import ocr_text
from proofmark.sources import files, images, pdf, pixels


def parse(spark, *named):
    got = ap.parse_files(spark.createDataFrame(list(named), "source_name string, content string")).collect()
    return {r["source_name"]: r for r in got}


def test_formats(spark):
    csv = "Brand Name,Class/Type,Alcohol Content,Net Contents,Name and Address,Country of Origin,Government Warning Required\nABC,RYE,45%,750 ML,\"ABC, MD\",,false\nX,Y,1%,1 L,Z,,true\n"
    txt = "Brand Name: ABC\nCountry of Origin:\nAlcohol Content - 45%\nNet Contents = 750 ML\nBrand Name: DEF\n: x\n"
    nested = json.dumps({"application": {"Brand Name": "ABC", "Class Type": ["RYE", None, "WHISKY"], "warning_required": False}})
    got = parse(spark, ("a.csv", csv), ("b.txt", txt), ("c.json", nested), ("d.json", "[{\"brand\": \"A\"}, {\"brand\": \"B\"}]"), ("e.json", "{broken"), ("f.csv", "a,b\n"), ("g.xyz", "x"), ("noext", "x"), ("h.txt", None), ("i.csv", None))
    a = got["a.csv"]
    assert (a["brand_name"], a["class_type"], a["name_address"], a["country_of_origin"], a["warning_required"]) == ("ABC", "RYE", "ABC, MD", "", False)
    assert a["messages"][0] == ap.MORE_ROWS and a["messages"][1].startswith("Imported fields: Brand Name, Class/Type")
    b = got["b.txt"]
    assert (b["brand_name"], b["alcohol_content"], b["net_contents"], b["country_of_origin"], b["warning_required"]) == ("DEF", "45%", "750 ML", "", True)
    c = got["c.json"]
    assert (c["brand_name"], c["class_type"], c["warning_required"]) == ("ABC", "RYE, WHISKY", False)
    assert got["d.json"]["brand_name"] == "A" and got["d.json"]["messages"][0] == ap.MORE_RECORDS
    assert got["e.json"]["error"] and got["e.json"]["messages"][0].startswith("Application parsing failed") and got["e.json"]["warning_required"] is True
    assert got["f.csv"]["messages"] == [ap.NO_ROWS] and got["g.xyz"]["messages"] == [ap.UNSUPPORTED]
    assert got["noext"]["source_format"] == "UNKNOWN" and got["h.txt"]["messages"] == [ap.NO_FIELDS] and got["i.csv"]["messages"] == [ap.NO_ROWS]


def alias(spark, field, *entries):
    df = spark.createDataFrame([([{"key": k, "value": v} for k, v in entries],)], "e array<struct<key:string,value:string>>")
    return df.select(ap.normalised(F.col("e")).alias("e")).select(ap.by_alias(F.col("e"), field)).first()[0]


def test_alias_order(spark):
    assert alias(spark, "class_type", ("Product Type", "WINE")) == "WINE"  # loose: holds the word of alias `type`
    assert alias(spark, "net_contents", ("Alcohol by Volume", "45%")) == "45%"
    assert alias(spark, "brand_name", ("brandName[0]", "X")) == ""
    assert alias(spark, "brand_name", ("Brand", "second"), ("6. Brand Name", "x"), ("Brand Name", "first")) == "first"
    assert alias(spark, "brand_name", ("Brand Name", " "), ("application brand name", "deep")) == "deep"
    assert alias(spark, "brand_name") == ""


@pytest.mark.parametrize("v,app,bat", [("f", False, True), ("NO", False, False), ("checked", True, True), ("", True, True), (None, True, True), (" Unchecked ", False, False)])
def test_booleans(spark, v, app, bat):
    from proofmark.operators.checks import batch_warning_required

    r = spark.createDataFrame([(v,)], "x string").select(ap.boolean(F.col("x")), batch_warning_required(F.col("x"))).first()
    assert tuple(r) == (app, bat)


def test_flat_against_own_walk():
    assert ap.flat({"a": {"b": 1, "c": [{"d": 2}, {"d": 3}]}, "e": [1, None, " x "], "f": []}) == [("a b", "1"), ("a c d", "2"), ("e", "1, x"), ("f", "")]
    assert ap.flat([[{"a": True}]]) == [("a", "True")] and ap.flat(3) == [] and ap.flat([]) == []


def test_merge_and_metadata(spark):
    cur = spark.createDataFrame([(1, "A", "B", True)], "id int, brand_name string, class_type string, warning_required boolean")
    imp = spark.createDataFrame([(1, "", "new", False)], "id int, brand_name string, class_type string, warning_required boolean")
    assert tuple(ap.merged(cur, imp, "id").first()) == (1, "A", "new", False)


def test_batch_csv(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('File Name,Brand Name,Class-Type,Alcohol Content,Net Contents,Extra\na.png,"A ""B""",N/A,007,"x\ny",1\n')
    r = files.read_batch_csv(spark, str(p)).first()
    assert (r["file_name"], r["brand_name"], r["class_type"], r["alcohol_content"], r["net_contents"]) == ("a.png", 'A "B"', None, "007", "x\ny")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="file_name"):
        files.read_batch_csv(spark, str(tmp_path / "c.csv"))
    (tmp_path / "apps").mkdir()
    (tmp_path / "apps" / "a.txt").write_bytes("﻿Brand Name: É\n".encode())
    assert ap.parse_files(files.read_application_files(spark, str(tmp_path / "apps"))).first()["brand_name"] == "É"


def test_pdf_with_injected_reader(spark):
    def reader(raw):
        if raw == b"bad":
            raise ValueError("no pdf")
        return {"Brand Name": {"/V": "ABC"}, "x": {"/DV": ""}}, "TTB F 5100.31\nBrand Name: other\nClass Type: RYE"

    df = spark.createDataFrame([("a.pdf", bytearray(b"ok")), ("b.pdf", bytearray(b"bad"))], "source_name string, content binary")
    got = {r["source_name"]: r for r in pdf.parse_pdf_files(df, reader).collect()}
    assert (got["a.pdf"]["brand_name"], got["a.pdf"]["class_type"]) == ("ABC", "RYE") and ap.PDF_FORM in got["a.pdf"]["messages"]
    assert got["b.pdf"]["messages"] == ["Application parsing failed: no pdf"]


def spec_fold(regions):
    import re

    key = lambda s: re.sub("[^A-Z0-9]+", "", s.upper())
    out, titles, has = [], set(), False
    for title, lines in regions:
        new = []
        for x in lines:
            k = key(x)
            if k and not any(k == key(o) or (len(k) >= 5 and k in key(o)) for o in out + new):
                new.append(x)
        if not new:
            continue
        if title:
            if out and has:
                out.append("")
            if title.lower() not in titles:
                out.append(f"{title}:")
                titles.add(title.lower())
            has = True
        out += new
    return "\n".join(out).strip()


def test_fold_against_loop(spark):
    import random

    rnd = random.Random(5)
    pool = ["OLD TOM", "45% ALC/VOL", "old tom", "TOM", "OLD TOM DISTILLERY", "45% ALC VOL", "BRAND", "LABEL", "Label OCR", "x"]
    cases = [[(rnd.choice(["", "Front / Brand Label OCR", "Label OCR", None]), [rnd.choice(pool) for _ in range(rnd.randint(0, 4))]) for _ in range(rnd.randint(0, 5))] for _ in range(60)]
    df = spark.createDataFrame([(i, [{"title": t, "lines": x} for t, x in c if x]) for i, c in enumerate(cases)], "i int, r array<struct<title:string,lines:array<string>>>")
    for r in df.select("i", ocr_text.folded_regions(F.col("r")).alias("t")).collect():
        assert r["t"] == spec_fold([(t or "", x) for t, x in cases[r["i"]] if x])


@pytest.mark.parametrize(
    "line,want",
    [('"ALC./VOL."', "ALC/VOL"), ("Government  Warning", "GOVERNMENT WARNING:"), ("3) According to. the Surgeon", "(1) According to the Surgeon"), ("|– abc ; def,. ||", "abc; def"), ("bevorages machinery. and", "beverages machinery, and"), (None, ""), ("frederick,  md", "FREDERICK, MD")],
)
def test_line_repair(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(ocr_text.repaired_line(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("line,bad", [("ABC", False), ("IMPORTED", False), ("i \\y", True), ("if —T|/\"'’v—wnnnnaanaaannwv—", True), ("750 ML", False), ("%%%%", True), ("", True), ("Brand Label", True), ("xx", True), ("aaaaabbbbb", True), ("Old Tom", False), ("tom", True), ("cats", False)])
def test_garbage(spark, line, bad):
    assert spark.createDataFrame([(line,)], "x string").select(ocr_text.garbage(F.col("x"))).first()[0] is bad


def test_label_text_from_regions(spark):
    def recogniser(image, region):
        assert image.ndim == 2 and image.shape[1] >= 1600
        if region.kind == "candidate":
            return "43% ALC/VOL\n730 ML"
        return "OLD TOM\n45% ALC/VOL" if region.psm == 4 else "OLD TOM\nWHISKY AND MORE"

    df = spark.createDataFrame([("a.png", bytearray(png(np.full((40, 60, 3), 200, np.uint8)))), ("b.jpg", bytearray(b"x")), ("c.png", bytearray(pixels.PNG + b"cut"))], "source_name string, content binary")
    regions = images.recognise(df, recogniser).cache()
    assert regions.where("error is null").count() == 7 and sorted(r["file_name"] for r in regions.where("error is not null").collect()) == ["b.jpg", "c.png"]
    assert images.label_texts(regions.where("error is null")).first()["detected_text"] == "Label OCR:\nOLD TOM\n45% ALC/VOL\nWHISKY AND MORE\n\nRecovered structured field candidates:\n750 ML"
    assert len(images.REGIONS) == images.region_table(spark).count() == 15


def png(image, kind=0, exif=None):
    """A PNG file of pixels, every line with the same filter."""
    h, w, n = image.shape
    flat = image.reshape(h, w * n).astype(int)
    left = np.zeros_like(flat)
    left[:, n:] = flat[:, :-n]
    up = np.vstack([np.zeros((1, w * n), int), flat[:-1]])
    corner = np.zeros_like(flat)
    corner[1:, n:] = flat[:-1, :-n]
    nearest = np.where((abs(up - corner) <= abs(left - corner)) & (abs(up - corner) <= abs(left + up - 2 * corner)), left, np.where(abs(left - corner) <= abs(left + up - 2 * corner), up, corner))
    guess = [0 * flat, left, up, (left + up) // 2, nearest][kind]
    raw = b"".join(bytes([kind]) + row.tobytes() for row in ((flat - guess) % 256).astype(np.uint8))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return pixels.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_is_read_back(kind, channels):
    image = np.random.default_rng(kind).integers(0, 256, (7, 5, channels), dtype=np.uint8)
    want = image[:, :, :3] if channels > 2 else np.repeat(image[:, :, :1], 3, axis=2)
    assert np.array_equal(pixels.read_image(png(image, kind)), want)
    turned = b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x112, 3, 1, 6, 0)
    assert np.array_equal(pixels.read_image(png(image, kind, turned)), np.rot90(want, -1))


def test_orientations():
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a), 0: a}
    assert all(np.array_equal(pixels.upright(a, k), w) for k, w in want.items()) and pixels.orientation_of(b"") == 1


def test_prepared_pixels():
    flat = np.full((10, 20, 3), 90, np.uint8)
    assert pixels.prepared(flat).shape == (800, 1600) and set(np.unique(pixels.prepared(flat))) == {90}
    step = np.zeros((4, 1700), np.uint8)
    step[:, 850:] = 100
    assert pixels.upscaled(step) is step  # wide enough
    assert set(np.unique(pixels.prepared(step))) == {0, 255} and set(np.unique(pixels.prepared(step, 175))) == {0, 255}
    grown = pixels.resized(np.tile(np.arange(0, 250, 10, dtype=np.uint8), (3, 1)), 50, 6)
    assert grown.shape == (6, 50) and (np.diff(grown[0, 6:-6].astype(int)) >= 0).all() and np.array_equal(pixels.resized(step, 1700, 4), step)
    # contrast doubles distances from the mean, the sharpened middle of a peak stands out more
    peak = np.full((5, 1600), 100, np.uint8)
    peak[2, 800] = 140
    assert pixels.prepared(peak)[2, 800] == 255 and pixels.prepared(peak)[0, 0] == 0


def test_ink_and_strategy():
    assert pixels.dark_share(np.full((30, 30, 3), 255, np.uint8)) == 0.0 and pixels.dark_share(np.zeros((30, 30), np.uint8)) == 1.0
    half = np.full((120, 120), 255, np.uint8)
    half[:, :60] = 0
    assert pixels.dark_share(half) == 0.5 and pixels.dark_share(half[:0]) == 0.0
    sheet = np.full((400, 600, 3), 255, np.uint8)
    sheet[100:300, 50:250] = 0
    assert not pixels.side_by_side(sheet)  # the right half is blank
    sheet[100:300, 350:550] = 0
    assert pixels.side_by_side(sheet) and not pixels.side_by_side(sheet[:, :450]) and not pixels.side_by_side(np.repeat(sheet, 2, axis=0))
    assert pixels.crop_box((0.5, 0.5, 0.5, 2.0), 10, 10) == (5, 5, 6, 10) and pixels.crop(sheet, (0, 0, 0.5, 0.5)).shape == (200, 300, 3)


def test_the_program_reads_a_bitmap(tmp_path, monkeypatch):
    fake = tmp_path / "tesseract"
    fake.write_text("#!/bin/sh\nhead -c 12 | tr '\\n' ' '\necho \"$@\"\n")
    fake.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    got = images.tesseract(np.zeros((2, 3), np.uint8), next(r for r in images.REGIONS if r.numeric))
    assert got.startswith("P5 3 2 255 ") and f"--psm 11 -c tessedit_char_whitelist={images.CHARACTERS}" in got and images.ready()[0]
    monkeypatch.setenv("PATH", "/nowhere")
    assert not images.ready()[0]
    with pytest.raises(RuntimeError, match="No recogniser"):
        images.tesseract(np.zeros((2, 3), np.uint8), images.REGIONS[0])


def test_pdf_without_a_library_says_so(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"%PDF"))], "source_name string, content binary")
    row = pdf.parse_pdf_files(df).first()
    assert row["messages"][0].startswith("Application parsing failed: ") and row["source_format"] == "PDF"


def test_votes_first_seen_on_ties(spark):
    df = spark.createDataFrame([("a", 0, "primary", "45% ABV"), ("a", 1, "candidate", "43% ABV"), ("a", 2, "candidate", None)], "file_name string, region_ord int, source string, raw_text string")
    assert [(r["field"], r["display"], r["score"]) for r in ocr_text.best_candidates(df, "file_name").collect()] == [("abv", "45% ALC/VOL", 2)]
