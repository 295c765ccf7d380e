import random
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from proofmark.functions import fuzzy, numbers, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


def two(spark, a, b, fn):
    return spark.createDataFrame([(a, b)], "a string, b string").select(fn(F.col("a"), F.col("b")).alias("y")).first()[0]


def spec_norm(s):
    s = (s or "").upper().replace("‘", "'").replace("’", "'").replace("“", '"').replace("”", '"').replace("&", " AND ")
    s = "".join(c for c in s if c == "%" or c not in string.punctuation)
    return re.sub(r"\s+", " ", s).strip()


@pytest.mark.parametrize("s", ["Stone's Throw", "CO-OP & Sons", "45.5% alc./vol.", "a\t b\n c", " ", "", None, "Straße — Ω", "‘x’ “y”"])
def test_norm_text_against_spec(spark, s):
    assert one(spark, s, text.norm_text) == spec_norm(s)


def test_norm_text_random(spark):
    rnd = random.Random(1)
    alphabet = string.printable + "éßÄ’“&% "
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", text.norm_text(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == spec_norm(values[r["i"]])


@pytest.mark.parametrize(
    "expected,seen,found",
    [("Stone's Throw", "STONE'S THROW", True), ("OLD TOM", "OLD TOMATO", False), ("OLD TOM DISTILLERY", "x\nOLD TOM\nDISTILLERY y", True), ("", "x", False), ("x", "", False), (None, None, False), ("45.5%", "has 45.5% in", True)],
)
def test_phrase(spark, expected, seen, found):
    assert two(spark, expected, seen, text.contains_phrase) is found


def test_values_and_keys(spark):
    assert one(spark, "/Off \r\n\n\n\n x\t y ", text.norm_value) == "Off \n\n x y"
    assert one(spark, " Class/Type & More ", text.norm_key) == "class type and more"
    assert one(spark, "\t a \n", text.clean_cell) == "a" and one(spark, None, text.clean_cell) == ""
    assert one(spark, ["a ", None, " ", "b"], text.norm_list, "array<string>") == "a, b"
    assert one(spark, " File  Name! ", text.column_name) == "file_name"
    assert one(spark, "a\r\nb\x0bc \n\n d", text.lines_of) == ["a", "b", "c", "d"]
    assert one(spark, "x" * 300 + "\n", text.preview) == "x" * 250
    assert one(spark, "abc_distillery_application.csv", text.file_tokens) == ["abc"]
    assert one(spark, "a.b.PDF ", text.file_extension) == "pdf" and one(spark, "none", text.file_extension) == ""
    assert two(spark, "5 PROOF", "45 PROOF", text.already_present) is True


def test_elapsed_is_rounded_as_binary(spark):
    for v in (0.456, 1.25, 2.45, 2.35, 12.05, 0.995):
        assert one(spark, v, text.elapsed, "double") == (f"{v:.2f} seconds" if v < 1 else f"{v:.1f} seconds")


def test_percent_values(spark):
    assert one(spark, "OIL % SOIL % 45.5% 100,5%", numbers.percent_values) == [11.0, 45.5]
    assert one(spark, "45% 45 percent 12 ABV 90 proof", numbers.percent_values) == [45.0, 12.0]
    assert one(spark, "9O Proof 201 proof 0 proof", numbers.proof_values) == [90.0]
    assert one(spark, None, numbers.percent_values) == []


@pytest.mark.parametrize("s,v", [("1.5.2", None), (".", None), ("4.", 4.0), ("4S", 45.0), ("l,5", 1.5), ("", None), (None, None), ("9" * 400, None)])
def test_number(spark, s, v):
    got = one(spark, s, numbers.number)
    assert got == v or (s and len(s) > 300 and got == float("inf"))


def test_net_contents(spark):
    assert one(spark, "1.75 liters", numbers.norm_net_contents) == "1.75 L"
    assert one(spark, "750mL", numbers.norm_net_contents) == "750 ML"
    for v, w in ((730.4, 750), (82.5, None), (186.6, 187), (1760.0, 1750), (1e18, None)):
        assert one(spark, v, numbers.usual_ml, "double") == w


def test_candidates(spark):
    df = spark.createDataFrame([("45% ALC/VOL 90 PROOF 73O ML 1.75 L 45% alc/vol",)], "x string").select(F.explode(numbers.field_candidates(F.col("x"), F.lit("region"))).alias("c")).select("c.*")
    assert [(r["field"], r["display"], r["value"]) for r in df.collect()] == [("abv", "45% ALC/VOL", 45.0), ("proof", "90 PROOF", 90.0), ("net_contents", "750 ML", 750.0), ("net_contents", "1.75 L", 1.75)]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_lcs_against_table():
    rnd = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rnd.choice("ABCD ") for _ in range(rnd.randint(0, 25))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == brute_lcs(a, b)
        assert abs(fuzzy.indel_ratio(a, b) - (200 * brute_lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9


@pytest.mark.parametrize("a,b,score", [("OLD TOM DISTILLERY", "OLD TOWN DISTILLERY", 82), ("OLD TOM DISTILLERY", "COMPLETELY DIFFERENT LABEL", 41), ("STRAIGHT RYE WHISKY", "WHISKY", 48), ("OLD TOM", "OLD TOMATO SPIRITS", 56), ("", "X", 0), ("A B", "X A B Y", 100)])
def test_line_score(a, b, score):
    assert fuzzy.line_score(a, b) == score


def test_best_line_earliest_on_ties():
    assert fuzzy.best_line("ABC", ["XYZ", "ABD", "ABE"]) == (1, fuzzy.line_score("ABC", "ABD"))
    assert fuzzy.best_line("ABC", []) == (-1, 0) and fuzzy.best_line(None, ["A"]) is None


def test_unicode_strip(spark):
    assert one(spark, " 　x\x1f", text.clean_cell) == "x"
    assert unicodedata.category(" ") == "Zs"


def test_borders_are_those_of_words(spark):
    """Joiners and marks end a word, letters of any alphabet don't."""
    assert one(spark, "(\u200c47 Proof) 2\u200d3.5% \u0301" + "12%", numbers.proof_values) == [47.0]
    assert one(spark, "2\u200d3.5% \u044f12% x\u030112%", numbers.percent_values) == [3.5, 12.0]
