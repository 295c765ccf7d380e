import pytest
from pyspark.sql import functions as F

from proofmark.operators import batch, checks, filenames

W = "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
COLS = "brand_name string, class_type string, alcohol_content string, net_contents string, name_address string, country_of_origin string, warning_required string, detected_text string"
FULL = f"OLD TOM DISTILLERY\nKENTUCKY STRAIGHT BOURBON\n45% Alc./Vol. (90 Proof)\n750 mL\n{W}"


def run(spark, **v):
    names = [c.split()[0] for c in COLS.split(", ")]
    df = checks.with_checks(spark.createDataFrame([tuple(v.get(n) for n in names)], COLS))
    return {c["check"]: c for c in df.first()["checks"]}


def test_full_label(spark):
    got = run(spark, brand_name="Old Tom Distillery", class_type="Kentucky Straight Bourbon", alcohol_content="45%", net_contents="750 mL", detected_text=FULL)
    assert list(got) == ["Brand Name", "Class/Type", "Alcohol Content", "Net Contents", "Government Warning"]
    assert all(c["result"] == "PASS" for c in got.values())


@pytest.mark.parametrize(
    "brand,seen,result,note",
    [
        ("Old Tom Distillery", "Old Town Distillery", "REVIEW", "Match score: 82."),
        ("OLD TOM DISTILLERY", "Completely Different Label", "FAIL", "Match score: 41."),
        ("OLD TOM", "OLD TOMATO SPIRITS", "FAIL", "Match score: 56."),
        ("OLD TOM", "", "FAIL", "No label text was provided for comparison."),
        ("", "x", "REVIEW", "No expected value was provided."),
        (None, None, "REVIEW", "No expected value was provided."),
    ],
)
def test_text_field(spark, brand, seen, result, note):
    c = run(spark, brand_name=brand, detected_text=seen)["Brand Name"]
    assert c["result"] == result and c["notes"].endswith(note)


@pytest.mark.parametrize(
    "expected,seen,result",
    [("45%", "45% Alc./Vol. (90 Proof)", "PASS"), ("45%", "90 Proof", "PASS"), ("90 proof", "45% abv", "PASS"), ("45%", "% ALC/VOL", "REVIEW"), ("45%", "4S% ALC/VOL", "PASS"), ("45%", "9O Proof", "PASS"), ("45%", "45.2%", "REVIEW"), ("45%", "nothing", "FAIL"), ("", "45%", "REVIEW")],
)
def test_alcohol(spark, expected, seen, result):
    assert run(spark, alcohol_content=expected, detected_text=seen)["Alcohol Content"]["result"] == result


def test_alcohol_detected_text(spark):
    c = run(spark, alcohol_content="40%", detected_text="45% 41.5% 90 proof")["Alcohol Content"]
    assert c["detected"] == "Percent values: 45%, 41.5%; Proof values: 90"


@pytest.mark.parametrize("expected,seen,result", [("750 mL", "750 mL", "PASS"), ("1.75 L", "175 L", "PASS"), ("750 mL", "730 mL", "REVIEW"), ("750 mL", "x", "FAIL")])
def test_net(spark, expected, seen, result):
    assert run(spark, net_contents=expected, detected_text=seen)["Net Contents"]["result"] == result


def test_warning(spark):
    phrases = "GOVERNMENT WARNING: according to the surgeon general risk of birth defects"
    cases = [(W, None, "PASS", None), (W.replace("GOVERNMENT WARNING:", "Government Warning:"), None, "FAIL", "Incorrect warning heading capitalization"), ("no statement", None, "FAIL", ""), (phrases, None, "REVIEW", "Found 2 of 5 required phrases"), (phrases[20:], None, "REVIEW", "Found 2 warning-related phrases but no correct heading"), ("GOVERNMENT WARNING:", None, "FAIL", ""), ("x", "no", "PASS", "Not checked"), (None, None, "FAIL", ""), ("GOVERNMENT WARNING : x", None, "FAIL", "Incorrect warning heading capitalization")]
    for seen, required, result, detected in cases:
        c = run(spark, warning_required=required, detected_text=seen)["Government Warning"]
        assert c["result"] == result and (detected is None or c["detected"] == detected), seen


def test_optional_fields(spark):
    got = run(spark, name_address="ABC Distillery, Frederick, MD", country_of_origin=" ", detected_text="ABC DISTILLERY FREDERICK MD")
    assert got["Name/Address"]["result"] == "PASS" and "Country of Origin" not in got
    assert run(spark, country_of_origin="Canada", detected_text="Imported from Canada")["Country of Origin"]["result"] == "PASS"


def test_batch_row(spark):
    df = spark.createDataFrame([(1, "a.png", "Old Tom Distillery", None, "45%", "750 mL", FULL, 1.005), (2, " ", "b", "c", "d", "e", None, None), (3, "z.png", "b", "c", "d", "e", None, None)], "row_id int, file_name string, brand_name string, class_type string, alcohol_content string, net_contents string, detected_text string, processing_time_s double")
    texts = df.where("row_id = 1").withColumn("at", F.lit(1)).withColumnRenamed("row_id", "id")
    got = {r["row_id"]: r for r in batch.results(batch.with_texts(df.drop("detected_text", "processing_time_s"), texts, "at", "id"), ["row_id"]).collect()}
    assert (got[1]["overall_result"], got[1]["passed_checks"], got[1]["manual_review_checks"], got[1]["failed_checks"]) == ("MANUAL REVIEW RECOMMENDED", 4, 1, 0)
    assert got[1]["issues"] == "Class/Type: No expected value was provided." and got[1]["class_type"] == ""
    assert got[2]["issues"] == batch.NO_NAME and got[3]["issues"] == batch.NO_IMAGE
    assert (got[3]["overall_result"], got[3]["failed_checks"], got[3]["ocr_text_preview"]) == ("FAIL", 1, "")


def test_matched_null_text_is_no_missing_image(spark):
    rows = spark.createDataFrame([("a.png",)], "file_name string")
    texts = spark.createDataFrame([(1, 1, "a.png", None, None)], "id int, at int, file_name string, detected_text string, processing_time_s double")
    assert batch.with_texts(rows, texts, "at", "id").first()["outcome"] == "matched"


def test_last_text_wins(spark):
    t = spark.createDataFrame([(1, "a", "old", 1.0, 1), (2, "a", "new", 2.0, 2), (3, "a", "newer", 3.0, 2), (9, "a", "undated", 1.0, None), (4, None, "x", 1.0, 3), (None, "a", "no key", 1.0, 9)], "id int, file_name string, detected_text string, processing_time_s double, at int")
    assert [tuple(r) for r in batch.last_texts(t, "at", "id").collect()] == [("a", 3)]
    rows = spark.createDataFrame([(" a ",), ("b",), (None,), ("a",)], "file_name string")
    got = sorted((r["outcome"], r["detected_text"] or "") for r in batch.with_texts(rows, t, "at", "id").collect())
    assert got == [("matched", "newer"), ("matched", "newer"), ("missing_image", ""), ("missing_name", "")]
    assert batch.with_texts(rows, t.limit(0), "at", "id").count() == 4 and batch.with_texts(rows.limit(0), t, "at", "id").count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`File Name` int, `Class-Type` int")
    assert batch.normalise_columns(df).columns == ["file_name", "class_type"]
    assert batch.missing_columns(batch.normalise_columns(df)) == ["brand_name", "alcohol_content", "net_contents"]
    with pytest.raises(ValueError):
        batch.normalise_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_overall_and_timing(spark):
    df = spark.createDataFrame([("PASS", 1.004), ("FAIL", None), ("MANUAL REVIEW RECOMMENDED", 2.0)], "overall_result string, processing_time_s double")
    assert tuple(batch.summary(df).first()) == (3, 1, 1, 1)
    assert tuple(batch.timing(df).first()) == (2, 1.5, True, 3.0)
    assert batch.timing(df.limit(0)).first()["mean_seconds"] is None


def test_overlay(spark):
    r = spark.createDataFrame([("k", "a", "b"), (None, "c", "d")], "id string, x string, y string")
    e = spark.createDataFrame([("k", "new", " ", 1), ("k", "alt", None, 2), ("k", " ", None, 3), ("k", "zzz", "z", None), (None, "q", "q", 9)], "id string, x string, y string, at int")
    assert sorted(map(tuple, batch.overlay(r, e, "id", ["x", "y"], "at").collect()), key=str) == [("k", "alt", "b"), (None, "c", "d")]


def test_file_matches(spark):
    images = ["abc_rye_whisky_label.jpg", "12345_rum_liqueur_label.jpg"]
    apps = spark.createDataFrame([("abc_distillery_application.csv",), ("sample_applications.json",), (None,), ("zzz.csv",)], "file_name string")
    got = dict(map(tuple, filenames.best_images(apps, spark.createDataFrame([(i,) for i in images], "file_name string")).collect()))
    assert got == {"abc_distillery_application.csv": images[0], "sample_applications.json": "", "": "", "zzz.csv": ""}
    twice = spark.createDataFrame([(images[0],), (images[0],)], "file_name string")
    assert dict(map(tuple, filenames.best_images(apps, twice).collect()))["abc_distillery_application.csv"] == ""


def test_file_matches_against_all_pairs(spark):
    import random
    import re
    from difflib import SequenceMatcher

    from proofmark.functions.text import FILE_WORDS

    rnd = random.Random(3)
    words = ["amber", "mill", "rye", "oak", "label", "form", "creek", "a1"]
    name = lambda ext: "_".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) + ext
    apps, images = sorted({name(".csv") for _ in range(40)}), [name(".png") for _ in range(30)]
    stem = lambda f: re.sub("[^a-z0-9]+", " ", f.rsplit(".", 1)[0].lower()).strip()
    toks = lambda f: {w for w in stem(f).split() if w not in FILE_WORDS}
    want = {}
    for a in apps:
        scored = sorted(((10 * len(toks(a) & toks(i)) + SequenceMatcher(None, stem(a), stem(i)).ratio(), i) for i in images), key=lambda x: -x[0])
        top = scored[0]
        want[a] = top[1] if toks(a) & toks(top[1]) and not (len(scored) > 1 and scored[1][0] == top[0]) else ""
    df = lambda v: spark.createDataFrame([(x,) for x in v], "file_name string")
    assert dict(map(tuple, filenames.best_images(df(apps), df(images)).collect())) == want


def test_extra_columns_do_no_harm(spark):
    df = spark.createDataFrame([(1, "a", "x", 5)], "row_id int, brand_name string, detected_text string, checks2 int")
    assert checks.with_checks(df).columns == ["row_id", "brand_name", "detected_text", "checks2", "checks"]
    assert checks.with_checks(df.limit(0)).count() == 0


def test_guards(spark):
    full = spark.createDataFrame([("a", "b", "c", "d", "e")], "file_name string, brand_name string, class_type string, alcohol_content string, net_contents string")
    batch.ensure_checkable(full, full)
    for rows, texts in ((full.drop("brand_name"), full), (full.limit(0), full), (full, full.limit(0))):
        with pytest.raises(ValueError):
            batch.ensure_checkable(rows, texts)


def test_names_in_sql(spark):
    from proofmark.functions import registry

    registry.register(spark)
    r = spark.sql("select match_score('OLD TOM DISTILLERY', 'OLD TOWN DISTILLERY') as m, round(indel_ratio('abc', 'abd'), 3) as i, sequence_ratio('ab', 'ab') as s").first()
    assert tuple(r) == (82, 66.667, 1.0)
