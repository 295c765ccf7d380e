import json

import pytest
from pyspark.sql import functions as F

from proofmark.operators import drift, records, units


# ------------------------------------------------------------------ loading


def parsed(spark, *raw):
    df = spark.createDataFrame(list(raw), "record_id long, source_file string, record_no int, raw_record string")
    return records.parse_records(df)


HEAD = "file_name,brand_name,warning_required"


@pytest.mark.parametrize(
    "rec,reason",
    [
        ('a.png,"x ""y"", z",true', None),
        ('a.png,"line\nbreak",', None),
        ('"a.PNG",b,Not Required', None),
        ('a.png,"open,true', "quoting"),
        ('a.png,"closed" x,true', "quoting"),
        ('a.png,b"are,true', "quoting"),
        ('a.png, "x",true', "quoting"),
        ('a.png,x"', "quoting"),
        ("a.png,x", "column_count"),
        ("a.png,x,true,y", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ("a.gif,x,true", "invalid_value"),
        (".png,x,true", "invalid_value"),
        ("  a.jpeg ,x, YES ", None),
        (",x,true", "invalid_value"),
        ("a.png,x,maybe", "invalid_value"),
        ('"",x,true', "invalid_value"),
        ('a.png,"""",', None),
        ('a.png,"x" "y",true', "quoting"),
        ("a.png,x\x01y\x01\x02,true", None),
        ('a.png,"\x01,\x01\x03",\x01', "invalid_value"),
    ],
)
def test_reasons(spark, rec, reason):
    df = parsed(spark, (1, "f", 0, HEAD), (2, "f", 1, rec))
    assert [r["reason"] for r in df.collect()] == [reason]


def test_control_characters_stay(spark):
    df = parsed(spark, (1, "f", 0, HEAD), (2, "f", 1, 'a.png,"\x01,\x01\x02\x01\x03",true'))
    assert records.load_valid(df).first()["brand_name"] == "\x01,\x01\x02\x01\x03".strip()


def test_against_a_scanner(spark):
    """Random records against a character by character reader."""
    import random

    def scan(rec):
        fields, i, n = [], 0, len(rec)
        while True:
            if i < n and rec[i] == '"':
                i, out = i + 1, ""
                while True:
                    if i >= n:
                        return None
                    if rec[i] == '"':
                        if rec[i + 1 : i + 2] == '"':
                            out, i = out + '"', i + 2
                            continue
                        i += 1
                        break
                    out, i = out + rec[i], i + 1
                if i < n and rec[i] != ",":
                    return None
            else:
                j = rec.find(",", i)
                j = n if j < 0 else j
                out, i = rec[i:j], j
                if '"' in out:
                    return None
            fields.append(out)
            if i >= n:
                return fields
            i += 1

    rnd = random.Random(4)
    recs = ["".join(rnd.choice('",,ab\n"') for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    df = parsed(spark, (0, "f", 0, "x,y"), *[(i + 1, "f", i + 1, r) for i, r in enumerate(recs)])
    for r in df.collect():
        want = scan(recs[r["record_id"] - 1])
        assert (r["reason"] == "quoting") == (want is None), repr(recs[r["record_id"] - 1])
        if want is not None:
            assert r["_values"] == want


def test_headers_delimiters_and_extra_columns(spark):
    df = parsed(spark, (0, "s", 0, "File-Name;Brand Name;WARNING REQUIRED"), (1, "s", 1, "a.png;x, y;no"), (2, "none", 1, "a.png,b"), (3, "s", 2, "a.png,x,no"))
    got = {r["record_id"]: r["reason"] for r in df.collect()}
    assert got == {1: None, 2: "no_header", 3: "column_count"}
    v = records.load_valid(df).first()
    assert (v["file_name"], v["brand_name"], v["class_type"], v["warning_required"]) == ("a.png", "x, y", None, False)
    odd = spark.createDataFrame([(0, "f", 0, "a", 9, "z"), (1, "f", 1, "x", 9, "z")], "record_id long, source_file string, record_no int, raw_record string, _names int, reason string")
    assert records.rejects(records.parse_records(odd)).count() == 0
    assert records.parse_records(odd.limit(0)).count() == 0


def test_long_record(spark):
    rec = 'a.png,"' + 'x""' * 100_000 + '",true'
    assert parsed(spark, (1, "f", 0, HEAD), (2, "f", 1, rec)).first()["reason"] is None


# ------------------------------------------------------------------ units


@pytest.mark.parametrize(
    "text,kind,default,value,unit",
    [
        ("90 proof", "strength", None, "0.45", "proof"),
        ("EIGHTY-SIX PROOF", "strength", None, "0.43", "proof"),
        ("one hundred proof", "strength", None, "0.5", "proof"),
        ("104 proof / 52% vol", "strength", None, "0.52", "percent"),
        ("140 ml of alcohol per litre", "strength", None, "0.14", "ml/l"),
        ("140 mL/L", "strength", None, "0.14", "ml/l"),
        ("0,385", "strength", "fraction", "0.385", "fraction"),
        ("0.100 by volume", "strength", None, "0.1", "fraction"),
        ("55‰ vol", "strength", None, "0.055", "per mille"),
        ("490", "strength", None, None, ""),
        ("see label", "strength", "proof", None, ""),
        ("1,750 ML", "contents", None, "1.75", "ml"),
        ("0,187 L", "contents", None, "0.187", "l"),
        ("half a litre", "contents", None, "0.5", "l"),
        ("HALF PINT", "contents", None, "0.236588", "pint"),
        ("1 PINT 0.9 FL OZ", "contents", None, "0.49979215", "pint+fl oz"),
        ("25.4 fl oz (750 ml)", "contents", None, "0.75", "ml"),
        ("per carton", "contents", "cl", None, ""),
        ("", "contents", "cl", None, ""),
        (None, "contents", "cl", None, ""),
        ("12 kg", "contents", "cl", None, ""),
    ],
)
def test_amounts(text, kind, default, value, unit):
    got = units.amount_of(text, kind, default)
    assert (None if got[0] is None else units.D(got[0])) == (None if value is None else units.D(value)) and got[1] == unit


def test_notes():
    assert units.note_units("Keyed by hand; contents are fl oz unless the row says otherwise; plain alcohol figures are US proof.") == {"strength": "proof", "contents": "fl oz"}
    assert units.note_units(None) == {"strength": None, "contents": None}
    assert units.note_units("strength is keyed as proof; the word itself is often left off; container sizes without a unit are litres.") == {"strength": "proof", "contents": "l"}


def test_converted_rows(spark):
    rows = spark.createDataFrame(
        [(1, 1, "90", "1.5 L", 0), (2, 2, "45", "25.4 oz", 0), (3, None, "45", None, 0), (4, 9, "90 proof", "75 cl", 0), (4, 9, "90 proof", "75 cl", 0)],
        "row_id long, source_id int, alcohol_content string, net_contents string, unit int",
    )
    notes = spark.createDataFrame([(1, "strength is keyed as proof"), (2, "plain alcohol figures are percent by volume; bare container sizes are millilitres."), (2, "plain alcohol figures are percent by volume; bare container sizes are millilitres.")], "source_id int, note string")
    got = sorted(map(tuple, units.amounts_in_other_units(rows, notes).collect()))
    assert got == [(1, "alcohol_content", 4500), (1, "net_contents", 1500), (2, "net_contents", 751), (4, "alcohol_content", 4500), (4, "alcohol_content", 4500), (4, "net_contents", 750), (4, "net_contents", 750)]
    assert units.standard_amounts(rows, notes).count() == 10 and units.amounts_in_other_units(rows.limit(0), notes.limit(0)).count() == 0


# ------------------------------------------------------------------ drift


def drifting(spark, files):
    return spark.createDataFrame([(*f, "x", None) for f in files], "file_id long, feed string, file_no int, file_format string, content string, name string, old_key string")


def changes(spark, files):
    return sorted((r["file_id"], r["change_kind"], r["field"]) for r in drift.drifted(drift.migrations(drifting(spark, files))).collect())


def csv_of(head, *rows):
    return "\n".join([",".join(head), *(",".join(r) for r in rows)])


def test_changes(spark):
    brands = [("OLD TOM", "750 ML"), ("BLUE HILL", "375 ML"), ("RED BARN", "1000 ML")]
    more = [("OLD HILL", "750 ML"), ("BLUE BARN", "200 ML"), ("RED TOM", "50 ML")]
    files = [
        (1, "f", 1, "csv", csv_of(["brand_name", "net_contents"], *brands)),
        (2, "f", 2, "csv", csv_of(["NET CONTENTS", "Marque"], *[(n, b) for b, n in more])),  # renamed, shuffled
        (3, "f", 4, "csv", csv_of(["Net-Contents", "marque", "vintage"], *[(str(i), b, "harvest of 2020") for i, (b, _) in enumerate(brands)])),  # after a gap: retyped, added
        (4, "f", 5, "csv", csv_of(["marque", "vintage"], *[(b, "harvest of 2021") for b, _ in more])),  # removed
        (9, "f", 5, "csv", csv_of(["marque"], ("a",))),  # second delivery
    ]
    assert changes(spark, files) == [(2, "renamed", "marque"), (3, "added", "vintage"), (3, "retyped", "net_contents"), (4, "removed", "net_contents")]


def test_second_best_names_are_renamed_too(spark):
    files = [(1, "f", 1, "csv", csv_of(["a", "b"], ("k l m n p q r u v", "k l m n p q r u w"))), (2, "f", 2, "csv", csv_of(["x", "y"], ("k l m n p q r u v", "k l m n p q r u z")))]
    assert changes(spark, files) == [(2, "renamed", "x"), (2, "renamed", "y")]


def test_json_wrappers_and_types(spark):
    a = {"applications": [{"brand-name": "A", "size": "1 L"}, {"brand-name": None, "size": "2 L"}]}
    b = [{"application": {"brandName": ["A", "B"], "size": 3}}, {"application": {"brandName": ["C"], "size": 4.5}}]
    files = [(1, "g", 1, "json", json.dumps(a)), (2, "g", 2, "json", json.dumps(b)), (3, "g", 3, "json", "{broken"), (4, "h", 1, "json", None), (5, None, 1, "json", "[]")]
    got = changes(spark, files)
    assert (2, "retyped", "brand_name") in got and (2, "retyped", "size") in got
    assert {k for f, k, _ in got if f == 3} <= {"removed"}
    assert changes(spark, files[:0]) == []


def test_kinds():
    assert drift.kind_of(["1", "2.5", ""], True) == "number" and drift.kind_of(["1", "x"], True) == "text"
    assert drift.kind_of(["true", "FALSE"], True) == "boolean" and drift.kind_of([None, " "], True) is None
    assert drift.kind_of([1, 2.5], False) == "number" and drift.kind_of(["1"], False) == "text" and drift.kind_of([True], False) == "boolean"
    assert drift.kind_of([{}], False) == "object" and drift.kind_of([[]], False) == "list"
    assert drift.field_name("BRAND-NAME") == drift.field_name("Brand Name") == drift.field_name("brandName") == "brand_name"


def routed(spark, files, links=()):
    """The routes of files by given renames (feed, file_no, old_key, key)."""
    versions = drift.file_versions(drift.read_files(drifting(spark, files)))
    fields = versions.select(F.explode("fields").alias("f")).select("f.key", "f.name")
    return drift.routed_fields(versions, *drift.routes(spark.createDataFrame(list(links), "feed string, file_no int, old_key string, key string"), fields))


def test_consistent_table(spark):
    files = [(1, "f", 1, "csv", "brand_name,x\nA,1\n,2"), (2, "f", 2, "json", '[{"Marque": "B", "y": {"z": 1}}]'), (3, "f", 2, "csv", "brand_name\nagain")]
    df = drift.consistent_table(drifting(spark, files), routed(spark, files, [("f", 2, "brandname", "marque")]))
    got = sorted((r["file_id"], r["record_no"], r["brand_name"], r["other_fields"]) for r in df.collect())
    assert got == [(1, 1, "A", {"x": "1"}), (1, 2, None, {"x": "2"}), (2, 1, "B", {"y": '{"z": 1}'})]


def test_table_by_feed_and_version(spark):
    links = [("f", 2, "brandname", "label"), ("f", 5, "x", "label"), ("g", 2, "classtype", "label"), ("h", 2, "brandname", "marque")]
    files = [
        (1, "f", 1, "csv", "brand_name,x\nA,1"),
        (2, "f", 2, "csv", "label,x\nB,2"),
        (3, "f", 5, "csv", "label\n3"),  # another field under the name
        (4, "g", 2, "csv", "label\nGIN"),  # another feed's meaning
        (5, "i", 1, "json", '[{"marque": ["M", "N"], "Brand Name": "L", "net_contents": 750.0, "alcohol_content": 45.5, "warning_required": false, "name_address": {"name": "P", "address": "Q"}}]'),
        (6, "j", 1, "csv", "label,marque\nZ,O"),
    ]
    to = routed(spark, files, links)
    got = {r["file_id"]: r for r in drift.consistent_table(drifting(spark, files), to).collect()}
    assert (got[1]["brand_name"], got[2]["brand_name"], got[3]["brand_name"], got[4]["brand_name"], got[6]["brand_name"]) == ("A", "B", None, None, "O")
    assert got[2]["other_fields"] == {"label": "2"} and got[3]["other_fields"] == {"label": "3"} and got[4]["class_type"] == "GIN" and got[6]["other_fields"] == {"label": "Z"}
    assert (got[5]["brand_name"], got[5]["other_fields"]) == ("L", {"brand_name.marque": "M, N"})
    assert (got[5]["net_contents"], got[5]["alcohol_content"], got[5]["warning_required"], got[5]["name_address"]) == ("750 ML", "45.5% ALC/VOL", "not required", "P, Q")
    steps = {(r["file_id"], r["step"], r["column"]) for r in drift.applied_steps(to).collect()}
    assert {(2, "rename", "brand_name"), (4, "rename", "class_type"), (5, "cast", "warning_required"), (5, "cast", "name_address"), (4, "default", "brand_name")} <= steps
    assert not any(s[:2] in ((1, "rename"), (1, "cast"), (5, "default")) and s[2] == "brand_name" for s in steps)


def test_unread_files_are_reported(spark):
    deep = "[" * 100_000
    files = [(1, "f", 1, "json", "{broken"), (2, "f", 2, "csv", "a\n1"), (3, "f", 3, "csv", ""), (4, None, 1, "csv", "a\n1"), (5, "f", 2, "csv", "b\n1"), (6, "f", 4, "json", deep), (7, "f", None, "csv", "a\n1"), (8, "f", 9, "csv", "a\n" + "x" * 200_000), (9, "f", 10, "csv", "a\n1")]
    m = drift.migrations(drifting(spark, files))
    got = {(r["file_id"], r["change_kind"]) for r in drift.schema_changes(m).collect()}
    assert got == {(1, "unreadable"), (3, "empty"), (4, "unordered"), (5, "repeated"), (6, "unreadable"), (7, "unordered"), (8, "retyped"), (9, "retyped")}
    table = drift.consistent_table(drifting(spark, files), routed(spark, files))
    assert sorted(r["file_id"] for r in table.select("file_id").collect()) == [2, 8, 9]


def test_same_schema_is_one_version(spark):
    files = [(k, "f", k, "csv", f"{'Brand Name' if k < 5 else 'brand-name'},x\nA,{k}") for k in range(1, 9)]
    v = drift.fingerprints(drift.file_versions(drift.read_files(drifting(spark, files))))
    assert sorted(r["file_id"] for r in v.where("new_version").collect()) == [1]


def test_order_of_a_long_feed_with_gaps(spark, monkeypatch):
    """Every file's predecessor, from ranges of any length, with gaps throughout."""
    import random

    rnd = random.Random(3)
    numbers = sorted(rnd.sample(range(1, 400), 150))
    read = spark.createDataFrame([(n, "f", n, None, [("a", f"v{n}", "text")], []) for n in numbers], drift.FILE_SCHEMA)
    want = dict(zip(numbers, [None, *numbers]))
    for width in (1000, 7, 1):
        monkeypatch.setattr(drift, "RANGE", width)
        assert {r["file_no"]: r["before_no"] for r in drift.file_versions(read).collect()} == want
