import pytest
from pyspark.sql import functions as F

from proofmark.llm import scan_noise as s

BODY = "the quiet inspector improves a careful blend while the kettle rests and the printer settles every neckband in barrel-aged lots from a pot-still run your between copper shipment POMACE BRANDY WINE".split()


@pytest.fixture(scope="module")
def model():
    words, pairs = {}, {}
    for w in BODY:
        for part in [w, *w.split("-")]:
            words[part.lower()] = words.get(part.lower(), 0) + 500
    for x, y in zip(BODY, BODY[1:]):
        pairs[x.lower(), y.lower()] = 300
    return s.Model(words, pairs, 20_000)


def noise(model, text):
    return s.examine(model, text)[0]


@pytest.mark.parametrize("seen,meant", [("qu1et", "quiet"), ("frorn", "from"), ("POMAC3", "POMACE"), ("W1NE", "WINE"), ("bctwccn", "bctwccn"), ("inspcctor", "inspector"), ("neckbancl", "neckband"), ("Brenn", "Brenn"), ("K6", "K6"), ("vvhile", "while"), ("5hipment", "shipment"), ("b|end", "blend")])
def test_words(model, seen, meant):
    fixes, _ = s.read_line(model, f"the {seen} rests")
    assert s.apply(f"the {seen} rests", fixes) == f"the {meant} rests"


@pytest.mark.parametrize("line,n", [("l3% ALC/VOL", 1), ("10.S% ALC", 1), ("lO% ALC", 1), ("LOT K6-52", 0), ("NET CONTENTS 1 L", 0), ("0.75L", 0), ("4O84 Weavers Road", 1), ("Form LR-6 (rev. 8)", 0), ("No. 279", 0), ("750 ML", 0), ("80s", 0)])
def test_figures(line, n):
    assert len(s.odd_figure(line)) == n


def test_furniture():
    t = "Record 7 / label review\nBRAND\nAGED\n8\nYEARS\nthe quiet\npage 1\nRecord 7 / label review\ninspector improves\npage 2   Record 7 / label rev1ew\nmore\n3\n"
    heads, numbers = s.furniture(t.split("\n"))
    assert heads == {0, 7, 9} and numbers == {6, 9, 11}
    assert s.furniture([]) == (set(), set()) and s.furniture(["", " "]) == (set(), set())


@pytest.mark.parametrize("line,page", [("page 2", True), ("Pg 3", True), ("p. 1/3", True), ("1 | 3", True), ("[4]", True), ("- 4 -", True), ("Page 2 of 3", True), ("iv", True), ("BOTTLE 3 OF 980", False), ("No. 279", False), ("LOT K5-88", False), ("12 FL OZ", False), ("mix", False)])
def test_page_numbers(line, page):
    assert (s.page_part(line)[0] is not None) == page


def test_repeated_passage_is_no_header():
    body = ["GOVERNMENT WARNING: (1) x", "leave this drink", "mind your health."]
    heads, _ = s.furniture(["BRAND", *body, "other", *body])
    assert heads == set()


def test_hyphenation(model):
    got = noise(model, "the insp-\nector improves a care¬\nful blend from a pot-\nstill run in barrel-\naged lots")
    assert got == [(1, "hyphenation"), (2, "hyphenation")]
    text = s.examine(model, "the insp-\npage 1\nector improves")[1]
    assert text == "the inspector improves"
    assert noise(model, "the insp-\npage 1\nector improves") == [(1, "hyphenation"), (2, "page_number")]


def test_misread_in_a_divided_word(model):
    assert (2, "misread") in noise(model, "the insp-\ncctor improves") and (1, "misread") not in noise(model, "the insp-\necctor improves")


def test_preview(model):
    assert s.examine_preview(model, "the insp- ector 1mproves a care¬ ful blend")[0] == [(1, "hyphenation")] or s.examine_preview(model, "the insp- ector improves a care¬ ful blend")[0] == [(1, "hyphenation")]
    cut = ("the quiet inspector " * 20)[:247] + "insp"
    assert s.examine_preview(model, cut)[0] == []


def test_paragraphs(model):
    t = "BRAND\n750 ML\n\nthe quiet inspector improves a careful blend while\nthe kettle rests.\n\nyour copper shipment settles."
    assert s.examine(model, t)[1].split("\n") == ["BRAND", "750 ML", "the quiet inspector improves a careful blend while the kettle rests.", "your copper shipment settles."]


def test_viterbi_prefers_the_likelier_neighbour():
    m = s.Model({"the": 500, "bear": 100, "hear": 100, "sound": 100, "i": 300}, {("i", "hear"): 90, ("hear", "the"): 90, ("the", "bear"): 60}, 5000)
    m.options["hcar"] = [("hear", -5.0), ("bear", -5.0)]
    assert m.read(["i", "hcar", "the"])[1] == "hear" and m.read(["the", "hcar"])[1] == "bear"


def test_rows(spark):
    body = "The quiet inspector improves a careful blend.\nThe kettle rests while the printer settles."
    data = [(i, body, None, "x") for i in range(40)] + [(100, body.replace("quiet", "qu1et"), None, "x"), (100, body.replace("quiet", "qu1et"), None, "x"), (101, None, "the qu1et inspector", "x"), (102, None, None, "x"), (103, "", "preview", "x"), (104, "x" * 200_000 + "\n" + "1" * 100_000, None, "x")]
    df = spark.createDataFrame(data, "row_id long, detected_text string, ocr_text_preview string, noise string")
    got = sorted(tuple(r) for r in s.noisy_lines(df).collect() if r["row_id"] < 104)
    assert got == [(100, 1, "misread"), (100, 1, "misread"), (101, 1, "misread")]
    fixed = {r["row_id"]: r["repaired_text"] for r in s.repaired(df).collect()}
    assert fixed[100] == fixed[1] and fixed[103] == "" and 102 not in fixed
    assert s.noisy_lines(df.limit(0)).count() == 0


def test_a_rare_word_is_meant_by_a_misread(spark, monkeypatch):
    m = s.Model({"quiet": 500}, {}, 20_000, {"hoxlefield": 3})
    assert m.candidates("h0xlefield")[0][0] == "hoxlefield" and m.candidates("hoxlefleld") == [("hoxlefleld", 0.0)]
    assert s.Model({"hoxlefield": 11}, {}, 20_000).read(["hoxlefleld"]) == ["hoxlefield"]
    # below the known share, sent to the readers or joined: the same rows
    monkeypatch.setattr(s, "KNOWN_SHARE", 0.05)
    data = [(i, "quiet quiet", None) for i in range(300)] + [(1000 + i, "Hoxlefield", None) for i in range(12)] + [(2000, "quiet\nH0XLEFIELD", None), (None, "hoxlefleld", None), (2001, None, "h0xlefield"), (2002, "hoxle-\nfie1d", None)]
    df = spark.createDataFrame(data, "row_id long, detected_text string, ocr_text_preview string")
    want = [(None, 1, "misread"), (2000, 2, "misread"), (2001, 1, "misread"), (2002, 1, "hyphenation"), (2002, 2, "misread")]
    for few in (s.RARE_ROWS, 0):
        monkeypatch.setattr(s, "RARE_ROWS", few)
        assert sorted(map(tuple, s.noisy_lines(df).collect()), key=str) == sorted(want, key=str)


def test_rows_do_not_depend_on_order_or_partitions(spark, data):
    batch = spark.read.parquet(f"{data}/batch.parquet").select("row_id", "detected_text", "ocr_text_preview")
    want = None
    for df in (batch.coalesce(1), batch.repartition(3), batch.repartition(8), batch.orderBy(F.desc("row_id")), batch.orderBy(F.hash("row_id"))):
        got = sorted(map(tuple, s.noisy_lines(df).collect()))
        assert got == (want := want or got) and got


def test_lines_read_before_change_nothing():
    make = lambda: s.Model({"the": 900, "bat": 500, "hot": 600, "bot": 20, "hat": 30}, {("the", "bat"): 200, ("the", "hot"): 250, ("the", "bot"): 9}, 20_000, suspects=frozenset({"bot", "hat"}))
    lines = [["the", "bot"], ["the", "bat"], ["the", "hat"], ["the", "hot"]]
    forward, back = make(), make()
    assert [forward.read(x) for x in lines] == [back.read(x) for x in lines[::-1]][::-1]


def test_meanings_against_all_replacements():
    """The search through the vocabulary finds what trying every replacement finds."""
    import random

    rnd = random.Random(2)
    vocabulary = sorted({"".join(rnd.choice("rnmhiltecodb") for _ in range(rnd.randint(2, 6))) for _ in range(4000)})
    for _ in range(60):
        w = "".join(rnd.choice("rn1ltmce0b") for _ in range(rnd.randint(2, 6)))
        for k in (1, 2, 3):
            every = {v for v, _, _ in s.meanings(w, k, {})}
            assert {v for v, _, _ in s.meanings(w, k, {}, vocabulary)} == every & set(vocabulary)
    assert {v for v, _, _ in s.meanings("rn", 1, {})} == {"m", "rh", "ru"}


def test_confusions_are_counted(spark):
    body = "the quiet kettle rests"
    df = spark.createDataFrame([(body,)] * 200 + [("the qu1et kett1e rests",)] * 20, "text string")
    channel = s.learn(df)[0].channel
    assert channel["1", "i"] > channel["|", "i"] and channel["1", "l"] > channel["l", "i"]
