import pytest

from proofmark.llm import addresses as a
from proofmark.llm.address_parts import parse


@pytest.mark.parametrize(
    "text,number,direction,street,kind,town,state,zip_",
    [
        ("HARROWGATE PELL IMPORTS, 20011 WEST ORCHARDVIEW HIGHWAY, MOUNT JASPERPORT, OR 31790", "20011", "WEST", "ORCHARDVIEW", "HIGHWAY", "MOUNT JASPERPORT", "OR", "31790"),
        ("Harrowgate Pell Imports 20011 Orchardview Hwy W Mt. Jasperport Oregon 31790, United States", "20011", "WEST", "ORCHARDVIEW", "HIGHWAY", "MOUNT JASPERPORT", "OR", "31790"),
        ("Brewed by X Cellars\nInverhaven\nGA 15213\n8766 Bellwether Ct", "8766", None, "BELLWETHER", "COURT", "INVERHAVEN", "GA", "15213"),
        ("Candle Co 4462 Glassworks Lane, Ste 5, Fort Zeph Springs, CO", "4462", None, "GLASSWORKS", "LANE", "FORT ZEPH SPRINGS", "CO", None),
        ("Orchardview Hwy. 6083\nJasperfield\nOR 27680-1234", "6083", None, "ORCHARDVIEW", "HIGHWAY", "JASPERFIELD", "OR", "27680"),
        ("17267 packhorse street,garrowmouth,39599", "17267", None, "PACKHORSE", "STREET", "GARROWMOUTH", None, "39599"),
        ("No. 1398 E. Knollwood Rd., #5, Inverton, GA, U.S.A.", "1398", "EAST", "KNOLLWOOD", "ROAD", "INVERTON", "GA", None),
        ("876 Kingfisher Jasperwick OR Distilled and bottled by Linden Path Brewing Co", "876", None, "KINGFISHER", None, "JASPERWICK", "OR", None),
        ("Holmes Cellars, 221B Baker Street, Inverton, GA", "221B", None, "BAKER", "STREET", "INVERTON", "GA", None),
        ("", None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        ("no address at all", None, None, None, None, None, None, None),
    ],
)
def test_parts(text, number, direction, street, kind, town, state, zip_):
    p = parse(text)
    got = (p["number"], p["direction"], p["street"], p["kind"], p["town"], p["state"], p["zip"])
    assert got[:4] == (number, direction, street, kind) and got[5:] == (state, zip_)
    if number:
        assert p["town"] == town


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 0, "z") for i, t in texts], "address_id long, name_address string, number int, town string")


def corpus():
    """Enough plain records that slips stand out."""
    made = [a + b for a in ("ALDER", "BRINE", "COPPER", "DROVE", "EMBER", "FALCON", "GARNET", "HARROW") for b in ("GATE", "MILL", "ROW", "SIDE", "WALK")]
    streets, towns = ["ORCHARDVIEW", "PACKHORSE", "LIMEKILN", "TOLLHOUSE", "WEAVERS", *made], [("INVERTON", "GA", "11103"), ("TARBOWICK", "CO", "45490"), ("MOUNT QUIMTON", "VT", "12199")]
    n = 1000
    out = []
    for k in range(450):
        s, (t, st, z) = streets[k % 45], towns[k % 3]
        out.append((n + k, f"Some Firm Cellars, {100 + k} {s.title()} Street, {t.title()}, {st} {z}"))
    return out


def test_same_premises(spark):
    own = [
        (1, "Velvet Mill Imports, 7777 Orchardview Street, Inverton, GA 11103"),
        (2, "BLENDED BY OTHER FIRM / 7777 ORCHARDVEIW ST. / SUITE 5 / INVERTON / GEORGIA"),
        (3, "7777 Orchardview, Inverton 11103"),
        (4, "Inverrton, GA 11103, Orchardview Street 7777"),
        (5, "7777 Orchardview Street, Inverton, CO 99999"),  # same town name, another state
        (6, "7778 Orchardview Street, Inverton, GA 11103"),  # next door
        (7, "17777 Orchardview Street, Inverton, GA 11103"),
        (8, None),
        (9, ""),
        (None, "7777 Orchardview Street, Inverton, GA 11103"),
        (1, "Velvet Mill Imports, 7777 Orchardview Street, Inverton, GA 11103"),
    ]
    got = {tuple(r) for r in a.same_premises(rows(spark, own + corpus())).collect() if r["address_id_1"] < 1000}
    assert got == {(x, y) for x in (1, 2, 3, 4) for y in (1, 2, 3, 4) if x < y}
    _, rewrites = a.normalised_parts(rows(spark, own + corpus()))
    assert ("street", "ORCHARDVEIW", "ORCHARDVIEW") in {tuple(r)[:3] for r in rewrites.collect()}


def test_empty_and_class_ids(spark):
    assert a.same_premises(rows(spark, [(1, "x")]).limit(0)).count() == 0
    got = a.premises(rows(spark, corpus()[:4] + [(5000, corpus()[0][1])])).collect()
    assert {r["address_id"]: r["premises_id"] for r in got}[5000] == 1000


def test_long_text():
    assert parse("word " * 50_000)["number"] is None
    assert parse("1 " * 20_000)["number"] == "1"


def test_two_streets_under_one_number(spark, monkeypatch):
    """The rarer street of a number and ZIP code keeps its own spellings."""
    own = []
    for k in range(6):  # both streets have these numbers; TLHS is read like neither but abbreviates one
        own += [(10 * k + i, f"{100 + 3 * k} {s} Street, Inverton, GA 11103") for i, s in enumerate(["Tollhouse", "Tlhs", "Weavers"])]
    want = {(10 * k, 10 * k + 1) for k in range(6)}
    for few in (a.FEW, 1):
        monkeypatch.setattr(a, "FEW", few)
        got = {tuple(r) for r in a.same_premises(rows(spark, own + corpus())).collect() if r["address_id_2"] < 1000}
        assert got == want


def test_blocks_of_alike_spellings():
    for x, y in [("TLHS", "TOLLHOUSE"), ("MT ORCH", "MOUNT ORCHARDVIEW"), ("ORCHRDVEIW", "ORCHARDVIEW"), ("IVES", "SAINT IVES"), ("OAKS", "OAK"), ("A" * 30 + "BCDEFGHIJKLMNOP" * 3, "B" + "A" * 29 + "BCDEFGHIJKLMNOP" * 2 + "BCDEFGHIJKLMNOPQ")]:
        assert not a._alike(x, y) or a.blocks(x) & a.blocks(y)


def test_rounds_go_on_until_nothing_is_new(spark, monkeypatch):
    words = [f"W{k}" for k in range(14)]
    found = iter([*zip(words, words[1:]), None])

    def mined(parts, totals):
        x = next(found)
        return spark.createDataFrame([("town", *x)] if x else [], "part string, old string, new string")

    monkeypatch.setattr(a, "mine", mined)
    monkeypatch.setattr(a, "by_slips", lambda parts, slips: spark.createDataFrame([], "part string, old string, new string"))
    parts, log = a.normalised_parts(rows(spark, [(1, "1 Oak Street, W0, GA 11103"), (2, "2 Oak Street, W0, GA 11103")]))
    assert log.count() == 13


def pairs(spark, own):
    return {tuple(r) for r in a.same_premises(rows(spark, own + corpus())).collect() if r["address_id_1"] < 1000}


def test_kinds_of_street_and_directions_tell_apart(spark):
    at = "Inverton, GA 11103"
    kinds = [(1, f"12 Oak St, {at}"), (2, f"12 Oak Ave, {at}"), (3, f"12 Oak Avenue, {at}"), (4, f"12 Oak, {at}"), (5, f"14 Oak Ave, {at}"), (6, f"14 Oak, {at}")]
    assert pairs(spark, kinds) == {(2, 3), (5, 6)}
    sides = [(1, f"12 N Elm St, {at}"), (2, f"12 North Elm St, {at}"), (3, f"12 S Elm St, {at}"), (4, f"12 Elm St, {at}"), (5, f"14 S Elm St, {at}"), (6, f"14 Elm St, {at}")]
    assert pairs(spark, sides) == {(1, 2), (5, 6)}
    letters = [(1, f"221B Baker Street, {at}"), (2, f"221B Baker St, {at}"), (3, f"221 Baker St, {at}")]
    assert pairs(spark, letters) == {(1, 2)}


def test_st_before_a_saint_is_no_kind(spark):
    own = [(1, "12 Potters Drive, Saint Ives, GA 11199"), (2, "12 Potters St Ives GA 11199"), (3, "12 Potters Dr., St. Ives, GA")]
    assert pairs(spark, own) == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("old,new,kind", [("OAKK", "OAK", "doubled"), ("OK", "OAK", "dropped"), ("OKA", "OAK", "swapped"), ("OIK", "OAK", "changed"), ("OAXK", "OAK", "added"), ("OAXKY", "OAK", "two"), ("OAK", "OAK", "none"), ("ELM", "OAK", "none")])
def test_slips(old, new, kind):
    assert a.slip_of(old, new) == kind


def test_only_mined_kinds_of_slip_are_used(spark):
    own = rows(spark, [(1, "9000 Orchardveiw Street, Inverton, GA")] + corpus())
    parts = a.read_parts(a.address_records(own))
    assert [tuple(r) for r in a.by_slips(parts, ["swapped"]).collect()] == [("street", "ORCHARDVEIW", "ORCHARDVIEW")]
    assert a.by_slips(parts, ["changed", "doubled"]).count() == 0 and a.mined_slips([]) == []
