import random
import time

import pytest

from proofmark.llm import canonical as c

COUNTRIES = ["Guyana", "Mexico", "Peru", "Cuba", "United Kingdom", "Trinidad and Tobago", "Austria", "Australia", "Netherlands", "New Zealand"]
CLASSES = ["POMACE BRANDY", "SPARKLING ROSE WINE", "SPARKLING WINE", "CANE RUM", "WHISKY WITH NATURAL FLAVORS", "WHITE TABLE WINE"]


@pytest.fixture(scope="module")
def countries():
    return c.Index([(i, n, float(i)) for i, n in enumerate(COUNTRIES, 1)], c.COUNTRY_NAMES)


@pytest.fixture(scope="module")
def classes():
    return c.Index([(i, n, 0.0) for i, n in enumerate(CLASSES, 1)], turned=True)


@pytest.mark.parametrize("v,want", [("GUYANA - bottled at source", 1), ("Product of gyuana", 1), ("MEX", 2), ("México", 2), ("Estados Unidos Mexicanos", 2), ("Peu", 3), ("Cba", 4), ("UK", 5), ("Trinidad/Tobago", 6), ("Holland", 9), ("NZ", 10), ("EU", 0), ("XX", 0), ("", 0), ("  ", 0), ("Caribbean blend", 0), ("see back label", 0), ("x" * 50_000, 0), ("Austtralia", 8), ("Austia", 7)])
def test_countries(countries, v, want):
    assert countries.lookup(v)[0] == want


@pytest.mark.parametrize("v,want", [("BRANDY, POMACE", 1), ("brdy, pomace", 1), ("POMACE BRNDY", 1), ("wine, spklg rose", 2), ("Sparkling  Wine (limited)", 3), ("class: cane rum", 4), ("CANE-RUM", 4), ("Whiskey With Nat. Flavors", 5), ("White Tbl Wine", 6), ("Sparkling water", 0), ("vinegar", 0), ("GIFT SET", 0)])
def test_classes(classes, v, want):
    assert classes.lookup(v)[0] == want


def test_near_against_all_entries(countries):
    """Symmetric deletion meets all that comparing with every spelling meets."""
    rnd = random.Random(7)
    for _ in range(300):
        s = list(c.plain(rnd.choice(COUNTRIES)).replace(" ", ""))
        for _ in range(rnd.randint(1, 2)):
            k = rnd.randrange(len(s))
            op = rnd.randrange(3)
            s[k : k + 1] = [] if op == 0 else [rnd.choice("abcxyz")] if op == 1 else [s[k], rnd.choice("abcxyz")]
        v = "".join(s)
        want = {i for sp, ids in countries.spellings.items() if (d := c.distance(v, sp.replace(" ", ""))[0]) <= c.bound(sp) and (c.bound(v) or (d <= 1 and len(v) == 3)) for i in ids}
        assert {i for _, _, i in countries.near(v)} == want, v


def test_distance():
    assert c.distance("abc", "abc") == (0, 0.0) and c.distance("abcd", "abdc")[0] == 1 and c.distance("", "ab")[0] == 2
    assert c.distance("ann", "an")[1] < c.distance("anx", "an")[1]
    assert c.distance("xan", "an")[1] > c.distance("anx", "an")[1]


def test_ties_go_to_the_entry_in_use():
    ix = c.Index([(1, "ABCDEFX", 1.0), (2, "ABCDEFM", 9.0)])
    assert ix.lookup("ABCDEFQ")[0] == 2


def test_rows(spark):
    rows = spark.createDataFrame([(1, "Peru", "a"), (2, "peru", "a"), (2, "peru", "a"), (3, None, "a"), (4, "nowhere", "a"), (5, "", "a")], "row_id long, country string, value string")
    ref = spark.createDataFrame([(i, n, "x") for i, n in enumerate(COUNTRIES, 1)] + [(99, None, "x")], "country_id int, country_name string, n string")
    got = sorted((r["row_id"], r["ref_id"]) for r in c.free_entries(rows, "country", ref, "country_id", "country_name").collect())
    assert got == [(2, 3), (2, 3), (4, 0), (5, 0)]
    assert {r["ref_id"] for r in c.free_entries(rows, "country", ref.limit(0), "country_id", "country_name").collect()} == {0}
    assert c.free_entries(rows.limit(0), "country", ref, "country_id", "country_name").count() == 0


def test_by_words_against_all_forms():
    """The postings meet all forms that comparing word by word with every one meets."""
    rnd = random.Random(11)
    vocabulary = ["sparkling", "rose", "wine", "red", "dry", "brandy", "pomace", "cane", "rum", "natural", "gin", "liqueur"]
    names = sorted({" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 3))) for _ in range(60)})
    ix = c.Index([(i, n, 0.0) for i, n in enumerate(names, 1)], turned=True)

    def cost(w, f):
        if w == f:
            return 0.0
        edits, weight = c.distance(w, f)
        near = edits <= c.bound(f) or (len(f) == 3 and edits == 1)
        return 0.3 if w == f + "s" or f == w + "s" or c.abbreviates(w, f) else weight if near else None

    for _ in range(400):
        words = rnd.choice(names).split()
        for k, w in enumerate(words):
            op, j = rnd.randrange(5), rnd.randrange(len(w))
            words[k] = [w, w[:3], w[:j] + w[j + 1 :], w + "s", w[:j] + "x" + w[j:]][op]
        want: dict[int, float] = {}
        for i, form in ix.forms:
            costs = [cost(c.WORD_FORMS.get(w, w), f) for w, f in zip(words, form)]
            if len(form) == len(words) and None not in costs and sum(costs) <= c.MAX_EDITS + 0.9:
                want[i] = min(want.get(i, 99.0), sum(costs))
        assert {i: pytest.approx(w) for w, _, i in ix.by_words(" ".join(words))} == want, words


def test_a_miss_costs_little_with_the_longest_list():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(3, 6)))
    ix = c.Index([(i, f"{word()} {word()}", 0.0) for i in range(c.MAX_ENTRIES)])
    values = [f"{word()} {word()}" for _ in range(50)]
    began = time.process_time()
    for v in values:
        ix.by_words(v)
    assert time.process_time() - began < 50 * 0.05
