import pytest

from proofmark.llm import quality as q

PROSE = "The shipment was quiet and the kettle was strong, as the ledger shows. At the request of the grower, the inspector improves a careful blend since the mill was rebuilt. Please note that the peppery artwork names the typeface over the course of the winter."


def kind(t):
    return q.kind_by_rules(q.shape(t))


@pytest.mark.parametrize(
    "text,want",
    [
        (PROSE, None),
        (PROSE.upper(), None),
        (PROSE.replace(". ", ".\n"), None),
        ("\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), None),
        ("La botella que recibimos por orden del inspector era suave y la uva también. Se guardó una viña dulce junto a la bodega.", None),
        ("Wir glauben, dass die Rebe besser als die süße Rebe ist. Sobald die Tonne offen ist, wirkt die Ernte anders.", None),
        (PROSE + "\n- one\n- two\n- three", None),
        (PROSE + "\n[%%[{$}!}@\\\\#", None),
        ("Contents\n" + "\n".join(f"({i}) {w}" for i, w in enumerate("quiet mash,iron merchant,soft cooper,pale label,barrel,rich sleeve,oily tank".split(","))), "list"),
        ("\n".join(f"- {w}" for w in "tank,modest label,crisp mash,invoice 12,Heron cask,soft yeast".split(",")), "list"),
        ("cooper, crisp; soft cooper; distiller; invoice; stopper 66; emblem 42; typeface, modest; pallet; dry label", "list"),
        ("quiet vineyard\nrecipe\npale proof-sheet\nLantern merchant\nunusual typeface\nblend\namber vineyard", "list"),
        ("a,b,c\n1,2,3\n4,5,6\n7,8,9", "table"),
        ("| vol | fill |\n|---|---|\n| 34.5% | 3000 ML |\n| 13.0% | 750 ML |", "table"),
        ("abv    fill     item\n32.0%  100 ML   mash\n39.5%  50 ML    copper", "table"),
        ("no\tref\tvol\n9692\t6158\t28.0%\n8493\t2494\t42.0%", "table"),
        ("39 92 43 cb 2e 8e 19 95\nee c0 76 0f d8 70 ae ea", "junk"),
        ("3xn1Yk78+5SZhhjLzEbhH6JCFE4m1SOenXa3MU2BFUYDCzlFwm44mKOCZmBw4Tz", "junk"),
        ("none\n" * 30, "junk"),
        ("click to enlarge " * 40, "junk"),
        ("l6#67%4\\!8 *~6%8187]5@{43l\n=~}\\%=l99{{08|^+~ #", "junk"),
        ("rege  erhaI ehlrs dimfrershthe A atnp B,sreeh  n riuisa cr s o mncigueatrag ohyo eh5gfuwna cx dn,ruhlhmsuylhbsipt .menfanbm", "junk"),
        ("", None),
        ("   \n ", None),
        ("word", None),
    ],
)
def test_kinds(text, want):
    assert kind(text) == want


def test_figures():
    s = q.shape("a b a b a b a b\n\na b a b a b a b")
    assert s["dup_line_share"] == 0.5 and s["dup_paragraph_share"] == 0.5 and s["dominant_share"] == 1.0
    assert q.dominant([]) == 0.0 and q.dominant("the of the of the of the".split()) > 0


def test_rows(spark):
    df = spark.createDataFrame([(1, PROSE, 0), (2, None, 0), (3, "", 0), (4, "none\n" * 50, 0), (4, "none\n" * 50, 0), (5, "x " * 100_000, 0)], "doc_id long, text string, kind int")
    got = {r["doc_id"]: r for r in q.text_statistics(df).collect()}
    assert got[2]["n_words"] is None and got[2]["kind"] is None and got[3]["n_words"] == 0 and got[3]["mean_word_length"] == 0.0
    assert got[1]["kind"] is None and got[1]["n_words"] == 45 and got[1]["punctuated_line_share"] == 1.0
    assert sorted(map(tuple, q.not_prose(df).collect())) == [(4, "junk"), (4, "junk"), (5, "junk")]
    assert q.text_statistics(df.limit(0)).count() == 0


def test_dominant_is_exact():
    long = "The quiet inspector of the mill improves a careful blend for the winter. "
    assert kind(long * 20) == "junk" and q.dominant(q.WORD.findall(long.lower()) * 20) == 1.0
    assert q.dominant("a b c d e f g h".split() * 2) == 0.0  # twice is no repetition
    often = "ab cd ef gh".split() * 4 + "extraordinarily".split() * 3
    assert q.dominant(often) == max(45 / 77, 32 / 77)
