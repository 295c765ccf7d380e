"""Values typed freely mapped to a reference list, the ones without an entry reported.

Symmetric delete: every spelling of every entry is indexed under all strings left when up to
two of its letters are deleted; a value is looked up under its own deletions, so all entries
within the edit bound are met without comparing with the list. What is met is ranked by a
weighted Damerau-Levenshtein distance and, on ties, by how often the entry itself is used.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.runtime import fits, spread

#: The index is broadcast; an entry of n letters has about n^2/2 deletions. Longer lists are refused.
MAX_ENTRIES = 20_000
MAX_EDITS = 2

# Other names of countries (endonyms, formal and short names, codes).
COUNTRY_NAMES: dict[str, str] = {
    "argentina": "republica argentina;arg", "australia": "commonwealth of australia;aus", "austria": "oesterreich;osterreich;autriche;aut", "barbados": "brb",
    "belgium": "belgique;belgie;belgien;bel", "bolivia": "estado plurinacional de bolivia;bol", "brazil": "brasil;bra", "bulgaria": "balgariya;bgr", "canada": "canadian;can",
    "chile": "republica de chile;chl", "china": "peoples republic of china;prc;zhongguo;chn", "colombia": "republica de colombia;col", "croatia": "hrvatska;hrv", "cuba": "republica de cuba;cub",
    "cyprus": "kypros;kibris;cyp", "czech republic": "czechia;cesko;ceska republika;cze", "denmark": "danmark;dnk", "dominican republic": "republica dominicana;dominican rep;dom rep;dom", "ecuador": "republica del ecuador;ecu",
    "estonia": "eesti;est", "finland": "suomi;fin", "france": "republique francaise;french republic;francia;frankreich;fra", "georgia": "sakartvelo;geo", "germany": "deutschland;allemagne;alemania;federal republic of germany;deu",
    "greece": "hellas;ellada;hellenic republic;grc", "guatemala": "gtm", "guyana": "co operative republic of guyana;guy", "hungary": "magyarorszag;hun", "iceland": "island;isl", "india": "bharat;ind",
    "ireland": "eire;republic of ireland;rep of ireland;irl", "israel": "yisrael;isr", "italy": "italia;italie;italien;ita", "jamaica": "jam", "japan": "nippon;nihon;jpn", "latvia": "latvija;lva", "lebanon": "liban;lubnan;lbn",
    "lithuania": "lietuva;ltu", "mexico": "estados unidos mexicanos;mejico;mex", "moldova": "republic of moldova;mda", "morocco": "maroc;al maghrib;mar", "nepal": "npl", "netherlands": "holland;nederland;the netherlands;pays bas;nld",
    "new zealand": "aotearoa;nz;nzl", "nicaragua": "nic", "norway": "norge;noreg;nor", "panama": "pan", "peru": "republica del peru;per", "philippines": "pilipinas;the philippines;phl", "poland": "polska;pol",
    "portugal": "portuguese republic;republica portuguesa;prt", "romania": "rou", "serbia": "srbija;srb", "slovakia": "slovensko;slovak republic;svk", "slovenia": "slovenija;svn", "south africa": "rsa;s africa;republic of south africa;suid afrika;zaf",
    "south korea": "korea south;republic of korea;rok;s korea;hanguk;kor", "spain": "espana;kingdom of spain;espagne;spanien;esp", "sweden": "sverige;swe", "switzerland": "schweiz;suisse;svizzera;swiss;che;ch", "taiwan": "chinese taipei;roc;twn", "thailand": "siam;prathet thai;tha",
    "trinidad and tobago": "trinidad tobago;trinidad;t and t;tto", "turkey": "turkiye;tur", "ukraine": "ukraina;ukr", "united kingdom": "uk;u k;great britain;england;scotland;wales;england uk;scotland uk;wales uk;gbr", "uruguay": "ury", "venezuela": "ven", "vietnam": "viet nam;vnm",
}
# Abbreviations whose letters are not a subsequence of the word, and other spellings.
WORD_FORMS = {"bbl": "barrel", "whiskey": "whisky", "cyder": "cider", "flavoured": "flavored", "liquor": "liqueur", "nat": "natural", "w": "with"}
# Phrases round a value that say nothing about which entry is meant.
AROUND = re.compile(
    r"^(?:product of|produce of|produced in|made in|imported from|bottled in|country|origin|class|type|premium|fine|the)\b[ :]*|[ :]*\b(?:bottled at source|origin|limited|limited edition|reserve|\d+ ?(?:yr|yrs|year|years)(?: old)?)$"
)


def plain(text: str) -> str:
    """Lower case, no accents, `&` as and, all else that isn't a letter or digit a blank."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O")).lower()
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("&", " and ").replace("'", "")
    return re.sub(r"[^a-z0-9]+", " ", text).strip()


def core(text: str) -> str:
    """plain() without the phrases round the value."""
    s = plain(text)
    while (t := AROUND.sub("", s).strip()) != s and t:
        s = t
    return s


def deletions(s: str, n: int) -> Iterable[str]:
    for k in range(n + 1):
        for drop in combinations(range(len(s)), k):
            yield "".join(c for i, c in enumerate(s) if i not in drop)


def bound(s: str) -> int:
    """Edits allowed for a spelling: none up to 3 letters, one up to 5, then two."""
    n = len(s.replace(" ", ""))
    return 0 if n <= 3 else 1 if n <= 5 else MAX_EDITS


# Keys next to each other, cheaper to mix up.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR = {frozenset((a, b)) for r in ROWS for a, b in zip(r, r[1:])}


def distance(a: str, b: str) -> tuple[int, float]:
    """Damerau-Levenshtein (adjacent transposition): number of edits and their weight. A doubled
    or dropped double letter, a transposition or a neighbouring key weighs less, the first letter more."""
    rows: list[list[tuple[int, float]]] = [[(j, j + 0.3 * (j > 0)) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, i + 0.3)]
        for j, y in enumerate(b, 1):
            first = 0.3 if i == 1 or j == 1 else 0.0
            del_w = (0.7 if i > 1 and a[i - 2] == x else 1.0) + first
            ins_w = (0.7 if j > 1 and b[j - 2] == y else 1.0) + first
            options = [(rows[i - 1][j][0] + 1, rows[i - 1][j][1] + del_w), (row[j - 1][0] + 1, row[j - 1][1] + ins_w)]
            if x == y:
                options.append(rows[i - 1][j - 1])
            else:
                options.append((rows[i - 1][j - 1][0] + 1, rows[i - 1][j - 1][1] + (0.8 if frozenset((x, y)) in NEAR else 1.0) + first))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                options.append((rows[i - 2][j - 2][0] + 1, rows[i - 2][j - 2][1] + 0.8))
            row.append(min(options))
        rows.append(row)
    return rows[-1][-1]


def abbreviates(short: str, word: str) -> bool:
    """A prefix of at least three letters, or a subsequence that starts alike and keeps no more
    vowels than it must (brdy, spklg, liqr)."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return len(short) >= 3
    it = iter(word)
    return len(short) >= 3 and len(short) <= len(word) - 2 + (sum(c in "aeiou" for c in short[1:]) == 0) and all(c in it for c in short)


class Index:
    """Spellings of all entries under their deletions."""

    def __init__(self, entries: list[tuple[int, str, float]], other_names: dict[str, str] | None = None, turned: bool = False):
        """entries: (id, name, use). turned: the words may come with the last ones first."""
        self.use = {i: u for i, _, u in entries}
        self.spellings: dict[str, set[int]] = defaultdict(set)
        self.words: set[str] = set()
        self.forms: list[tuple[int, list[str]]] = []
        for i, name, _ in entries:
            words = plain(name).split()
            self.words.update(words)
            for k in range(len(words) if turned else 1):
                w = words[k:] + words[:k]
                self.spellings[" ".join(w)].add(i)
                self.forms.append((i, w))
            for other in filter(None, (other_names or {}).get(plain(name), "").split(";")):
                self.spellings[other].add(i)
        self.under: dict[str, list[str]] = defaultdict(list)
        for s in self.spellings:
            for d in set(deletions(s.replace(" ", ""), bound(s))):
                self.under[d].append(s)
        #: Words of forms under their deletions and by first letter; forms under (words, place, word).
        self.word_under: dict[str, list[str]] = defaultdict(list)
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for f in sorted(self.words):
            for d in set(deletions(f, max(bound(f), 1 if len(f) == 3 else 0))):
                self.word_under[d].append(f)
            self.by_letter[f[0]].append(f)
        self.postings: dict[tuple[int, int, str], list[int]] = defaultdict(list)
        for place, (_, form) in enumerate(self.forms):
            for k, f in enumerate(form):
                self.postings[len(form), k, f].append(place)
        self.longest_word = max(map(len, self.words), default=0)
        self.word_memo: dict[str, dict[str, float]] = {}
        self.longest = max((len(s) for s in self.spellings), default=0) + MAX_EDITS
        self.memo: dict[str, tuple[int, float | None]] = {}

    def near(self, value: str) -> list[tuple[float, float, int]]:
        flat = value.replace(" ", "")
        best: dict[int, float] = {}
        if len(flat) > self.longest:  # longer than any spelling and its edits
            return []
        for s in {s for d in set(deletions(flat, bound(value) or (1 if len(flat) == 3 else 0))) for s in self.under.get(d, ())}:
            edits, weight = distance(flat, s.replace(" ", ""))
            if edits <= bound(s) and (bound(value) or edits <= 1):
                for i in self.spellings[s]:
                    best[i] = min(best.get(i, 99.0), weight)
        return sorted((w, -self.use.get(i, 0.0), i) for i, w in best.items())

    def word_costs(self, w: str) -> dict[str, float]:
        """The words of entries that w may stand for, with the weight of it: equal, abbreviated, or
        misspelt within the bound. They are met through deletions and first letters, not one by one."""
        if w in self.word_memo:
            return self.word_memo[w]
        out: dict[str, float] = {}
        met = {w, w + "s", w[:-1]} & self.words
        if len(w) <= self.longest_word + MAX_EDITS:
            met = met.union(*(self.word_under.get(d, ()) for d in set(deletions(w, MAX_EDITS))))
        for f in met:
            if w == f:
                out[f] = 0.0
            elif w == f + "s" or f == w + "s":
                out[f] = 0.3
            else:
                edits, weight = distance(w, f)
                if edits <= bound(f) or (len(f) == 3 and edits == 1):
                    out[f] = weight
        for f in self.by_letter.get(w[:1], ()):
            if f != w and abbreviates(w, f):
                out[f] = min(out.get(f, 9.0), 0.3)
        if len(self.word_memo) < 200_000:
            self.word_memo[w] = out
        return out

    def by_words(self, value: str) -> list[tuple[float, float, int]]:
        """Word against word: equal, abbreviated, or misspelt within the bound. Forms are taken from
        the postings of the word that has the fewest and tried against the other words."""
        words = [WORD_FORMS.get(w, w) for w in value.split()]
        costs = [self.word_costs(w) for w in words]
        if not all(costs):
            return []
        n = len(words)
        posted = [[self.postings.get((n, k, f), ()) for f in c] for k, c in enumerate(costs)]
        fewest = min(range(n), key=lambda k: sum(map(len, posted[k])))
        found: dict[int, float] = {}
        for at in posted[fewest]:
            for place in at:
                i, form = self.forms[place]
                if all(f in c for f, c in zip(form, costs)) and (total := sum(c[f] for f, c in zip(form, costs))) <= MAX_EDITS + 0.9:
                    found[i] = min(found.get(i, 99.0), total)
        return sorted((w, -self.use.get(i, 0.0), i) for i, w in found.items())

    def lookup(self, text: str) -> tuple[int, float | None]:
        """(id, weighted distance); id 0 where no entry is meant."""
        if text in self.memo:
            return self.memo[text]
        value = core(text)
        got = []
        if value:
            got = self.near(value)
            expanded = " ".join(WORD_FORMS.get(w, w) for w in value.split())
            if not got and expanded != value:
                got = self.near(expanded)
            if not got:
                got = self.by_words(value)
        out = (got[0][2], got[0][0]) if got else (0, None)
        if len(self.memo) < 200_000:
            self.memo[text] = out
        return out


def build_index(reference: DataFrame, id_col: str, name_col: str, rows: DataFrame, value_col: str, **kw: object) -> Index:
    """Index over a reference list, whose size is checked, with the use of each entry counted
    over all rows (values that are letter for letter an entry)."""
    entries = reference.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.min(id_col).alias("id"))
    if not fits(entries, MAX_ENTRIES):
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    used = entries.join(rows.groupBy(F.col(value_col).alias("name")).agg(F.count("*").alias("n")), "name", "left")
    return Index([(r["id"], r["name"], float(r["n"] or 0)) for r in used.collect()], **kw)


def mapped(rows: DataFrame, value_col: str, index: Index) -> DataFrame:
    """rows with `ref_id` (0: no entry meant; null for a null value) and `ref_distance`.
    Every row is mapped where it stands, so a frequent value skews nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("ref_id int, ref_distance double")
    def look(values: pd.Series) -> pd.DataFrame:
        index = shared.value
        return pd.DataFrame([index.lookup(v) if isinstance(v, str) else (None, None) for v in values], columns=["ref_id", "ref_distance"]).astype({"ref_id": "Int32", "ref_distance": "Float64"})

    return rows.withColumn("_got", look(value_col)).withColumns({"ref_id": F.col("_got.ref_id"), "ref_distance": F.col("_got.ref_distance")}).drop("_got")


def free_entries(rows: DataFrame, field: str, reference: DataFrame, id_col: str, name_col: str, **kw: object) -> DataFrame:
    """(row_id, field, value, ref_id, ref_distance) of the non-null values that aren't letter for
    letter an entry; ref_id 0 reports that none is meant. Repeated rows stay repeated."""
    index = build_index(reference, id_col, name_col, rows, field, **kw)
    exact = reference.select(F.col(name_col).alias(field)).distinct()  # MAX_ENTRIES at most, as checked
    typed = spread(rows.select("row_id", field)).where(F.col(field).isNotNull()).join(F.broadcast(exact), field, "left_anti")
    return mapped(typed.select("row_id", F.lit(field).alias("field"), F.col(field).alias("value")), "value", index)
