"""Recognised text of label regions: line repair, garbage filter, folding of regions, and the
recovery of structured values. All of it is column expressions on arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions import numbers, text
from proofmark.runtime import exploded, let, strip, tasks

# Spellings of ALC/VOL, captions that are no label text, and the heading of the block.
ALC_VOL = ["ALC/ VOL", "ALC /VOL", "ALC / VOL", "ALC./VOL.", "ALC./VOL", "ALC/VOL."]
CAPTIONS = ["BRANDLABEL", "BACKLABEL", "BRANDLABELBACKLABEL"]
RECOVERED = "Recovered structured field candidates:"
# Figures that make a line worth keeping, and the limits of the filter: letters of a short mark,
# of a word, of a word that suffices alone; length from which shares count; shares of signs, of
# different letters, of letters and digits.
USEFUL = [r"\b\d{1,5}\b", r"\b\d{1,3}(?:\.\d+)?\s*%", r"\b\d{1,4}(?:\.\d+)?\s*(ML|L)\b", r"\b\d{1,3}(?:\.\d+)?\s*PROOF\b", r"\(\s*\d+\s*\)", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"]
MARK, WORD, SUFFICES, LONG, SIGNS, VARIED, SOLID = (2, 5), 3, 4, 8, 0.18, 0.35, 0.32
WEIGHT = {"region": 3, "candidate": 2, "primary": 2}


def repaired_line(c: Column) -> Column:
    """One line with common recognition errors repaired. The rewrites and their order.
    Rewrites of certain words run only on lines that have these words."""
    has = lambda s, words: s.rlike(f"(?iU){words}")
    s = text.collapse(F.regexp_replace(strip(text.empty_if_null(c)), "^[\"`“”]+|[\"`“”]+$", ""))

    def first(s: Column) -> Column:
        alcohol = s
        for spelling in ALC_VOL:
            alcohol = F.replace(alcohol, F.lit(spelling), F.lit("ALC/VOL"))
        s = F.when(F.contains(s, F.lit("ALC")), alcohol).otherwise(s)
        s = F.when(has(c, "According"), F.regexp_replace(s, r"(?iU)\bAccording\s+to[.,]\s+the\b", "According to the")).otherwise(s)
        s = strip(F.regexp_replace(s, r"(?U)\s*\|+$", ""))
        s = strip(F.regexp_replace(s, r"(?U)^[|\\/\-–—_]+\s*", ""))
        return F.when(has(c, "FREDERICK"), F.regexp_replace(s, r"(?iU)\bFREDERICK,\s*MD\b", "FREDERICK, MD")).otherwise(s)

    def second(s: Column) -> Column:
        words = F.regexp_replace(s, r"(?iU)^\(?[3I|l]\)\s+According\b", "(1) According")
        words = F.regexp_replace(words, r"(?iU)\bbevorages\b", "beverages")
        words = F.regexp_replace(words, r"(?iU)\bmachinery\.\s+and\b", "machinery, and")
        rest = F.when(has(s, "According|bevorages|machinery"), words).otherwise(s)
        rest = strip(F.regexp_replace(F.regexp_replace(rest, r"(?U)\s+([,.;:])", "$1"), "[,.;]+$", ""))
        return F.when(s.rlike(r"(?iU)^GOVERNMENT\s+WARNING:?$"), "GOVERNMENT WARNING:").otherwise(rest)

    return let(let(s, first), second)


def upper_letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def distinct_share(letters: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(letters, F.lit("."), F.lit(0)))) / F.length(letters)


def useful_figures(c: Column) -> Column:
    up = numbers.bordered(c)
    out = up.rlike("(?U)" + USEFUL[0])
    for p in USEFUL[1:]:
        out = out | up.rlike("(?U)" + p)
    return out


def monotone(letters: Column) -> Column:
    """Four equal letters in a row, or hardly any different ones; of strings long enough to tell."""
    return letters.rlike(r"(.)\1{3,}") | ((F.length(letters) >= LONG) & (distinct_share(letters) < VARIED))


def line_figures(c: Column) -> Column:
    """What the filter looks at in a trimmed line, worked out once: length, capital letters, letters and digits,
    whether it has a digit and useful figures."""
    letters = upper_letters(c)
    solid = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.struct(F.length(c).alias("n"), letters.alias("letters"), F.length(letters).alias("n_letters"), solid.alias("solid"), c.rlike(r"\p{Nd}").alias("digit"), useful_figures(c).alias("useful"))


def readable(c: Column, f: Column) -> Column:
    """A mark in capitals, two words that can be read, or one of some length."""
    mark = f["n_letters"].between(*MARK) & (F.upper(c) == c) & c.rlike("^[A-Z0-9 .,%/:-]+$")
    words = F.filter(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]{2,}"), F.lit(0)), F.upper), lambda w: (F.length(w) >= WORD) & w.rlike("[AEIOU]") & ~monotone(w))
    return mark | let(words, lambda w: (F.size(w) >= 2) | ((F.size(w) == 1) & (F.length(F.get(w, F.lit(0))) >= SUFFICES)))


def garbage(c: Column) -> Column:
    """Whether a trimmed line is no text of the label: blank, a caption, barren of letters and digits,
    or decoration, that is a line without useful figures that is bare, full of signs, monotone or
    not readable."""

    def judge(f: Column) -> Column:
        bare = lambda most: (f["n_letters"] <= most) & ~f["digit"]
        barren = bare(1) | (f["solid"] == 0) | ((f["n"] > LONG) & (f["solid"] / f["n"] < SOLID))
        signs = (f["n"] >= LONG) & (f["solid"] < f["n"]) & (F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]+", "")) / f["n"] >= SIGNS)
        dull = (f["n_letters"] >= LONG) & monotone(f["letters"])
        return (f["n"] == 0) | f["letters"].isin(CAPTIONS) | barren | (~f["useful"] & (bare(2) | signs | dull | ~readable(c, f)))

    return let(line_figures(c), judge)


def clean_lines(c: Column) -> Column:
    """Repaired lines of a text without the garbage."""
    lines = F.transform(F.split(text.empty_if_null(c), text.LINE_BREAK), repaired_line)
    return F.filter(lines, lambda x: (x != "") & ~garbage(x))


def clean_text(c: Column) -> Column:
    return F.array_join(clean_lines(c), "\n")


def folded_regions(regions: Column) -> Column:
    """The text of a label from its regions (array of struct(title, lines), in order): lines that
    repeat or lie within an earlier one are dropped, each title heads its first section once,
    sections are parted by an empty line. A fold, since what is dropped depends on all before."""
    strings = F.array().cast("array<string>")
    start = F.struct(strings.alias("out"), strings.alias("keys"), strings.alias("titles"), F.lit(False).alias("has"))
    keyed = F.transform(
        regions,
        lambda r: F.struct(text.empty_if_null(r["title"]).alias("title"), F.transform(r["lines"], lambda x: F.struct(x.alias("line"), text.letters_key(x).alias("key"))).alias("lines")),
    )

    def line(a: Column, x: Column) -> Column:
        inside = F.exists(a["keys"], lambda e: (e == x["key"]) | ((F.length(x["key"]) >= 5) & F.contains(e, x["key"])))
        return F.when((x["key"] == "") | inside, a).otherwise(F.struct(F.concat(a["new"], F.array(x["line"])).alias("new"), F.concat(a["keys"], F.array(x["key"])).alias("keys")))

    def add(acc: Column, r: Column) -> Column:
        titled = r["title"] != ""
        fresh = titled & ~F.array_contains(acc["titles"], F.lower(r["title"]))
        gap = F.when(titled & (F.size(acc["out"]) > 0) & acc["has"], F.array(F.lit(""))).otherwise(strings)
        head = F.when(fresh, F.array(F.concat(r["title"], F.lit(":")))).otherwise(strings)

        def done(section: Column) -> Column:
            return F.when(F.size(section["new"]) == 0, acc).otherwise(
                F.struct(
                    F.concat(acc["out"], gap, head, section["new"]).alias("out"),
                    F.concat(section["keys"], F.transform(head, text.letters_key)).alias("keys"),
                    F.when(fresh, F.concat(acc["titles"], F.array(F.lower(r["title"])))).otherwise(acc["titles"]).alias("titles"),
                    (acc["has"] | titled).alias("has"),
                )
            )

        return let(F.aggregate(r["lines"], F.struct(strings.alias("new"), acc["keys"].alias("keys")), line), done)

    return strip(F.array_join(F.aggregate(keyed, start, add)["out"], "\n"))


def combine_regions(regions: DataFrame, key: str) -> DataFrame:
    """regions(key, region_ord, title, raw_text) -> (key, visible_text). A label has a handful of
    regions; they are cleaned before they are gathered. Regions of equal place go by title, text."""
    # Cleaning and folding are heavy beside the bytes: parted by label over enough tasks first.
    spread_out = regions.select(key, "region_ord", "title", "raw_text").repartition(tasks(regions.sparkSession), key)
    cleaned = spread_out.select(key, "region_ord", "title", clean_lines(F.col("raw_text")).alias("lines"))
    gathered = cleaned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("region_ord", "title", "lines"))).alias("r"))
    return gathered.select(key, folded_regions(F.filter("r", lambda x: F.size(x["lines"]) > 0)).alias("visible_text"))


def best_candidates(texts: DataFrame, key: str) -> DataFrame:
    """texts(key, region_ord, source, raw_text) -> per key and field the candidate of greatest vote
    (region 3, candidate and primary 2, others 1), the first seen on ties."""
    order = {"abv": 1, "proof": 2, "net_contents": 3}
    c = exploded(texts.select(key, "region_ord", "source", "raw_text"), numbers.field_candidates(F.col("raw_text"), F.col("source")), ["pos", "c"]).select(key, "region_ord", "pos", "c")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.col("c.source")], F.lit(1))
    votes = c.groupBy(key, F.col("c.field").alias("field"), F.round("c.value", 2).alias("value"), F.col("c.display").alias("display")).agg(
        F.sum(weight).alias("score"), F.min(F.struct("region_ord", "pos")).alias("first")
    )
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("field")]
    best = votes.groupBy(key, "field").agg(F.max_by(F.struct("value", "display", "score"), F.struct("score", -F.col("first.region_ord"), -F.col("first.pos"))).alias("b"))
    return best.select(key, rank.alias("field_no"), "field", "b.value", "b.display", "b.score")


def with_recovered(df: DataFrame, visible: str, candidates: str, into: str) -> DataFrame:
    """df with the column `into`: the visible text, cleaned again, and below it a block of recovered
    values it lacks. candidates: array of struct(field, display) in order. Alcohol values are left
    out where the text states alcohol already. What the candidates are compared with is computed
    once per row, in projections of its own."""
    keep = [F.col(c) for c in df.columns]
    df = df.select(*keep, clean_text(F.col(visible)).alias("_seen"))
    df = df.select(*keep, "_seen", numbers.states_alcohol(F.col("_seen")).alias("_known"), text.letters_key(F.col("_seen")).alias("_key"))

    def wanted(c: Column) -> Column:
        k = text.letters_key(c["display"])
        return ~(c["field"].isin("abv", "proof") & F.col("_known")) & ~((k != "") & F.contains(F.col("_key"), k))

    df = df.select(*keep, "_seen", F.array_distinct(F.transform(F.filter(candidates, wanted), lambda c: c["display"])).alias("_shown"))
    block = F.when(F.size("_shown") > 0, F.concat(F.lit(RECOVERED + "\n"), F.array_join("_shown", "\n")))
    return df.select(*keep, F.concat_ws("\n\n", F.nullif(F.col("_seen"), F.lit("")), block).alias(into))
