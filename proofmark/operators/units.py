"""Amounts in free text brought to canonical units.

A small grammar reads numbers (digits, decimal point or comma, thousands commas, number
words, halves and quarters) and unit expressions (units with `/`, `per`, `of ... per`).
A unit is a vector of exponents over the base dimensions (length, mass, time) with a scale
and an offset to the coherent unit; quotients subtract vectors. Strength is dimensionless
(shown in hundredths of a percent by volume), contents are cubic (shown in millilitres).
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.runtime import broadcast_if_small, spread

NONE, VOLUME, MASS = (0, 0, 0), (3, 0, 0), (0, 1, 0)
D = Decimal

# Unit -> (exponents of length, mass, time; scale to litre, gram or one; offset).
# US fluid measures as the task states them.
UNITS: dict[str, tuple[tuple[int, int, int], Decimal, Decimal]] = {
    "ml": (VOLUME, D("0.001"), D(0)),
    "cl": (VOLUME, D("0.01"), D(0)),
    "dl": (VOLUME, D("0.1"), D(0)),
    "l": (VOLUME, D(1), D(0)),
    "hl": (VOLUME, D(100), D(0)),
    "fl oz": (VOLUME, D("0.0295735"), D(0)),
    "pint": (VOLUME, D("0.473176"), D(0)),
    "quart": (VOLUME, D("0.946353"), D(0)),
    "gallon": (VOLUME, D("3.78541"), D(0)),
    "g": (MASS, D(1), D(0)),
    "kg": (MASS, D(1000), D(0)),
    "percent": (NONE, D("0.01"), D(0)),
    "per mille": (NONE, D("0.001"), D(0)),
    "proof": (NONE, D("0.005"), D(0)),
    "fraction": (NONE, D(1), D(0)),
}
# Spellings of units, longest match first.
SPELLINGS: dict[str, str] = {
    "millilitres": "ml", "millilitre": "ml", "milliliters": "ml", "milliliter": "ml", "mls": "ml", "ml": "ml",
    "centilitres": "cl", "centilitre": "cl", "centiliters": "cl", "centiliter": "cl", "cl": "cl",
    "decilitres": "dl", "decilitre": "dl", "deciliters": "dl", "deciliter": "dl", "dl": "dl",
    "hectolitres": "hl", "hectolitre": "hl", "hectoliters": "hl", "hl": "hl",
    "litres": "l", "litre": "l", "liters": "l", "liter": "l", "ltrs": "l", "ltr": "l", "lt": "l", "l": "l",
    "us fluid ounces": "fl oz", "us fluid ounce": "fl oz", "fluid ounces": "fl oz", "fluid ounce": "fl oz", "us fl oz": "fl oz",
    "fl. ozs.": "fl oz", "fl. oz.": "fl oz", "fl. oz": "fl oz", "fl oz.": "fl oz", "fl oz": "fl oz", "floz": "fl oz", "ounces": "fl oz", "ounce": "fl oz", "ozs": "fl oz", "oz.": "fl oz", "oz": "fl oz",
    "pints": "pint", "pint": "pint", "pts": "pint", "pt.": "pint", "pt": "pint",
    "quarts": "quart", "quart": "quart", "qts": "quart", "qt.": "quart", "qt": "quart",
    "gallons": "gallon", "gallon": "gallon", "gals": "gallon", "gal.": "gallon", "gal": "gallon",
    "kilograms": "kg", "kg": "kg", "grams": "g", "gram": "g", "g": "g",
    "per cent": "percent", "percent": "percent", "pct": "percent", "%": "percent",
    "per mille": "per mille", "per mil": "per mille", "permille": "per mille", "parts per thousand": "per mille", "‰": "per mille",
    "us proof": "proof", "proof": "proof",
    "fraction of volume": "fraction", "fraction": "fraction",
}
# Number words.
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
PARTS = {"half": D("0.5"), "quarter": D("0.25")}

UNIT = "|".join(re.escape(s) for s in sorted(SPELLINGS, key=len, reverse=True))
WORDS = "|".join([*SMALL, *TENS, "hundred", "half", "quarter"])
TOKEN = re.compile(rf"(?P<number>\d[\d.,]*\d|\d|(?<![\d])[.,]\d+)|(?P<unit>(?:{UNIT})(?![a-z]))|(?P<word>(?:{WORDS})(?![a-z]))|(?P<per>/|per(?![a-z]))|(?P<of>(?:of|a|an|and)(?![a-z]))|(?P<other>[a-z]+|\S)")
LITRES = {"fl oz", "l", "ml", "cl", "dl", "hl", "pint", "quart", "gallon"}
TARGET = {"strength": (NONE, {"percent"}), "contents": (VOLUME, {"ml"})}


def read_number(text: str) -> Decimal | None:
    """Digits with point or comma. A comma before exactly three digits groups thousands unless
    the part before it is 0 or the number has another kind of mark behind it."""
    if re.fullmatch(r"[1-9]\d{0,2}(,\d{3})+(\.\d+)?", text):
        return D(text.replace(",", ""))
    if re.fullmatch(r"[1-9]\d{0,2}(\.\d{3})+,\d+", text):
        return D(text.replace(".", "").replace(",", "."))
    if re.fullmatch(r"\d*[.,]?\d+", text):
        return D(text.replace(",", "."))
    return None


def read_words(words: list[str]) -> Decimal:
    total, part = D(0), D(0)
    for w in words:
        if w in SMALL:
            part += SMALL[w]
        elif w in TENS:
            part += TENS[w]
        elif w == "hundred":
            part = (part or D(1)) * 100
        else:
            part = (part or D(1)) * PARTS[w]
    return total + part


def tokens_of(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"\s+", " ", text.lower()).replace("°", " ")
    text = re.sub(r"(?<=[a-z])-(?=[a-z])|(?<=\d)-(?=[a-z])", " ", text)
    return [(m.lastgroup, m.group()) for m in TOKEN.finditer(text) if m.lastgroup]


@lru_cache(maxsize=65536)
def quantities(text: str) -> tuple[tuple[Decimal, tuple[int, int, int] | None, str], ...]:
    """All quantities a text states: (value in coherent units, exponents, unit name); the
    exponents are None where a number has no unit. `1 pint 0.9 fl oz` is one sum."""
    toks, out, i = tokens_of(text), [], 0
    leading = ""  # a unit before its number: `proof 90`, `fraction 0.45`
    while i < len(toks):
        kind, s = toks[i]
        if kind in ("number", "word"):
            if kind == "number":
                value, i = read_number(s), i + 1
            else:
                j = i
                while j < len(toks) and (toks[j][0] == "word" or toks[j] == ("of", "and")):
                    j += 1
                value, i = read_words([w for k, w in toks[i:j] if k == "word"]), j
            if value is None:
                continue
            while i < len(toks) and toks[i][0] == "of" and i + 1 < len(toks) and toks[i + 1][0] == "unit":
                i += 1
            while i < len(toks) and toks[i] == ("other", "(") and i + 1 < len(toks) and toks[i + 1][1].startswith("fraction"):
                i += 1
            name, dims, scale, offset = "", None, D(1), D(0)
            if i < len(toks) and toks[i][0] == "unit":
                name = SPELLINGS[toks[i][1]]
                (dims, scale, offset), i = UNITS[name], i + 1
                j = i  # `ml of alcohol per litre`: what is measured stands between the two units
                while j < len(toks) and toks[j][0] in ("of", "other") and toks[j][1].isalpha():
                    j += 1
                if j + 1 < len(toks) and toks[j][0] == "per" and toks[j + 1][0] == "unit":
                    under = SPELLINGS[toks[j + 1][1]]
                    d2, s2, _ = UNITS[under]
                    dims, scale, name, i = tuple(a - b for a, b in zip(dims, d2)), scale / s2, f"{name}/{under}", j + 2
            elif leading:
                name = leading
                dims, scale, offset = UNITS[name]
            leading = ""
            out.append((value * scale + offset, dims, name))
        else:
            if kind == "unit":
                leading = SPELLINGS[s]
            i += 1
    return tuple(out)


@lru_cache(maxsize=65536)
def amount_of(text: str | None, kind: str, default: str | None) -> tuple[str | None, str, bool]:
    """(value in litres or as a fraction, unit as stated, whether it is (also) stated in the
    target's own unit). A bare number takes the default unit; without one, no amount.
    For strength a bare fraction `by volume` states the share of volume."""
    dims, own = TARGET[kind]
    if text is None or (default is None and not re.search(r"[^\d\s.,]", text)):
        return None, "", False
    found = quantities(text)
    known = [q for q in found if q[1] == dims]
    if not known:
        bare = [q for q in found if q[1] is None]
        if not bare:
            return None, "", False
        if kind == "strength" and re.search(r"by vol", text.lower()) and bare[0][0] < 1:
            return str(bare[0][0]), "fraction", False
        if default is None or re.search(r"[^\W\d_]", text):
            return None, "", False
        known = [(bare[0][0] * UNITS[default][1] + UNITS[default][2], dims, default)]
    stated = [q for q in known if q[2] in own]
    if stated:
        return str(stated[0][0]), stated[0][2], True
    if kind == "contents" and len({q[2] for q in known}) > 1 and not re.search(r"[(/]", text):
        return str(sum(q[0] for q in known)), "+".join(q[2] for q in known), False
    return str(known[0][0]), known[0][2], False


# Words by which a note on keying names the quantity and the unit.
NOTE_KIND = {"strength": r"strength|alcohol|abv", "contents": r"size|contents|container|bottle|volume column|volumes?\b(?! *\.?$)"}
NOTE_UNIT = {
    "strength": [("proof", r"proof"), ("per mille", r"per thousand|per mille|‰|ml per lit"), ("fraction", r"share of one|fraction|as a share"), ("percent", r"per ?cent|%")],
    "contents": [("cl", r"centilit|\bcl\b"), ("ml", r"millilit|\bml\b"), ("fl oz", r"\bfl\.? ?oz|fluid ounce|\bounces?\b"), ("dl", r"decilit|\bdl\b"), ("pint", r"\bpints?\b"), ("quart", r"\bquarts?\b"), ("gallon", r"\bgallons?\b"), ("l", r"\blit(re|er)s?\b|\bl\b")],
}


def note_units(note: str | None) -> dict[str, str | None]:
    """The default unit of strength and contents that a source's note tells, clause by clause.
    A clause that only continues (`the word itself is often left off`) adds nothing."""
    out: dict[str, str | None] = {"strength": None, "contents": None}
    for clause in re.split(r"[;.]\s", f"{(note or '').lower()} "):
        for kind, units in NOTE_UNIT.items():
            if out[kind] is None and re.search(NOTE_KIND[kind], clause) and not (kind == "contents" and re.search(NOTE_KIND["strength"], clause)):
                out[kind] = next((u for u, pattern in units if re.search(pattern, clause)), None)
    return out


AMOUNT = T.StructType([T.StructField("value", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("own", T.BooleanType())])


def canonical_amount(text: Column, kind: str, default: Column) -> Column:
    """struct(value, unit, own): see amount_of; null text gives a null value."""

    @F.pandas_udf(AMOUNT)
    def read(texts: pd.Series, defaults: pd.Series) -> pd.DataFrame:
        none = lambda x: x if isinstance(x, str) else None
        return pd.DataFrame([amount_of(none(t), kind, none(d)) for t, d in zip(texts, defaults)], columns=["value", "unit", "own"])

    return read(text, default)


NOTES = T.StructType([T.StructField("strength", T.StringType()), T.StructField("contents", T.StringType())])


def standard_amounts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (row_id, field) of alcohol_content and net_contents: the text, `amount` in
    hundredths of a percent by volume or whole millilitres (half up; null where none is
    stated), the unit as stated or told by the source's note, and whether the text itself is
    (also) in the target unit or the note says that bare numbers are.

    Sources are few and joined by broadcast behind a size check; of a source_id held twice
    the smallest note counts. Null texts give null amounts; rows repeat as given; other columns are ignored.
    """

    @F.pandas_udf(NOTES)
    def told(notes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note_units(n if isinstance(n, str) else None) for n in notes], columns=["strength", "contents"])

    rows = spread(rows.select("row_id", "source_id", "alcohol_content", "net_contents"))
    units = sources.groupBy("source_id").agg(F.min("note").alias("note")).select(F.col("source_id").alias("_source"), told("note").alias("_told"))
    df = rows.join(broadcast_if_small(units), F.col("source_id") == F.col("_source"), "left")
    strength = canonical_amount(F.col("alcohol_content"), "strength", F.col("_told.strength"))
    contents = canonical_amount(F.col("net_contents"), "contents", F.col("_told.contents"))
    one = lambda field, text, got: F.struct(F.lit(field).alias("field"), F.col(text).alias("text"), F.col(got).alias("got"))
    df = df.select("row_id", "source_id", "alcohol_content", "net_contents", strength.alias("_s"), contents.alias("_c"))
    df = df.select("row_id", "source_id", F.explode_outer(F.array(one("alcohol_content", "alcohol_content", "_s"), one("net_contents", "net_contents", "_c"))).alias("_x"))
    value = F.col("_x.got.value").cast("decimal(30,12)")
    amount = F.round(F.when(F.col("_x.field") == "alcohol_content", value * 10000).otherwise(value * 1000), 0).cast("bigint")
    return df.select("row_id", "source_id", F.col("_x.field").alias("field"), F.col("_x.text").alias("text"), amount.alias("amount"), F.col("_x.got.unit").alias("unit"), F.col("_x.got.own").alias("own"))


def amounts_in_other_units(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The amounts that had to be converted: stated, but not (also) in the target unit."""
    df = standard_amounts(rows, sources)
    own_by_note = ((F.col("field") == "alcohol_content") & (F.col("unit") == "percent")) | ((F.col("field") == "net_contents") & (F.col("unit") == "ml"))
    return df.where(F.col("amount").isNotNull() & ~F.col("own") & ~own_by_note).select("row_id", "field", "amount")
