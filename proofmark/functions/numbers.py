"""Figures in recognised text: repair of digits, percentages, proof and container sizes.

Values are doubles throughout, tolerances included; nothing is rounded that isn't said to be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmark.functions.text import collapse, empty_if_null

# Letters read for digits, and the container sizes that are usual.
READ, MEANT = "OIL|S,", "01115."
ML_SIZES = [50, 100, 187, 200, 250, 300, 330, 341, 355, 375, 500, 700, 720, 750, 1000, 1500, 1750]
L_SIZES = [1.0, 1.5, 1.75]
DIGITS = "[0-9OILS|]"
VOL = r"(?:ALC\.?\s*/?\s*VOL\.?|ABV)"


def number(c: Column) -> Column:
    """A recognised number as a double; null where it is none (`1.5.2`, `.`)."""
    return F.regexp_replace(F.translate(F.upper(c), READ, MEANT), "[^0-9.]", "").try_cast("double")


def bordered(c: Column) -> Column:
    """Upper case, marks and zero-width joiners as plain signs: the JVM counts them as parts of
    words, the word borders meant here don't. Plain ASCII texts pass untouched."""
    up = F.upper(empty_if_null(c))
    return F.when(up.rlike(r"[^\x00-\x7F]"), F.regexp_replace(up, r"[\p{M}\x{200c}\x{200d}]", "\u2060")).otherwise(up)


def shown(v: Column) -> Column:
    """Whole values without a decimal part, others as they are."""
    return F.when(v == F.floor(v), v.try_cast("bigint").cast("string")).otherwise(v.cast("string"))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def _values(matches: Column, low: float, high: float, open_low: bool) -> Column:
    v = F.transform(matches, number)
    return F.filter(v, lambda n: n.isNotNull() & ((n > low) if open_low else (n >= low)) & (n <= high))


def percent_values(text: Column) -> Column:
    """Distinct percentages over 0 up to 100: by pattern (sign, word, ALC/VOL or ABV), then place."""
    up = bordered(text)
    n = rf"\b({DIGITS}{{1,3}}(?:[.,]{DIGITS}+)?)"
    parts = [found(up, n + r"\s*%"), found(up, n + r"\s*PERCENT\b"), found(up, n + r"\s*%?\s*(?:ALC\.?\s*/?\s*VOL\.?|ABV)\b")]
    return F.array_distinct(_values(F.concat(*parts), 0.0, 100.0, True))


def proof_values(text: Column) -> Column:
    up = bordered(text)
    return F.array_distinct(_values(found(up, rf"\b({DIGITS}{{1,3}}(?:[.,]{DIGITS}+)?)\s*PROOF\b"), 0.0, 200.0, True))


def norm_net_contents(c: Column) -> Column:
    """Upper case, plural unit words shortened, a blank between number and unit."""
    s = F.upper(empty_if_null(c))
    for word, unit in (("MILLILITERS", "ML"), ("MILLILITRES", "ML"), ("LITERS", "L"), ("LITRES", "L")):
        s = F.replace(s, F.lit(word), F.lit(unit))
    s = F.regexp_replace(s, r"(\d+)\s*ML", "$1 ML")
    return collapse(F.regexp_replace(s, r"(\d+)\s*L\b", "$1 L"))


def usual_ml(v: Column) -> Column:
    """The usual size a value in ml stands for: itself, or 750 and 1750 within 25; else null."""
    r = F.bround(v, 0).try_cast("int")
    return F.when(r.isin(ML_SIZES), r).when(r.between(725, 775), 750).when(r.between(1725, 1775), 1750)


def candidate(field: str, display: Column, value: Column, source: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), display.alias("display"), value.alias("value"), source.alias("source"))


def field_candidates(text: Column, source: Column) -> Column:
    """Structured values a text may state: array of (field, display, value, source), distinct by
    field and display, in order of field, pattern and place."""
    up = bordered(text)
    n = rf"\b({DIGITS}{{1,3}}(?:[.,]{DIGITS}{{1,2}})?)"
    abv = _values(F.concat(found(up, n + rf"\s*%?\s*{VOL}\b"), found(up, n + r"\s*(?:%|PERCENT)\b")), 0.5, 95.0, False)
    proof = _values(found(up, n + r"\s*PROOF\b"), 1.0, 200.0, False)
    net = rf"\b({DIGITS}{{1,4}}(?:[.,]{DIGITS}{{1,2}})?)\s*(ML|M[L1I]|L)\b"
    sized = F.zip_with(F.transform(found(up, net), number), found(up, net, 2), lambda v, u: F.struct(v.alias("v"), u.alias("u")))

    def size(x: Column) -> Column:
        ml, litres = usual_ml(x["v"]), F.round(x["v"], 2)
        as_ml = candidate("net_contents", F.concat(ml.cast("string"), F.lit(" ML")), ml.cast("double"), source)
        as_l = candidate("net_contents", F.concat(shown(litres), F.lit(" L")), litres, source)
        return F.when(F.startswith(x["u"], F.lit("M")) & ml.isNotNull(), as_ml).when((x["u"] == "L") & litres.isin(L_SIZES), as_l)

    return F.array_distinct(
        F.concat(
            F.transform(abv, lambda v: candidate("abv", F.concat(shown(v), F.lit("% ALC/VOL")), v, source)),
            F.transform(proof, lambda v: candidate("proof", F.concat(shown(v), F.lit(" PROOF")), v, source)),
            F.filter(F.transform(sized, size), lambda c: c.isNotNull()),
        )
    )


def states_alcohol(text: Column) -> Column:
    """Whether a text already gives an alcohol content (percentage or proof)."""
    up = bordered(text)
    n = rf"(?U)\b{DIGITS}{{1,3}}(?:[.,]{DIGITS}{{1,2}})?"
    return up.rlike(n + rf"\s*%?\s*{VOL}\b") | up.rlike(n + r"\s*(?:%|PERCENT)\b") | up.rlike(n + r"\s*PROOF\b")
