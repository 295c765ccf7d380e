"""One consistent form for text that looks alike but differs in its characters.

The skeleton of a text: decompose (NFKD), drop what can't be seen, replace every character by
its prototype from the look-alike table, decompose again. Texts of equal skeleton look alike
and are grouped. The consistent form of a text is the plain member of its skeleton's group:
composed, of plain width and shape, without invisible characters, with plain blanks, and each word
that mixes alphabets spelt from its skeleton in one of them. A text that isn't that member is a case.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other alphabets and the Latin letters they look like, as the public
# table of confusables has them.
CYRILLIC = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝѵкЬгԚԜѴҮү", "ABEKMHOPCTXYIJSaeopcyxijshdqwvkbrQWVYy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικυϲϳϹͿσγ", "ABEZHIKMNOPTYXaopvikucjCJoy"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHYGZbRWSVSLCPKdB"))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"))
OTHER = dict(zip("ӀӏԌԍɑɡՕօՍսհոռյցզգլիıȷɩɪʏꜱᴄᴏᴠᴡᴢƽ", "IlGgagOoUuhnnjgqqlhijiiyscovwzs"))
LATIN_OF = {a: b for a, b in (CYRILLIC | GREEK | CHEROKEE | LISU | COPTIC | OTHER).items() if b.isascii()}
# Further pairs that only a skeleton equates (never changed in a text).
SKELETON_ONLY = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn", "ß": "β", "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "`": "'", "´": "'"}

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]")
BLANK = re.compile("[\t   -   　]")
WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f'’]*[^\W\d_]+)*")
#: Letters beyond the Latin ones; without any no word mixes alphabets.
FOREIGN = re.compile("[\u0250-\u02af\u0370-\u1cff\u1f00-\u1fff\u2c00-\ua71f\ua800-\udfff]")
#: In the JVM: rows that hold nothing but plain ASCII are in the consistent form already.
NOT_PLAIN = r"[^\n\r -~]"
#: What a skeleton of one line needs more than built-in expressions for.
NOT_PLAIN_LINE = r"[^\t -~]"


@lru_cache(maxsize=None)
def plain_shape(ch: str) -> str:
    """The character in plain width and shape: wide, narrow, styled and ligature forms only."""
    tag = unicodedata.decomposition(ch).split(" ", 1)[0]
    if tag in ("<wide>", "<narrow>", "<font>") or (tag in ("<compat>", "<circle>", "<square>") and unicodedata.category(ch)[0] in "LS" and "ﬀ" <= ch <= "ﬆ" or tag == "<circle>" and "Ⓐ" <= ch <= "ⓩ"):
        return unicodedata.normalize("NFKC", ch)
    return ch


class Plain(dict):
    """Table for str.translate, filled as characters are met: nothing for what can't be seen, a
    plain blank for blanks, the plain shape for the rest."""

    def __missing__(self, code: int) -> str | int | None:
        ch = chr(code)
        to = None if INVISIBLE.match(ch) else " " if BLANK.match(ch) else plain_shape(ch)
        self[code] = code if to == ch else to
        return self[code]


PLAIN = Plain()


@lru_cache(maxsize=None)
def alphabet(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, ... of a letter."""
    return unicodedata.name(ch, "").split(" ", 1)[0]


def prototypes(decomposed: str, only: set[str] | None = None) -> str:
    """Every character by its prototype: the Latin letter it looks like (of the given alphabets only)."""
    return "".join(LATIN_OF.get(c, c) if only is None or alphabet(c) in only else c for c in decomposed)


def one_alphabet(word: str) -> str:
    """A decomposed word that mixes alphabets, spelt from its prototypes in one of them: Latin where all
    of them are Latin, else the alphabet of most letters whose own letters have these prototypes."""
    kinds = {alphabet(c) for c in word if c.isalpha()} - {"MODIFIER", ""}
    if len(kinds) < 2:
        return word
    spelt = prototypes(word, kinds - {"LATIN"})
    left = {alphabet(c) for c in spelt if c.isalpha()} - {"MODIFIER", "", "LATIN"}
    if not left:
        return spelt
    counts = {k: sum(alphabet(c) == k for c in word) for k in kinds}
    to = max(sorted(kinds - {"LATIN"}), key=lambda k: counts[k])
    back = {b: a for a, b in LATIN_OF.items() if alphabet(a) == to}
    return "".join(back.get(LATIN_OF.get(c, c), c) if c.isalpha() and alphabet(c) != to else c for c in word)


@lru_cache(maxsize=65536)
def consistent_short(text: str) -> str:
    if text.isascii() and not INVISIBLE.search(text) and "\t" not in text:
        return text
    text = text.translate(PLAIN)
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)  # a look-alike below an accent is replaced before they are composed
    if FOREIGN.search(text):
        text = WORD.sub(lambda m: m.group() if m.group().isascii() else one_alphabet(m.group()), text)
    return unicodedata.normalize("NFC", text)


def consistent(text: str | None) -> str | None:
    """The consistent form; null stays null, empty stays empty. Idempotent."""
    if text is None:
        return None
    return consistent_short(text) if len(text) < 200 else consistent_short.__wrapped__(text)


@lru_cache(maxsize=None)
def _prototype(ch: str) -> str:
    c = LATIN_OF.get(ch, ch)
    return SKELETON_ONLY.get(c, c)


def skeleton_of(text: str | None) -> str | None:
    """Equal for texts that look alike. Case is kept: capitals look different. Null stays null."""
    if text is None:
        return None
    text = prototypes(BLANK.sub(" ", INVISIBLE.sub("", text)))  # before some are decomposed to unlike letters
    text = "".join(map(_prototype, unicodedata.normalize("NFKD", text)))
    return unicodedata.normalize("NFD", re.sub(" +", " ", text).strip())


def plain_member(text: str | None) -> str | None:
    """The plain member of the text's skeleton group: the consistent form, if its skeleton is the
    text's own; else the text itself, which then is no case."""
    form = consistent(text)
    return form if form == text or skeleton_of(form) == skeleton_of(text) else text


@F.pandas_udf(StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: consistent(t) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def _plain_member(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: plain_member(t) if isinstance(t, str) else None)


_plain_member = _plain_member.asNondeterministic()  # a filter on its result runs it no second time


@F.pandas_udf(StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: skeleton_of(t) if isinstance(t, str) else None)


def consistent_form(text: Column) -> Column:
    """Column in consistent form. Plain rows hand the UDF a null and keep their text in the JVM."""
    return F.when(text.rlike(NOT_PLAIN), _consistent(F.when(text.rlike(NOT_PLAIN), text))).otherwise(text)


def skeleton(text: Column) -> Column:
    """Skeleton as a column. Of plain ASCII it is made by built-in expressions."""
    ascii_ = F.trim(F.regexp_replace(F.replace(F.translate(F.regexp_replace(text, "\t", " "), "01I|`", "Olll'"), F.lit("m"), F.lit("rn")), " +", " "))
    return F.when(text.rlike(NOT_PLAIN_LINE), _skeleton(F.when(text.rlike(NOT_PLAIN_LINE), text))).otherwise(ascii_)


def inconsistent_rows(df: DataFrame, text: str, key: str = "row_id") -> DataFrame:
    """(key, text, form) of the rows whose text isn't the plain member of its skeleton's group. Rows of
    plain ASCII never leave the JVM. Null and empty texts are no case; repeated rows stay repeated."""
    odd = df.where(F.col(text).rlike(NOT_PLAIN)).select(key, F.col(text).alias("text"))
    return odd.withColumn("form", _plain_member("text")).where(F.col("form") != F.col("text"))


def lines_of_texts(df: DataFrame, text: str) -> DataFrame:
    """The lines of all texts as rows, blank ones left out."""
    return df.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\r\n|\n|\r")).alias(text)).where(F.trim(text) != "")


def look_alike_groups(df: DataFrame, text: str) -> DataFrame:
    """Originals grouped by equal skeleton: one row per group with its number of distinct forms
    and rows, the form most rows have (ties: the smallest), in consistent form. Equal texts are
    counted before anything is shuffled, so a text that fills a third of all rows is one row."""
    counted = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n"))
    keyed = counted.select("text", "n", skeleton(F.col("text")).alias("skeleton"))
    return keyed.groupBy("skeleton").agg(
        F.count("*").alias("n_forms"), F.sum("n").alias("n_rows"), consistent_form(F.min_by("text", F.struct(-F.col("n"), F.col("text")))).alias("form")
    )
