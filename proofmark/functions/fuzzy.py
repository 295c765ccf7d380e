"""Similarity kernels Spark has no built-in for, as Arrow functions.

The indel ratio rests on the longest common subsequence, computed bit-parallel on integers. The
best line of a label for all its fields is found in one crossing into Python per row; operands
that are null (the phrase test already succeeded, or the field is blank) cost nothing.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

TOKEN = re.compile("[A-Z0-9%]+")


def lcs_length(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (len a + len b); two empty texts are alike."""
    n = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(maxsize=100_000)
def line_score(expected: str, line: str) -> int:
    """0 to 100 of two normalised texts: 100 where equal or contained as a phrase, else the better
    ratio, held down where few of the expected tokens are there."""
    if not expected or not line:
        return 0
    if expected == line or re.search(rf"(?<![A-Z0-9]){re.escape(expected)}(?![A-Z0-9])", line):
        return 100
    want, have = set(TOKEN.findall(expected)), set(TOKEN.findall(line))
    covered = len(want & have) / len(want) if want else 0.0
    top = 60 if covered < 0.5 else 82 if covered < 0.75 else 100
    return round(min(max(indel_ratio(expected, line), token_sort_ratio(expected, line)), top))


@lru_cache(maxsize=100_000)
def _wanted(expected: str) -> tuple[re.Pattern, frozenset[str]]:
    return re.compile(rf"(?<![A-Z0-9]){re.escape(expected)}(?![A-Z0-9])"), frozenset(TOKEN.findall(expected))


def best_line(expected: str | None, lines: list[str], tokens: list[frozenset[str]] | None = None) -> tuple[int, int] | None:
    """(place from 0, score) of the best line, the earliest on ties; (-1, 0) where none scores. A
    line is scored only if its length and the share of tokens it has let it beat the best so far."""
    if expected is None:
        return None
    place, score = -1, 0
    if not expected:
        return place, score
    pattern, want = _wanted(expected)
    for i, line in enumerate(lines):
        if not line:
            continue
        if expected in line and pattern.search(line):
            return (i, 100) if score < 100 else (place, score)
        have = tokens[i] if tokens is not None else frozenset(TOKEN.findall(line))
        covered = len(want & have) / len(want) if want else 0.0
        top = 60 if covered < 0.5 else 82 if covered < 0.75 else 100
        if round(min(top, 200.0 * min(len(expected), len(line)) / (len(expected) + len(line)))) <= score:
            continue
        s = line_score(expected, line)
        if s > score:
            place, score = i, s
    return place, score


BEST = StructType([StructField("place", IntegerType()), StructField("score", IntegerType())])


@F.pandas_udf(ArrayType(BEST))
def best_lines(expected: pd.Series, lines: pd.Series) -> pd.Series:
    """For each of the expected texts of a row (normalised, null: not wanted) the best line."""

    def one(wanted: object, have: object) -> list | None:
        if wanted is None or all(w is None for w in wanted):
            return None
        rows = list(have) if have is not None else []
        tokens = [frozenset(TOKEN.findall(x)) for x in rows]
        got = [best_line(w, rows, tokens) for w in wanted]
        return [None if g is None else {"place": g[0], "score": g[1]} for g in got]

    return pd.Series([one(w, h) for w, h in zip(expected, lines)])


@F.pandas_udf(IntegerType())
def match_score(expected: pd.Series, line: pd.Series) -> pd.Series:
    """line_score of two normalised columns; nulls count as empty."""
    text = lambda x: x if isinstance(x, str) else ""
    return pd.Series([line_score(text(a), text(b)) for a, b in zip(expected, line)], dtype="int32")


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    text = lambda x: x if isinstance(x, str) else ""
    return pd.Series([indel_ratio(text(x), text(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (not symmetric); nulls count as empty."""
    text = lambda x: x if isinstance(x, str) else ""
    return pd.Series([SequenceMatcher(None, text(x), text(y)).ratio() for x, y in zip(a, b)], dtype="float64")


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")
