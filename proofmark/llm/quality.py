"""Per-document text statistics that tell natural prose from lists, tables and junk.

Plain counts (words, lengths, symbols, lines) are built-in expressions; what needs the lines in
their order and the repetition figures (duplicate line and paragraph shares, the share of
characters that the dominant word n-gram covers) come from one Arrow pass over whole texts.
The combined rules weigh characters: every line goes to prose, list, table or junk by its
form, runs of plain lines by their sentences, common words and repetition, and a document is
not prose where less than half of its characters are.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from proofmark.runtime import spread

# Common words of the corpus languages.
COMMON = frozenset(
    "the of and to in a is that it was for on as with by at from his her this be are or an not have had but which they were there their its who once why what no so each our your"
    " el la los las de que y en un una es por con para del se lo como más pero sus al era no hay según sin muy también quién"
    " le les des du et est dans une qui pour pas sur au plus par ce il elle sont avec nous on ne sans"
    " der die das und ist den von zu mit sich auf für dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer im war wir wer kein".split()
)
WORD = re.compile(r"[^\W\d_]+")
RULE = re.compile(r"^[\s|+\-=:_~.*#]*$")
MARKER = re.compile(r"^\s*(?:[-*+•▪◦‣●○■□·–—>»]|\[[ xX✓]?\]|[☐☑✓✔]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\d{1,3} ?[xX×]|(?:[Nn]o|[Nn]r|#|[Ii]tem|[Ss]tep)\.? ?\d{1,3}[.:)]?)(?=\s)")
END = re.compile(r"[.!?…]['\")\]»”’]*(?=\s|$)")
HEX = re.compile(r"^(?:[0-9a-f]{2,8}[\s:]+){3,}[0-9a-f]{1,8}\s*$", re.I)


SIGNS = re.compile(r"[^\w%.&'+-]|_")
FILLED = re.compile(r"[\s|,;]")
BARS = re.compile(r"[lI1|]*")
COLUMNS = re.compile(r"\S {2,}(?=\S)")
TIGHT = {d: re.compile(rf"[^\s{d}]{d}(?=[^\s{d}])|{d}{d}") for d in ",;"}


def cells_of(line: str) -> int:
    """Number of table cells of a line by the strongest separator it has; 0: none, and where the
    cells hold signs rather than words and figures."""
    if not ("|" in line or "\t" in line or "  " in line or line.count(",") > 1 or line.count(";") > 1):
        return 0
    s = line.strip()
    filled = FILLED.sub("", s)
    if len(SIGNS.findall(filled)) > 0.2 * len(filled) or BARS.fullmatch(filled):
        return 0
    if "|" in s and s.count("|") >= 2:
        return s.strip("|").count("|") + 1
    if "\t" in s:
        return s.count("\t") + 1
    if "  " in s and (n := len(COLUMNS.findall(s))) >= 1:
        return n + 1
    for d, pattern in TIGHT.items():
        if (held := s.count(d)) > 1 and (tight := len(pattern.findall(s))) >= 2 and tight >= 0.7 * held:
            return tight + 1
    return 0


def ink(s: str) -> int:
    """Characters but blanks."""
    return sum(map(len, s.split()))


LINK = re.compile(r"https?://|www\.")
DIGIT = re.compile(r"\d")
ODD = re.compile(r"[^\x00-\x7e–—‘’“”…•▪°€£½¼«»¿¡‚„]")


def garbled(line: str, words: list[str]) -> bool:
    """No readable language in the line's own characters."""
    pieces = line.split()
    if not pieces:
        return False
    if (len(pieces) > 3 and HEX.match(line.strip())) or (max(map(len, pieces)) >= 32 and not LINK.search(line)):
        return True
    solid, letters = sum(map(len, pieces)), sum(map(len, words))
    share = letters / solid
    if share < 0.5 and solid >= 3 and not DIGIT.search(line):
        return True
    if solid < 6:
        return False
    return share < 0.3 or (not line.isascii() and sum(not c.isalpha() for c in ODD.findall("".join(pieces))) / solid > 0.15)


ROUGH = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|[aeiou]{4,}|^[bcdfghjklmnpqrstvwxz]{2,4}$|(.)\1\1|[a-z][A-Z]")


def spoiled(words: list[str]) -> bool:
    """Letters in an order no language has: few words with a plain pattern of vowels and common words missing."""
    if len(words) < 8:
        return False
    long = [w for w in words if len(w) >= 2]
    singles = (len(words) - len(long)) / len(words)
    rough = sum(ROUGH.search(w) is not None for w in long) / max(1, len(long))
    return singles > 0.3 or rough > 0.3 or (rough > 0.15 and singles > 0.12)


def dominant(words: list[str]) -> float:
    """Greatest share of the characters that one word n-gram (n 1 to 5) or longer phrase covers, above what its
    words would cover in prose: single common words don't count. An n-gram comes again only where the
    one a word shorter does, so each size looks only at the places the size before left."""
    total = sum(map(len, words))
    if len(words) < 6 or not total:
        return 0.0
    counts = Counter(words)
    best = max((k * len(w) for w, k in counts.items() if k >= 3 and w not in COMMON), default=0) / total
    starts = [i for i, w in enumerate(words) if counts[w] >= 2]
    for n in (2, 3, 4, 5):
        follows = set(starts)
        at = [(i, tuple(words[i : i + n])) for i in starts if i + 1 in follows and i + n <= len(words)]
        grams = Counter(g for _, g in at)
        for g, k in grams.items():
            size = sum(map(len, g))
            if k < 3 or k * size <= best * total:
                continue
            hits = k
            if any(g[:j] == g[-j:] for j in range(1, n)):  # it may overlap itself
                hits, end = 0, 0
                for i, x in at:
                    if x == g and i >= end:
                        hits, end = hits + 1, i + n
            best = max(best, hits * size / total)
        starts = [i for i, g in at if grams[g] >= 2]
    return max(best, periodic(words, starts))


def periodic(words: list[str], starts: list[int]) -> float:
    """Share of the characters in words that come three times or more at one distance of six
    words or more: the most frequent distance of equal runs of six words. starts: where runs of
    five words begin that come again."""
    last: dict[tuple[str, ...], int] = {}
    far: Counter = Counter()
    for i in starts:
        if i > len(words) - 6:
            break
        g = tuple(words[i : i + 6])
        if g in last and i - last[g] >= 6:
            far[i - last[g]] += 1
        last[g] = i
    if not far:
        return 0.0
    p = far.most_common(1)[0][0]
    held = {j for i in range(2 * p, len(words)) if words[i] == words[i - p] == words[i - 2 * p] for j in (i, i - p, i - 2 * p)}
    return sum(len(words[i]) for i in held) / sum(map(len, words))


ITEMS = re.compile(r"[;•▪|/]\s|,\s")


def run_kind(lines: list[str], words: list[str], n_common: int) -> str:
    """Kind of a run of unmarked lines with their words, of which so many are common: prose, list or junk."""
    if not words:
        return "junk" if sum(map(ink, lines)) > 3 else "prose"
    common = n_common / len(words)
    if common < 0.25 and spoiled(words):
        return "junk"
    text = " ".join(lines)
    ends = len(END.findall(text))
    if ends * 30 >= len(words) and common >= 0.1:
        return "prose"
    per_line = len(words) / len(lines)
    if len(lines) >= 3 and per_line <= 8 and ends * 30 < len(words) and (common < 0.3 or lines_open(lines) > 0.6):
        return "list"
    items = sum(1 for x in ITEMS.split(text) if x.strip()) if common < 0.1 else 0
    if items >= 4 and len(words) / items <= 4:
        return "list"
    if common < 0.06 and len(words) >= 8:
        return "list" if per_line <= 8 and len(lines) >= 2 else "junk"
    return "prose"


def lines_open(lines: list[str]) -> float:
    """Share of line breaks after which a new item begins: the line breaks before it was full."""
    width = max(map(len, lines))
    early = [a for a, b in zip(lines, lines[1:]) if len(a) + 1 + len(b.split(" ", 1)[0]) <= width]
    return len(early) / max(1, len(lines) - 1)


FRAME, STROKE = re.compile(r"[|+]"), re.compile(r"-{2,}|={2,}")
BREAK = re.compile(r"\n\s*\n")
is_common = COMMON.__contains__


def shape(text: str) -> dict[str, float]:
    """Characters (blanks aside) by kind of line, and repetition figures. Each line is cut into words
    once; runs and the whole text go by the same words."""
    lines = text.split("\n")
    size = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    cells = [cells_of(x) for x in lines]
    all_words: list[str] = []
    n_common = 0
    run: list[str] = []
    run_words: list[str] = []
    run_common = 0

    def close() -> None:
        nonlocal run_common
        if run:
            size[run_kind(run, run_words, run_common)] += sum(map(ink, run))
            run.clear()
            run_words.clear()
            run_common = 0

    for i, line in enumerate(lines):
        if not line.strip():
            if run and END.search(run[-1][-3:] + " "):
                close()
            continue
        words = WORD.findall(line)
        lower = [w.lower() for w in words]
        all_words += lower
        common = sum(map(is_common, lower))
        n_common += common
        near = (cells[i - 1] if i else 0, cells[i + 1] if i + 1 < len(lines) else 0)
        if not words and RULE.match(line) and len(line.strip()) >= 3:
            close()
            size["table" if max(near) >= 2 and FRAME.search(line) and STROKE.search(line) else "junk"] += ink(line)
            continue
        odd = garbled(line, words)
        if cells[i] >= 2 and (cells[i] in near or "|" in line and max(near) >= 2) and common <= max(1, len(words) * 0.2) and not (odd and not DIGIT.search(line)):
            close()
            size["table"] += ink(line)
        elif odd:
            close()
            size["junk"] += ink(line)
        elif MARKER.match(line) and (len(words) <= 8 or common < 0.15 * len(words)) and not (len(words) >= 6 and common >= 2 and END.search(line)):
            close()
            size["list"] += ink(line)
        else:
            run.append(line)
            run_words += words
            run_common += common
    close()
    full = [y for x in lines if (y := x.strip())]
    paragraphs = [y for x in BREAK.split(text) if (y := x.strip())]
    total = sum(size.values()) or 1
    out = {f"{k}_share": v / total for k, v in size.items()}
    out["dup_line_share"] = 1 - len(set(full)) / len(full) if full else 0.0
    out["dup_paragraph_share"] = 1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0
    out["dominant_share"] = dominant(all_words)
    out["distinct_share"] = len(set(all_words)) / len(all_words) if all_words else 0.0
    out["common_share"] = n_common / len(all_words) if all_words else 0.0
    out["n_words"] = len(all_words)
    return out


def kind_by_rules(s: dict[str, float]) -> str | None:
    """list, table or junk where less than half of the text is prose; null for prose and blanks. Lines or
    paragraphs over and over (boilerplate), and a phrase that covers half of the text, are junk."""
    repeats = max(s["dup_line_share"], s["dup_paragraph_share"]) > 0.8 and s["distinct_share"] < 0.3
    if s["n_words"] >= 8 and s["table_share"] < 0.5 and (s["dominant_share"] >= 0.5 or repeats):
        return "junk"
    if s["prose_share"] >= 0.5 or not any(s[f"{k}_share"] for k in ("list", "table", "junk")):
        return None
    return max(("table", "list", "junk"), key=lambda k: s[f"{k}_share"])


FIGURES = ["prose_share", "list_share", "table_share", "junk_share", "dup_line_share", "dup_paragraph_share", "dominant_share", "distinct_share", "common_share"]
SHAPE = StructType([*(StructField(f, DoubleType()) for f in FIGURES), StructField("kind", StringType())])


@F.pandas_udf(SHAPE)
def _shape(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        if not isinstance(t, str):
            rows.append((None,) * (len(FIGURES) + 1))
            continue
        s = shape(t)
        rows.append((*(s[f] for f in FIGURES), kind_by_rules(s)))
    return pd.DataFrame(rows, columns=[*FIGURES, "kind"])


_shape = _shape.asNondeterministic()  # else a filter on its result runs it a second time


def plain_counts(text: Column) -> dict[str, Column]:
    """Counts by built-in expressions."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    n_words = F.regexp_count(text, F.lit(r"\p{L}+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ending = F.filter(lines, lambda x: x.rlike(r"""[.!?]['")\]»”’]*\s*$"""))
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return {
        "n_words": n_words.cast("int"),
        "mean_word_length": share(letters, n_words),
        "symbol_ratio": share(solid - F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]+", "")), solid),
        "digit_ratio": share(F.length(F.regexp_replace(text, r"[^\p{N}]+", "")), solid),
        "n_lines": F.size(lines),
        "punctuated_line_share": share(F.size(ending), F.size(lines)),
    }


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, the figures and `kind` (list, table, junk or null: prose).
    Null texts give null figures, empty ones zeros; repeated rows stay repeated."""
    df = spread(documents.select("doc_id", "text")).select("doc_id", F.col("text").alias("_t"), _shape("text").alias("_s"))
    return df.select("doc_id", *[c.alias(n) for n, c in plain_counts(F.col("_t")).items()], *[F.col(f"_s.{f}").alias(f) for f in [*FIGURES, "kind"]])


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents whose text is for the most part not prose."""
    return spread(documents.select("doc_id", "text")).select("doc_id", _shape("text")["kind"].alias("kind")).where(F.col("kind").isNotNull())
