"""Text of scanned pages made continuous and readable.

A noisy-channel reader: what a scan shows is the meant word sent through a channel that takes
some characters for others. Which may be taken for which is a table; how often each is, is
estimated from the corpus. Candidates of a word are the known words that confusions lead to;
per line Viterbi picks the chain of greatest channel probability times corpus n-gram likelihood
(unigrams and bigrams over all texts), figures by that of all figures. Lines are further told to be
page numbers or running headers, and words divided at a line end are joined, unless they are compounds
that have their hyphen anyway. What is left is folded into paragraphs. What is learned is fixed
before the first line is read, so results don't depend on how rows are spread or ordered.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.llm.canonical import distance
from proofmark.llm.confusables import consistent
from proofmark.runtime import checkpointed, fits, spread

#: Words and pairs known to the model: at least this share of all, so 1 / share of each at most.
KNOWN_SHARE = 2e-6
LEAST_COUNT = 3
#: Probability of a confusion before anything is counted, and the places of its character that this weighs as much as.
ERROR, PRIOR = 0.002, 1000.0
#: Times as common as the word read a candidate must be; words with digits among letters need it only be commoner.
COMMONER = 10
#: Words below the known share that are sent to the readers too; more are joined to the rows that ask for them.
RARE_ROWS = 200_000
#: Longer strings seen a few times are no words that another one could be meant for.
LONGEST_WORD = 100
# What is read for what is meant, as one table (read, meant).
CONFUSIONS = [
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("6", "b"), ("6", "g"), ("8", "b"), ("9", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("$", "s"), ("@", "a"), ("+", "t"),
    ("c", "e"), ("e", "c"), ("o", "c"), ("c", "o"), ("l", "i"), ("i", "l"), ("l", "t"), ("f", "t"), ("t", "f"), ("u", "v"), ("v", "u"), ("h", "b"), ("b", "h"), ("n", "h"), ("n", "u"), ("u", "n"), ("a", "o"), ("o", "a"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"),
    ("rn", "m"), ("m", "rn"), ("nn", "m"), ("li", "h"), ("ii", "u"), ("ii", "n"), ("ri", "n"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("lc", "k"), ("tli", "th"), ("in", "m"), ("lt", "k"), ("fi", "h"), ("ll", "u"), ("lo", "b"), ("0", "d"), ("0", "q"), ("8", "a"), ("1", "t"),
]
MEANT: dict[str, list[str]] = defaultdict(list)
for _read, _meant in CONFUSIONS:
    MEANT[_read].append(_meant)
LONGEST = max(map(len, MEANT))
MEANINGS = sorted({m for _, m in CONFUSIONS})
DIGIT_FOR = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "G": "6", "b": "6", "g": "9", "q": "9"}

WORD = re.compile(r"[+|]?[^\W_]+(?:['’|!$@+][^\W_]+)*[+|]?")
BROKEN = re.compile(r"([^\W\d_][^\W_]*(?:['’][^\W_]+)*)([-‐­¬])\s*$")
NUMERAL = r"(?:[0-9OoIlS]{1,4}|[ivxlcIVXLC]{1,7})"
PAGE = re.compile(rf"(?:[Pp]a[gq9][ec]\.?|PA[G6]E|[Pp][gq9]\.?|[Pp]\.)\s*{NUMERAL}(?:\s*(?:/|of|oť|0f|OF)\s*{NUMERAL})?|{NUMERAL}\s*[|/]\s*{NUMERAL}|\[\s*{NUMERAL}\s*\]|[-–—]\s*{NUMERAL}\s*[-–—]")
BARE = re.compile(r"(?:\d{1,4}|[ivxlc]{1,7})\.?")
APART = r"(?:\s{2,}|\s+[-–—·]\s+)"
AHEAD = re.compile(rf"^({PAGE.pattern}|{BARE.pattern}){APART}(\S.*)$")
BEHIND = re.compile(rf"^(\S.*?){APART}({PAGE.pattern}|{BARE.pattern})$")

NOISE = "row_id bigint, line_no int, noise string"


# ---------------------------------------------------------------- corpus counts


MARKS = "-‐­¬"
COMPOUND = re.compile(r"\b[^\W\d_]+(?:-[^\W\d_]+)+")


def without_pieces(text: str) -> str:
    """The text without the first pieces of words divided at line ends."""
    if not any(f"{m}\n" in text for m in MARKS):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line and line[-1] in MARKS and (m := BROKEN.search(line)):
            lines[i] = line[: m.start()]
    return "\n".join(lines)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unigrams (b null) and bigrams of a batch, added up before they leave the task. Pieces of
    words at line ends count for nothing; whole compounds count as words of their own too."""
    for batch in batches:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            text = without_pieces((consistent(text) or "").lower())
            found = WORD.findall(text)
            words.update(found)
            pairs.update(zip(found, found[1:]))
            if "-" in text:
                words.update(c for t in text.split() if "-" in t for c in COMPOUND.findall(t))
        if words:
            yield pa.RecordBatch.from_pydict(
                {"a": [*words, *(k[0] for k in pairs)], "b": [*([None] * len(words)), *(k[1] for k in pairs)], "n": [*words.values(), *pairs.values()]},
                schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]),
            )


#: Times its expected slips up to which the occurrences of a suspect are taken for slips.
EXPLAINED = 3
#: Times that a word counts as seen though it isn't known.
UNSEEN = 0.01


def is_mixed(w: str) -> bool:
    """Whether a word has digits or signs among its letters."""
    return re.search(r"[^\W\d_]", w) is not None and re.search(r"[\d|!$@+]", w) is not None


Channel = dict[tuple[str, str], float]


def meanings(w: str, k: int, channel: Channel, vocabulary: list[str] | None = None) -> Iterator[tuple[str, float, tuple]]:
    """(v, log channel probability, confusions) of all strings v that exactly k confusions, at places of
    their own, may have made w of; of a sorted vocabulary, if one is given, all that can begin with
    what is read so far decide whether a path goes on, so nothing is cut off."""
    todo = [(0, "", k, 0.0, ())]
    while todo:
        i, out, left, p, used = todo.pop()
        if i == len(w):
            if not left and (vocabulary is None or ((at := bisect_left(vocabulary, out)) < len(vocabulary) and vocabulary[at] == out)):
                yield out, p, used
            continue
        if len(w) - i < left:
            continue
        steps = [(1, w[i], left, p, used)]
        for size in range(1, LONGEST + 1) if left else ():
            read = w[i : i + size]
            if len(read) == size:
                steps += [(size, m, left - 1, p + channel.get((read, m), LOG_ERROR), (*used, (read, m))) for m in MEANT.get(read, ())]
        for size, m, rest, q, u in steps:
            v = out + m
            if vocabulary is None or ((at := bisect_left(vocabulary, v)) < len(vocabulary) and vocabulary[at].startswith(v)):
                todo.append((i + size, v, rest, q, u))


LOG_ERROR = math.log(ERROR)


def is_plain_word(v: str) -> bool:
    return len(v) > 1 and v.replace("-", "").replace("'", "").isalpha()


class Model:
    """Known words, pairs, the channel, and the reader that corrects lines."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int, rare: dict[str, int] | None = None, longest: int | None = None, channel: Channel | None = None, suspects: frozenset[str] = frozenset()):
        self.words, self.pairs, self.total = words, pairs, max(1, total)
        self.counts = words | (rare or {})  # of words below the known share too
        self.vocabularies = [sorted(self.counts)]
        self.longest = (max(map(len, self.counts), default=0) if longest is None else longest) + 4  # no confusions shorten a word by more
        self.channel = channel or {}
        self.suspects = suspects  # known words that may be frequent slips of commoner ones
        self.figures = sum(n for w, n in words.items() if w.isdigit())
        self.asked: set[str] | None = None  # where set: what is looked up though not known
        self.options: dict[str, list[tuple[str, float]]] = {}  # what was found already, whoever asks
        self.clean: set[str] = set()  # words that can only be meant as they stand

    def add_rare(self, counts: dict[str, int]) -> None:
        """Counts that rows bring along; they hold all that the words of these rows may stand for."""
        self.counts = self.words | counts
        self.vocabularies[1:] = [sorted(counts)]
        self.options.clear()
        self.clean.clear()

    def found(self, w: str) -> dict[str, tuple[float, tuple]]:
        """Commoner known words that one confusion leads to, two in a word that is not known, three
        where it has digits among its letters, with channel probability and confusions: those of
        the fewest confusions that lead to any."""
        mixed = is_mixed(w)
        least = self.counts.get(w, 1) * (1 if mixed else COMMONER)
        out: dict[str, tuple[float, tuple]] = {}
        for k in range(1, (3 if mixed else 1 if w in self.words else 2) + 1):
            for vocabulary in self.vocabularies:
                for v, q, used in meanings(w, k, self.channel, vocabulary):
                    if v != w and self.counts[v] > least and is_plain_word(v) and (v not in out or q > out[v][0]):
                        out[v] = q, used
            if out:
                break
        return out

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """(meant word, log channel probability): the word itself and what is found for it; a word with
        digits among its letters is not itself a candidate where it has others, however often it
        is read so, and a suspect only as often as the channel doesn't explain."""
        if self.asked is not None and w not in self.words:
            self.asked.add(w)
        if w in self.options:
            return self.options[w]
        if len(w) > self.longest:
            return [(w, 0.0)]
        # Below the known share a word has no likelihood but as a candidate: its own is added here.
        found = self.found(w)
        out = [(v, q if v in self.words else q + math.log((self.counts[v] + UNSEEN) / UNSEEN)) for v, (q, _) in found.items()]
        if not (out and is_mixed(w)):
            n = self.words.get(w, 0)
            slips = EXPLAINED * max((self.counts[v] * math.exp(q) for v, (q, _) in found.items()), default=0.0)
            out.append((w, math.log((max(0.0, n - slips) + UNSEEN) / (n + UNSEEN))))
        if len(self.options) < 500_000:
            self.options[w] = out
        return out

    def is_figure(self, read: str, meant: str) -> bool:
        """Whether a figure with letters for digits is meant as one: the channel's probability times
        that of a figure, against the likelihood of what is read."""
        chance = sum(self.channel.get((a.lower(), b), LOG_ERROR) for a, b in zip(read, meant) if a != b)
        own = self.counts.get(read.lower(), 0) if any(c.isdigit() for c in read) else 0  # letters alone stand before %, where no word does
        return chance + math.log(self.figures + 1.0) > math.log(own + UNSEEN)

    def likelihood(self, before: str, w: str) -> float:
        """Log probability of a word after another one. Pairs with a suspect aren't heard: where a
        slip is frequent its own neighbours would speak for it."""
        n = self.words.get(w, 0)
        uni = (n + UNSEEN) / (self.total + 1)
        b = self.words.get(before, 0) if before else 0
        pair = self.pairs.get((before, w), 0) / b if b and w not in self.suspects and before not in self.suspects else 0.0
        return math.log(0.7 * min(1.0, pair) + 0.3 * uni)

    def read(self, words: list[str]) -> list[str]:
        """Viterbi over the candidates of a line's words."""
        if self.clean.issuperset(words):
            return words
        options = [self.candidates(w) for w in words]
        if all(len(o) == 1 for o in options):
            out = [o[0][0] for o in options]
            if len(self.clean) < 500_000:
                self.clean.update(w for w, v in zip(words, out) if w == v)
            return out
        states = {"": (0.0, [])}
        for o in options:
            nxt = {}
            for v, channel in o:
                score, path = max(((s + self.likelihood(b, v) + channel, p) for b, (s, p) in states.items()), key=lambda x: x[0])
                nxt[v] = (score, [*path, v])
            states = nxt
        return max(states.values(), key=lambda x: x[0])[1]

    def is_division(self, a: str, b: str, mark: str) -> bool:
        """Whether a and b are one word divided at the line end rather than a compound."""
        if self.asked is not None:
            self.asked.update({a + b, f"{a}-{b}", a, b} - self.words.keys())
        joined, compound = self.counts.get(a + b, 0), self.counts.get(f"{a}-{b}", 0)
        if joined or compound:
            return joined >= compound
        if mark != "-":
            return True
        meant = self.candidates(a + b)
        if meant[0][0] != a + b:
            return True
        whole_a, whole_b = self.counts.get(a, 0), self.counts.get(b, 0)
        return not (whole_a >= 5 and whole_b >= 5)


def _slips(shared: object) -> object:
    """Matcher of counted words (a, n): which confusions the words show that have one meaning only (read,
    meant, n), how often the characters stand where nothing is confused ("", meant, n), and which
    words are suspects (read null, the word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            out: Counter = Counter()
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = model.found(w) if len(w) <= model.longest else {}
                mixed = is_mixed(w)
                if found and not mixed and w in model.words:
                    out[None, w] += n
                if len(found) == 1:
                    out.update({x: n for x in next(iter(found.values()))[1]})
                figure = "".join(DIGIT_FOR.get(c, c) for c in w)
                if mixed and not found and figure.isdigit():
                    out.update({(a, b): n for a, b in zip(w, figure) if a != b})
                if not found:
                    out.update({("", m): n * k for m in MEANINGS if (k := w.count(m))} | {("", c): n * w.count(c) for c in set(w) if c.isdigit()})
            if out:
                yield pa.RecordBatch.from_pydict({"read": [a for a, _ in out], "meant": [b for _, b in out], "n": list(out.values())}, schema=pa.schema([("read", pa.string()), ("meant", pa.string()), ("n", pa.int64())]))

    return run


def _channel(rows: list[tuple[str, str, int]]) -> Channel:
    """Log probability of each confusion seen: its count over the places of its character, the prior
    beside them."""
    places = {m: n for r, m, n in rows if r == ""}
    seen = {(r, m): n for r, m, n in rows if r}
    chance = lambda read, m: (seen.get((read, m), 0) + PRIOR * ERROR) / (places.get(m, 0) + seen.get((read, m), 0) + PRIOR)
    return {x: math.log(chance(*x)) for x in {*CONFUSIONS, *seen}}


def learn(texts: DataFrame) -> tuple[Model, DataFrame | None]:
    """The model over all texts (one string column). What is known is a fixed share of all words,
    so the size that is broadcast is bounded however large the corpus is. Rarer words seen twice at
    least go with it where they are few; else they are a table (a, n) that is joined to the rows.
    Confusion probabilities and suspects are worked out from all counted words, once."""
    counts = spread(texts).mapInArrow(_counts, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    n, single = F.col("n"), F.col("b").isNull()
    counts = counts.where((n >= LEAST_COUNT) | (single & (n >= 2)))
    counts = counts.persist()
    try:
        sums = F.coalesce(F.sum(F.when(n >= LEAST_COUNT, n)), F.lit(0)).alias("total"), F.max(F.when(F.length("a") <= LONGEST_WORD, F.length("a"))).alias("longest")
        total, longest = counts.where(single).agg(*sums).collect()[0]
        least = max(LEAST_COUNT, math.ceil(KNOWN_SHARE * total))
        rows = counts.where(n >= least).collect()
        rare = counts.where(single & (n < least)).select("a", "n")
        table = None if fits(rare, RARE_ROWS) else checkpointed(rare)
        few = {r["a"]: r["n"] for r in rare.collect()} if table is None else {}
        words = {r["a"]: r["n"] for r in rows if r["b"] is None}
        pairs = {(r["a"], r["b"]): r["n"] for r in rows if r["b"] is not None}
        longest = max(longest or 0, max(map(len, words), default=0))
        # What a known word may be a slip of is commoner, so known itself: suspects need the known words alone.
        shared = texts.sparkSession.sparkContext.broadcast((words, {}, total, None, longest))
        told = counts.where(single).select("a", "n").mapInArrow(_slips(shared), "read string, meant string, n bigint").groupBy("read", "meant").agg(F.sum("n").alias("n")).collect()
    finally:
        counts.unpersist()
    suspects = frozenset(r["meant"] for r in told if r["read"] is None)
    channel = _channel([tuple(r) for r in told if r["read"] is not None])
    return Model(words, pairs, total, few, longest, channel, suspects), table


# ---------------------------------------------------------------- lines


NUMBERED = re.compile(r"\d|^\s*[ivxlcIVXLC]+\.?\s*$|(?:\s{2,}|[-–—|·/\[]\s*)[ivxlcIVXLCOoSl]+\s*[-–—\]]?\s*$|^\s*[ivxlcIVXLC]+(?:\s{2,}|\s+[-–—|·])|(?i:^\s*\[|\bp[agq9.])")


OPENS, CLOSES = frozenset("0123456789[-–—|pPivxlcIVXLCOoS"), frozenset("0123456789]-–—ivxlcIVXLCOoSl")


def page_part(line: str) -> tuple[str | None, str]:
    """(page number, rest) of a line: the whole line, or one end of it parted by blanks or a dash."""
    s = line.strip()
    if not s or (s[0] not in OPENS and s[-1] not in CLOSES) or not NUMBERED.search(s):
        return None, s
    if PAGE.fullmatch(s) or BARE.fullmatch(s):
        return s, ""
    for pattern, number, rest in ((AHEAD, 1, 2), (BEHIND, 2, 1)):
        if m := pattern.match(s):
            return m[number], m[rest].strip(" -–—|·\t")
    return None, s


def alike(a: str, b: str) -> bool:
    """Equal but for a few misread characters; lines longer than any header must be equal."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 2 or len(a) > 200:
        return False
    most = max(1, min(len(a), len(b)) // 9)
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    # What differs is compared in full where it is short; lines that differ at both ends are no match
    # unless their places agree nearly everywhere.
    if len(a) == len(b):
        return sum(map(ne, a, b)) <= most
    return max(len(a), len(b)) <= 3 * most + 2 and distance(a, b)[0] <= most


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def value_of(number: str) -> int | None:
    s = number.strip(" .")
    if s.isdigit():
        return int(s)
    if re.fullmatch("[ivxlc]+", s):
        v = [ROMAN[c] for c in s]
        return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))
    return None


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """(running headers, page numbers) as line indices. A header is a line, its page number
    taken off, that stands at the head of the text and again further on. A bare figure is a
    page number at either end of the text, next to a header, or in sequence with others, but
    not inside label words set one to a line (AGED / 8 / YEARS)."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    if not filled:
        return set(), set()
    parts = {i: page_part(lines[i]) for i in filled}
    heads: set[int] = set()
    for first in filled[:2]:
        core = parts[first][1]
        if len(core) < 4 or (first != filled[0] and parts[filled[0]][0] is None):
            continue
        same = [i for i in filled if alike(parts[i][1], core)]
        if len(same) > 1:
            heads.update(same)
    if heads:
        heads |= other_sides(filled, parts, heads)
    numbers: set[int] = set()
    bare: list[int] = []
    for i in filled:
        number, rest = parts[i]
        if number is None:
            continue
        if rest and i not in heads:
            # beside other words only where they are a header elsewhere or the number is no bare figure at the text's head
            if not (PAGE.fullmatch(number) and i in filled[:1]):
                continue
        if PAGE.fullmatch(number) or rest:
            numbers.add(i)
        else:
            bare.append(i)
    place = {i: k for k, i in enumerate(filled)}

    def label_word(k: int) -> bool:
        return 0 <= k < len(filled) and re.fullmatch(r"[A-Z0-9]{2,10}", lines[filled[k]].strip()) is not None

    free = [i for i in bare if not (label_word(place[i] - 1) and label_word(place[i] + 1))]
    values = {i: value_of(parts[i][0]) for i in free}
    for k, i in enumerate(free):
        near = [values[j] for j in free[max(0, k - 1) : k + 2] if j != i and values[j] is not None]
        in_sequence = values[i] is not None and any(abs(values[i] - v) == 1 for v in near)
        at_end = i in (filled[0], filled[-1])
        by_header = any(0 <= place[i] + s < len(filled) and filled[place[i] + s] in heads for s in (-1, 1))
        after_blank = (i > 0 and not lines[i - 1].strip()) or (i + 1 < len(lines) and not lines[i + 1].strip())
        inside = place[i] > 0 and not label_word(place[i] - 1) and re.search(r"[a-z]{2}", lines[filled[place[i] - 1]]) is not None
        if in_sequence or at_end or by_header or after_blank or inside:
            numbers.add(i)
    return heads, numbers


def other_sides(filled: list[int], parts: dict[int, tuple[str | None, str]], heads: set[int]) -> set[int]:
    """Headers of the pages between (left and right pages may differ): a line that comes again
    after the first header, never beside the same neighbour, as repeated passages do."""
    lines = [i for i in filled if i not in heads and len(parts[i][1]) >= 4]
    place = {i: k for k, i in enumerate(lines)}
    by: dict[str, list[int]] = defaultdict(list)
    for i in lines:
        by[parts[i][1]].append(i)
    out: set[int] = set()
    for core, at in by.items():
        if len(at) < 2 or at[0] < min(heads):
            continue
        beside = Counter(parts[lines[k]][1] for i in at for k in (place[i] - 1, place[i] + 1) if 0 <= k < len(lines) and parts[lines[k]][1])
        between = all(any(a < h < b for h in heads) for a, b in zip(at, at[1:]))
        if between and max(beside.values(), default=0) < 2:
            out.update(i for i in lines if alike(parts[i][1], core))
    return out


TOUCHING = re.compile(r"[0-9%](?:(?<=[0-9])[.,]?[A-Za-z|]|(?<=[A-Za-z|][0-9])|(?<=[A-Za-z|][.,][0-9])|(?<=[OlISBZo|]%))")
FIGURE = re.compile(r"[0-9OoQDlIi|SsBZzGbgq]+(?:[.,][0-9OoQlI|SsBZ]+)?")


def odd_figure(line: str) -> list[tuple[int, int, str]]:
    """(start, end, meant) of figures with letters among or for their digits."""
    out: list[tuple[int, int, str]] = []
    if "|" in line:  # a lone bar for a one before a unit
        out += [(m.start(), m.end(), "1") for m in re.finditer(r"(?<!\S)\|(?=\s+(?:L|ML|FL OZ)\b)", line)]
    if not TOUCHING.search(line):
        return out
    for m in FIGURE.finditer(line):
        s, a, b = m.group(), m.start(), m.end()
        before, after = line[a - 1 : a], line[b : b + 1]
        if (before and (before.isalnum() or before in "'’")) or (after and (after.isalnum() or after in "'’")):
            continue
        letters = [c for c in s if c.isalpha() or c == "|"]
        digits = [c for c in s if c.isdigit()]
        if not letters:
            continue
        if not digits and not (after == "%" and len(s) <= 4 and all(c in "OlISBZo|" for c in letters)):
            continue
        if len(letters) > max(1, len(digits)) and after != "%":
            continue
        if re.fullmatch(r"\d{1,2}(?:[.,]\d+)?[lL]", s) and after != "%":
            continue  # litres
        if re.fullmatch(r"\d+(?:s|th|st|nd|rd|g|b|B|z|G)", s) and after != "%":
            continue
        out.append((a, b, "".join(DIGIT_FOR.get(c, c) for c in s)))
    return out


def read_line(model: Model, line: str, skip: set[int] = frozenset()) -> tuple[list[tuple[int, int, str]], bool]:
    """Corrections (start, end, meant) of a line and whether there are any. skip: starts of
    words that are only pieces."""
    fixes = [(a, b, meant) for a, b, meant in odd_figure(line) if model.is_figure(line[a:b], meant)]
    if not fixes and not skip and model.clean.issuperset(WORD.findall(line.lower())):
        return fixes, False
    taken = {k for a, b, _ in fixes for k in range(a, b)}
    found = [(m.start(), m.end(), m.group()) for m in WORD.finditer(line) if m.start() not in taken and m.start() not in skip]
    words = [w.lower() for _, _, w in found]
    for (a, b, w), meant in zip(found, model.read(words)):
        if meant != w.lower() and not (w.isdigit()):
            fixes.append((a, b, like(w, meant)))
    return fixes, bool(fixes)


def like(seen: str, meant: str) -> str:
    """The meant word in the case of what was seen."""
    letters = [c for c in seen if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) > len(letters) / 2 and len(letters) > 1:
        return meant.upper()
    return meant.capitalize() if (seen[:1].isupper() or (not seen[:1].isalpha() and len(letters) == 0)) else meant


def apply(line: str, fixes: list[tuple[int, int, str]]) -> str:
    for a, b, s in sorted(fixes, reverse=True):
        line = line[:a] + s + line[b:]
    return line


FIRST = re.compile(r"^\s*([^\W_]+(?:['’][^\W_]+)*)")


def examine(model: Model, text: str, repair: bool = True) -> tuple[list[tuple[int, str]], str]:
    """Noise of a text as (line_no, noise) and, if asked for, the repaired text."""
    lines = (consistent(text) or "").split("\n")
    heads, numbers = furniture(lines)
    noise: list[tuple[int, str]] = [(i + 1, "running_header") for i in heads] + [(i + 1, "page_number") for i in numbers]
    content = [i for i in range(len(lines)) if lines[i].strip() and i not in heads and i not in numbers]
    fixed = dict.fromkeys(range(len(lines)), "")
    joins: dict[int, tuple[int, str, bool]] = {}
    skip: dict[int, set[int]] = defaultdict(set)
    bad: set[int] = set()
    for k, i in enumerate(content[:-1]):
        if lines[i].rstrip()[-1] not in MARKS:
            continue
        m = BROKEN.search(lines[i])
        n = FIRST.match(lines[content[k + 1]]) if m else None
        if not m or not n:
            continue
        a, b = m[1].lower(), n[1].lower()
        divided = model.is_division(a, b, m[2])
        if divided:
            noise.append((i + 1, "hyphenation"))
            skip[i].add(m.start(1))
            skip[content[k + 1]].add(n.start(1))
            joined = a + b
            meant = model.read([joined])[0] if joined not in model.words else joined
            if meant != joined:
                if not meant.startswith(a):
                    bad.add(i)
                if not meant.endswith(b):
                    bad.add(content[k + 1])
            joins[i] = (content[k + 1], like(m[1] + n[1], meant) if meant != joined else m[1] + n[1], True)
        else:
            joins[i] = (content[k + 1], m[1] + "-" + n[1], False)
            skip[i].add(m.start(1))
            fixes, _ = read_line(model, m[1])
            if fixes:
                bad.add(i)
    for i in [j for j in range(len(lines)) if lines[j].strip()]:
        if i in numbers and i not in heads:
            fixed[i] = lines[i]
            continue
        target = page_part(lines[i])[1] if i in heads and i in numbers else lines[i]
        fixes, any_fix = read_line(model, target, skip.get(i, set()))
        if any_fix:
            bad.add(i)
        fixed[i] = apply(target, fixes) if fixes else target
    noise += [(i + 1, "misread") for i in sorted(bad)]
    return sorted(set(noise)), paragraphs(lines, fixed, content, joins) if repair else ""


def paragraphs(lines: list[str], fixed: dict[int, str], content: list[int], joins: dict[int, tuple[int, str, bool]]) -> str:
    """Content lines folded: a line runs on where it is as wide as its block or ends mid-sentence
    before a small letter; blank lines that aren't at a page break end a paragraph."""
    out: list[str] = []
    carried = ""
    width = max((len(lines[i]) for i in content if re.search(r"[a-z]", lines[i])), default=0)
    for k, i in enumerate(content):
        s = fixed[i].strip()
        if carried:
            s = carried + FIRST.sub("", s, count=1)
            carried = ""
        if i in joins:
            s = BROKEN.sub("", s).rstrip()
            carried = joins[i][1]
        before = content[k - 1] if k else None
        between = range(before + 1, i) if before is not None else ()
        gap = any(not lines[j].strip() for j in between)
        page_break = any(lines[j].strip() for j in between)  # headers and page numbers
        mid_sentence = before is not None and re.match(r"\s*[a-z(]", lines[i]) and not re.search(r"[.!?:]\s*$", lines[before]) and (page_break or not gap)
        full = before is not None and not gap and len(lines[before]) >= 0.75 * width and re.search(r"[a-z]", lines[before]) and re.search(r"[a-z]", lines[i])
        runs_on = before is not None and out and (before in joins or mid_sentence or full)
        if runs_on:
            out[-1] = f"{out[-1]} {s}".strip()
        elif s or not carried:
            out.append(s)
        else:
            out.append("")
    if carried and out:
        out[-1] = f"{out[-1]} {carried}"
    return "\n".join(x for x in out)


def examine_preview(model: Model, text: str) -> tuple[list[tuple[int, str]], str]:
    """A preview is one line without its breaks, cut after 250 characters: its last word may be
    cut off and isn't judged."""
    line = consistent(text) or ""
    noise: list[tuple[int, str]] = []
    skip: set[int] = set()
    if len(text) >= 250 and (m := re.search(r"\S+$", line)):
        skip.update(range(m.start(), len(line)))
    spots = []
    misread = False
    for m in re.finditer(r"([^\W\d_][^\W_]*)([-‐­¬]) +([^\W\d_][^\W_]*)", line):
        if m.end() >= 249 and len(text) >= 250:
            whole = any(w.startswith((m[1] + m[3]).lower()) for w in model.words)
            divided = m[2] != "-" or whole
        else:
            divided = model.is_division(m[1].lower(), m[3].lower(), m[2])
        skip.update((m.start(1), m.start(3)))
        spots.append((m.start(), m.end(), m[1] + ("" if divided else "-") + m[3]))
        if divided:
            noise.append((1, "hyphenation"))
            joined = (m[1] + m[3]).lower()
            if m.end() < 249 and joined not in model.words and model.read([joined])[0] != joined:
                misread = True
    fixes, some = read_line(model, line, skip)
    if some or misread:
        noise.append((1, "misread"))
    return sorted(set(noise)), re.sub(r" {2,}", "\n", apply(line, [f for f in fixes if not any(a <= f[0] < b for a, b, _ in spots)] + spots))


# ---------------------------------------------------------------- operators


def _texts(batch: DataFrame) -> DataFrame:
    return batch.select(F.coalesce("detected_text", "ocr_text_preview").alias("text")).where(F.col("text").isNotNull())


def _with_rare(rows: DataFrame, shared: object, rare: DataFrame) -> DataFrame:
    """Rows with the counts of the rare words that reading them may ask for, as a map: the words
    looked up in vain are written down per row, what confusions may have made them of is
    found once per word, and both meet the full counts in equality joins."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            ids, words = [], []
            for row_id, text, preview in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own.asked = set()
                own.clean.clear()  # its words would not be asked for again
                own.options.clear()
                if text is not None:
                    examine(own, text, False)
                elif preview is not None:
                    examine_preview(own, preview)
                ids += [row_id] * len(own.asked)
                words += own.asked
            yield pa.RecordBatch.from_pydict({"row_id": pa.array(ids, pa.int64()), "w": pa.array(words, pa.string())})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = shared.value[4] + 4
        for b in batches:
            for w in b.column(0).to_pylist():
                levels = (3 if is_mixed(w) else 2) if len(w) <= longest else 0
                found = {w}.union(v for k in range(1, levels + 1) for v, _, _ in meanings(w, k, {}))
                yield pa.RecordBatch.from_pydict({"w": [w] * len(found), "a": list(found)}, schema=pa.schema([("w", pa.string()), ("a", pa.string())]))

    asked = checkpointed(spread(rows).mapInArrow(ask, "row_id bigint, w string"))
    needed = spread(asked.select("w").distinct()).mapInArrow(reach, "w string, a string").join(rare, "a")
    own = asked.join(needed, "w").select("row_id", "a", "n").distinct().groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("rare"))
    return rows.join(own.withColumnRenamed("row_id", "_id"), F.col("row_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def _pass(batch: DataFrame, learned: tuple[Model, DataFrame | None], ddl: str, schema: pa.Schema, emit: object, repair: bool) -> DataFrame:
    model, table = learned
    few = {w: n for w, n in model.counts.items() if w not in model.words}
    shared = batch.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.total, few, model.longest - 4, model.channel, model.suspects))
    rows = batch.select("row_id", "detected_text", "ocr_text_preview")
    rows = rows if table is None else _with_rare(rows, shared, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            if b.num_columns > 3:
                own.add_rare({w: n for found in b.column(3).to_pylist() for w, n in found or ()})
            for row_id, text, preview in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if text is not None:
                    noise, clean = examine(own, text, repair)
                elif preview is not None:
                    noise, clean = examine_preview(own, preview)
                else:
                    continue
                for row in emit(row_id, noise, clean):
                    for col, v in zip(out, row):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return spread(rows).mapInArrow(run, ddl)


def noisy_lines(batch: DataFrame) -> DataFrame:
    """(row_id, line_no, noise): one row per noisy line and kind. Rows without any text give
    none; repeated rows give repeated results; extra columns are ignored."""
    schema = pa.schema([("row_id", pa.int64()), ("line_no", pa.int32()), ("noise", pa.string())])
    return _pass(batch, learn(_texts(batch)), NOISE, schema, lambda r, noise, _: [(r, n, k) for n, k in noise], False)


def repaired(batch: DataFrame) -> DataFrame:
    """(row_id, repaired_text, n_noisy): continuous paragraphs without page furniture, words
    joined and corrected. Rows without any text are left out."""
    schema = pa.schema([("row_id", pa.int64()), ("repaired_text", pa.string()), ("n_noisy", pa.int32())])
    return _pass(batch, learn(_texts(batch)), "row_id bigint, repaired_text string, n_noisy int", schema, lambda r, noise, clean: [(r, clean, len(noise))], True)
