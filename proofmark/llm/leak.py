"""Evaluation passages found inside a large corpus, whole, in part, and slightly changed.

Greedy string tiling. Seeds: runs of three words that an item and a document share. Both sides are
hashed once by a running Karp-Rabin hash and joined on it, the words themselves compared. Seeds on
one diagonal grow into maximal matches; the longest are marked first and none overlaps another.
Tiles in the item's order, parted by no more than a few changed words, form a stretch; the
stretch and the tiles in it must cover enough of the item. Tiles out of order count for `coverage`,
which also catches reordered passages.

Every document is read and hashed once, however many items there are. What leaves its task are the
seeds that a bitmap of all item seeds lets pass (of a fixed size at most; a chance hit costs a row
that the join drops), so the join shuffles neither texts nor seeds that no item has.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from proofmark.runtime import broadcast_if_small, checkpointed, spread

SEED = 3
#: Words a gap in a stretch may have on either side, and how far the two sides may differ.
GAP, SLIP = 12, 4
#: Least share of an item's words that the stretch spans, and that its tiles cover.
SPAN, COVER = 0.5, 0.35
#: Different seeds of items (some 60 bytes each) up to which they are broadcast; more are joined by shuffles.
SEEDS_BROADCAST = 200_000
#: Bits of the bitmap of item seeds for one seed, and of all of it at most (32 MB).
BITS_A_SEED, MOST_BITS = 32, 1 << 28
#: A document's seeds are hashed to 64 bits: codes of words times powers of BASE, modulo 2^64.
BASE = 1_000_003

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words; case, punctuation, blanks and line breaks don't matter. A word divided
    by a hyphen at a line end is joined."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    text = re.sub(r"[-‐­¬]\n\s*", "", text)
    return WORD.findall(text.replace("'", "").replace("’", "").replace("­", ""))


def running_hashes(words: list[str], n: int = SEED) -> np.ndarray:
    """Karp-Rabin hash of every run of n words, as signed 64-bit numbers: the window moves on by a
    product and a sum for all places at once."""
    if len(words) < n:
        return np.empty(0, np.int64)
    codes = np.fromiter((crc32(w.encode()) for w in words), np.uint64, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(BASE) + codes[k : len(words) - n + 1 + k]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def tiles(hits: list[tuple[int, int]], n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of seed hits (doc position, item position) with an item of n_item words:
    (doc, item, length) of the longest non-overlapping matches, longest first; ties by position.
    What a marked tile leaves of a match is offered again if it is as long as a seed."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    for q, p in hits:
        diagonals[q - p].append(q)
    runs: list[tuple[int, int, int]] = []
    for d, qs in diagonals.items():
        qs = sorted(set(qs))
        start = last = qs[0]
        for q in qs[1:] + [None]:
            if q is not None and q <= last + 1:
                last = q
                continue
            runs.append((last - start + SEED, start, start - d))
            if q is not None:
                start = last = q
    doc_used, item_used, out = set(), set(), []
    heap = [(-n, q, p) for n, q, p in runs]
    heapify(heap)
    while heap and len(item_used) <= n_item - SEED:
        n, q, p = heappop(heap)
        n = -n
        free = [k for k in range(n) if q + k not in doc_used and p + k not in item_used]
        if len(free) == n:
            out.append((q, p, n))
            doc_used.update(range(q, q + n))
            item_used.update(range(p, p + n))
            continue
        k = 0
        while k < len(free):
            j = k
            while j + 1 < len(free) and free[j + 1] == free[j] + 1:
                j += 1
            if j - k + 1 >= SEED:
                heappush(heap, (-(j - k + 1), q + free[k], p + free[k]))
            k = j + 1
    return out


def stretch(found: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    """The best stretch of tiles in the item's order: (words covered, item words spanned, first
    and last document word)."""
    found = sorted(found)
    best, table = (0, 0, 0, 0), []
    for q, p, n in found:
        mine = (n, p, q)
        for (q2, p2, n2), (cover, first_p, first_q) in zip(found, table):
            dq, dp = q - q2 - n2, p - p2 - n2
            if 0 <= dq <= GAP and 0 <= dp <= GAP and abs(dq - dp) <= SLIP and cover + n > mine[0]:
                mine = (cover + n, first_p, first_q)
        table.append(mine)
        best = max(best, (mine[0], p + n - mine[1], mine[2], q + n - 1))
    return best


SEED_ROWS = "id bigint, text_key bigint, n_words int, h bigint, seed string, places array<int>"


def _seed_rows(bitmap: object, least_seeds: int) -> object:
    """Matcher of Arrow batches (id, text_key, text): one row per row and different seed, with its
    places. Seeds that the bitmap hasn't are left out, and texts left with fewer than least_seeds."""
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int32()), ("h", pa.int64()), ("seed", pa.string()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for row_id, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                hashes = running_hashes(words)
                at = np.arange(len(hashes))
                if bits is not None:
                    low = hashes & (8 * len(bits) - 1)
                    at = at[(bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1]
                places: dict[str, list[int]] = defaultdict(list)
                for q in at.tolist():
                    places[" ".join(words[q : q + SEED])].append(q)
                if len(places) < least_seeds:
                    continue
                for seed, qs in places.items():
                    for col, v in zip(out, (row_id, key, len(words), int(hashes[qs[0]]), seed, qs)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return run


def _bitmap(seeds: DataFrame) -> bytes:
    """Bitmap of the low bits of all item seeds, its size by their number up to MOST_BITS."""
    wanted = max(1 << 15, BITS_A_SEED * seeds.count())
    size = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    low = F.col("h").bitwiseAND(F.lit(size - 1))
    parts = seeds.groupBy(F.shiftright(low, 15).alias("part")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    whole = bytearray(size // 8)
    for r in parts.toLocalIterator():  # size / 2^15 parts of 4 KB at most
        whole[r["part"] << 12 : (r["part"] + 1) << 12] = r["bits"]
    return bytes(whole)


FOUND = StructType([*(StructField(c, DoubleType()) for c in ("coverage", "stretch_cover", "stretch_span")), *(StructField(c, IntegerType()) for c in ("first_word", "last_word"))])


@F.pandas_udf(FOUND)
def _tiled(n_item: pd.Series, hits: pd.Series) -> pd.DataFrame:
    rows = []
    for n, found in zip(n_item, hits):
        tiled = tiles([(q, p) for x in found for q in x["qs"] for p in x["ps"]], n)
        cover, span, a, b = stretch(tiled)
        rows.append((sum(k for _, _, k in tiled) / n, cover / n, span / n, a, b))
    return pd.DataFrame(rows, columns=FOUND.names).astype({"first_word": "int32", "last_word": "int32"})


_tiled = _tiled.asNondeterministic()  # a filter on its result runs it no second time


def shared_passages(documents: DataFrame, items: DataFrame, least: float = COVER) -> DataFrame:
    """One row per document and item whose tiles cover at least `least` of the item, with the
    best stretch. Null and empty texts and items without a seed match nothing; a row that is
    given again with the same id and text counts once. Extra columns are ignored."""
    keyed = lambda df, key: df.where(F.col(key).isNotNull() & (F.col("text") != "")).select(F.col(key).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    # Even unconnected seeds can't cover enough with fewer than this.
    least_seeds = F.ceil(F.col("n_words") * F.lit(least / SEED) - 1e-9) - (SEED - 1)
    seeds = checkpointed(spread(keyed(items, "item_id")).mapInArrow(_seed_rows(None, 1), SEED_ROWS).dropDuplicates(["id", "text_key", "h", "seed"]))
    fewest = seeds.agg(F.min(least_seeds)).first()[0]
    bitmap = seeds.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    docs = spread(keyed(documents, "doc_id")).mapInArrow(_seed_rows(bitmap, max(1, fewest or 1)), SEED_ROWS).select("id", "text_key", "h", "seed", "places")
    own = seeds.select("h", "seed", F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "n_words", F.col("places").alias("ps"))
    met = docs.join(broadcast_if_small(own, SEEDS_BROADCAST), ["h", "seed"])
    pairs = met.groupBy(F.col("id").alias("doc_id"), "text_key", "item_id", "item_key", "n_words").agg(F.collect_list(F.struct(F.col("places").alias("qs"), "ps")).alias("hits"))
    enough = F.size(F.array_distinct(F.flatten(F.col("hits.ps")))) >= least_seeds
    return pairs.where(enough).select("doc_id", "item_id", _tiled("n_words", "hits").alias("_t")).where(F.col("_t.coverage") >= least).select("doc_id", "item_id", "_t.*")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least half of the item as one stretch."""
    return shared_passages(documents, items).where((F.col("stretch_span") >= SPAN) & (F.col("stretch_cover") >= COVER)).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that leak it, that hold parts in another order (coverage of half, no
    stretch of half), and the greatest coverage; items that leak nowhere have zeros."""
    found = shared_passages(documents, items)
    leaks = (F.col("stretch_span") >= SPAN) & (F.col("stretch_cover") >= COVER)
    per = found.groupBy("item_id").agg(F.count_if(leaks).alias("n_leaks"), F.count_if(~leaks & (F.col("coverage") >= SPAN)).alias("n_reordered"), F.max("coverage").alias("most_coverage"))
    return items.select("item_id", "suite").join(per, "item_id", "left").na.fill(0)
