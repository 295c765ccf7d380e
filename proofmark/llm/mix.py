"""Mixing sources to target shares of the total tokens, without sorting the corpus.

Every distinct text gets a 60-bit hash. Tokens are summed by source and hash bucket; on that
small histogram the budget of a source falls into one bucket, which alone is refined by the
next bits, level by level, down to single hash values. What is left is one hash threshold per
source, and the mix is a filter: texts below it are used once more than those above.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.runtime import checkpointed, fits, spread

#: Bits of the hash, and how many of them one level of the histogram resolves.
HASH_BITS, BITS = 60, 12
#: Targets are few; more are refused, for their thresholds travel in the plan.
MAX_SOURCES = 100
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> object:
    """A public byte-level BPE vocabulary given as ranks; read where it lies, never copied."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """texts(doc_id, source, digest, text) -> (doc_id, source, digest, n_tokens), counted where the
    texts stand: no text is ever shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("digest", pa.binary()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t)) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(schema.types[i]) for i in range(3)), n], schema=schema)

    return spread(texts.select("doc_id", "source", "digest", "text")).mapInArrow(count, "doc_id bigint, source string, digest binary, n_tokens bigint")


def hashed(digest: Column) -> Column:
    """HASH_BITS bits, not negative."""
    return F.shiftrightunsigned(F.xxhash64(digest), 64 - HASH_BITS)


def distinct_texts(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Distinct non-empty texts of targeted sources: (source, text_id, h, n_tokens), each under the
    source of its copy with the smallest doc_id, so that copies under other sources add no use.

    Texts are told apart by a 128-bit digest. Only ids, sources, digests and counts are shuffled, once and
    pre-aggregated, so a text that a third of all rows copy is one group of few rows.
    """
    wanted = targets.select("source").distinct()
    docs = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).join(F.broadcast(wanted) if fits(wanted, MAX_SOURCES) else wanted, "source", "left_semi")
    counted = with_tokens(docs.select("doc_id", "source", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text"), path)
    first = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("f"))
    return first.select("f.source", F.col("f.doc_id").alias("text_id"), hashed(F.col("digest")).alias("h"), "f.n_tokens")


def thresholds(tokens: DataFrame, budgets: dict[str, int]) -> dict[str, int | None]:
    """For each source the greatest hash such that the tokens of the texts up to it stay within
    the budget (null: none fits). A level sums tokens in 2^BITS buckets of the bucket that the
    level before left open, so at most sources x 2^BITS sums reach the driver."""
    done: dict[str, int | None] = {}
    low = dict.fromkeys(budgets, 0)  # first hash of the open bucket
    left = dict(budgets)
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        if not left:
            break
        parent, width = 1 << (shift + BITS), 1 << shift
        is_open = F.lit(False)
        for s in left:
            is_open = is_open | ((F.col("source") == s) & F.col("h").between(F.lit(low[s]), F.lit(low[s] + parent - 1)))
        bucket = F.shiftright("h", shift)
        rows = tokens.where(is_open).groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("n")).collect()
        by: dict[str, list[tuple[int, int]]] = {s: [] for s in left}
        for r in rows:
            by[r["source"]].append((int(r["b"]), int(r["n"])))
        for s in list(left):
            end = low[s] + parent
            for b, n in sorted(by[s]):
                if n > left[s]:
                    low[s] = b * width
                    break
                left[s] -= n
            else:  # all of the open bucket fits
                low[s] = end
                del left[s]
    for s in budgets:
        done[s] = low[s] - 1 if low[s] else None
    return done


def mix_plan(tokens: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[list[dict], int]:
    """Per target its available tokens, budget, uses and threshold; and the total.

    Without a given total it is the greatest at which every source that has texts reaches its
    share within max_repeats. Shares of sources without texts go to the others in proportion;
    a source that can't reach its budget gives all it may, which the report shows. Of a source
    named twice in the targets the first by share counts; null shares and repeats count as 0.
    """
    if not fits(targets, MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} mixing targets")
    rows = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in sorted(targets.where(F.col("source").isNotNull()).collect(), key=lambda r: r["target_share"] or 0.0)}
    have = {r["source"]: (int(r["n"]), r["k"]) for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()}
    usable = {s for s, (share, cap) in rows.items() if share > 0 and cap > 0 and have.get(s, (0, 0))[0] > 0}
    whole = sum(rows[s][0] for s in usable) or 1.0
    share = {s: rows[s][0] / whole for s in usable}
    if total is None:
        total = int(min((rows[s][1] * have[s][0] / share[s] for s in usable), default=0))
    plan = []
    for s, (target, cap) in sorted(rows.items()):
        n, k = have.get(s, (0, 0))
        want = min(int(share[s] * total), cap * n) if s in usable else 0
        plan.append({"source": s, "target_share": target, "max_repeats": cap, "have": n, "n_texts": k, "budget": want, "base": want // n if n else 0, "rest": want % n if n else 0})
    cuts = thresholds(tokens, {p["source"]: p["rest"] for p in plan if p["rest"]})
    for p in plan:
        p["cut"] = cuts.get(p["source"])
    return plan, total


def mixed(tokens: DataFrame, plan: list[dict]) -> DataFrame:
    """(text_id, source, n_tokens, uses): a filter on the thresholds; unused texts are left out."""
    uses = F.lit(0)
    for p in plan:
        extra = F.when(F.col("h") <= F.lit(p["cut"]), 1).otherwise(0) if p["cut"] is not None else F.lit(0)
        uses = F.when(F.col("source") == p["source"], F.lit(int(p["base"])) + extra).otherwise(uses)
    return tokens.select("text_id", "source", "n_tokens", uses.cast("int").alias("uses")).where(F.col("uses") > 0)


def token_table(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Distinct texts with their tokens, written once to the shared checkpoint folder since the
    histogram levels and the final filter read it again."""
    return checkpointed(distinct_texts(documents, targets, path))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = TOKENIZER) -> DataFrame:
    tokens = token_table(documents, targets, path)
    plan, _ = mix_plan(tokens, targets, total)
    return mixed(tokens, plan)


def mix_report(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = TOKENIZER) -> DataFrame:
    """Per target: texts and tokens there are, tokens used, the most uses of a text, target and
    actual share."""
    tokens = token_table(documents, targets, path)
    plan, _ = mix_plan(tokens, targets, total)
    got = mixed(tokens, plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"), F.count("*").alias("texts_used"))
    spark = tokens.sparkSession
    base = spark.createDataFrame([(p["source"], float(p["target_share"]), int(p["max_repeats"]), int(p["n_texts"]), int(p["have"])) for p in plan], "source string, target_share double, max_repeats int, n_texts bigint, tokens_held bigint")
    out = base.join(got, "source", "left").na.fill(0)
    whole = out.agg(F.sum("tokens_used").alias("_all"))
    n = whole.collect()[0]["_all"] or 1
    return out.withColumn("actual_share", F.col("tokens_used") / F.lit(float(n)))
