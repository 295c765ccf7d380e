"""Which address records denote the same premises.

Records are read into parts. Records that agree elsewhere (same number and ZIP code, say) but
not in one part give pairs of spellings for it; a pair that is statistically significant and
looks like an abbreviation or a slip becomes a rewrite of the rarer spelling to the commoner.
Parts are re-normalised and matched again until no new rewrite appears. Spellings that no record
agrees on are rewritten by the kinds of slip that the mined rewrites show. Then ZIP codes and
majorities fill what is absent, and equal number, direction, street, kind of street, town and state
are one premises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from proofmark.llm.address_parts import parse
from proofmark.llm.canonical import abbreviates, deletions, distance
from proofmark.runtime import checkpointed, release, tasks

PARTS = ["number", "direction", "street", "kind", "town", "state", "zip"]
#: Street names known to the reader: at least this share of all records, so 1 / share at most.
KNOWN_SHARE = 5e-5
#: Log-likelihood ratio of a pair (chi-square, one degree: p < 0.01).
SIGNIFICANT = 6.63
#: Spellings of one key up to which all are paired; more are paired by blocks.
FEW = 12


def address_records(rows: DataFrame) -> DataFrame:
    """One row per address_id; of differing texts the smallest. Null ids and texts are left out."""
    return rows.where(F.col("address_id").isNotNull() & F.col("name_address").isNotNull()).groupBy("address_id").agg(F.min("name_address").alias("name_address"))


def read_parts(records: DataFrame) -> DataFrame:
    """address_id and parts, read twice: the second time with the street names the first found."""
    schema = pa.schema([("address_id", pa.int64()), *((p, pa.string()) for p in PARTS)])
    ddl = "address_id bigint, " + ", ".join(f"{p} string" for p in PARTS)

    def reader(known: object) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = known.value if known is not None else None
            for b in batches:
                got = [parse(t, None, names) for t in b.column("name_address").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("address_id"), *(pa.array([g[p] for g in got], pa.string()) for p in PARTS)], schema=schema)

        return run

    records = records.repartition(tasks(records.sparkSession))  # reading is heavy beside the bytes
    first = records.mapInArrow(reader(None), ddl)
    counts = first.where(F.col("kind").isNotNull() & F.col("street").isNotNull()).groupBy("street").agg(F.count("*").alias("n"))
    counts = checkpointed(counts)
    whole = counts.agg(F.sum("n")).first()[0] or 0
    names = {r["street"]: r["n"] for r in counts.where(F.col("n") >= max(3.0, KNOWN_SHARE * whole)).collect()}
    return records.mapInArrow(reader(records.sparkSession.sparkContext.broadcast(names)), ddl)


def _alike(a: str, b: str) -> bool:
    """b may be meant by a: an abbreviation, or a slip in a word of some length."""
    x, y = a.replace(" ", ""), b.replace(" ", "")
    words = list(zip(a.split(), b.split())) if a.count(" ") == b.count(" ") else []
    if words and all(p == q or abbreviates(p.lower(), q.lower()) for p, q in words):
        return True
    if b == f"SAINT {a}":  # `Main St St Ives` with one ST left out
        return True
    edits = distance(x, y)[0]
    return edits <= (2 if min(len(x), len(y)) >= 5 else 1)


def _significant(n_ab: float, n_a: float, n_b: float, n: float) -> bool:
    """Log-likelihood ratio of seeing b in n_ab of the n_a places of a, b having share n_b / n."""
    p, q = min(1.0, n_ab / max(n_a, n_ab)), min(max(n_b / n, 1e-12), 1 - 1e-12)
    if p <= q:
        return False
    k, m = n_ab, max(n_a, n_ab)
    llr = 2 * (k * math.log(p / q) + ((m - k) * math.log((1 - p) / (1 - q)) if m > k else 0.0))
    return llr >= SIGNIFICANT


@F.pandas_udf(BooleanType())
def _rewrite_holds(a: pd.Series, b: pd.Series, n_ab: pd.Series, n_a: pd.Series, n_b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([bool(_alike(*x[:2]) and _significant(*x[2:])) for x in zip(a, b, n_ab, n_a, n_b, n)], dtype=bool)


def _spellings(parts: DataFrame) -> DataFrame:
    """(part, v, state) of all streets and towns."""
    both = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("v"), F.col("state").alias("state")) for p in ("street", "town")])
    return parts.select(F.explode_outer(both).alias("x")).select("x.*").where(F.col("v").isNotNull())


def spelling_totals(parts: DataFrame) -> dict[str, float]:
    """How many records tell a street, and a town; rewriting doesn't change it."""
    return parts.agg(F.count("street").cast("double").alias("street"), F.count("town").cast("double").alias("town")).first().asDict()


def mine(parts: DataFrame, totals: dict[str, float]) -> DataFrame:
    """(part, old, new): rewrites of streets and towns from records that agree elsewhere, that is on
    one of the keys below, and differ in the part.

    Within a key every spelling is paired with the commoner ones, from counts that are aggregated
    before the shuffle: where there are few spellings with each, else with those it shares a block
    with, which all that are alike do. So a key with many records costs as many rows as it has
    blocks, never all pairs of its spellings. All keys go through one pipeline."""
    keys = [("street", ["number", "zip"]), ("street", ["number", "town", "state"]), ("town", ["zip"]), ("town", ["number", "street", "state"])]

    def keyed(k: int, part: str, names: list[str]) -> Column:
        known = reduce(Column.__and__, [F.col(n).isNotNull() for n in [*names, part]])
        return F.when(known, F.struct(F.lit(part).alias("part"), F.concat_ws("|", F.lit(str(k)), *names).alias("key"), F.col(part).alias("v")))

    counts = _spellings(parts).groupBy("part", "v").agg(F.count("*").alias("n"))
    rows = parts.select(F.explode_outer(F.array(*[keyed(k, *x) for k, x in enumerate(keys)])).alias("x")).where(F.col("x").isNotNull()).select("x.*")
    seen = rows.groupBy("part", "key", "v").agg(F.count("*").alias("in_key")).join(counts, ["part", "v"])
    top = seen.groupBy("part", "key").agg(F.max(F.struct("n", "v")).alias("top"), F.count("*").alias("spellings")).where("spellings > 1")
    seen = checkpointed(seen.join(top, ["part", "key"]))
    few = seen.where(F.col("spellings") <= FEW)
    many = seen.where(F.col("spellings") > FEW).withColumn("block", F.explode(_blocks("v")))
    pairs = _commoner(few, ["part", "key"]).unionByName(_commoner(many, ["part", "key", "block"]).distinct())
    found = pairs.groupBy("part", "old", "new").agg(F.sum("in_key").alias("n_both"), F.first("n_old").alias("n_old"), F.first("n_new").alias("n_new"))
    # Of the places of a spelling only those count where a commoner one stands beside it.
    places = seen.where(F.col("v") != F.col("top.v")).groupBy("part", F.col("v").alias("old")).agg(F.sum("in_key").alias("n_places"))
    found = found.join(places, ["part", "old"])
    d = lambda c: F.col(c).cast("double")
    whole = F.when(F.col("part") == "street", totals["street"]).otherwise(totals["town"])
    found = found.where(_rewrite_holds("old", "new", d("n_both"), d("n_places"), d("n_new"), whole))
    return found.groupBy("part", "old").agg(F.max_by("new", F.struct("n_both", "n_new", "new")).alias("new"))


def _commoner(seen: DataFrame, on: list[str]) -> DataFrame:
    """(part, key, old, new, in_key, n_old, n_new): spellings of a key with the commoner ones."""
    other = seen.select(*on, F.col("v").alias("new"), F.col("n").alias("n_new"))
    pairs = seen.withColumnsRenamed({"v": "old", "n": "n_old"}).join(other, on)
    return pairs.where((F.col("n_new") > F.col("n_old")) | ((F.col("n_new") == F.col("n_old")) & (F.col("new") > F.col("old")))).select("part", "key", "old", "new", "in_key", "n_old", "n_new")


@F.pandas_udf(ArrayType(StringType()))
def _blocks(v: pd.Series) -> pd.Series:
    """Of two spellings that are alike at least one block is the same."""
    return v.map(lambda s: sorted(blocks(s)))


def blocks_of_long(x: str) -> set[str]:
    return {x[:20], x[-20:], *(x[k : k + 10] for k in range(28, 33))}


def blocks(s: str) -> set[str]:
    """What is left where letters are left out (of long ones stretches, one of which two slips
    leave alone), three letters that an abbreviation of the first word keeps, the name behind SAINT."""
    x, w = s.replace(" ", ""), s.split(" ")[0]
    if len(x) > 60:
        slips = blocks_of_long(x)
    else:
        slips = set(deletions(x, 2 if len(x) >= 5 else 1))
    kept = {w[0] + p + q + "*" for p, q in combinations(w[1:60], 2)} if len(w) > 2 else {w + "*"}
    return slips | kept | {s.removeprefix("SAINT ") + "+"}


def slip_of(old: str, new: str) -> str:
    """The kind of slip that makes old of new: one letter doubled, added, dropped, changed, or two
    swapped; `two` for two slips, `none` for what is no slip."""
    if old == new:
        return "none"
    edits = distance(old, new)[0]
    if edits != 1:
        return "two" if edits == 2 else "none"
    if len(old) == len(new):
        return "swapped" if sorted(old) == sorted(new) else "changed"
    if len(old) < len(new):
        return "dropped"
    k = next((i for i, c in enumerate(new) if old[i] != c), len(new))
    return "doubled" if k and old[k] == old[k - 1] else "added"


@F.pandas_udf(StringType())
def _slip(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([slip_of(a, b) for a, b in zip(old, new)], dtype=object)


def mined_slips(log: list[DataFrame]) -> list[str]:
    """Kinds of slip that the mined rewrites show significantly often: more often than the share
    that unlike spellings would have it by chance (one in a hundred), by the log-likelihood ratio."""
    if not log:
        return []
    seen = {r["slip"]: r["n"] for r in reduce(DataFrame.unionByName, log).groupBy(_slip("old", "new").alias("slip")).agg(F.count("*").alias("n")).collect()}
    whole = sum(seen.values())
    return sorted(k for k, n in seen.items() if k != "none" and n >= 3 and _significant(n, whole, 0.01 * whole, whole))


def by_slips(parts: DataFrame, slips: list[str]) -> DataFrame:
    """(part, old, new) for spellings no record agrees on: a rare one that one of the mined kinds of
    slip makes of exactly one common spelling, the nearest, met by symmetric deletion in a join; for
    towns the records' own state must be the common town's, if they tell one. Names of over 60
    letters are met by the stretches that two slips leave alone."""
    counts = _spellings(parts).groupBy("part", "v").agg(F.count("*").alias("n"), F.mode("state").alias("state"))
    keyed = counts.where(F.length("v") >= 6).withColumn("d", F.explode_outer(_deleted("v")))
    rare = keyed.select("part", F.col("v").alias("old"), F.col("n").alias("n_old"), F.col("state").alias("s_old"), "d")
    common = keyed.where("n >= 5").select("part", F.col("v").alias("new"), F.col("n").alias("n_new"), F.col("state").alias("s_new"), "d")
    met = rare.join(common, ["part", "d"]).where((F.col("old") != F.col("new")) & (F.col("n_new") >= 10 * F.col("n_old")))
    met = met.where((F.col("part") == "street") | F.col("s_old").isNull() | (F.col("s_old") == F.col("s_new")))
    met = met.select("part", "old", "new").distinct().withColumn("slip", _slip("old", "new")).where(F.col("slip").isin(slips))
    nearest = met.groupBy("part", "old", (F.col("slip") == "two").alias("two")).agg(F.count("*").alias("k"), F.min("new").alias("new"))
    return nearest.groupBy("part", "old").agg(F.min(F.struct("two", "k", "new")).alias("m")).where("m.k = 1").select("part", "old", "m.new")


@F.pandas_udf(ArrayType(StringType()))
def _deleted(v: pd.Series) -> pd.Series:
    return v.map(lambda s: sorted(blocks_of_long(s) if len(s) > 60 else set(deletions(s, 2 if len(s) >= 8 else 1))))


def rewritten(parts: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Parts re-normalised. Rewrites grow with the slips in the data, so nothing is hinted:
    adaptive execution broadcasts them where their measured size allows and splits skew else."""
    for part in ("street", "town"):
        own = rewrites.where(F.col("part") == part).select(F.col("old").alias(part), F.col("new").alias("_new"))
        parts = parts.join(own, part, "left").withColumn(part, F.coalesce("_new", part)).drop("_new")
    return parts


def normalised_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts at the fixed point and all rewrites (part, old, new, round)."""
    parts = checkpointed(read_parts(address_records(rows)))
    totals = spelling_totals(parts)
    log: list[DataFrame] = []
    mined: list[DataFrame] = []
    slips: list[str] | None = None
    for n in count(1):  # ends: a rewrite leads to a commoner spelling, so each round leaves fewer
        new = checkpointed(mine(parts, totals).withColumn("round", F.lit(n)))
        if not new.isEmpty():
            mined.append(new)
        else:
            slips = mined_slips(mined) if slips is None else slips
            new = checkpointed(by_slips(parts, slips).withColumn("round", F.lit(n))) if slips else new
            if new.isEmpty():
                break
        log.append(new)
        parts = checkpointed(rewritten(parts, new))
        release(parts.sparkSession)
    empty = parts.sparkSession.createDataFrame([], "part string, old string, new string, round int")
    return parts, reduce(DataFrame.unionByName, log, empty)


def located(parts: DataFrame) -> DataFrame:
    """Parts with absent town and state filled: by the ZIP code's majority, then by the only
    state of records with the same number, street and town, then by the town's majority."""
    placed = parts.where("zip is not null and town is not null and state is not null").groupBy("zip", "town", "state").agg(F.count("*").alias("n"))
    by_zip = placed.groupBy("zip").agg(F.max(F.struct("n", "town", "state")).alias("z"))
    df = parts.join(by_zip, "zip", "left")
    # A ZIP code tells town and state unless the record names another state itself; one seen with a
    # single full address is believed only where the towns agree.
    sure = (F.col("z.n") >= 2) | (F.col("town") == F.col("z.town"))
    trust = F.coalesce(F.col("z").isNotNull() & sure & (F.col("state").isNull() | (F.col("state") == F.col("z.state"))), F.lit(False))
    df = df.withColumn("town", F.when(trust, F.col("z.town")).otherwise(F.col("town"))).withColumn("state", F.coalesce(F.when(trust, F.col("z.state")), "state")).drop("z")
    same = df.where("state is not null").groupBy("number", "street", "town").agg(F.min("state").alias("s1"), F.max("state").alias("s2")).where("s1 = s2").select("number", "street", "town", F.col("s1").alias("same_state"))
    usual = df.where("state is not null").groupBy("town").agg(F.mode("state").alias("usual_state"))
    whole, lacking = df.where("state is not null"), df.where("state is null and number is not null and street is not null and town is not null")
    lacking = lacking.join(same, ["number", "street", "town"], "left").join(usual, "town", "left").withColumn("state", F.coalesce("same_state", "usual_state")).drop("same_state", "usual_state")
    return whole.unionByName(lacking).where("number is not null and street is not null and town is not null and state is not null")


PLACE = ["number", "street", "town", "state"]


def told_apart(placed: DataFrame) -> DataFrame:
    """Placed records with direction and kind of street as far as they tell premises apart. Where the
    records of one number, street name, town and state give one kind at most, those without it have it
    too; where they give several (Oak Street and Oak Avenue), each is a premises of its own, and
    records that don't tell are another. Directions likewise. ST before a town named SAINT may
    belong to either, so it tells nothing."""
    sure = F.when(~((F.col("kind") == "STREET") & F.startswith("town", F.lit("SAINT "))), F.col("kind"))
    placed = placed.withColumn("kind", sure)
    # At most as many different kinds and directions as the tables of these words have.
    told = placed.groupBy(*PLACE).agg(F.collect_set("kind").alias("_k"), F.collect_set("direction").alias("_d"), F.min("address_id").alias("_first"))
    one = lambda own, all_: F.when(F.size(all_) > 1, F.coalesce(own, F.lit(""))).otherwise(F.coalesce(F.get(all_, F.lit(0)), F.lit("")))
    df = placed.join(told, PLACE)
    return df.select("address_id", *PLACE, one(F.col("direction"), F.col("_d")).alias("direction"), one(F.col("kind"), F.col("_k")).alias("kind"), ((F.size("_k") < 2) & (F.size("_d") < 2)).alias("_alone"), "_first")


def premises(rows: DataFrame) -> DataFrame:
    """(address_id, premises_id, number, direction, street, kind, town, state): one row per record that
    can be placed; premises_id is the smallest address_id there."""
    parts, _ = normalised_parts(rows)
    df = checkpointed(told_apart(located(parts)))
    key = ["number", "direction", "street", "kind", "town", "state"]
    apart = df.where(~F.col("_alone"))
    ids = apart.groupBy(*key).agg(F.min("address_id").alias("premises_id"))
    cols = ["address_id", "premises_id", *key]
    return df.where("_alone").withColumn("premises_id", F.col("_first")).select(*cols).unionByName(apart.join(ids, key).select(*cols))


def same_premises(rows: DataFrame) -> DataFrame:
    """(address_id_1, address_id_2) of all pairs of different records on one premises. The
    pairs are the required result; they come from an equality join that adaptive execution
    splits where one premises has very many records."""
    at = premises(rows).select("premises_id", "address_id")
    return at.select("premises_id", F.col("address_id").alias("address_id_1")).join(at.select("premises_id", F.col("address_id").alias("address_id_2")), "premises_id").where("address_id_1 < address_id_2").select("address_id_1", "address_id_2")
