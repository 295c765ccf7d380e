"""Files of drifting schemas read into one table, each change recorded.

Every file is read once where it stands and gets a schema fingerprint: its field names with the type
of their values. A feed's files in their order give its versions: a new one begins where the
fingerprint differs from that of the file before. From one fingerprint to another lead explicit
migration steps, found once for each pair of fingerprints whatever the number of files: rename, default
(a field that is added: null before), drop, and cast (another type). Whether a field that vanished
and one that appeared are the same is told by content: over the whole corpus each field name has a
profile of value shapes and words, and a pair is a rename where the profiles agree. The changes of a
file are the steps into its version. Chained renames lead every name of a feed, in the files where it
holds, to one column of the consistent table; each file is routed through them, then through the
casts and defaults of that table, and what was applied is recorded.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmark.runtime import checkpointed, fits, spread

#: Least cosine of two profiles for the same content.
SAME_CONTENT = 0.5
#: Files of one feed that are put in order at once; longer feeds go by ranges of their numbers.
RANGE = 1000
#: Field names and their links are collected for chaining behind this bound; beyond it no
#: corpus has sensible schemas and the call is refused.
NAMES = 20_000
# CSV words that are booleans.
BOOLEANS = {"true", "false"}
CANONICAL = ["brand_name", "class_type", "alcohol_content", "net_contents", "name_address", "country_of_origin", "warning_required"]


def field_name(name: str) -> str:
    """Lower case with underscores; camel case is parted."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def field_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def unwrap(x: object) -> list[dict]:
    """The records of a parsed JSON document, wrapper objects and lists taken off."""
    while isinstance(x, dict):
        inner = [v for v in x.values() if isinstance(v, list) and any(isinstance(r, dict) for r in v)]
        if len(inner) == 1:
            x = inner[0]
        elif len(x) == 1 and isinstance(next(iter(x.values())), dict):
            x = next(iter(x.values()))
        else:
            x = [x]
    records = []
    for r in x if isinstance(x, list) else []:
        while isinstance(r, dict) and len(r) == 1 and isinstance(next(iter(r.values())), dict):
            r = next(iter(r.values()))
        if isinstance(r, dict):
            records.append(r)
    return records


def read_file(content: str | None, file_format: str | None) -> tuple[list[list[tuple[str, object]]], str | None]:
    """(records as (name, value) lists, error): a file that can't be parsed has no records and an
    error, an empty one neither. Short CSV rows give nulls."""
    text = (content or "").lstrip("\ufeff")
    if not text.strip():
        return [], None
    try:
        if (file_format or "").lower() == "json" or (file_format is None and text.lstrip()[:1] in "[{"):
            return [list(r.items()) for r in unwrap(json.loads(text))], None
        csv.field_size_limit(sys.maxsize)
        head = text.split("\n", 1)[0]
        rows = list(csv.reader(io.StringIO(text), delimiter=max(",;\t|", key=head.count)))
    except (ValueError, csv.Error, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"
    names = rows[0] if rows else []
    return [[(n, r[i] if i < len(r) else None) for i, n in enumerate(names)] for r in rows[1:] if any(r)], None


def blank(v: object) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


def csv_kind(v: str) -> str:
    v = v.strip()
    if v.lower() in BOOLEANS:
        return "boolean"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
        return "number"
    if v[:1] + v[-1:] in ("[]", "{}"):
        try:
            return {list: "list", dict: "object"}.get(type(json.loads(v)), "text")
        except ValueError:
            pass
    return "text"


def json_kind(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    return {int: "number", float: "number", list: "list", dict: "object"}.get(type(v), "text")


def kind_of(values: list[object], is_csv: bool) -> str | None:
    """The type of a field's non-blank values, text where they differ; null if all are blank."""
    kinds = {csv_kind(v) if is_csv and isinstance(v, str) else json_kind(v) for v in values if not blank(v)}
    return None if not kinds else kinds.pop() if len(kinds) == 1 else "text"


def as_text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)


def flat(v: object) -> str:
    """A list or object as plain text: its texts in their order, or its other values if it has none."""
    parts: list[object] = []
    todo = [v]
    while todo:
        x = todo.pop(0)
        if isinstance(x, (list, dict)):
            todo = [*(x.values() if isinstance(x, dict) else x), *todo]
        elif not blank(x):
            parts.append(x)
    texts = [x for x in parts if isinstance(x, str)]
    return ", ".join(texts or map(as_text, parts))


def as_read(v: object, is_csv: bool) -> tuple[str | None, str | None, str | None]:
    """(value as text, its kind, its text if it were cast to text) of a cell."""
    if blank(v):
        return None, None, None
    kind = csv_kind(v) if is_csv and isinstance(v, str) else json_kind(v)
    inner = json.loads(v) if isinstance(v, str) and kind in ("list", "object") else v
    return as_text(v), kind, (flat(inner) or None) if kind in ("list", "object") else as_text(v)


def features(v: object) -> set[str]:
    """Words and the shape of a value; lists and objects by their parts."""
    if isinstance(v, dict):
        return set().union(*(features(x) for x in v.values())) if v else set()
    if isinstance(v, list):
        return set().union(*(features(x) for x in v)) if v else set()
    s = str(v).lower()
    words = set(re.findall(r"[^\W\d_]+", s))
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]+", "a", s))
    return words | {f"={re.sub(r'(a[ .,-]*)+', 'a', shape)[:24]}"}


FILE_SCHEMA = "file_id bigint, feed string, file_no int, error string, fields array<struct<key:string,name:string,kind:string>>, profiles array<struct<key:string,features:array<string>>>"
RECORD_SCHEMA = "file_id bigint, record_no int, cells array<struct<place:int,key:string,value:string,kind:string,plain:string>>"
_TEXTS = pa.list_(pa.string())
_FILES = pa.schema(
    [("file_id", pa.int64()), ("feed", pa.string()), ("file_no", pa.int32()), ("error", pa.string()), ("fields", pa.list_(pa.struct([("key", pa.string()), ("name", pa.string()), ("kind", pa.string())]))), ("profiles", pa.list_(pa.struct([("key", pa.string()), ("features", _TEXTS)])))]
)
_RECORDS = pa.schema([("file_id", pa.int64()), ("record_no", pa.int32()), ("cells", pa.list_(pa.struct([("place", pa.int32()), *((c, pa.string()) for c in ("key", "value", "kind", "plain"))])))])


def _read_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            records, error = read_file(r["content"], r["file_format"])
            is_csv = (r["file_format"] or "").lower() != "json"
            seen: dict[str, tuple[str, list]] = {}
            for record in records:
                for n, v in record:
                    seen.setdefault(field_key(n), (field_name(n), []))[1].append(v)
            seen.pop("", None)
            fields = [{"key": k, "name": n, "kind": kind_of(v, is_csv)} for k, (n, v) in seen.items()]
            profiles = [{"key": k, "features": sorted(set().union(*(features(x) for x in v if not blank(x))))} for k, (_, v) in seen.items()]
            out.append({"file_id": r["file_id"], "feed": r["feed"], "file_no": r["file_no"], "error": error, "fields": fields, "profiles": profiles})
        yield pa.RecordBatch.from_pylist(out, schema=_FILES)


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            is_csv = (r["file_format"] or "").lower() != "json"
            for i, record in enumerate(read_file(r["content"], r["file_format"])[0], 1):
                cells = [dict(zip(("place", "key", "value", "kind", "plain"), (place, field_key(n), *as_read(v, is_csv)))) for place, (n, v) in enumerate(record) if field_key(n)]
                out.append({"file_id": r["file_id"], "record_no": i, "cells": cells})
        yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)


def read_files(files: DataFrame) -> DataFrame:
    """One row per delivered file, contents left behind: its fields (key, name, type) and their content
    features, or the error that kept it from being read. Files are parsed where they stand."""
    cols = ["file_id", "feed", F.col("file_no").cast("int").alias("file_no"), "file_format", "content"]
    return spread(files.select(*cols)).mapInArrow(_read_fields, FILE_SCHEMA)


def file_versions(read: DataFrame) -> DataFrame:
    """(file_id, feed, file_no, fields, fingerprint, before_no, before): every file that can be ordered
    and has fields, with the fingerprint of the preceding one of its feed (null for the first). Of
    files delivered twice (same feed and file_no) the smallest file_id counts.

    Files are put in order within ranges of their numbers, and the ranges, one row each, among
    themselves, so that a feed that holds a third of all files is no single task."""
    names = F.array_sort(F.transform("fields", lambda f: F.concat_ws(":", f["name"], F.coalesce(f["kind"], F.lit("blank")))))
    numbered = read.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull())
    first = numbered.groupBy("feed", "file_no").agg(F.min(F.struct("file_id", "fields")).alias("f")).select("f.file_id", "feed", "file_no", "f.fields").where(F.size("fields") > 0)
    df = first.withColumn("fingerprint", F.xxhash64(names)).withColumn("_range", F.floor(F.col("file_no") / RANGE))
    own = F.struct("file_no", "fingerprint")
    ranges = df.groupBy("feed", "_range").agg(F.max(own).alias("_last"))
    ranges = ranges.select("feed", "_range", F.lag("_last").over(Window.partitionBy("feed").orderBy("_range")).alias("_carried"))
    df = df.withColumn("_own", F.lag(own).over(Window.partitionBy("feed", "_range").orderBy("file_no"))).join(ranges, ["feed", "_range"])
    before = F.coalesce("_own", "_carried")
    return df.select("file_id", "feed", "file_no", "fields", "fingerprint", before["file_no"].alias("before_no"), before["fingerprint"].alias("before"))


def same_contents(read: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old_key, key, alike) of the pairs of names whose content profiles agree: how often a feature is
    seen with a name over all files, by logarithm, features that most names share weighed down."""
    profiles = read.select(F.explode("profiles").alias("p")).select(F.col("p.key").alias("key"), F.explode_outer("p.features").alias("feature"))
    weights = checkpointed(profiles.groupBy("key", "feature").agg(F.count("*").cast("double").alias("w")))
    names = float(max(1, weights.select("key").distinct().count()))
    weights = weights.where(F.col("feature").isNotNull())
    rarity = weights.groupBy("feature").agg(F.log(F.lit(names) / F.count("*") + 1.0).alias("rarity"))
    asked = pairs.select(F.col("key")).union(pairs.select("old_key")).distinct()
    weights = weights.join(asked, "key", "left_semi").join(rarity, "feature").select("key", "feature", (F.log1p("w") * F.col("rarity")).alias("w"))
    norms = weights.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = checkpointed(weights.join(norms, "key").select("key", "feature", (F.col("w") / F.col("norm")).alias("w")))
    return (
        pairs.select("old_key", "key").distinct()
        .join(weights, "key")
        .join(weights.select(F.col("key").alias("old_key"), "feature", F.col("w").alias("w2")), ["old_key", "feature"])
        .groupBy("old_key", "key")
        .agg(F.sum(F.col("w") * F.col("w2")).alias("alike"))
        .where(F.col("alike") >= SAME_CONTENT)
    )


STEP = ["before", "fingerprint", "step", "key", "old_key", "field", "old_field", "old_kind", "new_kind"]


def migration_steps(read: DataFrame, versions: DataFrame) -> DataFrame:
    """The explicit steps from one fingerprint to another (columns STEP), for every pair that follow
    each other in some feed. Types are compared where both schemas have a non-blank value."""
    moves = versions.where(F.col("before") != F.col("fingerprint")).select("before", "fingerprint").distinct()
    schemas = versions.groupBy("fingerprint").agg(F.min("fields").alias("fields"))
    moves = moves.join(schemas.withColumnRenamed("fields", "now"), "fingerprint").join(schemas.select(F.col("fingerprint").alias("before"), F.col("fields").alias("past")), "before")
    lacks = lambda f, others: ~F.exists(others, lambda o: o["key"] == f["key"])
    moves = checkpointed(moves.select("before", "fingerprint", "now", "past", F.filter("past", lambda f: lacks(f, F.col("now"))).alias("gone"), F.filter("now", lambda f: lacks(f, F.col("past"))).alias("come")))
    ids = ["before", "fingerprint"]
    pairs = moves.select(*ids, F.explode("gone").alias("old"), "come").select(*ids, "old", F.explode("come").alias("new")).withColumns({"old_key": F.col("old.key"), "key": F.col("new.key")})
    scored = pairs.join(same_contents(read, pairs), ["old_key", "key"])
    # Each other's best of what is left, again and again: the best pairs first, each name once.
    pair = F.struct((-F.col("alike")).alias("d"), "old_key", "key", "old", "new")
    ranked = scored.groupBy(*ids).agg(F.array_sort(F.collect_list(pair)).alias("ranked"))  # fields gone times come of two schemas
    taken = lambda acc, x: F.exists(acc, lambda y: (y["old_key"] == x["old_key"]) | (y["key"] == x["key"]))
    chosen = F.aggregate("ranked", F.slice("ranked", 1, 0), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    df = moves.join(ranked.select(*ids, chosen.alias("same")), ids, "left").withColumn("same", F.coalesce("same", F.array().cast(ranked.schema["ranked"].dataType)))
    none = F.lit(None).cast("string")

    def step(kind: str, old: Column | None, new: Column | None) -> Column:
        of = lambda x, name: none if x is None else x[name]
        shown = new if new is not None else old
        return F.struct(F.lit(kind).alias("step"), of(new, "key").alias("key"), of(old, "key").alias("old_key"), shown["name"].alias("field"), of(old, "name").alias("old_field"), of(old, "kind").alias("old_kind"), of(new, "kind").alias("new_kind"))

    past_of = lambda f: F.get(F.filter("past", lambda o: o["key"] == f["key"]), F.lit(0))
    steps = F.concat(
        F.transform("same", lambda x: step("rename", x["old"], x["new"])),
        F.transform(F.filter("come", lambda f: ~F.exists("same", lambda x: x["key"] == f["key"])), lambda f: step("default", None, f)),
        F.transform(F.filter("gone", lambda f: ~F.exists("same", lambda x: x["old_key"] == f["key"])), lambda f: step("drop", f, None)),
        F.transform(F.filter("now", lambda f: F.coalesce(past_of(f)["kind"] != f["kind"], F.lit(False))), lambda f: step("cast", past_of(f), f)),
    )
    return df.select(*ids, F.explode(steps).alias("s")).select(*ids, "s.*")


@dataclass
class Migrations:
    """What read files went through: `read` (one row per delivery), `versions` (one per file that
    counts) and the `steps` between fingerprints. All three are written tables."""

    read: DataFrame
    versions: DataFrame
    steps: DataFrame


def migrations(files: DataFrame) -> Migrations:
    read = checkpointed(read_files(files))
    versions = checkpointed(file_versions(read))
    return Migrations(read, versions, checkpointed(migration_steps(read, versions)))


# How the report names the steps.
CHANGES = {"rename": "renamed", "default": "added", "drop": "removed", "cast": "retyped"}


def schema_changes(m: Migrations) -> DataFrame:
    """(file_id, feed, file_no, change_kind, field, old_field, old_kind, new_kind): the steps into each
    file's version, so none where the fingerprint is that of the file before. Files that tell no
    schema are reported too: `unreadable` (old_field: the error), `empty`, and `unordered` where
    feed or number is missing. A second delivery is reported as `repeated`."""
    kind = F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv])
    into = m.versions.where(F.col("before") != F.col("fingerprint")).select("file_id", "feed", "file_no", "before", "fingerprint").join(m.steps, ["before", "fingerprint"])
    found = into.select("file_id", "feed", "file_no", kind[F.col("step")].alias("change_kind"), "field", "old_field", "old_kind", "new_kind")
    none = F.lit(None).cast("string")
    unordered = F.col("feed").isNull() | F.col("file_no").isNull()
    why = F.when(F.col("error").isNotNull(), "unreadable").when(F.size("fields") == 0, "empty").when(unordered, "unordered").otherwise("repeated")
    # Only the rows without a place are joined away: ids alone are shuffled.
    rest = m.read.join(m.versions.select("file_id", "feed", "file_no"), ["file_id", "feed", "file_no"], "left_anti")
    return found.unionByName(rest.select("file_id", "feed", "file_no", why.alias("change_kind"), none.alias("field"), F.col("error").alias("old_field"), none.alias("old_kind"), none.alias("new_kind")))


def drifted(m: Migrations) -> DataFrame:
    """(file_id, change_kind, field) of the changes of fields alone."""
    return schema_changes(m).where(F.col("change_kind").isin(*CHANGES.values())).select("file_id", "change_kind", "field")


def fingerprints(versions: DataFrame) -> DataFrame:
    """(file_id, feed, file_no, schema, fingerprint, new_version): the schema as sorted `name:type` pairs,
    and whether a version of the feed begins with the file."""
    parts = F.array_sort(F.transform("fields", lambda f: F.concat_ws(":", f["name"], F.coalesce(f["kind"], F.lit("blank")))))
    begins = F.col("before").isNull() | (F.col("before") != F.col("fingerprint"))
    return versions.select("file_id", "feed", "file_no", F.array_join(parts, ",").alias("schema"), "fingerprint", begins.alias("new_version"))


def _bound(links: pd.DataFrame) -> pd.DataFrame:
    """What each name of a feed stands for over its files, by following the feed's renames in order:
    a name takes the line of names of the one it replaces from that file on."""
    links = links.sort_values(["file_no", "old_key", "key"])
    lines: dict[str, list[str]] = {}  # first name -> all names the field has had
    spans: dict[str, list[tuple[int, str]]] = {}  # name -> (from file, line)
    for n, same in links.groupby("file_no", sort=True):
        now = {}
        for old, new in zip(same["old_key"], same["key"]):
            now[new] = spans.setdefault(old, [(0, old)])[-1][1]
            lines.setdefault(now[new], [now[new]]).append(new)
        for new, line in now.items():
            if spans.setdefault(new, [(0, new)])[-1][1] != line:
                spans[new].append((int(n), line))
    rows = []
    for key, at in spans.items():
        for (since, line), (until, _) in zip(at, [*at[1:], (2**31 - 1, "")]):
            rows.append((links["feed"].iloc[0], key, since, until, sorted(set(lines.get(line, [line])))))
    return pd.DataFrame(rows, columns=["feed", "key", "since", "until", "names"])


def renames(m: Migrations) -> DataFrame:
    """(feed, file_no, old_key, key): the renames on the way of each feed."""
    links = m.steps.where("step = 'rename'").select("before", "fingerprint", "old_key", "key")
    return m.versions.join(links, ["before", "fingerprint"]).select("feed", "file_no", "old_key", "key")


def routes(links: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, usual). chains: (feed, key, since, until, column): the column of a name in the files of
    one feed from number `since` to before `until`, by the feed's own chain of renames. usual: (key,
    column) for names that their feed never renames, and for chains without a column's own name: the
    column that the chains of other feeds lead to, if they lead to one only. fields: (key, name) of
    all files. Names are few; their number is checked before they are collected."""
    names = fields.groupBy("key").agg(F.mode("name", True).alias("name"), F.count("*").alias("n"))
    bound = checkpointed(links.groupBy("feed").applyInPandas(_bound, "feed string, key string, since int, until int, names array<string>"))
    if not fits(names, NAMES):
        raise ValueError(f"more than {NAMES} field names: not one schema that drifts")
    count = {r["key"]: (r["n"], r["name"]) for r in names.collect()}
    known = {field_key(c): c for c in CANONICAL}
    column = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    # At most a row for each name and canonical column.
    own = F.array_sort(F.filter(F.transform("names", lambda k: column[k]), lambda c: c.isNotNull()))
    led = bound.select(F.explode("names").alias("key"), F.get(own, F.lit(0)).alias("column")).where("column is not null").groupBy("key").agg(F.min("column").alias("column"), F.max("column").alias("other")).where("column = other").collect()
    lead = {r["key"]: r["column"] for r in led} | known

    def column_of(keys: list[str]) -> str:
        own = sorted({known[k] for k in keys if k in known}) or sorted({lead[k] for k in keys if k in lead})
        return own[0] if len(own) == 1 else max(count.get(k, (0, k)) for k in keys)[1]

    chains = bound.select("feed", "key", "since", "until", F.udf(lambda names: column_of(names), "string")("names").alias("column"))
    usual = links.sparkSession.createDataFrame([(k, column_of([k])) for k in sorted(count)], "key string, column string")
    return chains, usual


def routed_fields(versions: DataFrame, chains: DataFrame, usual: DataFrame) -> DataFrame:
    """(file_id, feed, file_no, key, name, kind, column, chained): the column each field of each file
    goes to, and whether the feed's own chain of renames leads there."""
    fields = versions.select("file_id", "feed", "file_no", F.explode("fields").alias("f")).select("file_id", "feed", "file_no", "f.*")
    c = chains.select(F.col("feed").alias("_f"), F.col("key").alias("_k"), "since", "until", F.col("column").alias("_c"))
    df = fields.join(c, (F.col("feed") == F.col("_f")) & (F.col("key") == F.col("_k")) & (F.col("file_no") >= F.col("since")) & (F.col("file_no") < F.col("until")), "left")
    df = df.join(F.broadcast(usual), "key", "left")  # NAMES rows at most
    return df.select("file_id", "feed", "file_no", "key", "name", "kind", F.coalesce("_c", "column", "key").alias("column"), F.col("_c").isNotNull().alias("chained"))


def applied_steps(routed: DataFrame) -> DataFrame:
    """(file_id, feed, file_no, step, column, field, kind): what each file goes through on its way to the
    consistent table: `rename` of a field to a column of another name, `cast` of a canonical column
    from another type than text, `default` of a canonical column that no field leads to."""
    ids = ["file_id", "feed", "file_no"]
    made = F.array(
        F.when(_key(F.col("column")) != F.col("key"), F.lit("rename")),
        F.when(F.col("column").isin(CANONICAL) & (F.col("kind") != "text"), F.lit("cast")),
    )
    own = routed.select(*ids, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("step"), "column", F.col("name").alias("field"), "kind")
    none = F.lit(None).cast("string")
    lacking = routed.groupBy(*ids).agg(F.collect_set("column").alias("have")).select(*ids, F.explode(F.array_except(F.array(*map(F.lit, CANONICAL)), "have")).alias("column"))
    return own.unionByName(lacking.select(*ids, F.lit("default").alias("step"), "column", none.alias("field"), none.alias("kind")))


def _key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def cast(column: Column, kind: Column, plain: Column) -> Column:
    """A value as its canonical column has it, all of which are text: lists and objects by their
    texts, yes and no in words, bare figures with the unit of the column."""
    figure = F.regexp_replace(plain, r"\.0+$", "")
    return (
        F.when((column == "warning_required") & (kind == "boolean"), F.when(F.lower(F.trim(plain)) == "true", "required").otherwise("not required"))
        .when((column == "net_contents") & (kind == "number"), F.concat(figure, F.lit(" ML")))
        .when((column == "alcohol_content") & (kind == "number"), F.concat(figure, F.lit("% ALC/VOL")))
        .otherwise(plain)
    )


def consistent_table(files: DataFrame, routed: DataFrame) -> DataFrame:
    """All records of all files that count in one table: the canonical columns as text (null where a
    file lacks the field: the default) and the other fields, uncast, in a map. Every value goes to
    the column its file's route gives its name. Where a record has several values for one column,
    the one under the column's own name, else the first, is in it; the others stay apart in the map
    as `column.name`. A record is one row from the reading on; contents are not shuffled."""
    to = routed.groupBy("file_id", "feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("key", "column"))).alias("_to"))
    records = spread(files.select("file_id", "file_format", "content")).mapInArrow(_read_records, RECORD_SCHEMA)
    df = records.join(to, "file_id")

    def moved(x: Column) -> Column:
        column = F.coalesce(F.col("_to")[x["key"]], x["key"])
        value = F.when(column.isin(CANONICAL), cast(column, x["kind"], x["plain"])).otherwise(x["value"])
        return F.struct((_key(column) != x["key"]).alias("strange"), x["place"].alias("place"), x["key"].alias("key"), column.alias("column"), value.alias("value"))

    df = df.select("file_id", "feed", "file_no", "record_no", F.array_sort(F.transform("cells", moved)).alias("_m"))
    before = lambda x, i: F.size(F.filter(F.slice("_m", F.lit(1), i), lambda y: y["column"] == x["column"]))
    df = df.withColumn("_n", F.transform("_m", lambda x, i: F.struct(x["key"].alias("key"), x["column"].alias("column"), x["value"].alias("value"), before(x, i).alias("n"))))
    at = lambda c: F.get(F.filter("_n", lambda x: (x["column"] == c) & (x["n"] == 0)), F.lit(0))["value"].alias(c)
    named = lambda x: F.when(x["n"] == 0, x["column"]).when(x["n"] == 1, F.concat_ws(".", x["column"], x["key"])).otherwise(F.concat(x["column"], F.lit("."), x["key"], F.lit("#"), x["n"].cast("string")))
    others = F.filter("_n", lambda x: (~x["column"].isin(CANONICAL) | (x["n"] > 0)) & x["value"].isNotNull())
    rest = F.map_from_entries(F.array_sort(F.transform(others, lambda x: F.struct(named(x).alias("column"), x["value"].alias("value")))))
    return df.select("file_id", "feed", "file_no", "record_no", *[at(c) for c in CANONICAL], rest.alias("other_fields"))
