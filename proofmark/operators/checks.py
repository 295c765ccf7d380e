"""Checks of expected fields against the text detected on a label.

Every check is a struct (check, expected, detected, result, notes). Inputs that several checks
share (normalised text, lines, figures) are computed once per row in a projection of their own,
then one Arrow call scores all fuzzy fields, then the decision tables are plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions import numbers, text
from proofmark.functions.fuzzy import best_lines
from proofmark.runtime import exploded, let, strip

PASS, REVIEW, FAIL = "PASS", "REVIEW", "FAIL"
CHECK = "struct<check:string,expected:string,detected:string,result:string,notes:string>"

# The statement's phrases and the wording of the results.
WARNING_PHRASES = [
    "according to the surgeon general",
    "women should not drink alcoholic beverages during pregnancy",
    "risk of birth defects",
    "consumption of alcoholic beverages impairs your ability to drive a car or operate machinery",
    "may cause health problems",
]
HEADING = "GOVERNMENT WARNING:"
STATEMENT = "Standard government warning statement"
MARKER = r"(%|ALC\.?\s*/?\s*VOL\.?|ABV|PROOF)"
MARKER_DETECTED = "Alcohol content marker found, but numeric value was not clearly captured"
MARKER_NOTE = "OCR detected an alcohol-content marker such as '%', 'ALC/VOL', or 'PROOF', but did not capture a clear numeric value. Manual review or text correction is recommended."
OVERALL = {"FAIL": "FAIL", "REVIEW": "MANUAL REVIEW RECOMMENDED", "PASS": "PASS"}
SENTENCES = {
    "PASS": "PASS — The checked label fields appear to match the application data.",
    "MANUAL REVIEW RECOMMENDED": "MANUAL REVIEW RECOMMENDED — One or more fields need human review.",
    "FAIL": "FAIL — One or more required fields were not found or did not match.",
}
NO_ISSUES = "No review or failure items found."

#: name, label, least score for PASS and for REVIEW, whether a blank expected value omits the check
TEXT_FIELDS = [("brand_name", "Brand Name", 92, 75, False), ("class_type", "Class/Type", 92, 75, False), ("name_address", "Name/Address", 88, 72, True), ("country_of_origin", "Country of Origin", 90, 75, True)]
NET = ("net_contents", "Net Contents", 90, 75)


def check(name: str, expected: Column, detected: Column, result: str, notes: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), expected.alias("expected"), detected.alias("detected"), F.lit(result).alias("result"), notes.alias("notes"))


def scored(note: str, score: Column) -> Column:
    return F.concat(F.lit(f"{note} Match score: "), score.cast("string"), F.lit("."))


def text_check(name: str, expected: Column, blank_text: Column, hit: Column, line: Column, score: Column, least: int, review: int) -> Column:
    none = F.lit("")
    return (
        F.when(expected == "", check(name, none, none, REVIEW, F.lit("No expected value was provided.")))
        .when(blank_text, check(name, expected, none, FAIL, F.lit("No label text was provided for comparison.")))
        .when(hit, check(name, expected, expected, PASS, F.lit("Expected value found on label.")))
        .when(score >= least, check(name, expected, line, PASS, scored("Close normalized match found on label.", score)))
        .when(score >= review, check(name, expected, line, REVIEW, scored("Similar text found; manual review recommended.", score)))
        .otherwise(check(name, expected, line, FAIL, scored("Expected value was not found on label.", score)))
    )


def net_check(expected: Column, hit: Column, line: Column, score: Column) -> Column:
    name, none = NET[1], F.lit("")
    return (
        F.when(expected == "", check(name, none, none, REVIEW, F.lit("No expected net contents value was provided.")))
        .when(hit, check(name, expected, expected, PASS, F.lit("Expected net contents found on label.")))
        .when(score >= NET[2], check(name, expected, line, PASS, scored("Close normalized net contents match found.", score)))
        .when(score >= NET[3], check(name, expected, line, REVIEW, scored("Similar net contents text found; manual review recommended.", score)))
        .otherwise(check(name, expected, line, FAIL, scored("Expected net contents were not found on label.", score)))
    )


def alcohol_rule(want_pct: Column, want_proof: Column, got_pct: Column, got_proof: Column) -> Column:
    """1 to 4 by the first tolerance met: each expected percentage against percentages (0.2) then
    proofs (0.5), then each expected proof against proofs (0.5) then doubled percentages (0.5); null for none."""
    near = lambda a, b, tol: F.abs(a - b) <= F.lit(tol)
    by_pct = F.transform(want_pct, lambda e: F.when(F.exists(got_pct, lambda d: near(e, d, 0.2)), 1).when(F.exists(got_proof, lambda p: near(e * 2, p, 0.5)), 2))
    by_proof = F.transform(want_proof, lambda q: F.when(F.exists(got_proof, lambda p: near(q, p, 0.5)), 3).when(F.exists(got_pct, lambda d: near(d * 2, q, 0.5)), 4))
    return F.get(F.filter(F.concat(by_pct, by_proof), lambda x: x.isNotNull()), F.lit(0))


def listed(got_pct: Column, got_proof: Column) -> Column:
    pct = F.when(F.size(got_pct) > 0, F.concat(F.lit("Percent values: "), F.array_join(F.transform(got_pct, lambda v: F.concat(numbers.shown(v), F.lit("%"))), ", ")))
    proof = F.when(F.size(got_proof) > 0, F.concat(F.lit("Proof values: "), F.array_join(F.transform(got_proof, numbers.shown), ", ")))
    return F.concat_ws("; ", pct, proof)


def alcohol_check(expected: Column, rule: Column, detected: Column, marked: Column) -> Column:
    """rule: alcohol_rule; detected: listed; marked: has_marker. Each should be a column of its own
    by now, since every branch looks at them."""
    name, none = "Alcohol Content", F.lit("")
    notes = ["Expected ABV found on label.", "Expected ABV matches detected proof.", "Expected proof found on label.", "Expected proof matches detected ABV."]
    out = F.when(expected == "", check(name, none, none, REVIEW, F.lit("No expected alcohol content was provided.")))
    for k, note in enumerate(notes, 1):
        out = out.when(rule == k, check(name, expected, detected, PASS, F.lit(note)))
    return (
        out.when(detected != "", check(name, expected, detected, REVIEW, F.lit("Alcohol content found, but it does not clearly match the expected value.")))
        .when(marked, check(name, expected, F.lit(MARKER_DETECTED), REVIEW, F.lit(MARKER_NOTE)))
        .otherwise(check(name, expected, none, FAIL, F.lit("Alcohol content was not found on the label.")))
    )


def has_marker(seen: Column) -> Column:
    return F.upper(seen).rlike("(?U)" + MARKER)


def phrases_found(seen: Column) -> Column:
    return let(text.norm_phrase(seen), lambda s: F.filter(F.array(*map(F.lit, WARNING_PHRASES)), lambda p: F.contains(s, p)))


def phrases_missing(found: Column) -> Column:
    """The statement's phrases that aren't among the found ones, in order."""
    return F.array_except(F.array(*map(F.lit, WARNING_PHRASES)), found)


def heading_case(one_line: Column) -> Column:
    """2: the heading stands in capitals, 1: in another case, 0: not at all. White space is collapsed."""
    return F.when(F.contains(one_line, F.lit(HEADING)), 2).when(one_line.rlike(r"(?iU)government\s+warning\s*:"), 1).otherwise(0)


def warning_check(blank: Column, heading: Column, found: Column, required: Column) -> Column:
    """heading: heading_case of the text; found: phrases_found. Columns of their own by now."""
    name, none, total = "Government Warning", F.lit(""), len(WARNING_PHRASES)
    n = F.size(found)
    return (
        F.when(~required, check(name, F.lit("Not required"), F.lit("Not checked"), PASS, F.lit("Government warning check was not required for this review.")))
        .when(blank, check(name, F.lit("Required"), none, FAIL, F.lit("No label text was provided for warning validation.")))
        .when(heading == 1, check(name, F.lit(HEADING), F.lit("Incorrect warning heading capitalization"), FAIL, F.lit("Warning heading must appear as 'GOVERNMENT WARNING:' in all caps.")))
        .when((heading == 2) & (n == total), check(name, F.lit(STATEMENT), F.lit("Warning heading and required phrases found"), PASS, F.lit("Government warning text appears to be present with correct heading capitalization.")))
        .when(
            (heading == 2) & (n > 0),
            check(name, F.lit(STATEMENT), F.concat(F.lit("Found "), n.cast("string"), F.lit(f" of {total} required phrases")), REVIEW,
                  F.concat(F.lit("Warning heading was found, but the warning text appears incomplete. Missing phrase examples: "), F.array_join(F.slice(phrases_missing(found), 1, 2), ", "), F.lit("."))),
        )
        .when(n >= 2, check(name, F.lit(STATEMENT), F.concat(F.lit("Found "), n.cast("string"), F.lit(" warning-related phrases but no correct heading")), REVIEW, F.lit("Warning-like text was found, but the required 'GOVERNMENT WARNING:' heading was missing.")))
        .otherwise(check(name, F.lit(STATEMENT), none, FAIL, F.lit("Required government warning statement was not found on the label.")))
    )


# Words for false of a batch table's warning column; all else, blank too, is true.
BATCH_FALSE = ["false", "no", "n", "0", "not required", "unchecked"]


def batch_warning_required(c: Column) -> Column:
    return ~F.lower(text.clean_cell(c)).isin(BATCH_FALSE)


def with_checks(rows: DataFrame, seen: str = "detected_text") -> DataFrame:
    """rows (expected fields and the detected text) plus `checks`, in the order of the fields.

    Fields that rows lack count as blank. Null texts count as blank: the text checks fail. Rows
    repeat as given; other columns pass through, but for names that begin with `_v_`.
    """
    cols = set(rows.columns)
    field = lambda n: text.clean_cell(F.col(n).cast("string")) if n in cols else F.lit("")
    fields = [f[0] for f in TEXT_FIELDS] + [NET[0], "alcohol_content"]
    t = text.empty_if_null(F.col(seen))
    df = rows.withColumns({f"_v_{n}": field(n) for n in fields} | {"_v_t": t, "_v_norm": text.norm_text(t), "_v_lines": text.lines_of(t)})
    required = batch_warning_required(F.col("warning_required").cast("string")) if "warning_required" in cols else F.lit(True)
    hits = {f"_v_hit_{n}": text.has_phrase(text.norm_text(F.col(f"_v_{n}")), F.col("_v_norm")) for n, *_ in TEXT_FIELDS}
    hits["_v_hit_net"] = text.contains_phrase(numbers.norm_net_contents(F.col("_v_net_contents")), numbers.norm_net_contents(F.col("_v_t")))
    df = df.withColumns(
        hits
        | {"_v_required": required, "_v_blank": strip(F.col("_v_t")) == "", "_v_got_pct": numbers.percent_values(F.col("_v_t")), "_v_got_proof": numbers.proof_values(F.col("_v_t"))}
        | {"_v_want_pct": numbers.percent_values(F.col("_v_alcohol_content")), "_v_want_proof": numbers.proof_values(F.col("_v_alcohol_content"))}
    )
    figures = [F.col(f"_v_{x}") for x in ("want_pct", "want_proof", "got_pct", "got_proof")]
    df = df.withColumns(
        {"_v_rule": alcohol_rule(*figures), "_v_listed": listed(*figures[2:]), "_v_marked": has_marker(F.col("_v_t")), "_v_found": phrases_found(F.col("_v_t")), "_v_heading": heading_case(text.collapse(F.col("_v_t")))}
    )
    # Fuzzy operands: null where the decision is taken already.
    wanted = [F.when(~F.col(f"_v_hit_{n}") & ~F.col("_v_blank") & (F.col(f"_v_{n}") != ""), text.norm_text(F.col(f"_v_{n}"))) for n, *_ in TEXT_FIELDS]
    wanted.append(F.when(~F.col("_v_hit_net") & ~F.col("_v_blank") & (F.col("_v_net_contents") != ""), text.norm_text(F.col("_v_net_contents"))))
    df = df.withColumn("_v_best", best_lines(F.array(*wanted), F.transform("_v_lines", text.norm_text)))
    place = lambda k: F.coalesce(F.get(F.col("_v_best"), F.lit(k))["place"], F.lit(-1))
    score = lambda k: F.coalesce(F.get(F.col("_v_best"), F.lit(k))["score"], F.lit(0))
    line = lambda k: F.when(place(k) >= 0, F.get(F.col("_v_lines"), place(k))).otherwise(F.lit(""))
    made = {}
    for k, (n, label, least, review, optional) in enumerate(TEXT_FIELDS):
        c = text_check(label, F.col(f"_v_{n}"), F.col("_v_blank"), F.col(f"_v_hit_{n}"), line(k), score(k), least, review)
        made[n] = F.when(F.col(f"_v_{n}") != "", c) if optional else c
    made["alcohol"] = alcohol_check(F.col("_v_alcohol_content"), F.col("_v_rule"), F.col("_v_listed"), F.col("_v_marked"))
    made["net"] = net_check(F.col("_v_net_contents"), F.col("_v_hit_net"), line(4), score(4))
    order = ["brand_name", "class_type", "alcohol", "net", "name_address", "country_of_origin"]
    checks = F.array(*[made[k] for k in order], warning_check(F.col("_v_blank"), F.col("_v_heading"), F.col("_v_found"), F.col("_v_required")))
    return df.select(*rows.columns, F.filter(checks, lambda c: c.isNotNull()).alias("checks"))


def overall(checks: Column) -> Column:
    """Severity maximum of a label's checks; PASS for none."""
    has = lambda r: F.exists(checks, lambda c: c["result"] == r)
    return F.when(has(FAIL), OVERALL[FAIL]).when(has(REVIEW), OVERALL[REVIEW]).otherwise(OVERALL[PASS])


def count_of(checks: Column, result: str) -> Column:
    return F.size(F.filter(checks, lambda c: c["result"] == result))


def issues(checks: Column) -> Column:
    """`Check: Notes` of all checks that didn't pass, in order."""
    bad = F.filter(checks, lambda c: c["result"].isin(REVIEW, FAIL))
    return F.when(F.size(bad) == 0, NO_ISSUES).otherwise(F.array_join(F.transform(bad, lambda c: F.concat(c["check"], F.lit(": "), c["notes"])), "; "))


def check_rows(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per check, with its place in the label's order."""
    return exploded(checked.select(*keys, "checks"), F.col("checks"), ["check_no", "c"]).select(*keys, "check_no", "c.*")


def attention_items(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("result").isin(REVIEW, FAIL))
