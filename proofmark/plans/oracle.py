"""The same queries as SQL for DuckDB, written on their own: string in, string out.

Its expressions have no look-around and no back references and know only ASCII white space in
patterns, so the classes are spelt out and phrase borders are matched by characters.
"""

from __future__ import annotations

# The results depend on each of these, so they are stated here again, on their own.
ML_SIZES, L_SIZES = [50, 100, 187, 200, 250, 300, 330, 341, 355, 375, 500, 700, 720, 750, 1000, 1500, 1750], [1.0, 1.5, 1.75]
FILE_WORDS = "application applications app label labels ttb cola f510031 form test sample official filled pdf csv json txt distillery imports import importer company inc llc".split()
TRUE, FALSE = ["true", "t", "yes", "y", "1", "required", "checked"], ["false", "f", "no", "n", "0", "not required", "unchecked"]
BATCH_FALSE = ["false", "no", "n", "0", "not required", "unchecked"]
NO_FIELDS = "No supported expected-field values were found. You can still enter the fields manually."
TARGET_SECONDS = 5.0
HEADING, STATEMENT = "GOVERNMENT WARNING:", "Standard government warning statement"
MARKER_DETECTED = "Alcohol content marker found, but numeric value was not clearly captured"
MARKER_NOTE = "OCR detected an alcohol-content marker such as '%', 'ALC/VOL', or 'PROOF', but did not capture a clear numeric value. Manual review or text correction is recommended."
WARNING_PHRASES = [
    "according to the surgeon general",
    "women should not drink alcoholic beverages during pregnancy",
    "risk of birth defects",
    "consumption of alcoholic beverages impairs your ability to drive a car or operate machinery",
    "may cause health problems",
]

# White space as Unicode has it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
N = r"[0-9OILS|]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values: list) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def up(x: str) -> str:
    """Upper case with the letters that become two."""
    for a, b in (("ß", "SS"), ("ﬀ", "FF"), ("ﬁ", "FI"), ("ﬂ", "FL"), ("ﬃ", "FFI"), ("ﬄ", "FFL")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"upper({x})"


def plain_words(x: str) -> str:
    """Letters beyond ASCII as Q, other signs as ~, so that word borders fall as in Unicode."""
    s = sub(x, "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]", " ")
    return sub(sub(s, "[^\\x00-\\x7F\\p{L}\\p{N}]", "~"), "[^\\x00-\\x7F]", "Q")


def no_null(x: str) -> str:
    return f"coalesce({x}, '')"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def collapse(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def quotes(x: str) -> str:
    return f"""translate({x}, '‘’“”', '''''""')"""


def norm(x: str) -> str:
    s = f"replace({quotes(up(no_null(x)))}, '&', ' AND ')"
    return collapse(sub(s, r"""[!"#$&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", ""))


def phrase(x: str) -> str:
    return collapse(quotes(f"lower({no_null(x)})"))


def tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[A-Z0-9%]+')"


def holds(expected: str, text: str) -> str:
    """Both normalised already."""
    return f"({expected} <> '' and {text} <> '' and regexp_matches({text}, '(^|[^A-Z0-9])\\Q' || {expected} || '\\E([^A-Z0-9]|$)'))"


def key_of(x: str) -> str:
    return sub(up(no_null(x)), "[^A-Z0-9]+", "")


def number(x: str) -> str:
    return f"try_cast(nullif(regexp_replace(translate(upper({x}), 'OIL|S,', '01115.'), '[^0-9.]', '', 'g'), '') as double)"


def shown(v: str) -> str:
    return f"case when {v} = floor({v}) then cast(try_cast({v} as bigint) as varchar) else cast({v} as varchar) end"


def spaced(pattern: str) -> str:
    """White space in a pattern as Unicode has it."""
    return pattern.replace(r"\s", WS)


def values(x: str, patterns: list[str], low: str, high: str) -> str:
    found = " || ".join(f"regexp_extract_all({x}, {q(spaced(p))}, 1)" for p in patterns)
    return f"list_filter(list_transform({found}, lambda m: {number('m')}), lambda n: n is not null and n {low} and n {high})"


PCT = [rf"\b({N}{{1,3}}(?:[.,]{N}+)?)\s*%", rf"\b({N}{{1,3}}(?:[.,]{N}+)?)\s*PERCENT\b", rf"\b({N}{{1,3}}(?:[.,]{N}+)?)\s*%?\s*(?:ALC\.?\s*/?\s*VOL\.?|ABV)\b"]
PROOF = [rf"\b({N}{{1,3}}(?:[.,]{N}+)?)\s*PROOF\b"]


def percents(x: str) -> str:
    return values(x, PCT, "> 0", "<= 100")


def proofs(x: str) -> str:
    return values(x, PROOF, "> 0", "<= 200")


def states_alcohol(x: str) -> str:
    n = rf"\b{N}{{1,3}}(?:[.,]{N}{{1,2}})?"
    return "(" + " or ".join(f"regexp_matches({x}, {q(spaced(n + p))})" for p in (r"\s*%?\s*(?:ALC\.?\s*/?\s*VOL\.?|ABV)\b", r"\s*(?:%|PERCENT)\b", r"\s*PROOF\b")) + ")"


def in_order(x: str) -> str:
    """Distinct list items, first seen first."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def net(x: str) -> str:
    s = up(no_null(x))
    for a, b in (("MILLILITERS", "ML"), ("MILLILITRES", "ML"), ("LITERS", "L"), ("LITRES", "L")):
        s = f"replace({s}, '{a}', '{b}')"
    return collapse(sub(sub(s, r"(\d+)\s*ML", r"\1 ML"), r"(\d+)\s*L\b", r"\1 L"))


def usual_ml(v: str) -> str:
    r = f"try_cast(round_even({v}, 0) as integer)"
    return f"case when list_contains({ML_SIZES}, {r}) then {r} when {r} between 725 and 775 then 750 when {r} between 1725 and 1775 then 1750 end"


def lines(table: str) -> str:
    key = "doc_id" if table == "documents" else "row_id"
    col = "text" if table == "documents" else "detected_text"
    return f"(select {key}, unnest(l) as line, cast(unnest(range(len(l))) as integer) as line_no from (select {key}, string_split({col}, chr(10)) as l from {table} where {col} is not null))"


def repaired(x: str) -> str:
    """A line's repairs but the last step, which depends on the heading."""
    s = collapse(sub(strip(no_null(x)), '^["`“”]+|["`“”]+$', ""))
    for a in ("ALC/ VOL", "ALC /VOL", "ALC / VOL", "ALC./VOL.", "ALC./VOL", "ALC/VOL."):
        s = f"replace({s}, '{a}', 'ALC/VOL')"
    s = sub(s, rf"(?i)\bAccording{WS}+to[.,]{WS}+the\b", "According to the")
    s = strip(sub(s, rf"{WS}*\|+$", ""))
    s = strip(sub(s, rf"^[|\\/\-–—_]+{WS}*", ""))
    return sub(s, rf"(?i)\bFREDERICK,{WS}*MD\b", "FREDERICK, MD")


def repaired_rest(s: str) -> str:
    s = sub(s, rf"(?i)^\(?[3I|l]\){WS}+According\b", "(1) According")
    s = sub(s, r"(?i)\bbevorages\b", "beverages")
    s = sub(s, rf"(?i)\bmachinery\.{WS}+and\b", "machinery, and")
    s = sub(s, rf"{WS}+([,.;:])", r"\1")
    return strip(sub(s, "[,.;]+$", ""))


def warning_sql(src: str = "select row_id, failed_checks <> 2 as required, detected_text from batch") -> str:
    """Of src(row_id, required, detected_text); the plain query asks for the warning where two checks didn't fail."""
    n, total = "len(found)", len(WARNING_PHRASES)
    cols = {
        "expected": ["'Not required'", "'Required'", q(HEADING), q(STATEMENT), q(STATEMENT), q(STATEMENT), q(STATEMENT)],
        "detected": ["'Not checked'", "''", "'Incorrect warning heading capitalization'", "'Warning heading and required phrases found'", f"'Found ' || {n} || ' of {total} required phrases'", f"'Found ' || {n} || ' warning-related phrases but no correct heading'", "''"],
        "result": ["'PASS'", "'FAIL'", "'FAIL'", "'PASS'", "'REVIEW'", "'REVIEW'", "'FAIL'"],
        "notes": [
            "'Government warning check was not required for this review.'",
            "'No label text was provided for warning validation.'",
            "'Warning heading must appear as ''GOVERNMENT WARNING:'' in all caps.'",
            "'Government warning text appears to be present with correct heading capitalization.'",
            "'Warning heading was found, but the warning text appears incomplete. Missing phrase examples: ' || array_to_string(missing[1:2], ', ') || '.'",
            "'Warning-like text was found, but the required ''GOVERNMENT WARNING:'' heading was missing.'",
            "'Required government warning statement was not found on the label.'",
        ],
    }
    when = ["not required", "one = ''", "wrong", f"heading and {n} = {total}", f"heading and {n} > 0", f"{n} >= 2"]
    case = lambda v: "case " + " ".join(f"when {w} then {x}" for w, x in zip(when, v)) + f" else {v[-1]} end"
    return f"""
    with t as (select row_id, required, {collapse(no_null('detected_text'))} as one, {phrase('detected_text')} as low from ({src})),
    h as (select row_id, required, one, contains(one, {q(HEADING)}) as heading,
      list_filter({lst(WARNING_PHRASES)}, lambda p: contains(low, p)) as found, list_filter({lst(WARNING_PHRASES)}, lambda p: not contains(low, p)) as missing,
      not contains(one, {q(HEADING)}) and regexp_matches(one, '(?i)government\\s+warning\\s*:') as wrong from t)
    select row_id, {", ".join(f"{case(v)} as {k}" for k, v in cols.items())} from h"""


def alcohol_sql(src: str = "batch") -> str:
    near = lambda a, b, tol: f"abs({a} - {b}) <= {tol}::double"
    any_ = lambda xs, cond: f"len(list_filter({xs}, lambda d: {cond})) > 0"
    by_pct = f"list_transform(wp, lambda e: case when {any_('gp', near('e', 'd', 0.2))} then 1 when {any_('gq', near('e * 2', 'd', 0.5))} then 2 end)"
    by_proof = f"list_transform(wq, lambda e: case when {any_('gq', near('e', 'd', 0.5))} then 3 when {any_('gp', near('d * 2', 'e', 0.5))} then 4 end)"
    notes = ["Expected ABV found on label.", "Expected ABV matches detected proof.", "Expected proof found on label.", "Expected proof matches detected ABV."]
    marker = spaced(r"(%|ALC\.?\s*/?\s*VOL\.?|ABV|PROOF)")
    return f"""
    with a as (select row_id, {strip(no_null('alcohol_content'))} as e, {no_null('detected_text')} as t from {src}),
    b as (select row_id, e, t, {plain_words(up('e'))} as ue, {plain_words(up('t'))} as ut from a),
    v as (select row_id, e, ut, {percents('ue')} as wp0, {proofs('ue')} as wq0, {percents('ut')} as gp0, {proofs('ut')} as gq0 from b),
    o as (select row_id, e, ut, {in_order('wp0')} as wp, {in_order('wq0')} as wq, {in_order('gp0')} as gp, {in_order('gq0')} as gq from v),
    r as (select row_id, e, ut, list_filter(({by_pct}) || ({by_proof}), lambda x: x is not null)[1] as rule,
      concat_ws('; ', case when len(gp) > 0 then 'Percent values: ' || array_to_string(list_transform(gp, lambda x: ({shown('x')}) || '%'), ', ') end, case when len(gq) > 0 then 'Proof values: ' || array_to_string(list_transform(gq, lambda x: {shown('x')}), ', ') end) as seen from o)
    select row_id, e as expected,
      case when e = '' then '' when rule is not null or seen <> '' then seen when regexp_matches(ut, {q(marker)}) then {q(MARKER_DETECTED)} else '' end as detected,
      case when e = '' then 'REVIEW' when rule is not null then 'PASS' when seen <> '' or regexp_matches(ut, {q(marker)}) then 'REVIEW' else 'FAIL' end as result,
      case when e = '' then 'No expected alcohol content was provided.' {" ".join(f"when rule = {k} then {q(n)}" for k, n in enumerate(notes, 1))}
        when seen <> '' then 'Alcohol content found, but it does not clearly match the expected value.' when regexp_matches(ut, {q(marker)}) then {q(MARKER_NOTE)} else 'Alcohol content was not found on the label.' end as notes
    from r"""


def candidates_sql() -> str:
    n = rf"\b({N}{{1,3}}(?:[.,]{N}{{1,2}})?)"
    abv = values("t", [n + r"\s*%?\s*(?:ALC\.?\s*/?\s*VOL\.?|ABV)\b", n + r"\s*(?:%|PERCENT)\b"], ">= 0.5", "<= 95")
    proof = values("t", [n + r"\s*PROOF\b"], ">= 1", "<= 200")
    sized = spaced(rf"\b({N}{{1,4}}(?:[.,]{N}{{1,2}})?)\s*(ML|M[L1I]|L)\b")
    return f"""
    with b as (select row_id, {plain_words(up('detected_text'))} as t from batch where detected_text is not null),
    m as (select row_id, {number('x')} as v, u from (select row_id, unnest(regexp_extract_all(t, {q(sized)}, 1)) as x, unnest(regexp_extract_all(t, {q(sized)}, 2)) as u from b)),
    s as (select row_id, v, case when u like 'M%' then {usual_ml('v')} end as ml, case when u = 'L' and list_contains({L_SIZES}, round(v, 2)) then round(v, 2) end as l from m),
    a as (select row_id, unnest({abv}) as v from b), p as (select row_id, unnest({proof}) as v from b)
    select distinct row_id, field, display, value from (
      select row_id, 'abv' as field, ({shown('v')}) || '% ALC/VOL' as display, v as value from a
      union all select row_id, 'proof', ({shown('v')}) || ' PROOF', v from p
      union all select row_id, 'net_contents', ml || ' ML', ml::double from s where ml is not null
      union all select row_id, 'net_contents', ({shown('l')}) || ' L', l from s where l is not null)"""


def records_cte() -> str:
    """Records judged and cut by one pattern of a sound record for each delimiter."""
    by_d = lambda pattern: "case d when ';' then " + q(pattern.replace("D", ";")) + " else " + q(pattern.replace("D", ",")) + " end"
    field = '(?:"(?:[^"]|"")*"|[^"D]*)'
    plain = "case when starts_with(v, '\"') then replace(v[2:-2], '\"\"', '\"') else v end"
    at = lambda n: f"vals[list_position(names, '{n}')]"
    return f"""
    with h as (select source_file, min(raw_record) as header from raw_application where record_no = 0 group by source_file),
    hd as (select source_file, header, case when len(regexp_extract_all(header, ';')) > len(regexp_extract_all(header, ',')) then ';' else ',' end as d from h),
    hn as (select source_file, d, list_transform(string_split(header, d), lambda c: trim(regexp_replace(lower(c), '[^a-z0-9]+', '_', 'g'), '_')) as names from hd),
    r as (select a.record_id, a.source_file, a.record_no, a.raw_record, coalesce(a.raw_record, '') as t, hn.d, hn.names from raw_application a left join hn on a.source_file = hn.source_file where a.record_no > 0),
    s as (select *, regexp_full_match(t, {by_d(f"{field}(?:D{field})*")}) as well, list_transform(regexp_extract_all(d || t, {by_d(f"D({field})")}, 1), lambda v: {plain}) as vals from r),
    f as (select *, case when names is null then 'no_header' when not well then 'quoting' when len(vals) <> len(names) then 'column_count'
      when (list_contains(names, 'file_name') and not regexp_full_match(coalesce({strip(at('file_name'))}, ''), '(?is).+\\.(png|jpe?g)'))
        or (list_contains(names, 'warning_required') and lower(coalesce({strip(at('warning_required'))}, '')) not in ('', 'true', 'false', 'yes', 'no', 'y', 'n', '1', '0', 'required', 'not required', 'checked', 'unchecked')) then 'invalid_value' end as reason from s)"""


def loaded_sql() -> str:
    at = lambda n: strip(f"vals[list_position(names, '{n}')]")
    texts = ["file_name", "brand_name", "class_type", "alcohol_content", "net_contents", "name_address", "country_of_origin"]
    false = "('false', 'no', 'n', '0', 'not required', 'unchecked')"
    return f"{records_cte()} select record_id, source_file, record_no, {', '.join(f'nullif({at(n)}, {q('')}) as {n}' for n in texts)}, coalesce(lower({at('warning_required')}) not in {false}, true) as warning_required from f where reason is null"


def units_sql(everything: bool = False) -> str:
    """Amounts by unit words and, for bare numbers, by the source's note: those in other units, or all."""
    comma = "case when regexp_matches(x, '^[1-9][0-9]{0,2},[0-9]{3}$') then replace(x, ',', '') else replace(x, ',', '.') end"
    words = {"twenty": 20, "sixty": 60, "eighty": 80, "eighty-six": 86, "ninety": 90, "one hundred": 100}
    word = "case " + " ".join(f"when v like '{w} proof' then {n}" for w, n in words.items()) + " end"
    number_in = f"(select try_cast({comma} as decimal(18,6)) from (select regexp_extract(v, '([0-9][0-9.,]*[0-9]|[0-9])') as x))"
    unit_a = r"""case when regexp_matches(v, '%|percent|per cent') then 'percent' when regexp_matches(v, 'proof') then 'proof' when regexp_matches(v, '‰|per mille|ml/l|ml of alcohol per litre') then 'mille' when regexp_matches(v, 'fraction|by volume') then 'one'
      when not regexp_matches(v, '[^0-9.,\s]') then (case when regexp_matches(note, 'proof') then 'proof' when regexp_matches(note, 'per thousand') then 'mille' when regexp_matches(note, 'share of one') then 'one' when regexp_matches(note, 'per ?cent') then 'percent' end) end"""
    size_note = r"regexp_extract(note, '((a size with|bare container|container sizes|contents are|sizes come|bottle size|volume column)[^;.]*)')"
    unit_n = rf"""case when regexp_matches(v, '\bml\b|[0-9]ml|millilit') then 'ml' when regexp_matches(v, '[0-9 ]cl\b|centilit') then 'cl' when regexp_matches(v, '\bdl\b') then 'dl' when regexp_matches(v, 'pint') then 'pint' when regexp_matches(v, '\bqt\b') then 'quart' when regexp_matches(v, '\bgal') then 'gallon'
      when regexp_matches(v, 'oz|fluid ounce') then 'oz' when regexp_matches(v, '[0-9 ]l\b|lit(re|er)|ltr') then 'l'
      when not regexp_matches(v, '[^0-9.,\s]') then (case when regexp_matches({size_note}, 'centilit|\bcl\b') then 'cl' when regexp_matches({size_note}, 'millilit') then 'ml' when regexp_matches({size_note}, 'fl oz|fluid ounce') then 'oz' when regexp_matches({size_note}, 'litre') then 'l' end) end"""
    half = f"coalesce(case when regexp_matches(v, '^half') then 0.5::decimal(18,6) when regexp_matches(v, '^one ') then 1 end, {number_in})"
    plus = r"coalesce(try_cast(nullif(regexp_extract(v, 'pint ([0-9.]+) fl oz', 1), '') as decimal(18,6)), 0)"
    ctes = f"""
    with s as (select source_id, lower(min(note)) as note from application_source group by source_id),
    r as (select a.row_id, lower(a.alcohol_content) as a, lower(a.net_contents) as n, a.source_id, a.alcohol_content as ta, a.net_contents as tn, s.note from sample_application a left join s on a.source_id = s.source_id),
    x as (select row_id, a as v, {unit_a.replace('(v,', '(a,')} as unit from r),
    al as (select row_id, v, unit, coalesce({word}, {number_in}) as num from x where unit is not null),
    y as (select row_id, n as v, {unit_n.replace('(v,', '(n,')} as unit from r),
    ne as (select row_id, v, unit, {half} as num, {plus} as more from y where unit is not null)
    """
    if everything:
        before = lambda unit: f"(select try_cast({comma} as decimal(18,6)) from (select nullif(regexp_extract(v, '([0-9][0-9.,]*[0-9]|[0-9])\\s*(?:{unit})', 1), '') as x))"
        mille = "case when v like '%ml%' then 'ml/l' else 'per mille' end"
        return ctes + f"""
        , aa as (select r.row_id, source_id, ta, unit, coalesce(case when unit = 'percent' then {before('%|percent|per cent')} end, {word}, {number_in}) as num, r.a as v from r join x using (row_id)),
        nn as (select r.row_id, source_id, tn, unit, coalesce(case when unit = 'ml' then {before('ml|millilit')} end, {half}) as num, {plus} as more, r.n as v from r join y using (row_id))
        select row_id, source_id, 'alcohol_content' as field, ta as text, cast(round(num * case unit when 'percent' then 100 when 'proof' then 50 when 'mille' then 10 when 'one' then 10000 end, 0) as bigint) as amount,
          case when num is null or unit is null then '' when unit = 'mille' then {mille} when unit = 'one' then 'fraction' else unit end as unit, coalesce(unit = 'percent' and num is not null, false) as own from aa
        union all
        select row_id, source_id, 'net_contents', tn, cast(round(num * case unit when 'ml' then 1 when 'cl' then 10 when 'dl' then 100 when 'l' then 1000 when 'oz' then 29.5735 when 'pint' then 473.176 when 'quart' then 946.353 when 'gallon' then 3785.41 end + more * 29.5735, 0) as bigint),
          case when num is null or unit is null then '' when unit = 'oz' then 'fl oz' when unit = 'pint' and more > 0 then 'pint+fl oz' else unit end, coalesce(unit = 'ml' and num is not null, false) from nn"""
    return ctes + f"""
    select row_id, 'alcohol_content' as field, cast(round(num * case unit when 'proof' then 50 when 'mille' then 10 when 'one' then 10000 end, 0) as bigint) as amount from al where unit <> 'percent' and num is not null
    union all
    select row_id, 'net_contents', cast(round(num * case unit when 'cl' then 10 when 'dl' then 100 when 'l' then 1000 when 'oz' then 29.5735 when 'pint' then 473.176 when 'quart' then 946.353 when 'gallon' then 3785.41 end + more * 29.5735, 0) as bigint) from ne where unit <> 'ml' and num is not null"""


def text_applications_sql() -> str:
    """The expected rows as their text files give them back."""
    one_line = lambda c: sub(c, "[\\r\\n]+", " ")
    read = lambda c: strip(sub(sub(strip(no_null(one_line(c))), "^/", ""), "[ \\t]+", " "))
    fields = [("brand_name", "Brand Name"), ("class_type", "Class/Type"), ("alcohol_content", "Alcohol Content"), ("net_contents", "Net Contents"), ("name_address", "Name / Address"), ("country_of_origin", "Country of Origin")]
    told = ", ".join(f"case when {c} <> '' then {q(label)} end" for c, label in fields)
    return f"""
    with r as (select row_id, lower({read('warning_required')}) as w, {", ".join(f"{read(c)} as {c}" for c, _ in fields)} from sample_application)
    select row_id || '.txt' as source_name, 'TXT' as source_format, cast(null as varchar) as error, {", ".join(c for c, _ in fields)}, '' as product_type, '' as fanciful_name,
      case when list_contains({lst(FALSE)}, w) then false else true end as warning_required,
      case when concat_ws(', ', {told}) = '' then {q(NO_FIELDS)} else 'Imported fields: ' || concat_ws(', ', {told}) || '.' end as messages
    from r"""


def region_table_sql() -> str:
    front, back, label = "Front / Brand Label OCR", "Back Label OCR", "Label OCR"
    side = [(front, (0.03, 0.04, 0.49, 0.27), 6), (front, (0.06, 0.22, 0.48, 0.51), 6), (front, (0.03, 0.58, 0.50, 0.90), 6), (back, (0.55, 0.04, 0.98, 0.31), 6), (back, (0.55, 0.22, 0.98, 0.44), 6), (back, (0.55, 0.34, 0.98, 0.86), 6), ("", (0.02, 0.58, 0.50, 0.90), 6), ("", (0.08, 0.66, 0.48, 0.91), 11)]
    general = [(label, (0, 0, 1, 1), 4), (label, (0, 0, 1, 1), 11), (label, (0, 0, 1, 0.28), 6), (label, (0, 0.12, 1, 0.45), 6), (label, (0, 0.30, 1, 0.96), 6), ("", (0, 0.50, 1, 1), 6), ("", (0, 0.50, 1, 1), 11)]
    rows = [(i, "side_by_side" if i < 8 else "general", *r) for i, r in enumerate(side + general)]
    one = lambda i, strategy, title, box, psm: f"({i}, {q(strategy)}, {q(title)}, {', '.join(f'{x}::double' for x in box)}, {psm}, {i in (5, 7, 13, 14)}, {i in (7, 14)})"
    return f"select region_ord, strategy, case when title = '' then 'candidate' else 'visible' end as kind, title, l, t, r, b, psm, threshold, \"numeric\" from (values {', '.join(one(*r) for r in rows)}) x(region_ord, strategy, title, l, t, r, b, psm, threshold, \"numeric\")"


def joined_cte() -> str:
    """`j`: applications with the last text of their file name and the outcome of the join."""
    last = "row_number() over (partition by file_name order by processed_at desc nulls last, row_id desc)"
    return f"""
    with l as (select file_name as k, detected_text, processing_time_s from (select *, {last} as rn from batch where file_name is not null) where rn = 1),
    a as (select *, {strip(no_null('file_name'))} as key from sample_application),
    j as (select a.*, l.detected_text, l.processing_time_s, case when key = '' then 'missing_name' when l.k is null then 'missing_image' else 'matched' end as outcome from a left join l on a.key = l.k)"""


def oracle_sql() -> dict[str, str]:
    cc = strip(no_null("country_of_origin"))
    stem = f"trim({sub(f'lower({sub(no_null("file_name"), r"(?s)\.[^.]*$", "")})', '[^a-z0-9]+', ' ')})"
    value = strip(sub(sub(f"replace({sub(strip(no_null('name_address')), '^/', '')}, chr(13), chr(10))", "[ \\t]+", " "), "\\n{3,}", "\n\n"))
    bools = f"lower({strip(no_null('warning_required'))})"
    kv = r"^(.{2,80}?)(?:\s*[:=]\s*|\s+-\s+)(.+)$"
    edits = ["brand_name", "class_type", "net_contents"]
    head = f"regexp_matches(s, '(?i)^GOVERNMENT{WS}+WARNING:?$')"
    return {
        "text_normalized": f"select row_id, {norm('brand_name')} as brand, {norm('name_address')} as address from sample_application",
        "text_tokens": f"select row_id, array_to_string({tokens('name_address')}, ' ') as tokens from sample_application",
        "text_phrases": f"select row_id, {phrase('detected_text')} as phrase, {collapse(no_null('detected_text'))} as spaces from batch",
        "phrase_containment": f"select row_id, {holds('b', 't')} as brand_found, {holds('c', 't')} as class_found from (select row_id, {norm('brand_name')} as b, {norm('class_type')} as c, {norm('detected_text')} as t from batch)",
        "token_coverage": f"select row_id, case when len(e) = 0 then 0.0::double else len(list_intersect(e, t))::double / len(e) end as coverage from (select row_id, list_distinct({tokens('name_address')}) as e, {tokens('detected_text')} as t from batch)",
        "cells_and_keys": f"select row_id, {cc} as cell, trim({sub(f"replace(lower({no_null('class_type')}), '&', ' and ')", '[^a-z0-9]+', ' ')}) as key, trim({sub(f"lower({strip(no_null('class_type'))})", '[^a-z0-9]+', '_')}, '_') as column_name, {value} as value from sample_application",
        "file_names": f"select row_id, stem, array_to_string(list_sort(list_distinct(list_filter(string_split(stem, ' '), lambda w: w <> '' and not list_contains({lst(FILE_WORDS)}, w)))), ' ') as words, extension from (select row_id, {stem} as stem, case when contains({no_null('file_name')}, '.') then lower({strip('string_split(file_name, chr(46))[-1]')}) else '' end as extension from sample_application)",
        "text_previews": f"select row_id, replace(substr({strip(no_null('detected_text'))}, 1, 250), chr(10), ' ') as preview from batch",
        "elapsed_times": "select row_id, case when processing_time_s < 1 then printf('%.2f seconds', processing_time_s) when processing_time_s >= 1 then printf('%.1f seconds', processing_time_s) end as elapsed from batch",
        "alcohol_values": f"select row_id, array_to_string(list_transform(list_sort(list_distinct({percents('t')})), lambda x: {shown('x')}), ',') as percent, array_to_string(list_transform(list_sort(list_distinct({proofs('t')})), lambda x: {shown('x')}), ',') as proof, {states_alcohol('t')} as stated from (select row_id, {plain_words(up(no_null('detected_text')))} as t from batch)",
        "recognised_numbers": f"select row_id, {number('alcohol_content')} as strength, {usual_ml('v')} as size from (select row_id, alcohol_content, {number('net_contents')} as v from sample_application)",
        "net_contents_normalized": f"select row_id, {net('net_contents')} as net from sample_application",
        "candidate_presence": f"select row_id, n <> '' and contains(t, n) as net_present, a <> '' and contains(t, a) as alcohol_present from (select row_id, {key_of('net_contents')} as n, {key_of('alcohol_content')} as a, {key_of('detected_text')} as t from batch)",
        "warning_phrases": f"select row_id, cast(len(list_filter({lst(WARNING_PHRASES)}, lambda p: contains(low, p))) as integer) as n_found, array_to_string(list_filter({lst(WARNING_PHRASES)}, lambda p: not contains(low, p)), '; ') as missing from (select row_id, {phrase('detected_text')} as low from batch)",
        "booleans": f"select row_id, not list_contains({lst(BATCH_FALSE)}, b) as batch_required, case when list_contains({lst(TRUE)}, b) then true when list_contains({lst(FALSE)}, b) then false else true end as application_required from (select row_id, {bools} as b from sample_application)",
        "status_labels": "select row_id, case overall_result when 'PASS' then '✅ PASS' when 'REVIEW' then '⚠️ REVIEW' when 'FAIL' then '❌ FAIL' when 'Not implemented' then '⏳ Not implemented' else overall_result end as status from batch",
        "line_keys": f"select row_id, line_no, {key_of('line')} as line_key from {lines('batch')}",
        "line_repairs": f"select row_id, line_no, case when {head} then 'GOVERNMENT WARNING:' else {repaired_rest('s')} end as repaired from (select row_id, line_no, {repaired('line')} as s from {lines('batch')})",
        "field_candidates": candidates_sql(),
        "join_outcome": f"{joined_cte()} select row_id, outcome, cast(len(detected_text) as integer) as text_length from j",
        "batch_summary": "select count(*) as total, count(*) filter (overall_result = 'PASS') as passed, count(*) filter (overall_result = 'MANUAL REVIEW RECOMMENDED') as review, count(*) filter (overall_result = 'FAIL') as failed from batch",
        "alcohol_checks": alcohol_sql(),
        "warning_checks": warning_sql(),
        "timing_summary": f"select count(t) as timed, avg(t) as mean_seconds, avg(t) <= {TARGET_SECONDS} as within_target, sum(t) as total_seconds from (select round_even(processing_time_s, 2) as t from batch)",
        "duplicate_names": "select file_name, count(*) as n from batch where file_name is not null group by file_name having count(*) > 1",
        "blank_names": f"select count(*) as rows, count(*) filter ({strip(no_null('file_name'))} = '') as blank_names, count(*) > 25 as large_batch from batch",
        "reviewer_edits": f"with e as (select file_name, {', '.join(f'arg_max(v_{c}, (processed_at, v_{c})) filter (v_{c} is not null) as {c}' for c in edits)} from (select file_name, processed_at, {', '.join(f'nullif({strip(no_null(c))}, {q("")}) as v_{c}' for c in edits)} from batch where file_name is not null and processed_at is not null) group by file_name) select s.row_id, s.file_name, {', '.join(f'coalesce(e.{c}, s.{c}) as {c}' for c in edits)}, s.alcohol_content from sample_application s left join e on s.file_name = e.file_name",
        "key_value_lines": f"with l as (select doc_id, line_no, {strip('line')} as s from {lines('documents')}), p as (select doc_id, line_no, {strip(f'regexp_extract(s, {q(kv)}, 1)')} as key, {strip(f'regexp_extract(s, {q(kv)}, 2)')} as value from l where regexp_matches(s, {q(kv)})) select doc_id, key, value from p where key <> '' and value <> '' qualify row_number() over (partition by doc_id, key order by line_no desc) = 1",
        "text_applications": text_applications_sql(),
        "p3_found": f"{records_cte()} select record_id, reason from f where reason is not null and reason <> 'no_header'",
        "p3_rejects": f"{records_cte()} select record_id, source_file, record_no, reason, raw_record as corrupt_text from f where reason is not null",
        "p3_loaded": loaded_sql(),
        "p5_found": units_sql(),
        "p5_amounts": units_sql(True),
        "region_table": region_table_sql(),
    }
