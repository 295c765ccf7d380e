"""SQL for DuckDB of the checks of labels, their fuzzy scores and the results of a batch.

The longest common subsequence is found by thresholds: for every length the earliest place in the
one text at which a common subsequence of that length ends, updated letter by letter of the other.
The matching-blocks ratio takes the longest common piece apart and goes on left and right of it.
"""

from __future__ import annotations

from proofmark.plans import oracle as o

SOME = 1_000_000


def lcs(a: str, b: str) -> str:
    at = f"list_transform(range(1, len({b}) + 1), lambda i: list_filter(range(1, len({a}) + 1), lambda j: substr({a}, j, 1) = substr({b}, i, 1)))"
    nxt = f"list_transform(range(1, len(ends) + 1), lambda v: least(coalesce(ends[v + 1], {SOME}), coalesce(list_min(list_filter(places, lambda p: p > ends[v])), {SOME})))"
    return f"(len(list_reduce({at}, lambda ends, places: [0::bigint] || list_filter({nxt}, lambda x: x < {SOME}), [0::bigint])) - 1)"


def ratio(a: str, b: str) -> str:
    return f"case when len({a}) + len({b}) = 0 then 100.0::double else 200.0::double * {lcs(a, b)} / (len({a}) + len({b})) end"


def in_sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"


def scores_cte(pairs: str) -> str:
    """Scores of distinct pairs (ne, nl) of normalised texts, none of them empty."""
    words = lambda x: f"list_distinct(regexp_extract_all({x}, '[A-Z0-9%]+'))"
    return f"""
    sp as (select distinct ne, nl, {in_sorted_words('ne')} as se, {in_sorted_words('nl')} as sl, {words('ne')} as we, {words('nl')} as wl from {pairs}),
    sr as (select ne, nl, {ratio('ne', 'nl')} as indel, {ratio('se', 'sl')} as token_sort, case when len(we) = 0 then 0.0 else len(list_intersect(we, wl))::double / len(we) end as covered from sp),
    sc as (select ne, nl, indel, token_sort, cast(case when ne = '' or nl = '' then 0 when ne = nl or {o.holds('ne', 'nl')} then 100
      else round_even(least(greatest(indel, token_sort), case when covered < 0.5 then 60 when covered < 0.75 then 82 else 100 end), 0) end as integer) as score from sr)"""


#: column, label, least score for PASS and for REVIEW, whether a blank value omits the check, place
FIELDS = [("brand_name", "Brand Name", 92, 75, False, 0), ("class_type", "Class/Type", 92, 75, False, 1), ("net_contents", "Net Contents", 90, 75, False, 3), ("name_address", "Name/Address", 88, 72, True, 4), ("country_of_origin", "Country of Origin", 90, 75, True, 5)]


def checks_cte(src: str) -> str:
    """CTEs ending in `checks` (row_id, place, name, expected, detected, result, notes) of the rows of
    src(row_id, detected_text, the expected fields, required)."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    wanted = " union all ".join(
        f"select row_id, {o.q(c)} as field, {o.q(label)} as name, {least} as least_pass, {review} as least_review, {omit} as omits, {place} as place, {c} as expected, "
        + (f"{o.holds('nn', 'nt')} as hit from (select *, {o.norm(o.net(c))} as nn, {o.norm(o.net('t'))} as nt from given)" if c == "net_contents" else f"{o.holds('nn', 'nt')} as hit from (select *, {o.norm(c)} as nn, {o.norm('t')} as nt from given)")
        for c, label, least, review, omit, place in FIELDS
    )
    net = "field = 'net_contents'"
    by = lambda net_note, note: f"case when {net} then {o.q(net_note)} else {o.q(note)} end"
    told = "' Match score: ' || score || '.'"
    close, similar, absent = by("Close normalized net contents match found.", "Close normalized match found on label."), by("Similar net contents text found; manual review recommended.", "Similar text found; manual review recommended."), by("Expected net contents were not found on label.", "Expected value was not found on label.")
    return f"""
    given as (select row_id, {', '.join(f"{o.strip(o.no_null(c))} as {c}" for c, *_ in FIELDS)}, {o.no_null('detected_text')} as t from {src}),
    wanted as ({wanted}),
    judged as (select w.*, {o.strip('g.t')} = '' as blank, {o.norm('w.expected')} as ne from wanted w join given g using (row_id)),
    label_lines as (select row_id, line_no, line, {o.norm('line')} as nl from (select row_id, unnest(l) as line, unnest(range(len(l))) as line_no from (select row_id, list_filter(list_transform(regexp_split_to_array(t, {o.q(breaks)}), lambda x: {o.strip('x')}), lambda x: x <> '') as l from given))),
    open_pairs as (select j.row_id, j.field, j.ne, l.line_no, l.line, l.nl from judged j join label_lines l using (row_id) where not j.hit and not j.blank and j.ne <> '' and l.nl <> ''),
    {scores_cte('open_pairs')},
    best as (select row_id, field, line, score from (select p.row_id, p.field, p.line, s.score, row_number() over (partition by p.row_id, p.field order by s.score desc, p.line_no) as rn from open_pairs p join sc s on p.ne = s.ne and p.nl = s.nl) where rn = 1 and score > 0),
    scored as (select j.*, coalesce(b.line, '') as line, coalesce(b.score, 0) as score from judged j left join best b on j.row_id = b.row_id and j.field = b.field),
    text_checks as (select row_id, place, name, expected,
      case when expected = '' then '' when blank and not {net} then '' when hit then expected else line end as detected,
      case when expected = '' then 'REVIEW' when blank and not {net} then 'FAIL' when hit or score >= least_pass then 'PASS' when score >= least_review then 'REVIEW' else 'FAIL' end as result,
      case when expected = '' then {by('No expected net contents value was provided.', 'No expected value was provided.')} when blank and not {net} then 'No label text was provided for comparison.'
        when hit then {by('Expected net contents found on label.', 'Expected value found on label.')} when score >= least_pass then {close} || {told} when score >= least_review then {similar} || {told} else {absent} || {told} end as notes
      from scored where not (omits and expected = '')),
    alcohol_checks as ({o.alcohol_sql(src)}),
    warning_checks as ({o.warning_sql(f"select row_id, required, detected_text from {src}")}),
    checks as (select * from text_checks union all select row_id, 2, 'Alcohol Content', expected, detected, result, notes from alcohol_checks union all select row_id, 6, 'Government Warning', expected, detected, result, notes from warning_checks),
    counted as (select row_id, case when bool_or(result = 'FAIL') then 'FAIL' when bool_or(result = 'REVIEW') then 'MANUAL REVIEW RECOMMENDED' else 'PASS' end as overall_result,
      cast(count(*) filter (result = 'PASS') as integer) as pass, cast(count(*) filter (result = 'REVIEW') as integer) as review, cast(count(*) filter (result = 'FAIL') as integer) as fail,
      coalesce(string_agg(name || ': ' || notes, '; ' order by place) filter (result <> 'PASS'), 'No review or failure items found.') as issues from checks group by row_id)"""


OF_BATCH = "with src as (select *, true as required from batch)"


def core_sql(extra: str = "", columns: str = 'row_id, check_no, name as "check", expected, detected, result, notes') -> str:
    return f'{OF_BATCH}, {checks_cte("src")} select {columns} from (select *, cast(row_number() over (partition by row_id order by place) - 1 as integer) as check_no from checks) {extra}'


def results_sql(select: str) -> str:
    """The results of all applications against the last text of their file name."""
    src = f"""{o.joined_cte()},
    src as (select j.*, lower({o.strip(o.no_null('j.warning_required'))}) not in ('false', 'no', 'n', '0', 'not required', 'unchecked') as required from j)"""
    cell = lambda c: f"{o.strip(o.no_null('s.' + c))} as {c}"
    ok = "s.outcome = 'matched'"
    cells = ["brand_name", "class_type", "alcohol_content", "net_contents", "name_address", "country_of_origin"]
    return f"""{src}, {checks_cte("src")},
    results as (select s.row_id, {cell('file_name')}, case when {ok} then c.overall_result else 'FAIL' end as overall_result, case when {ok} then c.pass else 0 end as passed_checks, case when {ok} then c.review else 0 end as manual_review_checks, case when {ok} then c.fail else 1 end as failed_checks,
      {', '.join(map(cell, cells))}, case s.outcome when 'matched' then c.issues when 'missing_name' then 'CSV row is missing a file_name value.' else 'Matching image file was not uploaded.' end as issues,
      case when {ok} then replace(substr({o.strip(o.no_null('s.detected_text'))}, 1, 250), chr(10), ' ') else '' end as ocr_text_preview, round_even(s.processing_time_s, 2) as processing_time_s
      from src s join counted c using (row_id))
    {select}"""


def blocks_cte(pairs: str) -> str:
    """`matching` (a, b, ratio) of the distinct pairs (a, b): matching blocks, the longest first, the
    earliest on ties, then what is left and right of it."""
    reach = "list_transform(range(1, len(x) + 1), lambda i: {'n': coalesce(list_max(list_filter(range(1, len(x) - i + 2), lambda n: contains(y, substr(x, i, n)))), 0), 'i': -i})"
    return f"""
    dp as (select distinct a, b from {pairs}),
    pieces as (
      select a, b, a as x, b as y, 0::bigint as n from dp
      union all
      select a, b, case when side = 0 then substr(x, 1, -m.i - 1) else substr(x, m.n - m.i) end, case when side = 0 then substr(y, 1, pos - 1) else substr(y, pos + m.n) end, case when side = 0 then m.n else 0 end
      from (select *, instr(y, substr(x, -m.i, m.n)) as pos from (select a, b, x, y, list_max({reach}) as m from pieces where len(x) > 0 and len(y) > 0)), (values (0), (1)) sides(side) where m.n > 0),
    matching as (select a, b, case when len(a) + len(b) = 0 then 1.0::double else 2.0::double * sum(n) / (len(a) + len(b)) end as ratio from pieces group by a, b)"""


def similarity_sql() -> str:
    return f"""
    with recursive p as (select b.row_id, {o.norm('a.brand_name')} as ne, {o.norm('b.brand_name')} as nl, {o.no_null('a.class_type')} as a, {o.no_null('b.class_type')} as b from batch b join sample_application a on a.file_name = b.file_name),
    {scores_cte('p')}, {blocks_cte('p')}
    select p.row_id, s.indel, s.token_sort, s.score, m.ratio as sequence from p join sc s on p.ne = s.ne and p.nl = s.nl join matching m on p.a = m.a and p.b = m.b"""


def oracle_sql() -> dict[str, str]:
    one = {"brand_checks": "Brand Name", "class_checks": "Class/Type", "net_contents_checks": "Net Contents", "name_address_checks": "Name/Address", "country_checks": "Country of Origin"}
    return {
        "similarity": similarity_sql(),
        "core_checks": core_sql(),
        "attention": core_sql("where result in ('REVIEW', 'FAIL')"),
        "label_counts": f'{OF_BATCH}, {checks_cte("src")} select * from counted',
        "batch_results": results_sql("select * from results"),
        "own_summary": results_sql("select count(*) as total, count(*) filter (overall_result = 'PASS') as passed, count(*) filter (overall_result = 'MANUAL REVIEW RECOMMENDED') as review, count(*) filter (overall_result = 'FAIL') as failed from results"),
    } | {k: core_sql(f"where name = {o.q(v)}", "row_id, expected, detected, result, notes") for k, v in one.items()}
