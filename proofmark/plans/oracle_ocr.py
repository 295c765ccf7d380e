"""SQL for DuckDB of the cleaning and folding of recognised text and the recovery of values.

Folding is told without a fold: a line that lies within a dropped one lies within what that was
dropped for, so a line goes where any line or header before it, kept or not, is equal or holds it.
"""

from __future__ import annotations

from string import ascii_uppercase

from proofmark.plans import oracle as o

FOUR = "|".join(c + "{4,}" for c in ascii_uppercase)
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
FRONT, BACK = "Front / Brand Label OCR", "Back Label OCR"


def useful(x: str) -> str:
    """Figures worth keeping, in upper case with plain word borders."""
    patterns = [r"\b\d{1,5}\b", r"\b\d{1,3}(\.\d+)?\s*%", r"\b\d{1,4}(\.\d+)?\s*(ML|L)\b", r"\b\d{1,3}(\.\d+)?\s*PROOF\b", r"\(\s*\d+\s*\)", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"]
    return "(" + " or ".join(f"regexp_matches({x}, {o.q(o.spaced(p))})" for p in patterns) + ")"


def varied(x: str) -> str:
    return f"len(list_distinct(string_split({x}, '')))::double / len({x})"


def judged_cte(src: str, name: str = "judged") -> str:
    """`judged`: the columns of src, which has a trimmed line s, and whether it is garbage."""
    words = f"""list_filter(list_transform(regexp_extract_all(s, '[A-Za-z]{{2,}}'), lambda w: upper(w)), lambda w: len(w) >= 3 and not regexp_matches(w, '{FOUR}') and not (len(w) >= 8 and {varied('w')} < 0.35) and regexp_matches(w, '[AEIOU]'))"""
    return f"""
    {name}_f as (select *, regexp_replace({o.up('s')}, '[^A-Z]', '', 'g') as letters, regexp_matches(s, '\\p{{Nd}}') as digit, {useful(o.plain_words(o.up('s')))} as useful, {words} as words,
      len(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as alnum, len({o.sub('regexp_replace(s, ' + o.q(chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}]+') + ', ' + o.q('') + ', ' + o.q('g') + ')', o.WS, '')}) as signs from {src}),
    {name} as (select *, s = '' or letters in ('BRANDLABEL', 'BACKLABEL', 'BRANDLABELBACKLABEL') or (len(letters) <= 1 and not digit) or alnum = 0 or (len(s) > 8 and alnum::double / len(s) < 0.32)
      or (not useful and ((len(letters) <= 2 and not digit) or (len(s) >= 8 and signs::double / len(s) >= 0.18) or (len(letters) >= 8 and (regexp_matches(letters, '{FOUR}') or {varied('letters')} < 0.35))
        or not (len(words) >= 2 or (len(words) = 1 and len(words[1]) >= 4) or (len(letters) between 2 and 5 and {o.up('s')} = s and regexp_matches(s, '^[A-Z0-9 .,%/:-]+$'))))) as garbage from {name}_f)"""


def repaired_line(x: str) -> str:
    head = f"regexp_matches({o.repaired(x)}, '(?i)^GOVERNMENT{o.WS}+WARNING:?$')"
    return f"case when {head} then 'GOVERNMENT WARNING:' else {o.repaired_rest(o.repaired(x))} end"


def cleaned_cte(src: str, keys: str, text: str, name: str = "cleaned") -> str:
    """`cleaned`: (keys, line_no, s) of the lines of a text that cleaning keeps, repaired."""
    return f"""
    {name}_l as (select {keys}, unnest(l) as line, unnest(range(len(l))) as line_no from (select {keys}, regexp_split_to_array({o.no_null(text)}, {o.q(BREAKS)}) as l from {src})),
    {name}_r as (select {keys}, line_no, {repaired_line('line')} as s from {name}_l),
    {judged_cte(f"{name}_r", f"{name}_j")},
    {name} as (select {keys}, line_no, s from {name}_j where s <> '' and not garbage)"""


def regions_cte() -> str:
    """`regions`: label texts as overlapping regions (file_name, region_ord, kind, title, source, raw_text)."""
    upto = lambda x: f"array_to_string(l[1:greatest(1, {x})], chr(10))"
    region = lambda k, kind, title, source, raw: f"select file_name, {k} as region_ord, '{kind}' as kind, '{title}' as title, '{source}' as source, {raw} as raw_text from t"
    return f"""
    with t as (select cast(row_id as varchar) as file_name, string_split(detected_text, chr(10)) as l from batch where detected_text is not null),
    regions as ({region(0, 'visible', FRONT, 'region', upto('len(l) * 2 // 3'))} union all {region(1, 'visible', FRONT, 'region', upto('len(l) // 3'))}
      union all {region(2, 'visible', BACK, 'region', "array_to_string(l[greatest(1, len(l) // 2):], chr(10))")} union all {region(3, 'candidate', '', 'candidate', "array_to_string(list_filter(l, lambda x: regexp_matches(x, '[0-9]')), chr(10))")})"""


def folded_cte() -> str:
    """`folded` (file_name, visible_text) of the visible regions."""
    key = o.key_of
    dropped = lambda earlier: f"exists (select 1 from {earlier} e where e.file_name = x.file_name and (e.k = x.k or (len(x.k) >= 5 and contains(e.k, x.k))))"
    before = "exists (select 1 from keyed e where e.file_name = x.file_name and (e.region_ord, e.line_no) < (x.region_ord, x.line_no) and e.k <> '' and (e.k = x.k or (len(x.k) >= 5 and contains(e.k, x.k))))"
    header = lambda n: f"""h{n} as (select distinct file_name, {key('title')} as k from (select * from {' union all select * from '.join(f'kept{i}' for i in range(n))}))"""
    kept = lambda n: f"kept{n} as (select * from keyed x where region_ord = {n} and k <> '' and not {before}" + (f" and not {dropped(f'h{n}')}" if n else "") + ")"
    return f"""
    {cleaned_cte("(select * from regions where kind = 'visible')", "file_name, region_ord, title", "raw_text")},
    keyed as (select *, {key('s')} as k from cleaned),
    {kept(0)}, {header(1)}, {kept(1)}, {header(2)}, {kept(2)},
    sections as (select file_name, region_ord, title, string_agg(s, chr(10) order by line_no) as body from (select * from kept0 union all select * from kept1 union all select * from kept2) group by all),
    headed as (select *, row_number() over (partition by file_name, lower(title) order by region_ord) = 1 as fresh from sections),
    folded as (select f.file_name, coalesce(g.body, '') as visible_text from (select distinct file_name from regions where kind = 'visible') f left join (select file_name, {o.strip("string_agg(case when fresh then title || ':' || chr(10) else '' end || body, chr(10) || chr(10) order by region_ord)")} as body from headed group by file_name) g using (file_name))"""


def votes_cte() -> str:
    """`elected` (file_name, field_no, field, value, display, score)."""
    n = rf"\b({o.N}{{1,3}}(?:[.,]{o.N}{{1,2}})?)"
    abv = o.values("u", [n + r"\s*%?\s*(?:ALC\.?\s*/?\s*VOL\.?|ABV)\b", n + r"\s*(?:%|PERCENT)\b"], ">= 0.5", "<= 95")
    proof = o.values("u", [n + r"\s*PROOF\b"], ">= 1", "<= 200")
    sized = o.q(o.spaced(rf"\b({o.N}{{1,4}}(?:[.,]{o.N}{{1,2}})?)\s*(ML|M[L1I]|L)\b"))
    made = lambda xs, field, shown: f"list_transform({xs}, lambda v: {{'field': '{field}', 'display': {shown}, 'value': v::double}})"
    size = f"list_transform(list_zip(regexp_extract_all(u, {sized}, 1), regexp_extract_all(u, {sized}, 2)), lambda z: {{'v': {o.number('z[1]')}, 'm': z[2] like 'M%'}})"
    ml, litres = f"list_transform(sizes, lambda z: case when z.m then {o.usual_ml('z.v')} end)", f"list_transform(sizes, lambda z: case when not z.m and round(z.v, 2) in (1.0, 1.5, 1.75) then round(z.v, 2) end)"
    nets = "list_filter(list_transform(range(1, len(sizes) + 1), lambda i: case when ml[i] is not null then {'field': 'net_contents', 'display': ml[i] || ' ML', 'value': ml[i]::double} when litres[i] is not null then {'field': 'net_contents', 'display': (" + o.shown("litres[i]") + ") || ' L', 'value': litres[i]::double} end), lambda x: x is not null)"
    return f"""
    up as (select file_name, region_ord, source, {o.plain_words(o.up('raw_text'))} as u from regions),
    zs as (select *, {size} as sizes from up), zm as (select *, {ml} as ml, {litres} as litres from zs),
    cands as (select file_name, region_ord, source, {made(abv, 'abv', '(' + o.shown('v') + ") || '% ALC/VOL'")} || {made(proof, 'proof', '(' + o.shown('v') + ") || ' PROOF'")} || {nets} as l from zm),
    one as (select file_name, region_ord, source, unnest(l) as c, unnest(range(len(l))) as pos from cands),
    firsts as (select file_name, region_ord, source, c, min(pos) as pos from one group by all),
    votes as (select file_name, c.field as field, round(c.value, 2) as value, c.display as display, cast(sum(case source when 'region' then 3 when 'candidate' then 2 when 'primary' then 2 else 1 end) as bigint) as score, min((region_ord, pos)) as seen from firsts group by all),
    elected as (select file_name, case field when 'abv' then 1 when 'proof' then 2 else 3 end as field_no, field, value, display, score from (select *, row_number() over (partition by file_name, field order by score desc, seen) as rn from votes) where rn = 1)"""


def label_texts_sql() -> str:
    known = o.states_alcohol(o.plain_words(o.up("seen")))
    return f"""{regions_cte()}, {folded_cte()}, {votes_cte()},
    {cleaned_cte("folded", "file_name", "visible_text", "again")},
    seen as (select f.file_name, coalesce(string_agg(a.s, chr(10) order by a.line_no), '') as seen from folded f left join again a using (file_name) group by f.file_name),
    facts as (select *, {known} as known, {o.key_of('seen')} as k from seen),
    shown as (select f.file_name, string_agg(display, chr(10) order by field_no) as block from facts f join elected e using (file_name) where not (field in ('abv', 'proof') and known) and not ({o.key_of('display')} <> '' and contains(k, {o.key_of('display')})) group by f.file_name)
    select f.file_name, concat_ws(chr(10) || chr(10), nullif(seen, ''), 'Recovered structured field candidates:' || chr(10) || block) as detected_text from facts f left join shown s using (file_name)"""


def oracle_sql() -> dict[str, str]:
    return {
        "line_garbage": f"with l as (select doc_id, line_no, {o.strip('line')} as s from {o.lines('documents')}), {judged_cte('l')} select doc_id, line_no, s = '' as blank, garbage from judged",
        "clean_texts": f"with {cleaned_cte('batch', 'row_id', 'detected_text')} select b.row_id, coalesce(string_agg(s, chr(10) order by line_no), '') as clean_text from batch b left join cleaned c using (row_id) group by b.row_id",
        "combined_regions": f"{regions_cte()}, {folded_cte()} select * from folded",
        "best_candidates": f"{regions_cte()}, {votes_cte()} select * from elected",
        "label_texts": label_texts_sql(),
    }
