"""SQL for DuckDB of application files: nested JSON laid flat, the first record of CSV files, fields by
their aliases, images by their names, and what is made of them."""

from __future__ import annotations

from proofmark.plans import oracle as o
from proofmark.plans.oracle_checks import blocks_cte

# Names of fields in order of preference, labels, words and messages.
ALIASES = {
    "brand_name": ["brand name", "brand", "item 6", "item 6 brand name", "6 brand name"],
    "class_type": ["class type", "class and type", "class type designation", "class designation", "type designation", "class", "type", "product designation"],
    "alcohol_content": ["alcohol content", "alcohol by volume", "alc vol", "abv", "proof", "percent alcohol"],
    "net_contents": ["net contents", "net content", "bottle size", "container size", "volume", "contents"],
    "warning_required": ["warning required", "government warning required", "health warning required", "government health warning required", "requires warning"],
    "product_type": ["type of product", "product type", "item 5", "item 5 type of product", "5 type of product"],
    "fanciful_name": ["fanciful name", "item 7", "item 7 fanciful name", "7 fanciful name"],
    "name_address": ["name address", "name and address", "name and address of applicant", "applicant name and address", "applicant address", "bottler address", "producer address", "importer address", "item 8", "item 8 name and address", "8 name and address"],
    "country_of_origin": ["country of origin", "origin country", "import country", "country"],
}
LABELS = {"brand_name": "Brand Name", "class_type": "Class/Type", "alcohol_content": "Alcohol Content", "net_contents": "Net Contents", "product_type": "Product Type", "fanciful_name": "Fanciful Name", "name_address": "Name / Address", "country_of_origin": "Country of Origin"}
ABSENT = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NO_ROWS = "The uploaded CSV did not contain any rows."
MORE_ROWS = "The CSV contains multiple rows. Single-label review imported the first row only. Use Batch Applications for multi-row review."
MORE_RECORDS = "The JSON contains multiple records. Single-label review imported the first record only."
NO_MATCH = "Could not confidently match this application to a label image filename. Review and fill in file_name before processing."


def scalar(v: str) -> str:
    """A JSON scalar in words."""
    return f"case json_type({v}) when 'BOOLEAN' then case when {v}::varchar = 'true' then 'True' else 'False' end when 'NULL' then null else {v} ->> '$' end"


def json_cte() -> str:
    """`entries` (file_id, place, key, value) of the JSON files."""
    items = "list_filter(list_transform(json_extract(v, '$[*]'), lambda x: trim(" + scalar("x") + ")), lambda x: x <> '')"
    return f"""
    docs as (select file_id, ltrim(content, chr(65279))::json as j from imports_application where file_format = 'json'),
    nodes as (
      select file_id, j, '' as prefix, []::bigint[] as trail, true as root, false as leaf, '' as key from docs
      union all
      select file_id, case when json_type(c.v) = 'ARRAY' and (root_list or json_type(c.v -> '$[0]') = 'OBJECT') then c.v -> '$[0]' else c.v end, trim(prefix || ' ' || c.k), list_append(trail, c.i),
        root_list and json_type(c.v -> '$[0]') = 'ARRAY', not (json_type(c.v) = 'OBJECT' or root_list or (json_type(c.v) = 'ARRAY' and json_type(c.v -> '$[0]') = 'OBJECT')), trim(prefix || ' ' || c.k)
      from (select file_id, prefix, trail, root and json_type(j) = 'ARRAY' as root_list,
          unnest(case when root and json_type(j) = 'ARRAY' then [{{'k': '', 'i': 0::bigint, 'v': j}}] else list_transform(range(1, len(json_keys(j)) + 1), lambda i: {{'k': json_keys(j)[i], 'i': i, 'v': j -> ('$."' || json_keys(j)[i] || '"')}}) end) as c
        from nodes where not leaf and json_type(j) in ('ARRAY', 'OBJECT'))),
    leaves as (select file_id, key, trail, case when json_type(v) = 'ARRAY' then array_to_string({items}, ', ') else {scalar('v')} end as value from (select file_id, key, trail, j as v from nodes where leaf)),
    entries as (select file_id, cast(row_number() over (partition by file_id order by first) - 1 as integer) as place, key, value from (select file_id, key, min(trail) as first, arg_max(coalesce({{'v': value}}, {{'v': null}}), trail).v as value from leaves group by file_id, key))"""


def parsed_cte() -> str:
    """`parsed`: one row per application file, as the engine's parse_files gives it, messages joined."""
    field = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'
    cells = lambda r: f"list_transform(regexp_extract_all(',' || {r}, {o.q(',(' + field + ')')}, 1), lambda v: case when starts_with(v, '\"') then replace(v[2:-2], '\"\"', '\"') else v end)"
    value = o.strip(o.sub(o.sub("replace(" + o.sub(o.strip(o.no_null("value")), "^/", "") + ", chr(13), chr(10))", "[ \\t]+", " "), "\\n{3,}", "\n\n"))
    key = f"trim({o.sub("replace(lower(" + o.no_null('key') + "), '&', ' and ')", '[^a-z0-9]+', ' ')})"

    def of(f: str) -> str:
        exact = "list_transform(" + o.lst(ALIASES[f]) + ", lambda a: list_filter(e, lambda x: x.key = a and x.value <> '')[1].value)"
        loose = f"list_filter(e, lambda x: x.value <> '' and len(list_filter({o.lst(ALIASES[f])}, lambda a: len(list_filter(string_split(a, ' '), lambda w: not list_contains(string_split(x.key, ' '), w))) = 0)) > 0)[1].value"
        return f"coalesce(list_filter({exact}, lambda v: v is not null)[1], {loose}, '') as {f}"

    told = "concat_ws(', ', " + ", ".join(f"case when {f} <> '' then {o.q(label)} end" for f, label in LABELS.items()) + ")"
    fields = [f for f in ALIASES if f != "warning_required"]
    records = r"""list_filter(regexp_extract_all(ltrim(content, chr(65279)), '(?:"(?:[^"]|"")*"|[^"\r\n])+'), lambda r: r <> '')"""
    return f"""
    tables as (select file_id, {records} as r from imports_application where file_format = 'csv'),
    pairs as (select file_id, unnest(range(len(h))) as place, unnest(h) as key, unnest(list_transform(range(1, len(h) + 1), lambda i: case when list_contains({o.lst(ABSENT)}, v[i]) then null else v[i] end)) as value from (select file_id, {cells('r[1]')} as h, {cells('r[2]')} as v from tables where len(r) > 1)),
    every as (select file_id, place, {key} as key, {value} as value from (select file_id, place, key, value from pairs union all select * from entries)),
    normal as (select file_id, key, min(place) as place, arg_max(value, place) as value from every group by file_id, key),
    lists as (select file_id, list({{'key': key, 'value': value}} order by place) as e from normal group by file_id),
    counts as (select file_id, len(r) - 1 as n from tables union all select file_id, case when json_type(j) = 'ARRAY' then json_array_length(j) else 1 end from docs),
    valued as (select a.file_id, a.file_format, c.n, {', '.join(of(f) for f in ALIASES)} from imports_application a left join lists l using (file_id) left join counts c using (file_id)),
    parsed as (select file_id || '.' || file_format as source_name, upper(file_format) as source_format, cast(null as varchar) as error, {', '.join(fields)},
      not list_contains({o.lst(o.FALSE)}, lower(warning_required)) as warning_required,
      case when file_format = 'csv' and n <= 0 then {o.q(NO_ROWS)} else concat_ws(' ', case when n > 1 then case when file_format = 'csv' then {o.q(MORE_ROWS)} else {o.q(MORE_RECORDS)} end end,
        case when {told} = '' then {o.q(o.NO_FIELDS)} else 'Imported fields: ' || {told} || '.' end) end as messages,
      list_filter([case when n > 1 then case when file_format = 'csv' then {o.q(MORE_ROWS)} else {o.q(MORE_RECORDS)} end end, case when {told} = '' then {o.q(o.NO_FIELDS)} else 'Imported fields: ' || {told} || '.' end], lambda m: m is not null) as message_list
      from valued)"""


def matches_cte(apps: str) -> str:
    """`matched` (app_name, image_name): the image of greatest score, blank on ties and where no word is
    shared. A shared word counts ten and the ratio one at most, so only images that share the most are scored."""
    stem = lambda x: f"trim({o.sub(f'lower({o.sub(x, r'(?s)\.[^.]*$', '')})', '[^a-z0-9]+', ' ')})"
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '' and not list_contains({o.lst(o.FILE_WORDS)}, w)))"
    return f"""
    an as (select app_name, {stem('app_name')} as stem from (select distinct app_name from ({apps}))),
    im as (select image_name, times, {stem('image_name')} as stem from (select file_name as image_name, count(*) as times from batch where file_name is not null group by 1)),
    aw as (select app_name, unnest({words('stem')}) as w from an), iw as (select image_name, unnest({words('stem')}) as w from im),
    shared as (select app_name, image_name, count(*) as k from aw join iw using (w) group by 1, 2),
    most as (select s.app_name, s.image_name, a.stem as a, i.stem as b, i.times from (select *, max(k) over (partition by app_name) as top from shared) s join an a using (app_name) join im i using (image_name) where k = top),
    {blocks_cte('most')},
    ranked as (select app_name, ratio, sum(times) as times, min(image_name) as image_name, max(ratio) over (partition by app_name) as top from most m join matching r on m.a = r.a and m.b = r.b group by app_name, ratio),
    matched as (select an.app_name, coalesce(case when r.times = 1 then r.image_name end, '') as image_name from an left join ranked r on an.app_name = r.app_name and r.ratio = r.top)"""


FILES = "select file_id || '.' || file_format as app_name from imports_application"


def imported_sql() -> str:
    fields = ["brand_name", "class_type", "net_contents"]
    return f"""
    with i as ({o.text_applications_sql()}), c as (select row_id, {o.up('brand_name')} as brand_name, class_type, '75 cl' as net_contents from sample_application)
    select c.row_id, {', '.join(f"coalesce(nullif(i.{f}, ''), c.{f}) as {f}" for f in fields)}, i.warning_required from c join i on i.source_name = c.row_id || '.txt'"""


def oracle_sql() -> dict[str, str]:
    start = f"with recursive {json_cte()}, {parsed_cte()}"
    metadata = ["product_type", "fanciful_name", "name_address", "country_of_origin"]
    cols = "source_name, source_format, error, " + ", ".join(f for f in ALIASES if f != "warning_required") + ", warning_required, messages"
    batch = f"{start}, {matches_cte(FILES)}, made as (select m.image_name as file_name, p.source_name as application_file, brand_name, class_type, alcohol_content, net_contents, name_address, country_of_origin, warning_required from parsed p join matched m on m.app_name = p.source_name)"
    return {
        "json_entries": f"with recursive {json_cte()} select file_id, place, key, value from entries",
        "parsed_applications": f"{start} select {cols} from parsed",
        "metadata_rows": f"{start} " + " union all ".join(f"select source_name, '{m}' as field, {m} as imported_value from parsed where {m} <> ''" for m in metadata),
        "imported_fields": imported_sql(),
        "file_matches": "with recursive " + matches_cte(r"select regexp_replace(file_name, '_?\d*\.[A-Za-z]+$', '', 'g') || '_application.csv' as app_name from sample_application where file_name is not null") + " select * from matched",
        "generated_batch": f"{batch} select * from made",
        "batch_messages": f"{batch} select application_file, application_file || ': ' || m as message from (select source_name as application_file, unnest(message_list) as m from parsed union all select application_file, {o.q(NO_MATCH)} from made where file_name = '')",
    }
