"""Queries of the general data-preparation operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import enzymes, reports, shred, units
from graphloom.storage import table


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def p2_found(spark, d):
    return units.found(*_t(spark, d, "bindingdb", "depositor", "canonical_interaction", "dataset_note"))


def p2_converted(spark, d):
    """Values in nM to 9 digits, so that the last bits of powers do not matter."""
    values = units.convert(units.quantities(*_t(spark, d, "bindingdb", "depositor", "canonical_interaction", "dataset_note")))
    return values.select("source_table", "record_id", "field_name", "unit_name", F.format_string("%.8e", "converted").try_cast("double").alias("converted"))


def p5_found(spark, d):
    return enzymes.found(*_t(spark, d, "brenda"))


def p5_proteins(spark, d):
    return enzymes.proteins(*_t(spark, d, "brenda"))


def p5_ligand_items(spark, d):
    return enzymes.ligand_items(*_t(spark, d, "brenda"))


def nested_coverage(spark, d):
    store = enzymes.columns(table(spark, d, "brenda"))
    return reports.nested_coverage(enzymes.table_of(store, "proteins"), enzymes.table_of(store, "accessions"), store.select(F.col("record_id").alias("entry_id")))


def unreadable_records(spark, d):
    return shred.unreadable(table(spark, d, "brenda"), "entry_id", "record_json").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_converted, p5_found, p5_proteins, p5_ligand_items, nested_coverage, unreadable_records)}
_LIGAND = "(inhibitor|ki_value|ic50_value|km_value|turnover_number)(:[0-9]+)?"


def _list(v: str) -> str:
    return f"case when {v} is null or json_type({v}) = 'NULL' then [] when json_type({v}) = 'ARRAY' then json_extract({v}, '$[*]') else [{v}] end"


def _numbered(v: str) -> str:
    return f"list_zip(range(len({_list(v)})), {_list(v)})"


def _text(v: str) -> str:
    return f"case when json_type({v}) in ('NULL', 'OBJECT', 'ARRAY') then null else json_extract_string({v}, '$') end"


_ITEMS = f"""entries as materialized (select entry_id, record_json::json as j from brenda), fields as (select entry_id, k as field_name, json_extract(j, '$."' || k || '"') as v from (select entry_id, j, unnest(json_keys(j)) as k from entries) where regexp_full_match(k, '{_LIGAND}')),
items as (select entry_id, field_name, x[1] as item_no, x[2] as item from (select entry_id, field_name, unnest({_numbered('v')}) as x from fields))"""
_PROTEINS = f"""prot as (select entry_id, place, k, json_extract(p, '$."' || k || '"') as o from (select entry_id, p, unnest(list_zip(range(len(json_keys(p))), json_keys(p)))[1] as place, unnest(list_zip(range(len(json_keys(p))), json_keys(p)))[2] as k from (select entry_id, json_extract(j, '$.protein') as p from entries) where json_type(p) = 'OBJECT'))"""
_ACCESSIONS = f"""owners as (select entry_id, k as protein_key, o from prot union all select entry_id, {_text("json_extract(u, '$.key')")}, u from (select entry_id, unnest({_list("json_extract(o, '$.subunits')")}) as u from prot)),
acc as (select distinct entry_id, trim(protein_key) as protein_key, trim(case when json_type(x) = 'OBJECT' then json_extract_string(x, '$.id') else {_text('x')} end) as accession from (select entry_id, protein_key, unnest({_list("json_extract(o, '$.accessions')")}) as x from owners))"""

# The conversion of text to units, with patterns that need no looking back.
_LITRE = "\\s*(/\\s*l(it(re|er)s?)?|per\\s+l(it(re|er))?|l\\s*(\\^?\\s*[-−–]\\s*1|⁻¹))"
_SQL_UNIT = f"((pico|nano|micro|milli)?molar|[pnuµμm]?mol(es?)?{_LITRE}|[pnuµμm]?m)"
_SQL_NUMBER = "([0-9][0-9.,\'\']*(e[+-]?[0-9]+)?|\\.[0-9]+)(\\s*[x×*·]\\s*10\\s*\\^?\\s*[-−–+]?[0-9]+)?"
_SQL_VALUE = f"(?i)^[\\s<>=~≤≥≈]*(p\\s?(ki|kd|km|ic\\s?50)\\s*[:=]?\\s*)?[<>=~≤≥≈\\s]*{_SQL_NUMBER}\\s*((±|\\+/-)\\s*{_SQL_NUMBER})?\\s*[(\\[]?\\s*{_SQL_UNIT}?\\s*[)\\]]?\\s*$"


def _sql_name(word: str) -> str:
    w = f"lower({word})"
    return f"case when {w} like 'p%' then 'pM' when {w} like 'n%' then 'nM' when {w} similar to '[uµμ].*' or {w} like 'micro%' then 'uM' when {w} like 'milli%' or {w} like 'mm%' then 'mM' when {w} <> '' then 'M' end"


def _sql_note(c: str) -> str:
    unit = f"((?i:(pico|nano|micro|milli)?molar|[pnuµμm]?mol(es?)?{_LITRE})|[pnuµμm][mM]|M)"
    amount = f"(^|[^\\p{{L}}\\p{{N}}.,])[0-9][0-9.,]*\\s*((?i:(pico|nano|micro|milli)?molar|[pnuµμm]?mol(es?)?{_LITRE})|[pnuµμm][mM]|M)($|[^\\p{{L}}\\p{{N}}])"
    log = "(?i)neg(ative|\\.)?\\s+(decadic\\s+)?log|[-−–]\\s*log|logarithmic|(^|[^\\p{L}\\p{N}])p(x|ki|kd|km|ic\\s?50|ec\\s?50)($|[^\\p{L}\\p{N}])"
    rest = f"regexp_replace({c}, '{amount}', '\\1 \\7', 'g')"
    word = f"regexp_extract({rest}, '(^|[^\\p{{L}}\\p{{N}}]){unit}($|[^\\p{{L}}\\p{{N}}])', 2)"
    return f"case when regexp_matches({c}, '{log}') then '-log M' else {_sql_name(word)} end"


_SQL_FIELD = "replace(lower(regexp_extract({c}, '(?i)(^|[^\\p{{L}}\\p{{N}}])(ki|kd|ic\\s?50)\\s+(is\\s+in|column\\s+in|values?\\s+in|only\\s*:)', 2)), ' ', '')".format(c="curator_note")
_UNITS = f"""with vals as (select entry_id, depositor_id, curator_note, f, replace(v, chr(160), ' ') as v from (select entry_id, depositor_id, curator_note, unnest(['ki', 'kd', 'ic50']) as f, unnest([ki, kd, ic50]) as v from bindingdb)),
a as (select 'bindingdb' as source_table, entry_id as record_id, f as field_name, coalesce(case when regexp_matches(v, '(?i)^[\\s<>=~≤≥≈]*p\\s?(ki|kd|km|ic\\s?50)') then '-log M' else {_sql_name(f"regexp_extract(regexp_replace(regexp_extract(v, '{_SQL_VALUE}', 0), '[)\\]\\s]+$', ''), '(?i)([pnuµμm]?m|(pico|nano|micro|milli)?molar|[pnuµμm]?mol(es?)?{_LITRE})$', 0)")} end,
 case when {_SQL_FIELD} in ('', f) then {_sql_note('curator_note')} end, {_sql_note('practice_note')}, 'nM') as unit_name, v, null::double as raw from vals left join depositor using (depositor_id) where regexp_matches(v, '{_SQL_VALUE}')),
told as (select lower(trim(source_dataset)) as s, case when regexp_matches(unit_note, '(?i)no (concentration|unit)|dimensionless|confidence') then 'none' else {_sql_note('unit_note')} end as u from dataset_note),
parts as (select source_dataset, i, lower(trim(p)) as s from (select source_dataset, unnest(range(len(string_split(source_dataset, '|')))) as i, unnest(string_split(source_dataset, '|')) as p from (select distinct source_dataset from canonical_interaction where source_dataset is not null))),
sets as (select source_dataset, arg_min(u, i) as u from parts join told using (s) where u is not null group by source_dataset),
b as (select 'canonical_interaction' as source_table, interaction_id as record_id, 'raw_score' as field_name, coalesce({_sql_note('score_note')}, u, 'nM') as unit_name, null::varchar as v, raw_score as raw from canonical_interaction left join sets using (source_dataset) where raw_score is not null and not isnan(raw_score) and coalesce(u, '') <> 'none')
select source_table, record_id, field_name, unit_name from (select * from a union all select * from b) where unit_name <> 'nM'"""

_MANTISSA = f"lower(regexp_extract(v, '{_SQL_VALUE}', 3))"
_THOUSANDS = "'[1-9][0-9]{0,2}(' || %s || '[0-9]{3})+(\\.[0-9]*)?(e[+-]?[0-9]+)?'"
_CONVERTED = f"""{_UNITS[:_UNITS.rindex("select source_table")]}, nums as (select source_table, record_id, field_name, unit_name, coalesce(raw, try_cast(case when regexp_full_match({_MANTISSA}, {_THOUSANDS % "','"}) then replace({_MANTISSA}, ',', '')
 when regexp_full_match({_MANTISSA}, {_THOUSANDS % "chr(39)"}) then replace({_MANTISSA}, chr(39), '') else replace({_MANTISSA}, ',', '.') end as double)
 * pow(10.0, coalesce(try_cast(replace(replace(regexp_extract(regexp_extract(v, '{_SQL_VALUE}', 5), '10\\s*\\^?\\s*([-−–+]?[0-9]+)$', 1), '−', '-'), '–', '-') as integer), 0))) as x from (select * from a union all select * from b))
 select source_table, record_id, field_name, unit_name, format('{{:.8e}}', case when unit_name = '-log M' then pow(10.0, 9 - x) when x > 0 then pow(10.0, log10(x) + case unit_name when 'pM' then -3 when 'uM' then 3 when 'mM' then 6 when 'M' then 9 else 0 end)
 when x = 0 then 0.0 end)::double as converted from nums where x is not null"""

# Numbers without a fraction are written as whole numbers, here as in the operator.
SQL: dict[str, str] = {
    "p2_found": _UNITS,
    "p2_converted": _CONVERTED,
    "unreadable_records": "select case when record_json is null or trim(record_json) = '' then 'missing' when not json_valid(record_json) then 'malformed' else 'no object' end as reason, count(*) as n from brenda where record_json is null or not json_valid(record_json) or json_type(record_json) <> 'OBJECT' group by 1",
    "p5_found": f"""with {_ITEMS}, {_PROTEINS}, {_ACCESSIONS}, refs as (select distinct entry_id, field_name, item_no, trim({_text('r')}) as protein_key from (select entry_id, field_name, item_no, unnest({_list("json_extract(item, '$.proteins')")}) as r from items where json_type(item) = 'OBJECT'))
 select entry_id, field_name, item_no, protein_key, accession from refs join acc using (entry_id, protein_key) where accession <> '' and protein_key <> ''""",
    "p5_proteins": f"""with {_ITEMS}, {_PROTEINS} select entry_id, place as protein_no, k as protein_key, case when json_type(json_extract(o, '$.organism')) = 'OBJECT' then json_extract_string(o, '$.organism.name') else {_text("json_extract(o, '$.organism')")} end as organism,
 json_extract_string(o, '$.organism.taxon') as taxon, {_text("json_extract(o, '$.source')")} as source from prot""",
    "nested_coverage": f"""with {_ITEMS}, {_PROTEINS}, o1 as (select *, case when json_type(json_extract(o, '$.organism')) = 'OBJECT' then json_extract_string(o, '$.organism.name') else {_text("json_extract(o, '$.organism')")} end as organism, {_text("json_extract(o, '$.source')")} as source,
 len(list_filter({_list("json_extract(o, '$.accessions')")}, lambda x: trim(coalesce(case when json_type(x) = 'OBJECT' then json_extract_string(x, '$.id') when json_type(x) in ('NULL', 'ARRAY') then null else json_extract_string(x, '$') end, '')) <> '')) > 0 as has from prot),
 own as (select * from o1 where lower(organism) like '%homo sapiens%') select 'entries' as measure, (select count(*) from brenda) as n union all select 'entries with organism', count(distinct entry_id) from own union all select 'proteins', count(*) from own
 union all select 'proteins with accessions', count(*) filter (where has) from own union all select 'proteins without accessions', count(*) filter (where not has) from own union all select 'source ' || source, count(*) from own where source is not null group by source""",
    "p5_ligand_items": f"with {_ITEMS} select entry_id, field_name, item_no, json_extract_string(item, '$.value') as value, json_extract_string(item, '$.comment') as comment, regexp_replace(json_extract_string(item, '$.conditions.ph'), '\\.0$', '') as ph from items",
}
