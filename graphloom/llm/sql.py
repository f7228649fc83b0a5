"""SQL of the training-data queries that SQL can express, for DuckDB."""

from graphloom.llm import canonical, components
from graphloom.plans.general import _ITEMS


def _entity(c: str) -> str:
    bare = f"regexp_replace({c}, '[^\\p{{L}}\\p{{Nd}}.]+', '', 'g')"
    whole = f"regexp_replace({bare}, '^([\\p{{Nd}}.]*\\p{{Nd}})\\.0\\.*$', '\\1')"
    return f"nullif(upper(replace({whole}, '.', '')), '')"


def _alnum(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')), '')"


_FORMS = f"""forms as (select interaction_id as id, least(s, t) as a, greatest(s, t) as b, rel, split, source from (select interaction_id, {_entity('source_id')} as s, {_entity('target_id')} as t,
 {_alnum('relation_type')} as rel, nullif(lower(trim(split_name)), '') as split, nullif(lower(trim(source_dataset)), '') as source from canonical_interaction) where s is not null and t is not null)"""
_COPIES = f"with {_FORMS}, g as (select id, min(id) over w as keep_id, count(*) over w as n from forms where rel is not null window w as (partition by a, b, rel))"
_PAIRS = f"""with {_FORMS}, ends as (select id, a as x, b as y, split, source from forms union select id, b, a, split, source from forms), hit as (select distinct e.id as e, t.id as t, min(levenshtein(e.y, t.y)) as d
 from ends e join ends t on e.x = t.x where e.split in ('valid', 'test') and t.split = 'train' and levenshtein(e.y, t.y) <= 1 group by e.id, t.id)"""
_VECTORS = """v as (select id, list_transform(f, lambda x: x / sqrt(list_inner_product(f, f))) as f from (select global_id as id, list_transform(features, lambda x: coalesce(x, 0)::double) as f from node_features
 where len(features) = 48 and len(list_filter(features, lambda x: x is null or isnan(x) or isinf(x))) = 0) where list_inner_product(f, f) > 0)"""

_GROUPS = f"""raw as (select interaction_id, {_entity('source_id')} as s, {_entity('target_id')} as t from canonical_interaction), links as (select s as u, t as v from raw where s is not null and t is not null union select t, s from raw where s is not null and t is not null),
 alone as (select u from (select s as u from raw union select t from raw) where u is not null), walk(node, root) using key (node) as (select u, u from alone union select l.u, min(w.root) from links l join walk w on l.v = w.node join recurring.walk r on r.node = l.u where w.root < r.root group by l.u)"""
_SPLITS = f"""with recursive {_GROUPS}, rws as (select interaction_id, coalesce(root, 'row ' || interaction_id) as group_id from raw left join walk on node = coalesce(s, t)),
 sizes as (select group_id, count(*) as n, cast('0x' || substr(md5('7:' || group_id), 1, 10) as bigint) as h from rws group by group_id), tot as (select sum(n)::bigint as total from sizes),
 large as (select group_id, n, row_number() over (order by n desc, group_id) as i from sizes, tot where n > greatest(1, total // {components.LARGE_SHARE})),
 place(i, group_id, split_name, a, b, c) as (select 0::bigint, null::varchar, null::varchar, 0.8::double * total, 0.1::double * total, 0.1::double * total from tot union all
 select l.i, l.group_id, case when a >= b and a >= c then 'train' when b >= c then 'validation' else 'test' end, case when a >= b and a >= c then a - n else a end, case when not (a >= b and a >= c) and b >= c then b - n else b end,
 case when not (a >= b and a >= c) and not b >= c then c - n else c end from place p join large l on l.i = p.i + 1),
 room as (select greatest(0.0::double, a) as a, greatest(0.0::double, b) as b, greatest(0.0::double, c) as c from place order by i desc limit 1),
 small as (select group_id, n, sum(n) over (order by h, group_id) - n / 2.0 as mid, sum(n) over () as whole from sizes where group_id not in (select group_id from large)),
 filled as (select group_id, case when mid < a * (whole / (a + b + c)) then 'train' when mid < (a + b) * (whole / (a + b + c)) then 'validation' else 'test' end as split_name from small, room)
 select interaction_id, group_id, split_name from rws join (select group_id, split_name from filled union all select group_id, split_name from place where group_id is not null) using (group_id)"""


def _normal(c: str) -> str:
    out = f"lower({c})"
    for letter, word in canonical.GREEK.items():
        out = f"replace({out}, '{letter}', '{word}')"
    return f"nullif(regexp_replace({out}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'), '')"


def _grams(source: str, c: str) -> str:
    """(name, g, n) of a table's distinct names."""
    pairs = " union all ".join(f"select name, 'w' || x[i] || x[i + {d}] as g, 1.0 as n from (select name, x, unnest(range(1, len(x) - {d} + 1)) as i from chars_{source})" for d in range(1, canonical.GAP + 1))
    placed = " union all ".join(
        f"select name, '{k}' || x[i] || ({at} + {d}) as g, {w} as n from (select name, x, unnest(range(2, len(x))) as i from chars_{source})" for k, at in (("p", "i - 1"), ("e", "len(x) - i")) for d, w in ((-1, 0.5), (0, 1.0), (1, 0.5))
    )
    return f"chars_{source} as (select name, string_split('^' || name || '$', '') as x from (select distinct {c} as name from {source})), grams_{source} as (select name, g, sum(n)::double as n from ({pairs} union all {placed}) group by name, g)"


_EDITS = f"greatest({canonical.EDITS}, floor(length * {canonical.EDIT_SHARE}))"
_NAMES = f"""with {_ITEMS}, raws as (select entry_id, field_name, item_no, case when field_name like 'inhibitor%' then v when contains(v, '{{') then regexp_extract(v, '(?s)^[^{{]*\\{{(.*?)(?:\\}}|$)', 1) end as raw from (select *, json_extract_string(item, '$.value') as v from items)),
 bare as (select entry_id, field_name, item_no, regexp_replace(regexp_replace(regexp_replace(raw, '(?s)\\([^)]*(?:\\)|$)', ' ', 'g'), '(?s);.*$', ''), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') as typed from raws),
 typed as (select *, {_normal('typed')} as name from bare where typed not in ('', '?')), refs as (select distinct cid, {_normal('x')} as ref from (select cid, unnest(list_concat([ligand_name], coalesce(synonyms, []))) as x from ref_ligand where cid is not null) where {_normal('x')} is not null),
 exact as (select ref as name, min(cid) as cid from refs group by ref), asked as (select distinct name from typed where name is not null and name not in (select name from exact)),
 {_grams('refs', 'ref')}, {_grams('asked', 'name')}, idf as (select g, ln((1.0 + (select count(*) from chars_refs)) / count(*)) as w from grams_refs group by g),
 wr as (select r.name as ref, g, n * w as x from grams_refs r join idf using (g)), nr as (select ref, sqrt(sum(x * x)) as norm from wr group by ref),
 wq as (select q.name, g, n * coalesce(w, ln(1.0 + (select count(*) from chars_refs))) as x from grams_asked q left join idf using (g)), nq as (select name, sqrt(sum(x * x)) as norm from wq group by name),
 cosine as (select d.name, d.ref, dot / (nq.norm * nr.norm) as score from (select wq.name, wr.ref, sum(wq.x * wr.x) as dot from wq join wr using (g) group by wq.name, wr.ref) d join nq using (name) join nr using (ref)),
 rivals as (select name, ref, score, levenshtein(name, ref) as edits from (select *, max(score) over (partition by name) as top from cosine) where score >= {canonical.THRESHOLD} and score >= top - {canonical.MARGIN}),
 entry as (select name, cid, min(edits) as edits, max(score) as score, arg_min(length(ref), (edits, -score)) as length from rivals join refs using (ref) group by name, cid),
 ranked as (select *, row_number() over w as r, lead(edits) over w as nxt from entry window w as (partition by name order by edits, score desc, cid)),
 known as (select name, cid from exact union all select name, cid from ranked where r = 1 and (nxt is null or edits < nxt) and edits <= {_EDITS})"""

SQL: dict[str, str] = {
    "p1_found": f"{_PAIRS} select distinct least(e, t) as id_a, greatest(e, t) as id_b from hit",
    "p1_report": f"""{_PAIRS}, best as (select e, min(d) as d from hit group by e) select split as split_name, source as source_dataset, count(*) as n_rows, count(*) filter (where d = 0) as n_exact, count(*) filter (where d = 1) as n_near
 from forms left join best on e = id where split in ('valid', 'test') group by split, source""",
    "p3_found": f"""with {_VECTORS}, s as (select a.id as x, b.id as y, list_inner_product(a.f, b.f) as c from v a join v b on a.id <> b.id), r as (select *, row_number() over (partition by x order by round(c, 6) desc, y) as r from s)
 select distinct least(x, y) as id_a, greatest(x, y) as id_b from r where r <= 5 and c >= 0.9""",
    "p4_found": f"{_COPIES} select keep_id, id as copy_id from g where id <> keep_id",
    "p4_collapsed": f"{_COPIES} select interaction_id as keep_id, coalesce(n, 1) as n_copies from canonical_interaction left join g on id = interaction_id where keep_id is null or keep_id = interaction_id",
    "p6_found": f"with recursive {_GROUPS} select node as entity_id, root as group_id from walk",
    "p6_splits": _SPLITS,
    "p7_found": f"{_NAMES} select entry_id, field_name, item_no, coalesce(cid, 0) as cid from typed left join known using (name)",
    "p7_unmatched": f"{_NAMES} select typed, count(*) as n from typed left join known using (name) where coalesce(cid, 0) = 0 group by typed",
}
