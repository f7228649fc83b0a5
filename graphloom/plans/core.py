"""Queries of the engine's own operators, each with the SQL that gives the same rows (README names the few whose SQL gives less).

They run over whole tables: canonical_interaction as raw edges, entity_manifest, bindingdb, node_features and embeddings as they are.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import edges as E
from graphloom.operators import entities as N
from graphloom.operators import filters as P
from graphloom.operators import graph as G
from graphloom.operators import labels as L
from graphloom.operators import reports as R
from graphloom.operators import sampling as S
from graphloom.operators import selectors as Q
from graphloom.operators import similarity as V
from graphloom.operators import splits as X
from graphloom.operators import features as Y
from graphloom.schema import KINDS, RELATIONS, UNKNOWN_PRIORITY, priority
from graphloom.sources import adapters as A
from graphloom.sources.sinks import missing
from graphloom.storage import fresh_path, materialize, table

SEED = 514
FOLDS = 5


def raw(spark, d):
    return E.normalized(table(spark, d, "canonical_interaction"))


def merged(spark, d):
    return E.store(raw(spark, d))


def entities(spark, d):
    return N.manifest(merged(spark, d))


# SQL of the tables above.
def _plain(c: str) -> str:
    t = f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"
    return f"case when regexp_full_match({t}, '[0-9]+\\.0+') then regexp_replace({t}, '\\.0+$', '') else {t} end"


def _priority(c: str) -> str:
    return "case " + " ".join(f"when {c} = '{k}' then {v.priority}" for k, v in KINDS.items()) + f" else {UNKNOWN_PRIORITY} end"


def _meta(c: str) -> str:
    return "case " + " ".join(f"when {c} = '{k}' then '{'protein' if v.metatype == 'gene' else v.metatype}'" for k, v in KINDS.items()) + " end"


_KEYS = "source_id, target_id, relation_type"
RAW = f"""raw as (select interaction_id as ord, {_plain('source_id')} as source_id, source_type, {_plain('target_id')} as target_id, target_type, relation_type,
 coalesce(label, 1) as label, coalesce(source_dataset, 'unknown') as source_dataset, raw_score from canonical_interaction)"""
CANON = f"""{RAW}, turn as (select *, coalesce({_priority('source_type')} > {_priority('target_type')} or ({_priority('source_type')} = {_priority('target_type')} and source_id > target_id), false) as sw from raw),
canon as (select ord, case when sw then target_id else source_id end as source_id, case when sw then target_type else source_type end as source_type,
 case when sw then source_id else target_id end as target_id, case when sw then source_type else target_type end as target_type, relation_type, label, source_dataset, raw_score from turn)"""


def _first(c: str) -> str:
    return f"arg_min({c}, ord) filter (where {c} is not null) as {c}"


MERGED = f"""{CANON}, atoms as (select {_KEYS}, array_to_string(list_sort(list_distinct(flatten(list(string_split(source_dataset, '|'))))), '|') as source_dataset from canon group by all),
m as (select c.*, a.source_dataset from (select {_KEYS}, min(ord) as ord, {_first('source_type')}, {_first('target_type')}, {_first('label')}, {_first('raw_score')} from canon
 where source_id is not null and target_id is not null and relation_type is not null group by all) c join atoms a using ({_KEYS}))"""
ENTITIES = f"""{MERGED}, ends as (select source_id as id, source_type as t, source_dataset as s from m union all select target_id, target_type, source_dataset from m),
ent as (select id as entity_id, list_sort(list_distinct(list(t) filter (where t is not null))) as all_types, list_sort(list_distinct(flatten(list(string_split(s, '|'))))) as all_sources,
 arg_min(t, ({_priority('t')} * 1000 + 0)::varchar) as x, min((lpad(({_priority('t')})::varchar, 4, '0') || t)) as best from ends group by id),
e as (select entity_id, substr(best, 5) as entity_type, coalesce(all_types, []) as all_types, all_sources from ent)"""


def _md5(purpose: str, *keys: str, seed: int = SEED) -> str:
    return "md5(concat_ws(':', " + ", ".join([f"'{seed}'", f"'{purpose}'", *(f"coalesce(({k})::varchar, '')" for k in keys)]) + "))"


def _fold(rank: str, n: str, k: int) -> str:
    q, r = f"({n} // {k})", f"({n} % {k})"
    return f"(case when {rank} < ({q} + 1) * {r} then {rank} // ({q} + 1) else {r} + ({rank} - ({q} + 1) * {r}) // greatest({q}, 1) end + 1)::integer"


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_EDGE = "source_id, source_type, target_id, target_type, relation_type, label, source_dataset, raw_score"


@query(f"with {RAW} select ord, {_EDGE} from raw")
def id_normalise(spark, d):
    return raw(spark, d)


@query(f"with {CANON} select ord, {_EDGE} from canon")
def canonical_edges(spark, d):
    return E.canonical(raw(spark, d))


@query(f"with {MERGED} select ord, {_EDGE} from m")
def dedup_merge_source(spark, d):
    return merged(spark, d)


@query(f"with {MERGED} select relation_type, source_dataset, count(*) as n_edges, count(raw_score) as n_scored from m group by all")
def relation_provenance_counts(spark, d):
    return merged(spark, d).groupBy("relation_type", "source_dataset").agg(F.count(F.lit(1)).alias("n_edges"), F.count("raw_score").alias("n_scored"))


@query(f"with {RAW} select distinct entity_id from (select source_id as entity_id from raw union all select target_id from raw) where entity_id is not null")
def endpoint_set(spark, d):
    return E.endpoints(raw(spark, d))


def _joined(df, *cols):
    return df.withColumns({c: F.array_join(c, "|") for c in cols})


@query(f"with {ENTITIES} select entity_id, entity_type, array_to_string(all_types, '|') as all_types, array_to_string(all_sources, '|') as all_sources from e")
def entity_manifest(spark, d):
    return _joined(entities(spark, d).drop("structure"), "all_types", "all_sources")


_LOGIC = f"row_number() over (order by {_priority('entity_type')}, entity_type, case when regexp_full_match(entity_id, '[0-9]{{1,18}}') then entity_id::bigint end nulls last, entity_id) - 1"


@query(f"with {ENTITIES} select entity_id, entity_type, {_LOGIC} as global_id from e")
def logic_ids(spark, d):
    return N.logic_ids(entities(spark, d)).select("entity_id", "entity_type", "global_id")


@query(
    f"with {ENTITIES}, s as (select entity_id, first(structure) as structure from entity_manifest group by entity_id) select {_LOGIC} as global_id, entity_type as node_type, entity_id as authoritative_id,"
    " array_to_string(all_sources, ',') as sources, coalesce(structure, '') as sequence_or_smiles from e left join s using (entity_id)"
)
def nodes_output(spark, d):
    return N.nodes(N.manifest(merged(spark, d), table(spark, d, "entity_manifest")))


@query(f"with {ENTITIES} select entity_type, {_meta('entity_type')} as metatype, count(*) as n from e group by all")
def entity_type_counts(spark, d):
    return N.type_counts(entities(spark, d))


@query(
    f"with {ENTITIES} select entity_type, count(*) filter (where regexp_full_match(entity_id, '[0-9]{{1,18}}')) as numbers, count(*) filter (where not regexp_full_match(entity_id, '[0-9]{{1,18}}')) as texts"
    " from e group by entity_type having numbers > 0 and texts > 0"
)
def mixed_id_types(spark, d):
    return N.mixed_types(entities(spark, d))


@query(f"with {MERGED} select distinct source_type, target_type, case when {_priority('source_type')} <= {_priority('target_type')} then source_type || '_' || target_type || '_similarity' else target_type || '_' || source_type || '_similarity' end as edge_type from m")
def relation_names(spark, d):
    return merged(spark, d).select("source_type", "target_type", V.relation_name(F.col("source_type"), F.col("target_type")).alias("edge_type")).distinct()


@query(f"with {ENTITIES} select entity_id, entity_type from e where {_meta('entity_type')} = 'molecule' and list_has_any(all_sources, ['gtopdb', 'labfeed'])")
def selector_entities(spark, d):
    return Q.select_entities(entities(spark, d), Q.EntitySelector(meta_types=("molecule",), from_sources=("gtopdb", "labfeed"))).select("entity_id", "entity_type")


_SIDE = {"s": f"(coalesce({_meta('{p}.entity_type')} = 'molecule' and list_has_any({{p}}.all_sources, ['bindingdb']), false))", "t": "(coalesce({p}.entity_type in ('protein', 'enzyme'), false))"}
_BOTH = f"with {ENTITIES} select m.* exclude (ord) from m left join e a on m.source_id = a.entity_id left join e b on m.target_id = b.entity_id where relation_type in ('interacts_with', 'inhibits') and (({_SIDE['s'].format(p='a')} and {_SIDE['t'].format(p='b')}) or ({_SIDE['s'].format(p='b')} and {_SIDE['t'].format(p='a')}))"
_SELECTOR = Q.InteractionSelector(Q.EntitySelector(meta_types=("molecule",), from_sources=("bindingdb",)), Q.EntitySelector(entity_types=("protein", "enzyme")), ("interacts_with", "inhibits"))


@query(_BOTH)
def selector_bidirectional(spark, d):
    m = materialize(merged(spark, d))
    return Q.select_edges(m, N.manifest(m), _SELECTOR).drop("ord")


@query(f"with {MERGED}, ok as (select entity_id from entity_manifest where structure is not null) select m.* exclude (ord) from m where source_id in (select entity_id from ok) and target_id in (select entity_id from ok)")
def pure_edges(spark, d):
    return E.pure(merged(spark, d), table(spark, d, "entity_manifest").where("structure is not null")).drop("ord")


@query(f"with {MERGED} select m.* exclude (ord) from m where not exists (select 1 from (select distinct {_KEYS} from m where source_dataset like '%bindingdb%') r where r.source_id = m.source_id and r.target_id = m.target_id and r.relation_type = m.relation_type)")
def edge_difference(spark, d):
    m = materialize(merged(spark, d))
    return E.difference(m, m.where(F.col("source_dataset").contains("bindingdb"))).drop("ord")


@query(
    f"with {MERGED}, ids as (select entity_id, row_number() over (order by entity_id) - 1 as i from entity_manifest) select a.i as source, b.i as target, relation_type, source_dataset, coalesce(raw_score, 1.0) as score"
    " from m join ids a on m.source_id = a.entity_id join ids b on m.target_id = b.entity_id"
)
def logic_edges(spark, d):
    from graphloom.operators.ranking import sorted_rank

    ids = sorted_rank(table(spark, d, "entity_manifest").select("entity_id"), F.col("entity_id"), name="global_id")
    return E.with_logic_ids(merged(spark, d), ids, strict=False)


def _num(c: str) -> str:
    return f"try_cast(case when regexp_full_match(trim(replace(replace({c}, '<', ''), '>', '')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then trim(replace(replace({c}, '<', ''), '>', '')) end as double)"


@query(f"select entry_id, raw_score from (select entry_id, coalesce({_num('ki')}, {_num('kd')}, {_num('ic50')}) as raw_score from bindingdb) where raw_score <= 10000")
def affinity_coalesce(spark, d):
    return P.at_most(P.affinities(table(spark, d, "bindingdb")), 10_000).select("entry_id", "raw_score")


@query(f"with {RAW} select ord, relation_type, raw_score from raw where case when relation_type = 'inhibits' then coalesce(raw_score <= 1000, false) when relation_type = 'km_value' then coalesce(raw_score <= 0.01, false) else true end")
def relation_threshold(spark, d):
    return P.by_relation(raw(spark, d), {"inhibits": 1000, "km_value": 0.01}).select("ord", "relation_type", "raw_score")


#: A stand-in for properties a chemistry library would compute: simple counts on the structure's text.
_PROPS = {
    "MW": "12.5 * length(structure)",
    "LogP": "(length(structure) - length(replace(structure, 'C', ''))) / 4.0",
    "HBD": "(length(structure) - length(replace(structure, 'N', ''))) * 1.0",
    "HBA": "(length(structure) - length(replace(structure, 'O', ''))) * 1.0",
    "QED": "1.0 / (1 + length(structure))",
    "SA_Score": "length(structure) / 10.0",
}


def _properties(manifest):
    return manifest.select("*", *(F.expr(f"cast({x} as double)").alias(n) for n, x in _PROPS.items()), F.contains("structure", F.lit("C#N")).alias("is_pains"))


_PROP_SQL = "select *, " + ", ".join(f"cast({x} as double) as {n}" for n, x in _PROPS.items()) + ", contains(structure, 'C#N') as is_pains from entity_manifest"
_GENERAL = P.Bounds(mw_min=150, mw_max=600, logp_max=5, hbd_max=5, hba_max=10, check_pains=True)
_RULES = P.SourceRules(_GENERAL, {"brenda": None, "gtopdb": P.Bounds(mw_min=100, mw_max=900, logp_max=8, hbd_max=5, hba_max=10)})


@query(f"select entity_id from ({_PROP_SQL}) where MW >= 150 and MW <= 600 and LogP <= 5 and HBD <= 5 and HBA <= 10 and not is_pains")
def static_filter(spark, d):
    return _properties(table(spark, d, "entity_manifest")).where(P.static_filter(_GENERAL)).select("entity_id")


_RELAX = (
    f"select entity_id, entity_type, structure, coalesce((br or (MW >= case when gt then 100 else 150 end and MW <= case when gt then 900 else 600 end and LogP <= case when gt then 8 else 5 end and HBD <= 5 and HBA <= 10))"
    f" and (not is_pains or br or gt), false) as passes, MW from (select *, coalesce(list_contains(all_sources, 'brenda'), false) as br, coalesce(list_contains(all_sources, 'gtopdb'), false) as gt from ({_PROP_SQL}))"
)


@query(f"select entity_id, passes from ({_RELAX})")
def dynamic_filter(spark, d):
    return P.dynamic_filter(_properties(table(spark, d, "entity_manifest")), _RULES).select("entity_id", "passes")


@query("select entity_id, length(structure) > 0 and regexp_full_match(upper(regexp_replace(structure, '^\\s+|\\s+$', '', 'g')), '[AC-IK-Z]*') as ok from entity_manifest where structure is not null")
def validate_sequences(spark, d):
    return table(spark, d, "entity_manifest").where("structure is not null").select("entity_id", text.valid_sequence(F.col("structure")).alias("ok"))


_VALID = f"""select entity_id, reason is null as valid, reason from (select entity_id, case
 when mol and coalesce(try_cast(entity_id as double), 0) < 1 then 'id' when mol and MW is null then 'structure' when mol and not passes then 'properties'
 when prot and not coalesce(white, false) then 'whitelist' when prot and not coalesce(length(structure) > 0 and regexp_full_match(upper(regexp_replace(structure, '^\\s+|\\s+$', '', 'g')), '[AC-IK-Z]*'), false) then 'sequence'
 when not coalesce(mol or prot, false) then 'type' end as reason
 from (select r.*, entity_type in ('drug', 'exogenous_ligand', 'ligand', 'endogenous_ligand', 'molecule') as mol, entity_type = 'protein' as prot, w.white from ({_RELAX}) r left join (select distinct protein_id, true as white from bindingdb) w on w.protein_id = r.entity_id))"""


def _validated(spark, d):
    m = table(spark, d, "entity_manifest")
    props = _properties(m).select("structure", *_PROPS, "is_pains")
    return P.validated(m, props, _RULES, table(spark, d, "bindingdb").select(F.col("protein_id").alias("entity_id")))


@query(_VALID)
def validated_entities(spark, d):
    return _validated(spark, d).select("entity_id", "valid", "reason")


@query(f"select status, n, round(100.0 * n / sum(n) over (), 4) as percent from (select coalesce(reason, 'valid') as status, count(*) as n from ({_VALID}) group by 1)")
def validation_report(spark, d):
    return R.status_report(_validated(spark, d), F.coalesce("reason", F.lit("valid")))


_STRATA = [
    S.Stratum("ligand", "source_type = 'ligand'", fraction=0.5),
    S.Stratum("drug", "source_type = 'drug'", ratio_to="ligand", ratio=0.4),
    S.Stratum("ppi", "relation_type = 'physical_association'", ratio_to="drug", ratio=0.1),
]
_STRAT = f"""with {MERGED}, st as (select *, case when source_type = 'ligand' then 'ligand' when source_type = 'drug' then 'drug' when relation_type = 'physical_association' then 'ppi' end as g from m),
rk as (select *, row_number() over (partition by g order by {_md5('stratified', 'source_id', 'target_id', 'relation_type')}) - 1 as rk, count(*) over (partition by g) as n from st),
q as (select ceil(coalesce(max(n) filter (where g = 'ligand'), 0) * 0.5) as ql, coalesce(max(n) filter (where g = 'drug'), 0) as nd, coalesce(max(n) filter (where g = 'ppi'), 0) as np from rk)
select source_id, target_id, relation_type from rk, q where g is null or rk < case g when 'ligand' then ql when 'drug' then least(ceil(ql * 0.4), nd) else least(ceil(nd * 0.1), np) end"""


@query(_STRAT)
def stratified_sample(spark, d):
    return S.stratified(materialize(merged(spark, d)), _STRATA, SEED).select("source_id", "target_id", "relation_type")


@query(f"with {MERGED} select {_KEYS} from (select *, row_number() over (order by {_md5('uniform', 'source_id', 'target_id', 'relation_type')}) as r, count(*) over () as n from m) where r <= ceil(n * 0.3)")
def uniform_sample(spark, d):
    return S.uniform(materialize(merged(spark, d)), 0.3, SEED).select("source_id", "target_id", "relation_type")


_COLD = f"cf as (select entity_id, {_fold('r', 'n', FOLDS)} as fold from (select entity_id, row_number() over (order by {_md5('cold', 'entity_id')}) - 1 as r, count(*) over () as n from e where {_meta('entity_type')} = 'molecule'))"


def _molecules(m):
    return Q.select_entities(N.manifest(m), Q.EntitySelector(meta_types=("molecule",)))


@query(f"with {ENTITIES}, {_COLD} select entity_id, fold from cf")
def cold_kfold(spark, d):
    return X.cold_folds(materialize(_molecules(merged(spark, d))), FOLDS, SEED)


#: A target's edges are dealt in turn if every target has FOLDS edges; else all edges are divided plainly.
_WARM = f"""with {MERGED}, least_ as (select min(n) as n from (select count(*) as n from m group by target_id)),
 rk as (select {_KEYS}, row_number() over (order by {_md5('warm', 'source_id', 'target_id', 'relation_type')}, source_id, target_id, relation_type) - 1 as r, count(*) over () as n,
 row_number() over (partition by target_id order by {_md5('warm', 'source_id', 'target_id', 'relation_type')}) - 1 as rt, cast('0x' || substr({_md5('turn', 'target_id')}, 1, 8) as bigint) as turn from m)
 select {_KEYS}, case when (select n from least_) >= {FOLDS} then (rt + turn) % {FOLDS} + 1 else {_fold('r', 'rk.n', FOLDS)} end::integer as fold from rk"""


@query(_WARM)
def warm_kfold(spark, d):
    return X.warm_folds(materialize(merged(spark, d)), FOLDS, SEED).select("source_id", "target_id", "relation_type", "fold")


@query(f"with {MERGED} select {_KEYS}, row_number() over (order by {_md5('single', 'source_id', 'target_id', 'relation_type')}) - 1 < ceil(count(*) over () * 0.2) as is_test from m")
def single_split(spark, d):
    return X.held_out(materialize(merged(spark, d)), 0.2, SEED, ("source_id", "target_id", "relation_type")).select("source_id", "target_id", "relation_type", "is_test")


#: Of every fold k: its cold entities, evaluable and background edges, and the labels left for training.
_SPLIT = f"""with {ENTITIES}, {_COLD}, folds as (select unnest(range(1, {FOLDS} + 1))::integer as fold), cold as (select entity_id, fold from cf),
ev as (select m.*, fold from m, folds where relation_type in ('interacts_with', 'inhibits')), bg as (select m.*, fold from m, folds where relation_type not in ('interacts_with', 'inhibits')),
lab as (select * from ev where (source_id, fold) not in (select entity_id, fold from cold) and (target_id, fold) not in (select entity_id, fold from cold))"""


def _split(spark, d):
    """Merged edges, cold entities with their fold, evaluable edges, background edges."""
    m = materialize(merged(spark, d))
    cold = materialize(X.cold_folds(materialize(_molecules(m)), FOLDS, SEED))
    ev = m.where(F.col("relation_type").isin("interacts_with", "inhibits"))
    return m, cold, ev, materialize(E.difference(m, ev))


def _each_fold(cold, of):
    """`of` of the cold entities of each fold, one below the other, with `fold`."""
    out = None
    for k in range(1, FOLDS + 1):
        part = of(cold.where(F.col("fold") == k).select("entity_id")).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _graph(spark, d, strictness):
    _, cold, ev, bg = _split(spark, d)
    graphs = _each_fold(cold, lambda c: X.train_graph(E.touching(ev, c, keep=False), bg, c, "cold", strictness))
    return graphs.select("fold", "source_id", "target_id", "relation_type")


@query(f"{_SPLIT} select fold, {_KEYS} from (select * from lab union all select * from bg) where (source_id, fold) not in (select entity_id, fold from cold) and (target_id, fold) not in (select entity_id, fold from cold)")
def train_graph_strict(spark, d):
    return _graph(spark, d, "strict")


@query(f"{_SPLIT} select fold, {_KEYS} from (select * from lab union all select * from bg)")
def train_graph_informed(spark, d):
    return _graph(spark, d, "informed")


@query(f"{_SPLIT} select fold, {_KEYS} from ev where (source_id, fold) in (select entity_id, fold from cold) or (target_id, fold) in (select entity_id, fold from cold)")
def cold_test_edges(spark, d):
    _, cold, ev, _ = _split(spark, d)
    return _each_fold(cold, lambda c: E.touching(ev, c)).select("fold", "source_id", "target_id", "relation_type")


_DRAW = "cast('0x' || substr({}, 1, 8) as bigint) % (select count(*) from {})"


_NEGATIVES = (
    f"with {ENTITIES}, ps as (select entity_id, row_number() over (order by entity_id) - 1 as i from e where {_meta('entity_type')} = 'molecule'), pt as (select entity_id, row_number() over (order by entity_id) - 1 as i from e where {_meta('entity_type')} = 'protein'),"
    f" pos as (select source_id, target_id, row_number() over (order by {_md5('negative', 'source_id', 'target_id')}, source_id, target_id) - 1 as r from (select distinct source_id, target_id from m where relation_type in ('interacts_with', 'inhibits'))),"
    f" tr as (select r, a, {_DRAW.format(_md5('source', '0', 'r', 'a'), 'ps')} as si, {_DRAW.format(_md5('target', '0', 'r', 'a'), 'pt')} as ti from pos, range(10) x(a)),"
    " ok as (select r, a, ps.entity_id as source_id, pt.entity_id as target_id from tr join ps on ps.i = si join pt on pt.i = ti where not exists (select 1 from m where (m.source_id = ps.entity_id and m.target_id = pt.entity_id) or (m.source_id = pt.entity_id and m.target_id = ps.entity_id)))"
    " select arg_min(source_id, a) as source_id, arg_min(target_id, a) as target_id from ok group by r"
)


@query(_NEGATIVES)
def negative_samples(spark, d):
    m = materialize(merged(spark, d))
    e = materialize(N.manifest(m))
    s, t = (Q.select_entities(e, Q.EntitySelector(meta_types=(x,))) for x in ("molecule", "protein"))
    return L.negatives(m.where("relation_type in ('interacts_with', 'inhibits')").select("source_id", "target_id").distinct(), s, t, m, SEED)


def _topk(name: str, i: str, v: str, c: str, k: int = 10, ok: str = "true") -> str:
    unit = f"select {i} as i, {c} as c, list_transform({v}, lambda x: coalesce(x, 0)::double) as v from {name} where {ok}"
    return (
        f"vec as (select i, c, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from ({unit}) where list_inner_product(v, v) > 0), big as (select c from vec group by c having count(*) > {k}),"
        f" hit as (select i, j, cos from (select a.i as i, b.i as j, round(list_inner_product(a.v, b.v), 10) as cos, row_number() over (partition by a.i order by round(list_inner_product(a.v, b.v), 10) desc, b.i) as r"
        f" from vec a join vec b on a.c = b.c and a.i <> b.i where a.c in (select c from big)) where r <= {k})"
    )


@query(f"with {_topk('embeddings', 'vec_id', 'embedding', 'label')} select i, j, round(cos, 6) as cos from hit")
def topk_similarity(spark, d):
    return V.top_k(table(spark, d, "embeddings"), 10, "vec_id", "embedding", "label").select("i", "j", F.round("cos", 6).alias("cos"))


_NODE_OK = "features is not null and len(features) = 48 and len(list_filter(features, lambda x: x is null or isnan(x))) = 0"
_SAFE = "list_transform(features, lambda x: coalesce(x, 0)::double)"


@query(
    f"with {_topk('node_features', 'global_id', 'features', 'node_type', ok=_NODE_OK)}, ty as (select global_id as i, case when node_type = 'protein' then 'protein' when entity_type in ('drug', 'exogenous_ligand', 'ligand', 'endogenous_ligand') then entity_type else 'molecule' end as t"
    f" from node_features left join entity_manifest on entity_id = authoritative_id), s as (select h.i, h.j, a.t as ti, b.t as tj, coalesce({_priority('a.t')} > {_priority('b.t')}, false) as sw, round(1 - 2 * power(1 - cos, 2), 6) as score from hit h join ty a on a.i = h.i join ty b on b.i = h.j where h.i < h.j),"
    " o as (select case when sw then j else i end as source, case when sw then i else j end as target, case when sw then tj else ti end as st, case when sw then ti else tj end as tt, score from s)"
    f" select source, target, st || '_' || tt || '_similarity' as edge_type, 'computed' as source_dataset, score from o where score > case {' '.join(f"when st = '{a}' and tt = '{b}' then {x}" for (a, b), x in V.THRESHOLDS.items())} else 1.1 end"
)
def similarity_edges(spark, d):
    v = table(spark, d, "node_features").where(F.size("features") == 48)
    kinds = table(spark, d, "entity_manifest").select(F.col("entity_id").alias("authoritative_id"), "entity_type")
    kind = F.when(F.col("node_type") == "protein", "protein").when(F.col("entity_type").isin("drug", "exogenous_ligand", "ligand", "endogenous_ligand"), F.col("entity_type")).otherwise("molecule")
    types = v.join(kinds, "authoritative_id", "left").select(F.col("global_id").alias("id"), kind.alias("type"))
    return V.similarity_edges(V.candidates(v, types, class_col="node_type", thresholds=V.THRESHOLDS))


@query(
    f"with {MERGED}, f as (select authoritative_id as id, {_SAFE} as v from node_features where {_NODE_OK} and list_inner_product({_SAFE}, {_SAFE}) > 0)"
    " select m.source_id as source, m.target_id as target, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) as cos from m join f a on m.source_id = a.id join f b on m.target_id = b.id"
)
def pair_cosine(spark, d):
    v = table(spark, d, "node_features").where(F.size("features") == 48).where(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)))
    pairs = merged(spark, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return V.pair_cosine(pairs, v, "authoritative_id").withColumn("cos", F.round("cos", 6))


@query(f"with {ENTITIES} select source_id, target_id, round(case when len(list_distinct(list_concat(a.all_sources, b.all_sources))) > 0 then len(list_intersect(a.all_sources, b.all_sources)) / len(list_distinct(list_concat(a.all_sources, b.all_sources))) else 0 end, 6) as tanimoto from m join e a on source_id = a.entity_id join e b on target_id = b.entity_id")
def tanimoto_sources(spark, d):
    m = materialize(merged(spark, d))
    e = N.manifest(m).select("entity_id", "all_sources")
    out = m.join(e.select(F.col("entity_id").alias("source_id"), F.col("all_sources").alias("a")), "source_id").join(e.select(F.col("entity_id").alias("target_id"), F.col("all_sources").alias("b")), "target_id")
    return out.select("source_id", "target_id", F.round(V.tanimoto(F.col("a"), F.col("b")), 6).alias("tanimoto"))


@query(
    f"with {MERGED} select source_id, target_id, relation_type, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 9) as score from (select *, min(score) over w as lo, max(score) over w as hi"
    " from (select *, coalesce(raw_score, 1.0) as score from m) window w as (partition by relation_type))"
)
def minmax_score(spark, d):
    rows = merged(spark, d).withColumnRenamed("raw_score", "score")
    return G.minmax(rows, "relation_type").select("source_id", "target_id", "relation_type", F.round("score", 9).alias("score"))


_FLAGS = {"interacts_with": True, "inhibits": True, "catalyzes": False, "physical_association": True}


@query(f"with {MERGED} select {_KEYS} from m where relation_type in ('interacts_with', 'inhibits', 'physical_association')")
def enabled_edges(spark, d):
    return G.enabled(merged(spark, d), _FLAGS).select("source_id", "target_id", "relation_type")


@query(f"{_SPLIT} select fold, {_KEYS} from m, folds where relation_type in ({', '.join(repr(r) for r in RELATIONS)}) or not ((source_id, fold) in (select entity_id, fold from cold) or (target_id, fold) in (select entity_id, fold from cold))")
def background_without_leaks(spark, d):
    m, cold, _, _ = _split(spark, d)
    rows = m.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("edge_type"))
    out = _each_fold(cold, lambda c: G.without_leaks(rows, c.withColumnRenamed("entity_id", "id"), RELATIONS))
    return out.select("fold", F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.col("edge_type").alias("relation_type"))


_LOCAL = "loc as (select global_id, row_number() over (order by case when node_type = 'molecule' then 0 else 1 end, global_id) - 1 as local_id from node_features where global_id is not null)"


def _local(spark, d):
    nodes = table(spark, d, "node_features").where("global_id is not null")
    return G.local_ids(nodes.select("global_id", (F.col("node_type") == "molecule").alias("is_molecule"))).select("global_id", "local_id")


@query(f"with {_LOCAL} select global_id, local_id from loc")
def local_ids(spark, d):
    return _local(spark, d)


@query(
    f"with {MERGED}, {_LOCAL}, g as (select global_id, authoritative_id from node_features) select la.local_id as source, lb.local_id as target, relation_type from m join g a on source_id = a.authoritative_id join g b on target_id = b.authoritative_id"
    " join loc la on la.global_id = a.global_id join loc lb on lb.global_id = b.global_id"
)
def fold_edges(spark, d):
    ids = table(spark, d, "node_features").select(F.col("authoritative_id").alias("entity_id"), "global_id")
    return G.to_local(E.with_logic_ids(merged(spark, d), ids, strict=False), _local(spark, d)).select("source", "target", "relation_type")


_CLEAN = "trim(string_split(regexp_replace(lower(coalesce(ligand_name, '')), '\\(.*?\\)', '', 'g'), ';')[1])"


@query(f"with dict as (select name, min(cid) as cid from (select lower(trim(x)) as name, cid from (select cid, unnest(list_concat([ligand_name], coalesce(synonyms, []))) as x from ref_ligand)) where name <> '' group by name) select r.cid, d.cid as found from ref_ligand r join dict d on d.name = {_CLEAN}")
def clean_name_lookup(spark, d):
    ref = table(spark, d, "ref_ligand")
    names = ref.select("cid", F.explode(F.concat(F.array("ligand_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    typed = ref.select(F.col("cid").alias("own"), text.clean_name(F.col("ligand_name")).alias("clean"))
    return A.resolved_names(typed, A.dictionary(names.select("name", "cid", F.col("cid").alias("place")), "place")).select(F.col("own").alias("cid"), F.col("cid").alias("found"))


@query("select molecule_id, arg_min(protein_id, entry_id) as protein_id from bindingdb where molecule_id is not null and protein_id is not null group by molecule_id")
def first_alias(spark, d):
    b = table(spark, d, "bindingdb").select(F.col("molecule_id").alias("network_id"), F.col("protein_id").alias("alias"), F.lit("BLAST_UniProt_AC").alias("source"), "entry_id")
    return A.first_alias(b, "entry_id").select(F.col("network_id").alias("molecule_id"), F.col("alias").alias("protein_id"))


_TYPES = list(RELATIONS)
_COUNTS = f"fc as (select split_name as fold, {', '.join(f'count(*) filter (where relation_type = {t!r}) as n_{t}' for t in _TYPES)}, count(*) as total_edges from canonical_interaction group by split_name)"


def _counts(spark, d):
    return R.edge_type_counts(table(spark, d, "canonical_interaction"), _TYPES, "split_name").withColumnRenamed("split_name", "fold")


@query(f"with {_COUNTS} select * from fc")
def edge_type_pivot(spark, d):
    return _counts(spark, d)


@query(f"with {_COUNTS} " + " union all ".join(f"select '{c}' as statistic, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std from fc" for c in [*(f"n_{t}" for t in _TYPES), "total_edges"]))
def edge_type_mean_std(spark, d):
    return R.mean_std(_counts(spark, d), [*(f"n_{t}" for t in _TYPES), "total_edges"])


@query("select source_dataset as value, count(*) as n from canonical_interaction group by 1")
def value_counts(spark, d):
    return R.value_counts(table(spark, d, "canonical_interaction"), "source_dataset")


_PATTERNS = {"accession": r"^[OPQW][0-9][A-Z0-9]{3}[0-9]", "short_code": r"^[A-Z][0-9]{3}[A-Z0-9]{4}$", "number": r"^[0-9]+$"}


@query(" union all ".join(f"select '{n}' as pattern, count(*) filter (where regexp_matches(entity_id, '{p}')) as matched, round(100.0 * count(*) filter (where regexp_matches(entity_id, '{p}')) / count(*), 4) as percent from entity_manifest where entity_id is not null" for n, p in _PATTERNS.items()))
def regex_coverage(spark, d):
    return R.pattern_coverage(table(spark, d, "entity_manifest"), "entity_id", _PATTERNS)


_DEGREES = f"{MERGED}, pr as (select distinct least(source_id, target_id) as u, greatest(source_id, target_id) as v from m where source_id <> target_id), dg as (select node, count(*) as degree from (select u as node from pr union all select v from pr) group by node)"


@query(f"with {_DEGREES} select degree, n, round(n / sum(n) over (), 8) as share from (select degree, count(*) as n from dg group by degree)")
def degree_distribution(spark, d):
    return R.degree_distribution(merged(spark, d))


@query(f"with {_DEGREES} select count(*) as nodes, max(degree) as max_degree, min(degree) as min_degree, round(avg(degree), 6) as mean_degree from dg")
def degree_summary(spark, d):
    return R.degree_summary(merged(spark, d))


@query(f"{_SPLIT}, t as (select fold, count(*) as n from ev where (source_id, fold) in (select entity_id, fold from cold) or (target_id, fold) in (select entity_id, fold from cold) group by fold) select fold, relation_type as edge_type, count(*) as train, count(*) + case when relation_type = 'interacts_with' then max(coalesce(t.n, 0)) else 0 end as whole from (select * from lab union all select * from bg) left join t using (fold) group by fold, relation_type")
def split_effect(spark, d):
    _, cold, ev, bg = _split(spark, d)
    return _each_fold(cold, lambda c: R.split_effect(X.train_graph(E.touching(ev, c, keep=False), bg, c, "cold", "informed"), E.touching(ev, c), "interacts_with"))


@query(f"with {MERGED} select relation_type, count(raw_score) as n, round(avg(raw_score), 6) as mean, round(median(raw_score), 6) as median from m group by relation_type")
def group_statistics(spark, d):
    return R.group_statistics(merged(spark, d), "relation_type", "raw_score")


@query(
    f"with {ENTITIES} select 'features ' || coalesce(node_type, 'null') as part, count(*) filter (where features is null or len(list_filter(features, lambda x: x is null or isnan(x) or isinf(x))) > 0) as problems from node_features group by node_type"
    " union all select 'edges ' || coalesce(relation_type, 'null') as part, count(*) filter (where source_id not in (select entity_id from e) or target_id not in (select entity_id from e)) as problems from m group by relation_type"
)
def graph_health(spark, d):
    m = materialize(merged(spark, d))
    ids = materialize(N.logic_ids(N.manifest(m)))
    edges = E.with_known_ids(m, ids).withColumnRenamed("relation_type", "edge_type")
    return R.graph_health(edges, ids.count(), table(spark, d, "node_features"))


@query(f"with {RAW}, ids as (select source_id as entity_id from raw union select target_id from raw) select entity_id from ids where entity_id is not null and entity_id not in (select entity_id from entity_manifest)")
def incremental_missing_ids(spark, d):
    return missing(E.endpoints(raw(spark, d)), table(spark, d, "entity_manifest"))


@query(
    f"with recursive {MERGED}, both_ as (select source_id as u, target_id as v from m union select target_id, source_id from m), walk(node, root) using key (node) as (select u, min(least(u, v)) from both_ group by u"
    " union select b.u, min(w.root) from both_ b join walk w on b.v = w.node join recurring.walk r on r.node = b.u where w.root < r.root group by b.u) select node, root as component from walk"
)
def connected_components(spark, d):
    return G.connected_components(materialize(merged(spark, d)))


_SPLITS = ("train", "valid", "test")


@query("select relation_type, " + ", ".join(f"trunc(avg(raw_score) filter (where split_name = '{x}'))::bigint as {x}" for x in _SPLITS) + " from canonical_interaction group by relation_type")
def pivot_mean(spark, d):
    return R.by_largest(R.pivot_mean(table(spark, d, "canonical_interaction"), "relation_type", "split_name", "raw_score", list(_SPLITS)), "relation_type")


@query(f"select entity_id as value, count(*) as n from entity_manifest where entity_id is not null and not regexp_matches(entity_id, '{_PATTERNS['short_code']}') group by entity_id")
def regex_exceptions(spark, d):
    return R.pattern_exceptions(table(spark, d, "entity_manifest"), "entity_id", _PATTERNS["short_code"])


@query(f"select entity_id, reason from ({_VALID}) where not valid order by entity_id limit 5")
def validation_mismatches(spark, d):
    return R.first_mismatches(_validated(spark, d), F.col("valid"), "entity_id").select("entity_id", "reason")


@query(
    "select 'molecule' as kind, entity_id from (select distinct floor(try_cast(trim(entity_id) as double))::bigint::varchar as entity_id from entity_manifest where structure is null and regexp_matches(entity_type, 'molecule|drug|ligand') and try_cast(trim(entity_id) as double) >= 1)"
    " union all select 'protein', entity_id from (select distinct entity_id from entity_manifest where structure is null and entity_type = 'protein' and entity_id is not null)"
)
def enrichment_mask(spark, d):
    m = table(spark, d, "entity_manifest")
    molecules, proteins = (N.to_enrich(m, k).select(F.lit(k).alias("kind"), "entity_id") for k in ("molecule", "protein"))
    return molecules.unionByName(proteins)


@query("select distinct entity_id from entity_manifest where entity_type in ('drug', 'ligand') and list_has_any(all_sources, ['bindingdb']) union select distinct entity_id from entity_manifest where len(structure) > 40")
def ids_by_selector(spark, d):
    m = table(spark, d, "entity_manifest")
    chosen = N.ids_of(m, Q.EntitySelector(entity_types=("drug", "ligand"), from_sources=("bindingdb",)))
    return chosen.unionByName(N.ids_of(m, F.length("structure") > 40)).distinct()


@query(f"with {MERGED} select {_KEYS} from (select *, row_number() over (order by {_md5('sample', 'source_id', 'target_id', 'relation_type')}) as r, count(*) over () as n from m) where r <= round_even(n * 0.25, 0)")
def sample_fraction(spark, d):
    return S.sample(materialize(merged(spark, d)), fraction=0.25, seed=SEED).select("source_id", "target_id", "relation_type")


#: Stratified where every target has two edges; these tables have targets with one, so the split is plain. A test covers the other branch.
@query(f"with {MERGED} select {_KEYS}, row_number() over (order by {_md5('single', 'source_id', 'target_id', 'relation_type')}) - 1 < ceil(count(*) over () * 0.2) as is_test from m")
def warm_single_split(spark, d):
    return X.warm_single(materialize(merged(spark, d)), 0.2, SEED).select("source_id", "target_id", "relation_type", "is_test")


@query(f"with {_topk('embeddings', 'vec_id', 'embedding', 'label')} select i, j, round(greatest(0, least(1, (cos + 1) / 2)), 6) as scaled from hit")
def scaled_similarity(spark, d):
    return V.top_k(table(spark, d, "embeddings"), 10, "vec_id", "embedding", "label").select("i", "j", F.round(V.scaled(F.col("cos")), 6).alias("scaled"))


@query(
    f"with f as (select authoritative_id as id, {_SAFE} as v from node_features where {_NODE_OK} and list_inner_product({_SAFE}, {_SAFE}) > 0), neg as ({_NEGATIVES})"
    " select source_id as source, target_id as target, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) as cos from neg join f a on source_id = a.id join f b on target_id = b.id"
)
def pair_cosine_negative(spark, d):
    v = table(spark, d, "node_features").where(F.size("features") == 48).where(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)))
    pairs = negative_samples(spark, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return V.pair_cosine(pairs, v, "authoritative_id").withColumn("cos", F.round("cos", 6))


def _sql_bits(c: str, bits: int) -> str:
    return f"list_transform(range(1, len({c}) - 1), lambda i: cast('0x' || substr(md5(substr({c}, i, 3)), 1, 8) as bigint) % {bits})"


@query(
    f"with {MERGED}, fp as (select entity_id, list_distinct({_sql_bits('structure', 2048)}) as b from entity_manifest where structure is not null)"
    " select source_id, target_id, relation_type, round(case when len(list_distinct(list_concat(x.b, y.b))) > 0 then len(list_intersect(x.b, y.b)) / len(list_distinct(list_concat(x.b, y.b))) else 0 end, 6) as tanimoto from m join fp x on x.entity_id = source_id join fp y on y.entity_id = target_id"
)
def tanimoto_structures(spark, d):
    fp = materialize(table(spark, d, "entity_manifest").where("structure is not null").select("entity_id", V.fingerprint(F.col("structure")).alias("b")))
    out = merged(spark, d).join(fp.select(F.col("entity_id").alias("source_id"), F.col("b").alias("x")), "source_id").join(fp.select(F.col("entity_id").alias("target_id"), F.col("b").alias("y")), "target_id")
    return out.select("source_id", "target_id", "relation_type", F.round(V.tanimoto(F.col("x"), F.col("y")), 6).alias("tanimoto"))


@query(
    f"select entity_id, unnest(range(8)) as place, unnest(list_transform(range(8), lambda p: len(list_filter(b, lambda x: x = p)))) as n from (select entity_id, {_sql_bits('structure', 8)} as b from entity_manifest where structure is not null and entity_id is not null)"
)
def extracted_features(spark, d):
    known = Y.Extractors()
    known.register("entity", Y.hashed(8))
    cache = fresh_path(spark)
    m = table(spark, d, "entity_manifest").select("entity_id", "structure")
    known.extract(m.where("structure < 'M'"), "entity", cache)  # a part is cached first, the rest computed then
    out = known.extract(m, "entity", cache)
    return out.select("entity_id", F.posexplode("features").alias("place", "x")).select("entity_id", F.col("place").cast("bigint").alias("place"), F.col("x").cast("bigint").alias("n"))


_LINKS = "lk as (select u, v from pr union all select v, u from pr union all select node, node from dg)"


def _lpa(rounds: int) -> str:
    out, last = "", "(select node, node as community from dg)"
    for i in range(rounds):
        out += f", l{i} as (select u as node, arg_min(community, (-n, community)) as community from (select u, community, count(*) as n from lk join {last} p on p.node = lk.v group by u, community) group by u)"
        last = f"l{i}"
    return out


@query(f"with {_DEGREES}, {_LINKS}{_lpa(5)} select node, community from l4")
def label_communities(spark, d):
    return G.communities(merged(spark, d), 5)


@query(
    f"with {_DEGREES}, {_LINKS}{_lpa(5)}, e2 as (select a.community as cu, b.community as cv from pr join l4 a on a.node = u join l4 b on b.node = v), t as (select count(*) as m, count(*) filter (where cu = cv) as inside from e2),"
    " q as (select sum(k * k) as squares from (select sum(d)::double as k from (select cu as c, count(*) as d from e2 group by cu union all select cv, count(*) from e2 group by cv) group by c)) select round(inside / m - squares / (4.0 * m * m), 9) as modularity from t, q"
)
def community_modularity(spark, d):
    m = materialize(merged(spark, d))
    return R.modularity(m, G.communities(m, 5))


@query(
    f"with {MERGED}, en as (select source_id as entity_id from m union select target_id from m), ids as (select distinct entity_id from entity_manifest where entity_id is not null)"
    " select 'repeated or null ids' as problem, (select count(*) from (select entity_id from entity_manifest group by 1 having count(*) > 1 or entity_id is null)) as n union all select 'ends without entity', (select count(*) from en where entity_id not in (select entity_id from ids))"
    " union all select 'entities without edge', (select count(*) from ids where entity_id not in (select entity_id from en)) union all select 'vectors without entity', (select count(distinct coalesce(authoritative_id, '')) from node_features where authoritative_id is null or authoritative_id not in (select entity_id from ids))"
)
def consistency_audit(spark, d):
    return R.consistency(table(spark, d, "entity_manifest"), merged(spark, d), table(spark, d, "node_features").select(F.col("authoritative_id").alias("entity_id")))


def feature_clusters(spark, d):
    ok = table(spark, d, "node_features").where(F.size("features") == 48).where(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)))
    return V.cluster_labels(ok, 8)


QUERIES["feature_clusters"] = feature_clusters
