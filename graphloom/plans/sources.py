"""Queries of the source adapters: tables are written as the raw files a source would deliver, whole, and read again; the SQL computes the same edges from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.filters import Bounds
from graphloom.plans.core import _PROPS, _num, _plain
from graphloom.plans.general import _ITEMS, _PROTEINS, _list, _text
from graphloom.sources import adapters as A
from graphloom.sources import sinks
from graphloom.storage import fresh_path, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _flat(c):
    """Without what would end a field or a line."""
    return F.regexp_replace(c, r"[\t\r\n]+", " ")


def _ordered(df: DataFrame, *by) -> DataFrame:
    return df.repartitionByRange(by[0]).sortWithinPartitions(*by)


def _write(df: DataFrame, sep: str, **options) -> str:
    path = fresh_path(df.sparkSession)
    df.write.options(sep=sep, header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


def _write_lines(lines: DataFrame, **options) -> str:
    path = fresh_path(lines.sparkSession)
    lines.write.options(**options).text(path)
    return path


def _bindings_file(spark, d, organism=None) -> str:
    b = _ordered(table(spark, d, "bindingdb"), "entry_id")
    c = A.BINDINGS
    roles = {"structure": "molecule_sequence", "molecule": "molecule_id", "organism": "organism", "ki": "ki", "ic50": "ic50", "kd": "kd", "protein": "protein_id", "sequence": "protein_sequence"}
    return _write(b.select(*((organism if organism is not None and r == "organism" else _flat(F.col(x))).alias(c[r]) for r, x in roles.items())), "\t", quote="")


_BIND = f"""bind as (select entry_id, {_plain("nullif(molecule_id, '')")} as source_id, {_plain("nullif(protein_id, '')")} as target_id, molecule_sequence, coalesce({_num('ki')}, {_num('kd')}, {_num('ic50')}) as raw_score
 from bindingdb where organism = 'Homo sapiens' and nullif(protein_id, '') is not null and nullif(molecule_id, '') is not null)"""


def _first(rows: str, source: str, kind: str = "drug", relation: str = "interacts_with") -> str:
    return f"select source_id, '{kind}' as source_type, target_id, 'protein' as target_type, '{relation}' as relation_type, 1 as label, '{source}' as source_dataset, raw_score from (select *, row_number() over (partition by source_id, target_id order by entry_id) as r from ({rows})) where r = 1"


@query(f"with {_BIND} {_first('select * from bind where raw_score <= 10000', 'bindingdb')}")
def source_bindings(spark, d):
    return A.bindings(spark, _bindings_file(spark, d))


@query(f"with {_BIND} {_first('select * from bind where raw_score <= 10000 and 12.5 * length(molecule_sequence) <= 600', 'bindingdb')}")
def source_bounds(spark, d):
    props = table(spark, d, "bindingdb").select(F.col("molecule_sequence").alias("structure")).distinct()
    props = props.select("structure", *(F.expr(f"cast({x} as double)").alias(n) for n, x in _PROPS.items()))
    return A.bindings(spark, _bindings_file(spark, d), properties=props, bounds=Bounds(mw_max=600))


@query("select count(*) as lines, count(*) filter (where organism is null) as bad from bindingdb")
def source_rejected(spark, d):
    long = F.coalesce(_flat(F.col("organism")), F.lit("un\tknown"))
    return A.rejected(spark, _bindings_file(spark, d, long)).agg(F.sum("lines").alias("lines"), F.sum("bad").alias("bad"))


_DECIMAL = "regexp_full_match(trim(ki), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"


@query(
    f"""with rows as (select entry_id, {_plain("molecule_id || '0'")} as source_id, {_plain("string_split(protein_id, '|')[1]")} as target_id, case when entry_id % 2 = 0 then 'endogenous_ligand' else 'exogenous_ligand' end as source_type,
 case when {_DECIMAL} then trim(ki)::double end as raw_score from bindingdb where nullif(molecule_id, '') is not null and protein_id is not null)
 select source_id, source_type, target_id, 'protein' as target_type, 'interacts_with' as relation_type, 1 as label, 'gtopdb' as source_dataset, raw_score from (select *, row_number() over (partition by source_id, target_id order by entry_id) as r from rows where raw_score <= 10000) where r = 1"""
)
def source_pharmacology(spark, d):
    b, c = table(spark, d, "bindingdb"), A.PHARMACOLOGY
    endo = F.when(F.col("ki").isNull(), "# not measured").when(F.col("entry_id") % 2 == 0, "true").otherwise("false")  # lines that begin with # are comments
    inter = _ordered(b, "entry_id").select(endo.alias(c["endogenous"]), F.concat(_flat(F.col("protein_id")), F.lit("|X1")).alias(c["protein"]), _flat(F.col("molecule_id")).alias(c["ligand"]), _flat(F.col("ki")).alias(c["affinity"]))
    lig = b.groupBy("molecule_id").agg(F.min("molecule_sequence").alias("s")).select(_flat(F.col("molecule_id")).alias(c["ligand"]), _flat(F.col("s")).alias(c["structure"]), F.concat(_flat(F.col("molecule_id")), F.lit("0")).alias(c["molecule"]))
    return A.pharmacology(spark, _write(inter, ","), _write(lig, ","))


def _links_files(spark, d, sep: str) -> tuple[str, str]:
    c = A.LINKS
    end = lambda x: F.concat(F.lit("9606."), F.trim(_flat(F.col(x))))
    rows = _ordered(table(spark, d, "canonical_interaction").where("relation_type = 'physical_association'"), "interaction_id")
    links = rows.select(end("source_id").alias(c["a"]), end("target_id").alias(c["b"]), F.col("raw_score").cast("string").alias(c["score"]))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(s).alias("s")) for i, (p, s) in enumerate((("z", "Ensembl"), ("b", "BLAST_UniProt_AC"), ("a", "BLAST_UniProt_AC")))))).alias("x")
    alias = _ordered(table(spark, d, "entity_manifest").select("entity_id", each), "entity_id", "x.i")
    alias = alias.select(F.concat(F.lit("9606."), "entity_id").alias(c["network_id"]), F.concat("x.p", F.lit("_"), "entity_id").alias("alias"), F.col("x.s").alias("source"))
    return _write(links, sep, compression="gzip"), _write(alias, "\t", compression="gzip")


_LINK = """link as (select interaction_id as entry_id, 'b_' || a.entity_id as source_id, 'b_' || b.entity_id as target_id, raw_score from canonical_interaction join entity_manifest a on a.entity_id = trim(source_id) join entity_manifest b on b.entity_id = trim(target_id)
 where relation_type = 'physical_association')"""


@query(f"with {_LINK} {_first('select * from link', 'stringdb', 'protein', 'physical_association')}")
def source_links(spark, d):
    return A.links(spark, *_links_files(spark, d, "\t"))


@query(f"with {_BIND}, {_LINK} select source_dataset, count(*) as n, count(raw_score) as n_scored from ({_first('select * from bind where raw_score <= 500', 'bindingdb')} union all {_first('select * from link', 'stringdb', 'protein', 'physical_association')}) group by source_dataset")
def source_registry(spark, d):
    links, aliases = _links_files(spark, d, "\t")
    settings = {"bindingdb": {"path": _bindings_file(spark, d), "threshold": 500.0}, "stringdb": {"links": links, "aliases": aliases}}
    cache = fresh_path(spark)
    A.SOURCES.read(spark, settings, cache)
    return A.SOURCES.read(spark, settings, cache).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.count("raw_score").alias("n_scored"))


def _reference_names(spark, d) -> DataFrame:
    """Names of the reference list, with their place: the largest cid first."""
    ref = table(spark, d, "ref_ligand")
    names = F.posexplode(F.concat(F.array("ligand_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("i", "name")
    return ref.select("cid", names).where("name is not null").select("cid", F.struct((-F.col("cid")).alias("c"), "i").alias("place"), "name")


_NAMES = "names as (select lower(trim(x)) as name, max(cid) as cid from (select cid, unnest(list_concat([ligand_name], coalesce(synonyms, []))) as x from ref_ligand) where trim(x) <> '' and cid is not null group by 1)"


@query(f"with {_NAMES} select name, cid from names")
def source_synonyms(spark, d):
    rows = _ordered(_reference_names(spark, d), "place").select(F.concat_ws("\t", F.col("cid").cast("string"), _flat(F.col("name"))))
    return A.synonym_dictionary(spark, _write_lines(rows, compression="gzip"))


@query("select distinct trim(entity_id) as entity_id from entity_manifest where structure is not null and list_contains(all_sources, 'bindingdb')")
def source_whitelist(spark, d):
    m = table(spark, d, "entity_manifest")
    rows = m.select(F.col("entity_id").alias("Entry"), F.when(F.col("structure").isNotNull(), "reviewed").otherwise("unreviewed").alias("Reviewed"), F.when(F.array_contains("all_sources", "bindingdb"), "9606").otherwise("10090").alias("Organism (ID)"))
    return A.whitelist(spark, _write(rows, "\t"))


_NUMBER = "-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE]-?[0-9]+)?"
_VALUE = f"'^\\s*({_NUMBER})\\s*\\{{([^}}]*)\\}}'"


@query(
    f"""with {_ITEMS}, {_PROTEINS}, {_NAMES}, vals as (select entry_id, field_name, item, {_text("json_extract(item, '$.value')")} as v from items where json_type(item) = 'OBJECT' and field_name in ({", ".join(repr(f) for f in A.ENZYME_FIELDS)})),
 named as (select *, case when field_name like '%value%' then nullif(regexp_extract(v, {_VALUE}, 1), '')::double end as raw_score,
 case when field_name like '%value%' then regexp_extract(v, {_VALUE}, 2) when field_name like '%inhibitor%' and regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '?' then v end as typed from vals),
 clean as (select *, trim(string_split(regexp_replace(lower(regexp_replace(typed, '^\\s+|\\s+$', '', 'g')), '\\(.*?\\)', '', 'g'), ';')[1]) as name from named),
 refs as (select entry_id, field_name, raw_score, name, {_text('r')} as key from (select *, unnest({_list("json_extract(item, '$.proteins')")}) as r from clean)),
 acc as (select entry_id, k as key, case when json_type(x) = 'OBJECT' then {_text("json_extract(x, '$.id')")} else {_text('x')} end as accession from (select entry_id, k, unnest({_list("json_extract(o, '$.accessions')")}) as x from prot
 where lower(case when json_type(json_extract(o, '$.organism')) = 'OBJECT' then json_extract_string(o, '$.organism.name') else {_text("json_extract(o, '$.organism')")} end) like '%homo sapiens%'))
 select n.cid::varchar as source_id, 'ligand' as source_type, {_plain('accession')} as target_id, 'protein' as target_type, field_name as relation_type, 1 as label, 'brenda' as source_dataset, min(raw_score) as raw_score
 from refs join acc using (entry_id, key) join names n using (name) where accession is not null and (field_name <> 'ki_value' or raw_score <= 1) group by n.cid, {_plain('accession')}, field_name"""
)
def source_enzymes(spark, d):
    lines = _write_lines(table(spark, d, "brenda").select(F.regexp_replace("record_json", r"[\r\n]+", " ")).where("record_json is not null"))
    names = A.dictionary(_reference_names(spark, d), "place")
    return A.enzymes(spark, lines, names, {"ki_value": 1.0}, lines=True)


@query("select 'vectors' as model, count(*) as n_rows, 48 as dim, sum(len(features)) as numbers from node_features where len(features) = 48")
def source_features(spark, d):
    path = fresh_path(spark)
    v = table(spark, d, "node_features").where(F.size("features") == 48)
    sinks.write_features(v, path, "vectors")
    back = sinks.load_features(spark, path, "vectors", dim=48)
    meta = spark.read.parquet(f"{path}.meta")
    return meta.crossJoin(F.broadcast(back.agg(F.sum(F.size("features")).alias("numbers"))))  # one row each
