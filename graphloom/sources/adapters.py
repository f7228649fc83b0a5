"""Readers of raw sources, each a pure function to the canonical edge table; explicit schemas, pushed-down filters, no inference."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import clean_name, first_part, kinetic_name, kinetic_number, plain_id
from graphloom.operators.enzymes import columns, table_of
from graphloom.operators.filters import Bounds, affinities, at_most, by_relation, static_filter
from graphloom.operators.graph import first_per_key
from graphloom.schema import EDGES, KEYS
from graphloom.sources.sinks import exists, write_edges


@dataclass(frozen=True)
class Columns:
    """Names of a source's raw columns, by role."""

    names: dict[str, str]

    def __getitem__(self, role: str) -> str:
        return self.names[role]


#: Column names of the public exports.
BINDINGS = Columns(
    {
        "structure": "Ligand SMILES",
        "molecule": "PubChem CID",
        "organism": "Target Source Organism According to Curator or DataSource",
        "ki": "Ki (nM)",
        "ic50": "IC50 (nM)",
        "kd": "Kd (nM)",
        "protein": "UniProt (SwissProt) Primary ID of Target Chain 1",
        "sequence": "BindingDB Target Chain Sequence 1",
    }
)
PHARMACOLOGY = Columns({"endogenous": "Endogenous", "protein": "Target UniProt ID", "ligand": "Ligand ID", "affinity": "Original Affinity Median nm", "structure": "SMILES", "molecule": "PubChem CID"})
LINKS = Columns({"a": "protein1", "b": "protein2", "score": "combined_score", "network_id": "#string_protein_id", "alias": "alias", "source": "source"})


#: The place of a row: its file, its split of the file, its number within the split. Rows of one key are kept by it, the first first.
LINE = "_line"


def _line() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("no")).alias(LINE)


def _text(spark: SparkSession, path: str, names: list[str], **options) -> DataFrame:
    """A delimited file by header: only the named columns are parsed, all as text, and the place of each row. Names with no column in the file raise an error.

    Lines that do not fit are kept with null columns; `rejected` counts them.
    """
    head = spark.read.options(header=True, mode="PERMISSIVE", **options).csv(path)
    if missing := [n for n in names if n not in head.columns]:
        raise ValueError(f"{path} has no columns {missing}")
    return head.select(*(F.col(f"`{n}`") for n in names), _line())


def rejected(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """`file`, `lines`, `bad`: lines of each delimited file without quotes (header, blank and comment lines left out), and those with more or fewer fields than the header."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), _line()).where(F.trim("value") != "")
    rows = rows.where(~F.col("value").startswith(comment)) if comment else rows
    rows = rows.select("file", LINE, F.size(F.split("value", sep.replace("|", r"\|"), -1)).alias("n"))
    head = rows.groupBy("file").agg(F.min(F.struct(LINE, "n")).getField("n").alias("want"))
    return rows.join(head, "file").groupBy("file").agg((F.count(F.lit(1)) - 1).alias("lines"), F.count(F.when(F.col("n") != F.col("want"), 1)).alias("bad"))


def finished(rows: DataFrame, dataset: str) -> DataFrame:
    """The canonical columns of one source: defaults, plain ids, one row a key: the first by place in its file (column LINE, if there is one), then by all columns."""
    have = set(rows.columns)
    cols = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in EDGES}
    cols |= {"source_id": plain_id(cols["source_id"]), "target_id": plain_id(cols["target_id"]), "label": F.coalesce(cols["label"], F.lit(1)), "source_dataset": F.lit(dataset)}
    order = (LINE,) if LINE in have else ()
    out = rows.select(*(c.alias(n) for n, c in cols.items()), *order)
    return first_per_key(out, KEYS, (*order, "raw_score", "source_type", "target_type")).select(*EDGES.names)


def bounded(rows: DataFrame, structure: str, properties: DataFrame | None, bounds: Bounds | None) -> DataFrame:
    """Rows whose structure has properties (column structure, MW, ...) within a source's own bounds; without properties or bounds all rows. A structure without properties fails."""
    if properties is None or bounds is None:
        return rows
    fine = properties.where("MW is not null and LogP is not null").where(static_filter(bounds)).select(F.col("structure").alias("_fine")).distinct()
    return rows.join(fine, F.col(structure) == F.col("_fine"), "left_semi")


def bindings(spark: SparkSession, path: str, c: Columns = BINDINGS, threshold: float | None = 10_000.0, organism: str = "Homo sapiens", properties: DataFrame | None = None, bounds: Bounds | None = None) -> DataFrame:
    """Tab-separated affinities: drug to protein, the first of Ki, Kd, IC50 that is a number, up to the threshold; one organism, both ids present; structures within bounds, where given."""
    raw = _text(spark, path, list(c.names.values()), sep="\t", quote="")
    rows = raw.where((F.col(f"`{c['organism']}`") == organism) & F.col(f"`{c['protein']}`").isNotNull() & F.col(f"`{c['molecule']}`").isNotNull())
    rows = bounded(rows.select(*(F.col(f"`{c[r]}`").alias(r) for r in ("structure", "molecule", "protein", "ki", "kd", "ic50")), LINE), "structure", properties, bounds)
    return finished(binding_edges(rows, threshold), "bindingdb")


def binding_edges(rows: DataFrame, threshold: float | None = 10_000.0) -> DataFrame:
    """Edges of rows with `molecule`, `protein`, `ki`, `kd`, `ic50`."""
    scored = affinities(rows)
    scored = scored if threshold is None else at_most(scored, threshold)
    return scored.select(F.col("molecule").alias("source_id"), F.lit("drug").alias("source_type"), F.col("protein").alias("target_id"), F.lit("protein").alias("target_type"), F.lit("interacts_with").alias("relation_type"), "raw_score", *(x for x in rows.columns if x == LINE))


def pharmacology(spark: SparkSession, interactions: str, ligands: str, c: Columns = PHARMACOLOGY, threshold: float = 10_000.0, properties: DataFrame | None = None, bounds: Bounds | None = None) -> DataFrame:
    """Two comma-separated files joined on the ligand id: exogenous or endogenous ligand to the first protein named.

    Lines that begin with `#` are comments; a `#` within a line is data (a triple bond of a structure).
    """
    inter = _text(spark, interactions, [c["endogenous"], c["protein"], c["ligand"], c["affinity"]], comment="#")
    lig = bounded(_text(spark, ligands, [c["ligand"], c["molecule"], c["structure"]], comment="#"), c["structure"], properties, bounds)
    inter = inter.select(F.col(f"`{c['endogenous']}`").alias("endo"), F.col(f"`{c['protein']}`").alias("protein"), F.col(f"`{c['ligand']}`").alias("ligand"), F.col(f"`{c['affinity']}`").try_cast("double").alias("raw_score"), LINE)
    lig = lig.select(F.col(f"`{c['ligand']}`").alias("ligand"), F.col(f"`{c['molecule']}`").alias("molecule")).where("ligand is not null and molecule is not null")
    endo = F.lower(F.trim("endo")).isin("yes", "true", "t", "1")
    rows = at_most(inter.where("protein is not null").join(lig, "ligand"), threshold)
    rows = rows.select(F.col("molecule").alias("source_id"), F.when(endo, "endogenous_ligand").otherwise("exogenous_ligand").alias("source_type"), first_part(F.col("protein")).alias("target_id"), F.lit("protein").alias("target_type"), F.lit("interacts_with").alias("relation_type"), "raw_score", LINE)
    return finished(rows, "gtopdb")


#: Fields of an enzyme entry that are read.
ENZYME_FIELDS = ("inhibitor", "ki_value", "ic50_value", "km_value", "turnover_number")


def top_entries(stream: TextIO, name: str = "data", step: int = 1 << 20) -> Iterator[tuple[str, str]]:
    """(key, JSON text) of each entry of the object `name` of a JSON document `{..., name: {key: entry, ...}, ...}`; no more of it is held than an entry and a step."""
    decoder, buffer, at, ended = json.JSONDecoder(), "", 0, False

    def more() -> None:
        nonlocal buffer, at, ended
        part = stream.read(max(step, len(buffer) - at))
        ended = not part
        buffer, at = buffer[at:] + part, 0

    def token() -> str:
        nonlocal at
        while True:
            while at < len(buffer) and buffer[at] in " \t\r\n\ufeff":
                at += 1
            if at < len(buffer):
                return buffer[at]
            if ended:
                raise ValueError("the document ends too early")
            more()

    def value() -> tuple[object, str]:
        nonlocal at
        token()
        while True:
            try:
                out, end = decoder.raw_decode(buffer, at)
                if end < len(buffer) or ended:
                    break
            except json.JSONDecodeError:
                if ended:
                    raise
            more()
        text, at = buffer[at:end], end
        return out, text

    def skip(char: str) -> None:
        nonlocal at
        if token() != char:
            raise ValueError(f"{char} expected, {token()} found")
        at += 1

    def members() -> Iterator[str]:
        nonlocal at
        skip("{")
        if token() == "}":
            at += 1
            return
        while True:
            key = value()[0]
            skip(":")
            yield key
            if token() != ",":
                return skip("}")
            at += 1

    for key in members():
        if key == name and token() == "{":
            for entry in members():
                yield entry, value()[1]
        else:
            value()


def enzyme_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """`entry_id`, `record_json` of each entry: of files with one entry a line, or of documents whose object `data` has an entry under each key.

    A document can't be split, so it is read by one task, but as a stream, and its entries are dealt out before they are parsed.
    """
    if lines:
        return spark.read.text(path).select(_line(), "value").where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("entry_id"), F.col("value").alias("record_json"))
    files = spark.read.format("binaryFile").load(path).select("path", "length").repartition("path")  # the content is not read here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs

        for batch in batches:
            for at in batch.column("path").to_pylist():
                system, name = fs.FileSystem.from_uri(at if "://" in at or not at.startswith("file:") else "file://" + at[5:])
                with system.open_input_stream(name) as f, io.TextIOWrapper(f, "utf-8") as text:
                    some = []
                    for _, entry in top_entries(text):
                        some.append(entry)
                        if sum(map(len, some)) > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["record_json"])
                            some = []
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["record_json"])

    entries = files.mapInArrow(run, "record_json string").select(F.monotonically_increasing_id().alias("entry_id"), "record_json")
    return entries.repartition("entry_id")


def resolved_names(rows: DataFrame, names: DataFrame, name: str = "clean") -> DataFrame:
    """Adds `cid` to rows with a cleaned name by a dictionary (name, cid); names it lacks drop out."""
    return rows.join(names.select(F.col("name").alias("_name"), "cid"), F.col(name) == F.col("_name")).drop("_name")


def enzymes(spark: SparkSession, path: str, names: DataFrame, thresholds: dict[str, float] | None = None, organism: str = "homo sapiens", lines: bool = False) -> DataFrame:
    """Nested enzyme entries: ligand to protein by field. Names become ids by the dictionary `names` (name, cid); names it lacks drop out.

    Only accessions of proteins of the organism count. Thresholds go by relation. Entries are shredded into columns once, and the tables joined by entry.
    """
    return enzyme_edges(enzyme_entries(spark, path, lines), names, thresholds, organism)


def enzyme_edges(entries: DataFrame, names: DataFrame, thresholds: dict[str, float] | None = None, organism: str = "homo sapiens") -> DataFrame:
    store = columns(entries)
    own = table_of(store, "proteins").where(F.contains(F.lower("organism"), F.lit(organism))).select("entry_id", "protein_no")
    accessions = table_of(store, "accessions").join(own, ["entry_id", "protein_no"], "left_semi").select("entry_id", F.col("protein_key").alias("key"), F.col("accession").alias("target_id")).where("target_id is not null")
    items = table_of(store, "items").where(F.col("field_name").isin(*ENZYME_FIELDS))
    named = items.select("entry_id", "field_no", "item_no", "field_name", kinetic_number(F.col("value")).alias("raw_score"), clean_name(kinetic_name(F.col("field_name"), F.col("value"))).alias("clean")).where("clean <> ''")
    refs = table_of(store, "item_proteins").select("entry_id", "field_no", "item_no", F.col("protein_key").alias("key"))
    rows = named.join(refs, ["entry_id", "field_no", "item_no"]).join(accessions, ["entry_id", "key"])
    found = resolved_names(rows.select(F.col("field_name").alias("relation_type"), "raw_score", "clean", "target_id").distinct(), names)
    found = found.select(F.col("cid").cast("string").alias("source_id"), F.lit("ligand").alias("source_type"), "target_id", F.lit("protein").alias("target_type"), "relation_type", "raw_score")
    return finished(by_relation(found, thresholds or {}), "brenda")


def first_alias(aliases: DataFrame, order: str = LINE) -> DataFrame:
    """`network_id`, `alias`: the first alias of each id by the column `order`, of rows whose source names UniProt accessions."""
    rows = aliases.where(F.col("source").contains("UniProt_AC")).where("network_id is not null and alias is not null")
    return rows.groupBy("network_id").agg(F.min(F.struct(F.col(order).alias("o"), "alias")).getField("alias").alias("alias"))


def separator(spark: SparkSession, path: str) -> str:
    """A tab if the first line of a file has one, else a space."""
    first = spark.read.text(path).first()
    return "\t" if first and "\t" in first[0] else " "


def links(spark: SparkSession, link_path: str, alias_path: str, c: Columns = LINKS, sep: str | None = None) -> DataFrame:
    """Gzip files of protein links and aliases: protein to protein with a combined score; ends without alias drop out. Gzip can't be split, so rows are dealt out again.

    Links are separated by tabs or by spaces, which the first line tells unless `sep` is given.
    """
    raw = _text(spark, link_path, [c["a"], c["b"], c["score"]], sep=sep or separator(spark, link_path)).repartition(F.col(c["a"]))
    alias = _text(spark, alias_path, [c["network_id"], c["alias"], c["source"]], sep="\t")
    alias = first_alias(alias.select(F.col(f"`{c['network_id']}`").alias("network_id"), "alias", "source", LINE))
    out = raw.join(alias.select(F.col("network_id").alias(c["a"]), F.col("alias").alias("source_id")), c["a"]).join(alias.select(F.col("network_id").alias(c["b"]), F.col("alias").alias("target_id")), c["b"])
    out = out.select("source_id", F.lit("protein").alias("source_type"), "target_id", F.lit("protein").alias("target_type"), F.lit("physical_association").alias("relation_type"), F.col(c["score"]).try_cast("double").alias("raw_score"), LINE)
    return finished(out, "stringdb")


def dictionary(rows: DataFrame, order: str = LINE) -> DataFrame:
    """`name` (lower case, trimmed), `cid`: the first id of each name by the column `order`; rows (name, cid) without either drop out."""
    rows = rows.select(F.lower(F.trim("name")).alias("name"), "cid", F.col(order).alias("o")).where("cid is not null and name is not null and name <> ''")
    return rows.groupBy("name").agg(F.min(F.struct("o", "cid")).getField("cid").alias("cid"))


def synonym_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`name` (lower case), `cid` from lines `cid<tab>name`, gzip or plain: the first id of a name by line; malformed lines drop out."""
    parts = F.split("value", "\t", 2)
    return dictionary(spark.read.text(path).select(parts[0].try_cast("bigint").alias("cid"), F.get(parts, F.lit(1)).alias("name"), _line()))


def whitelist(spark: SparkSession, path: str, organism: str = "9606") -> DataFrame:
    """`entity_id` of reviewed proteins of one organism from a tab-separated export."""
    rows = _text(spark, path, ["Entry", "Reviewed", "Organism (ID)"], sep="\t")
    return rows.where((F.col("Reviewed") == "reviewed") & (F.trim("`Organism (ID)`") == organism)).select(F.trim("Entry").alias("entity_id")).where("entity_id is not null").distinct()


@dataclass
class Registry:
    """Sources by name: functions of (spark, settings) to edge tables."""

    adapters: dict[str, Callable[[SparkSession, dict], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, adapter: Callable[[SparkSession, dict], DataFrame]) -> None:
        if name in self.adapters:
            raise ValueError(f"{name} is registered already")
        self.adapters[name] = adapter

    def read(self, spark: SparkSession, settings: dict[str, dict], cache: str | None = None) -> DataFrame:
        """All configured sources, one below the other; with a cache folder each is read once for the same settings and kept there."""
        if unknown := set(settings) - set(self.adapters):
            raise ValueError(f"no such sources: {sorted(unknown)}")
        out = None
        for name, s in settings.items():
            part = self.adapters[name](spark, s) if cache is None else self.cached(spark, name, s, cache)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], EDGES)

    def cached(self, spark: SparkSession, name: str, settings: dict, folder: str, force: bool = False) -> DataFrame:
        """A source from the table that the same settings gave before, read anew where there is none; settings that are tables count by their columns only."""
        told = json.dumps({k: v.columns if isinstance(v, DataFrame) else v for k, v in settings.items()}, sort_keys=True, default=str)
        path = f"{folder}/{name}-{hashlib.md5(told.encode()).hexdigest()[:16]}"
        if force or not exists(spark, f"{path}/_SUCCESS"):
            write_edges(self.adapters[name](spark, settings), path)
        return spark.read.schema(EDGES).parquet(path)


def _given(settings: dict, *names: str) -> dict:
    return {n: settings[n] for n in names if n in settings}


SOURCES = Registry()
SOURCES.register("bindingdb", lambda spark, s: bindings(spark, s["path"], **_given(s, "threshold", "organism", "properties", "bounds")))
SOURCES.register("gtopdb", lambda spark, s: pharmacology(spark, s["interactions"], s["ligands"], **_given(s, "threshold", "properties", "bounds")))
SOURCES.register("brenda", lambda spark, s: enzymes(spark, s["path"], s["names"], **_given(s, "thresholds", "organism", "lines")))
SOURCES.register("stringdb", lambda spark, s: links(spark, s["links"], s["aliases"], **_given(s, "sep")))
