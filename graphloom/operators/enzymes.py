"""Flat tables of enzyme entries, and the links between their ligand items and protein accessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.shred import ENZYMES, rebuild, shredded
from graphloom.storage import materialize


def columns(brenda: DataFrame) -> DataFrame:
    """The shredded columns of record_json, written once for all tables built from them. Other columns are not read."""
    return materialize(shredded(brenda, ENZYMES, "entry_id", "record_json"))


def table_of(store: DataFrame, name: str) -> DataFrame:
    """A table of ENZYMES; every row has entry_id and the places of its parents."""
    return rebuild(store, ENZYMES, name, "entry_id")


def _key(name: str):
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def accessions(store: DataFrame) -> DataFrame:
    """`entry_id`, `protein_key`, `accession` of proteins and of subunits, each once; null and blank accessions and keys are left out."""
    whole = table_of(store, "accessions").select("entry_id", _key("protein_key").alias("protein_key"), _key("accession").alias("accession"))
    parts = table_of(store, "subunit_accessions").select("entry_id", _key("subunit_key").alias("protein_key"), _key("accession").alias("accession"))
    return whole.unionByName(parts).where("protein_key is not null and accession is not null").distinct()


def linked(store: DataFrame) -> DataFrame:
    """`entry_id`, `field_name`, `item_no`, `protein_key`, `accession`: each accession of each protein or subunit a ligand item refers to.

    References that lead nowhere give no row; repeated references and accessions give one.
    """
    refs = table_of(store, "item_proteins").select("entry_id", "field_name", "item_no", _key("protein_key").alias("protein_key")).where("protein_key is not null").distinct()
    return refs.join(accessions(store), ["entry_id", "protein_key"]).select("entry_id", "field_name", "item_no", "protein_key", "accession")


def found(brenda: DataFrame) -> DataFrame:
    return linked(columns(brenda))


def ligand_items(brenda: DataFrame) -> DataFrame:
    """`entry_id`, `field_name`, `item_no`, `value`, `comment`, `ph` of every place in a ligand field; null where the place holds no object."""
    return table_of(columns(brenda), "items").drop("field_no")


def proteins(brenda: DataFrame) -> DataFrame:
    """`entry_id`, `protein_no`, `protein_key`, `organism`, `taxon`, `source` of every protein."""
    return table_of(columns(brenda), "proteins")
